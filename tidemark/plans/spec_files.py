"""The study's families and the calendars' labels from files: JSON, or YAML where its library is installed. What a file says is checked whole before anything runs."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..schema import UNITS
from .event_study import SPLITS, Family, StudySpec

#: Keys of a family, of the file, and of a label's entry.
FAMILY_KEYS = {"name": "name", "group": "group", "frequency": "frequency", "publisher": "publisher", "expected_release_times_et": "times", "relative_surprise": "relative", "weak_surprise_proxy": "weak_proxy"}
SPEC_KEYS = ("families", "splits", "research_end", "min_history", "tolerance", "baseline_horizons", "baseline_min", "policy_family")
ENTRY_KEYS = ("indicator", "release_bundle", "names", "value_unit", "unit_rule")
_CLOCK = re.compile(r"([01]\d|2[0-3]):[0-5]\d")


class SpecError(ValueError):
    pass


def read_file(spark: SparkSession, path: str) -> dict[str, Any]:
    """A small file from any of Spark's file systems."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise SpecError(f"{path} is no table of keys")
    return found


def _only(told: dict, allowed, where: str) -> None:  # noqa: ANN001
    if extra := sorted(set(told) - set(allowed)):
        raise SpecError(f"{where}: unknown keys {extra}")


def family_of(key: str, told: dict[str, Any]) -> Family:
    _only(told, FAMILY_KEYS, key)
    lacking = [k for k in ("name", "group", "frequency", "publisher") if not str(told.get(k) or "").strip()]
    if lacking:
        raise SpecError(f"{key}: {lacking} are missing")
    made = {FAMILY_KEYS[k]: v for k, v in told.items()}
    if "times" in made:
        made["times"] = tuple(made["times"])
        if not made["times"] or any(not _CLOCK.fullmatch(str(t)) for t in made["times"]):
            raise SpecError(f"{key}: release times are HH:MM")
    return Family(**made)


def spec_of(told: dict[str, Any]) -> StudySpec:
    """A study's parameters; what isn't told keeps its default. Splits are in order and apart, and the policy family is one of the families."""
    _only(told, SPEC_KEYS, "the study")
    made = {k: v for k, v in told.items() if k not in ("families", "splits", "baseline_horizons")}
    if "families" in told:
        made["families"] = {k: family_of(k, v) for k, v in told["families"].items()}
    if "baseline_horizons" in told:
        made["baseline_horizons"] = tuple(int(h) for h in told["baseline_horizons"])
    splits = {k: (str(a), str(z)) for k, (a, z) in told.get("splits", SPLITS).items()}
    last = None
    for name, (a, z) in splits.items():
        first, end = dt.date.fromisoformat(a), dt.date.fromisoformat(z)
        if first > end or last is not None and first <= last:
            raise SpecError(f"the split {name} doesn't follow the one before it")
        last = end
    spec = StudySpec(**made, splits=splits)
    if spec.policy_family not in spec.families:
        raise SpecError(f"the policy family {spec.policy_family} is none of the families")
    assert {f.name for f in fields(StudySpec)} >= set(SPEC_KEYS)
    return spec


def normal_label(name: str) -> str:
    return " ".join(name.strip().lower().split())


def labels_of(told: dict[str, Any]) -> list[tuple]:
    """(label_key, event_family, indicator, release_bundle, value_unit, rule_unit, rule_multiplier) of all names; a name stands for one family only."""
    rows: dict[str, tuple] = {}
    for family, entry in told.items():
        _only(entry, ENTRY_KEYS, family)
        if not entry.get("indicator"):
            raise SpecError(f"{family}: no indicator")
        if entry.get("value_unit") not in (None, *UNITS):
            raise SpecError(f"{family}: unit {entry['value_unit']}")
        rule = entry.get("unit_rule") or {}
        _only(rule, ("unit", "multiplier"), family)
        for name in [entry["indicator"], *entry.get("names", [])]:
            key = normal_label(name)
            row = (key, family, entry["indicator"], entry.get("release_bundle"), entry.get("value_unit"), rule.get("unit"), rule.get("multiplier"))
            if rows.get(key, row) != row:
                raise SpecError(f"{name!r} stands for {rows[key][1]} and {family}")
            rows[key] = row
    return list(rows.values())


def load_spec(spark: SparkSession, path: str) -> StudySpec:
    return spec_of(read_file(spark, path))


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """The mapping of calendar labels, as `label_frame` gives it for the built-in ones."""
    return spark.createDataFrame(labels_of(read_file(spark, path)), "label_key string, event_family string, indicator string, release_bundle string, value_unit string, rule_unit string, rule_multiplier string")
