"""Families, splits and labels from files."""

import json

import pytest
from helpers import rows

from tidemark.plans import event_study, spec_files

FAMILY = {"name": "Retail sales m/m", "group": "SALES", "frequency": "monthly", "publisher": "Census", "expected_release_times_et": ["08:30", "10:00"], "relative_surprise": True}


def test_spec(spark, tmp_path):
    told = {"families": {"RETAIL": FAMILY, "RATE": FAMILY | {"group": "FOMC", "weak_surprise_proxy": True}}, "policy_family": "RATE", "research_end": "2024-12-31", "splits": {"early": ["2020-01-01", "2021-12-31"], "late": ["2022-01-01", "2022-12-31"]}, "baseline_horizons": [1, 5]}
    (tmp_path / "s.json").write_text(json.dumps(told))
    spec = spec_files.load_spec(spark, f"{tmp_path}/s.json")
    assert spec.families["RETAIL"] == event_study.Family("Retail sales m/m", "SALES", "monthly", "Census", ("08:30", "10:00"), True) and spec.families["RATE"].weak_proxy and spec.baseline_horizons == (1, 5) and spec.min_history == 12
    assert {r["event_family"] for r in rows(event_study.family_frame(spark, spec))} == {"RETAIL", "RATE"}
    assert spec_files.spec_of({}) == event_study.StudySpec()
    for bad in (
        {"family": {}}, told | {"policy_family": "NONE"}, told | {"splits": {"a": ["2020-01-01", "2021-01-01"], "b": ["2021-01-01", "2022-01-01"]}}, told | {"families": {"RATE": FAMILY | {"expected_release_times_et": ["8:30"]}}}, told | {"families": {"RATE": FAMILY | {"colour": 1}}},
        told | {"families": {"RATE": {k: v for k, v in FAMILY.items() if k != "group"}}},
    ):
        with pytest.raises(spec_files.SpecError):
            spec_files.spec_of(bad)


def test_labels(spark, tmp_path):
    told = {"RETAIL": {"indicator": "Retail Sales m/m", "release_bundle": "SALES", "names": ["Retail  sales M/M", "Headline retail"], "value_unit": "PERCENT"}, "NFP": {"indicator": "Payrolls", "unit_rule": {"unit": "JOB", "multiplier": "THOUSANDS"}}}
    (tmp_path / "m.json").write_text(json.dumps(told))
    got = rows(spec_files.load_labels(spark, f"{tmp_path}/m.json"), "label_key")
    assert [(r["label_key"], r["event_family"], r["rule_unit"]) for r in got] == [("headline retail", "RETAIL", None), ("payrolls", "NFP", "JOB"), ("retail sales m/m", "RETAIL", None)]
    assert got[0].keys() == rows(event_study.label_frame(spark))[0].keys()
    for bad in ({"A": {"names": ["x"]}}, {"A": {"indicator": "x"}, "B": {"indicator": "y", "names": ["X "]}}, {"A": {"indicator": "x", "value_unit": "ELLS"}}, {"A": {"indicator": "x", "colour": 1}}):
        with pytest.raises(spec_files.SpecError):
            spec_files.labels_of(bad)
