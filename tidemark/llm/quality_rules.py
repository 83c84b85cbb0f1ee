"""Quality rules over texts as a short-circuit cascade whose order is estimated on a sample.

A rule is a measure of a text and a test of it; a text is kept if no rule rejects it. The verdict is the same in any order, the cost is not:

1. A bounded sample (SAMPLE_ROWS rows; only figures come to the driver) runs each measure by itself: its seconds, those of the words or lines it needs, and whom its rules reject.
2. The order is greedy: next comes the rule that rejects most of the sample's texts not yet rejected, for each second it adds. Words and lines that an
   earlier rule needs are paid for already, and so are measures that the caller asks for anyway. Rules that reject nobody in the sample come last, cheapest first.
3. Over the table each rule sees only those texts of a batch that all earlier rules have passed; words, lines and measures are made for the texts that need them.

Seconds vary from run to run, so the order may; no result but `rejected_by` (the first rule in the order taken) depends on it, and `order` fixes it.

Null texts count as empty: no words, all counts 0. Texts are read whole; repeated rows and null ids are rows like others; an empty table has no sample and takes the
rules as they are given. Other columns of the input are ignored, so none can clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_arrays import Words, repeated_windows, slices, words_of

#: Most rows whose figures the order is estimated from, and the share of the first rows that are taken for it.
SAMPLE_ROWS, SAMPLE_SHARE, SEED = 2_000, 0.1, 7

#: Words in a window that counts as repeated, and the characters that count as symbols: fixed values.
WINDOW, SYMBOLS = 8, "[#*$%&|<>]"


class Texts:
    """A slice of texts. Words and lines are made once for the texts that are left when they are first asked for."""

    def __init__(self, texts: pa.Array):
        self.texts = pc.fill_null(texts, "")
        self._words: tuple[np.ndarray, Words] | None = None
        self._lines: tuple[np.ndarray, pa.Array] | None = None
        self.seconds: dict[str, float] = {}

    def _places(self, have: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(have, rows)

    def of(self, rows: np.ndarray) -> pa.Array:
        return self.texts if len(rows) == len(self.texts) else self.texts.take(pa.array(rows))

    def words(self, rows: np.ndarray) -> Words:
        """rows ascend, and are among those of the first call."""
        if self._words is None:
            began = time.perf_counter()
            self._words = rows, words_of(self.of(rows))
            self.seconds["words"] = time.perf_counter() - began
        have, words = self._words
        if len(have) == len(rows):
            return words
        size = np.diff(words.offsets)
        left = np.zeros(len(have), bool)
        left[self._places(have, rows)] = True
        mask = np.repeat(left, size)
        return Words(words.values.filter(pa.array(mask)), np.concatenate([[0], np.cumsum(size[left])]), words.codes[mask])

    def lines(self, rows: np.ndarray) -> pa.Array:
        if self._lines is None:
            began = time.perf_counter()
            self._lines = rows, pc.split_pattern(self.of(rows), "\n")
            self.seconds["lines"] = time.perf_counter() - began
        have, lines = self._lines
        return lines if len(have) == len(rows) else lines.take(pa.array(self._places(have, rows)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return before[offsets[1:]] - before[offsets[:-1]]


def _count(pattern: str) -> Callable[[Texts, np.ndarray], np.ndarray]:
    return lambda t, rows: pc.count_substring_regex(t.of(rows), pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _n_words(t: Texts, rows: np.ndarray) -> np.ndarray:
    return np.diff(t.words(rows).offsets)


def _word_chars(t: Texts, rows: np.ndarray) -> np.ndarray:
    words = t.words(rows)
    return _sums(pc.utf8_length(words.values).to_numpy(zero_copy_only=False), words.offsets)


def _n_repeat_words(t: Texts, rows: np.ndarray) -> np.ndarray:
    words = t.words(rows)
    return _sums(repeated_windows(words, WINDOW), words.offsets)


def _n_letter_words(t: Texts, rows: np.ndarray) -> np.ndarray:
    words = t.words(rows)
    seen = words.values.dictionary_encode()
    return _sums(pc.match_substring_regex(seen.dictionary, r"\p{L}").to_numpy(zero_copy_only=False)[seen.indices.to_numpy(zero_copy_only=False)] if len(seen) else np.empty(0, bool), words.offsets)


def _n_lines(t: Texts, rows: np.ndarray) -> np.ndarray:
    return np.diff(t.lines(rows).offsets.to_numpy().astype(np.int64))


def _n_dup_lines(t: Texts, rows: np.ndarray) -> np.ndarray:
    lines = t.lines(rows)
    ends = lines.offsets.to_numpy().astype(np.int64)
    seen = lines.flatten().dictionary_encode()
    with_word = pc.match_substring_regex(seen.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool) if len(seen.dictionary) else np.empty(0, bool)
    codes = seen.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(rows)), np.diff(ends))
    full = with_word[codes] if len(codes) else np.empty(0, bool)
    kinds = np.unique(text[full] << 32 | codes[full]) >> 32
    return np.bincount(text[full], minlength=len(rows)) - np.bincount(kinds, minlength=len(rows))


#: By name: what makes the measure, and which of words and lines it needs.
MEASURES: dict[str, tuple[Callable[[Texts, np.ndarray], np.ndarray], str]] = {
    "n_words": (_n_words, "words"), "word_chars": (_word_chars, "words"), "n_repeat_words": (_n_repeat_words, "words"), "n_letter_words": (_n_letter_words, "words"),
    "n_lines": (_n_lines, "lines"), "n_dup_lines": (_n_dup_lines, "lines"),
    "n_symbols": (_count(SYMBOLS), ""), "n_calls": (_count("[!?]"), ""), "n_letters": (_count(r"\p{L}"), ""), "n_capitals": (_count(r"\p{Lu}"), ""),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose measures (whole numbers, in the order named) make fails true."""

    name: str
    measures: tuple[str, ...]
    fails: Callable[..., np.ndarray]


BASE = (Rule("few words", ("n_words",), lambda n: n < 20), Rule("repeated windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n))

#: The method's own rules: limits on shares that prose of any alphabet with words between spaces stays within by far.
OWN = (
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("words without letters", ("n_letter_words", "n_words"), lambda a, n: 10 * a < 8 * n),
    Rule("capitals", ("n_capitals", "n_letters"), lambda u, a: 2 * u > a),
    Rule("calls", ("n_calls", "n_words"), lambda c, n: 2 * c > n),
    Rule("repeated lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("word length", ("word_chars", "n_words"), lambda c, n: (10 * c < 25 * n) | (c > 15 * n)),
)


def _measured(t: Texts, name: str, rows: np.ndarray, known: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The measure for rows; what is known for these or more rows is not made again."""
    if name not in known:
        known[name] = rows, MEASURES[name][0](t, rows)
    have, values = known[name]
    return values if len(have) == len(rows) else values[np.searchsorted(have, rows)]


def cascade(texts: pa.Array, rules: Sequence[Rule], wanted: Sequence[str] = ()) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, int]]:
    """The wanted measures of all texts; for each text the place of the first rule that rejects it, or -1; and how many texts each measure was made for."""
    t, rows = Texts(texts), np.arange(len(texts))
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    out = {m: _measured(t, m, rows, known) for m in wanted}
    by = np.full(len(texts), -1, np.int32)
    for k, rule in enumerate(rules):
        if not len(rows):
            break
        fails = rule.fails(*(_measured(t, m, rows, known) for m in rule.measures))
        by[rows[fails]] = k
        rows = rows[~fails]
    return out, by, {m: len(have) for m, (have, _) in known.items()}


def _probe(texts: pa.Array, rules: Sequence[Rule]) -> tuple[np.ndarray, list[float]]:
    """For each text and rule whether it rejects; seconds of words, lines and of each measure."""
    t, rows = Texts(texts), np.arange(len(texts))
    t.words(rows)
    t.lines(rows)
    values, seconds = {}, [t.seconds["words"], t.seconds["lines"]]
    for m, (make, _) in MEASURES.items():
        began = time.perf_counter()
        values[m] = make(t, rows)
        seconds.append(time.perf_counter() - began)
    return np.stack([r.fails(*(values[m] for m in r.measures)) for r in rules], axis=1), seconds


def greedy_order(fails: np.ndarray, seconds: dict[str, float], rules: Sequence[Rule], wanted: Sequence[str] = ()) -> list[int]:
    """Places of the rules. fails: a row for each text of the sample, a column for each rule; seconds: by measure, and of words and lines."""
    paid = {*wanted, *(MEASURES[m][1] for m in wanted), ""}
    left, todo, order = np.ones(len(fails), bool), list(range(len(rules))), []

    def price(k: int) -> float:
        need = {*rules[k].measures, *(MEASURES[m][1] for m in rules[k].measures)} - paid
        return sum(seconds.get(x, 0.0) for x in need) + 1e-9

    while todo:
        best = max(todo, key=lambda k: (fails[left, k].sum() / price(k), -price(k), -k))
        todo.remove(best)
        order.append(best)
        left &= ~fails[:, best]
        paid |= {*rules[best].measures, *(MEASURES[m][1] for m in rules[best].measures)}
    return order


def estimated_order(docs: DataFrame, rules: Sequence[Rule], wanted: Sequence[str] = (), text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[int]:
    """The order by a sample of at most `rows` rows: a SAMPLE_SHARE of the table's first rows. Spark starts no more tasks than these rows take."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(0)):
                fails, seconds = _probe(batch.column(0).slice(at, n), rules)
                each = [s / n for s in seconds]
                yield pa.RecordBatch.from_arrays([pa.array(fails.tolist(), pa.list_(pa.bool_())), pa.array([each] * n, pa.list_(pa.float64()))], names=["fails", "seconds"])

    sample = docs.select(F.col(text_col).cast("string").alias("__text")).sample(SAMPLE_SHARE, SEED).mapInArrow(probe, "fails array<boolean>, seconds array<double>").limit(rows).collect()
    if not sample:
        return list(range(len(rules)))
    seconds = np.array([r["seconds"] for r in sample]).sum(axis=0)
    return greedy_order(np.array([r["fails"] for r in sample]), dict(zip(["words", "lines", *MEASURES], seconds, strict=True)), rules, wanted)


def judged(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *OWN), wanted: Sequence[str] = (), order: Sequence[int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: id, the wanted measures, and rejected_by, the name of the first rule that rejects the text (null: it is kept)."""
    taken = [rules[k] for k in (estimated_order(docs, rules, wanted, text_col) if order is None else order)]
    names = pa.array([r.name for r in taken])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1)):
                values, by, _ = cascade(batch.column(1).slice(at, n), taken, wanted)
                first = names.take(pa.array(by, mask=by < 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(values[m]) for m in wanted), first], names=[id_col, *wanted, "rejected_by"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, " + "".join(f"{m} long, " for m in wanted) + "rejected_by string")


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame) -> DataFrame:
    """Per document the base measures, whether a base rule fails, and whether all rules keep it."""
    found = judged(docs, wanted=REPORTED)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select("doc_id", *REPORTED, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))
