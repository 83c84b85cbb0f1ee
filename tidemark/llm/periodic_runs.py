"""Periodic runs of words within texts, and texts with each run collapsed to one period.

A run is a stretch of consecutive words with smallest period q and at least max(min_length, min_exponent * q) words that no
neighbouring word extends with period q.

1. Masking. A run without its last q words stands again q words later, and that overlap has at least k = min over q of
   max(min_length, min_exponent * q) - q words. So each word of a run lies in a window of k words that stands twice in the text. Words
   outside such windows cannot join runs; what survives falls into segments.
2. Main-Lorentz on the surviving segments: a segment is halved again and again, and for each middle m and each q up to a third
   of the block (in general its length by the exponent), how far the text agrees with itself q words on, forward and backward from m, gives
   the run of period q around m. All blocks of a level are worked on at once, and the extents are found by halving: equal windows of 2^j words have
   equal numbers, which come from sorting pairs, so no hash decides anything. Extents reach over the block's borders, so what
   is found is maximal at once, and found repeatedly; of equal stretches the smallest period counts, which divides the others.

Null and empty texts, and texts with too few words, have no runs. Texts are read whole; memory follows a slice of texts or the longest text. Repeated
rows and null ids are rows like others. Empty tables give empty results; other columns of the input are ignored, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .word_arrays import joined, repeated_windows, slices, words_of

MIN_LENGTH, MIN_EXPONENT = 24, 3


def least_overlap(min_length: int, min_exponent: int) -> int:
    """The shortest overlap of a run with itself one period on, over all periods."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))


class _Names:
    """Numbers for the windows of 2^j words of a sequence: equal ones for equal windows. Up to the longest stretch asked for, or until no window stands twice; so no two stretches agree over twice the size of the last level."""

    def __init__(self, seq: np.ndarray, longest: int):
        self.levels = [np.unique(seq, return_inverse=True)[1].astype(np.int32)]
        while 2 << (len(self.levels) - 1) <= min(longest, len(seq)):
            last, size = self.levels[-1].astype(np.int64), 1 << (len(self.levels) - 1)
            named, names = np.unique(last[:-size] << 32 | last[size:], return_inverse=True)
            if len(named) == len(names):  # no window of this size or a larger one stands twice
                break
            self.levels.append(names.astype(np.int32))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        got = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            name = self.levels[k]
            b = j + got
            ok = b < len(name)
            ok[ok] = name[i[ok] + got[ok]] == name[b[ok]]
            got[ok] += 1 << k
        return got

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words back from i, itself included, equal those back from j."""
        got = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            name = self.levels[k]
            a = i - got - (1 << k) + 1
            ok = a >= 0
            ok[ok] = name[a[ok]] == name[a[ok] + (j[ok] - i[ok])]
            got[ok] += 1 << k
        return got

    def agree(self, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from i on equal those from j on, or the n words before i those before j; at least so for windows of the largest power of two within n."""
        k = min(n.bit_length() - 1, len(self.levels) - 1)
        name, size = self.levels[k], 1 << k
        ok = j < len(name)
        ok[ok] = name[i[ok]] == name[j[ok]]
        back = i >= size
        back[back] = name[i[back] - size] == name[j[back] - size]
        return ok | back


def _pairs(lo: np.ndarray, hi: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(middle, period, block) for all blocks, each with all its periods."""
    most = (hi - lo) // exponent
    block = np.repeat(np.arange(len(lo)), most)
    period = np.arange(len(block)) - np.repeat(np.cumsum(most) - most, most) + 1
    return ((lo + hi) // 2)[block], period, block


def main_lorentz(segments: list[np.ndarray], min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, length, period) of all runs within the segments (arrays of non-negative codes), by segment, start and period."""
    lengths = np.array([len(s) for s in segments], np.int64)
    parts = [np.array([-1])]
    for k, s in enumerate(segments):
        parts += [s, np.array([-2 - k])]  # an end of its own after each segment, which nothing equals
    seq = np.concatenate(parts)
    begin = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    names = _Names(seq, int(lengths.max(initial=1)))
    half = (least_overlap(min_length, min_exponent) + 1) // 2
    found = [np.empty((3, 0), np.int64)]
    lo, hi = begin, begin + lengths
    while len(lo):
        long_enough = hi - lo >= min_length
        lo, hi = lo[long_enough], hi[long_enough]
        middle, q, block = _pairs(lo, hi, min_exponent)
        for left in (False, True):
            i = middle - q if left else middle
            ok = (i >= lo[block]) & (i + q < hi[block] + 1)
            i, p = i[ok], q[ok]
            near = names.agree(i, i + p, half)
            i, p = i[near], p[near]
            after, before = names.forward(i, i + p), names.backward(i - 1, i + p - 1)
            size = before + after + p
            is_run = size >= np.maximum(min_length, min_exponent * p)
            found.append(np.stack([(i - before)[is_run], size[is_run], p[is_run]]))
        middle = (lo + hi) // 2
        lo, hi = np.concatenate([lo, middle]), np.concatenate([middle, hi])
    start, size, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, size, start))
    start, size, period = start[order], size[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    start, size, period = start[first], size[first], period[first]
    order = np.lexsort((period, start))
    start, size, period = start[order], size[order], period[order]
    segment = np.searchsorted(begin, start, "right") - 1
    return segment, start - begin[segment], size, period


def _runs_of_slice(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, runs and collapsed texts of a slice."""
    words = words_of(texts)
    survive = repeated_windows(words, least_overlap(min_length, min_exponent))
    text = words.text_of()
    edge = np.flatnonzero(np.diff(np.concatenate([[False], survive, [False]]).astype(np.int8)) | np.concatenate([[0], np.diff(text) * (survive[1:] & survive[:-1]), [0]])) if len(survive) else np.empty(0, np.int64)
    spans = [(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a >= min_length and survive[a]]
    base = np.array([a for a, _ in spans], np.int64)
    if spans:
        segment, start, size, period = main_lorentz([words.codes[a:b] for a, b in spans], min_length, min_exponent)
        start = start + base[segment]
    else:
        start = size = period = np.empty(0, np.int64)
    marks = np.zeros(len(survive) + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + size, -1)
    keep = np.cumsum(marks[:-1]) == 0
    owner = text[start] if len(start) else np.empty(0, np.int64)
    order = np.lexsort((period, start))
    owner, start, size, period = owner[order], start[order], size[order], period[order]
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start - words.offsets[owner]), pa.array(size), pa.array(period)], names=["start", "length", "period"]))
    return pa.array(np.diff(words.offsets)), runs, joined(words, keep)


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: id, n_words, runs (array of start, length, period, by start and then period) and collapsed (the text without what follows a run's first period, one space between words)."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two periods and two words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *_runs_of_slice(batch.column(1).slice(at, n), min_length, min_exponent)], names=[id_col, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts (by crc32 of the id) repeat from some word on with some period; those are rewritten with single spaces, the others are untouched."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(F.pmod(h, F.lit(10)) == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n")))
    d = d.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod("g", F.lit(8)))))
    tail = F.flatten(F.array_repeat(F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    edited = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(tail, F.lit(1), (F.col("n") - F.col("a")).cast("int"))), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def _steepest(runs: Column) -> Column:
    """The run with the greatest length by period, compared as whole numbers; of equal ones the first."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def run_report(docs: DataFrame) -> DataFrame:
    """Per document n_runs, the steepest run (start, length, period, exponent_milli) and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = periodic_runs(with_planted_runs(docs))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), _steepest(F.col("runs")).alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * r.length) div r.period")
    return found.select("doc_id", "n_runs", "r.start", "r.length", "r.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
