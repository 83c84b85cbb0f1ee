"""Words of many texts as Arrow arrays and integer codes, and windows of words that stand twice in a text; used within tasks.

Words are `[^\\x20\\x09-\\x0D]+`. Nothing here looks at one word at a time: Arrow cuts and codes them, numpy does the rest.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of a batch are worked on in slices of so many bytes (or one text, if that is longer), so memory doesn't follow the batch.
SLICE_BYTES = 4_000_000


class Words(NamedTuple):
    #: All words, text after text.
    values: pa.Array
    #: Where each text's words begin, and the end.
    offsets: np.ndarray
    #: Equal numbers for equal words.
    codes: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def slices(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, number) of successive texts that have `most` bytes together, or one text."""
    most = most or SLICE_BYTES
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        limit = (ends[at - 1] if at else 0) + most
        to = max(at + 1, int(np.searchsorted(ends, limit, "right")))
        yield at, to - at
        at = to


def words_of(texts: pa.Array) -> Words:
    """Null texts have no words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word there
    before = np.concatenate([[0], np.cumsum(full)])
    values = values.filter(pa.array(full))
    codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(values, before[ends - ends[0]], codes)


def _mixed(a: np.ndarray, b: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = (a * odd) ^ (b + np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def repeated_windows(words: Words, k: int) -> np.ndarray:
    """For each word whether a window of k words that stands twice or more in its text covers it.

    Windows are sorted by a hash, and neighbours with equal hashes compared word by word; if any differ, another hash is taken. So the result is exact."""
    codes, n = words.codes, len(words.codes)
    covered = np.zeros(n, bool)
    if n < k:
        return covered
    text = words.text_of()
    here = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
    for odd in (np.uint64(2 * s + 0x94D049BB133111EB) for s in itertools.count()):
        key, size = codes.astype(np.uint64), 1
        while 2 * size <= k:
            key = _mixed(key[:-size], key[size:], odd)
            size *= 2
        if size < k:  # two overlapping windows make up the window
            key = _mixed(key[: len(key) - (k - size)], key[k - size :], odd)
        key = _mixed(key, text[: n - k + 1].astype(np.uint64), odd)[here]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        a, b = here[order[:-1][same]], here[order[1:][same]]
        if (text[a] == text[b]).all() and all((codes[a + j] == codes[b + j]).all() for j in range(k)):
            break
    marks = np.zeros(n + 1, np.int64)
    twice = np.unique(np.concatenate([a, b]))
    marks[twice] += 1
    marks[twice + k] -= 1
    return np.cumsum(marks[:-1]) > 0


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    before = np.concatenate([[0], np.cumsum(keep)])
    offsets = pa.array(before[words.offsets].astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words.values.filter(pa.array(keep))), " ")
