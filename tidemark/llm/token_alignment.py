"""Cross-tokenizer alignment: two tokenizers over the same bytes, cut into groups where both end a token.

Labels: each byte has a label: none, end of an A token, end of a B token, or both. A regular expression scans the label string (without its nones, which count for nothing) for spans
up to each both-label; the counts of end labels in a span are the numbers of A and B tokens of its group. Within a group the tokens that
overlap are a staircase: each end label other than the first stretch's moves on by one token of A, of B, or of both, so a group of a and b tokens has a + b - 1 links.

Units: texts are aligned by units, each distinct one once and many at a time, joined by spaces; they are kept in a cache of bounded size. A unit begins at a space between two other than white-space
characters. A's pattern begins a piece there, and B has no piece with its space sign after another character (checked when it is
loaded; else a text is one unit), so both tokenizers and hence the labels are cut there in any case.

Counts: how many texts hold an id pair linked. Pairs are counted once a text, summed within tasks and then by key. The COMMON commonest pairs at most are
broadcast as sorted arrays (their number is counted, whole powers of two of the count at a time); rarer links are joined with their counts through a shuffle, which no pair can
skew, as each is in fewer texts than the commonest ones. If all rarer pairs have count 1, that is all there is to know. Each A id's highest count is a row an id of the vocabulary.

A: byte-level BPE by its json file, read as ranks (the ids of merged tokens must ascend as the merges do); strings of special tokens are plain text. B: a
sentencepiece model. Null and empty texts, and texts whose joined bytes differ from space + text in A or B (signs that B folds, such as U+2581), have no tokens: zeros
and an empty groups_sha256. Texts are encoded whole; repeated rows count as texts of their own; null ids are rows like others. Empty tables give empty
results; other columns of the input are ignored, so none can clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_letters, refuse
from .common import settled
from .word_arrays import slices

#: Most pairs whose counts are broadcast (12 bytes each).
COMMON = 1_000_000
#: Units in a cache beyond which only those of the last slice of texts stay, characters of units that are aligned together, and most pairs that a task holds before it hands counts on.
CACHE, TOGETHER, HELD = 250_000, 1_000_000, 2_000_000

#: Ids of B below this; a pair is one number, A's id times this plus B's.
WIDTH = 1 << 31

_NONE, _A, _B, _BOTH = range(4)
_SPAN = re.compile(rb"[\x01\x02]*\x03")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE_SIGN = "▁"


class Unit(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    #: `a1,a2|b1;a3|b2`
    groups: str
    #: The linked pairs as 64-bit numbers.
    pairs: bytes


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse(spec)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        added = {x["content"] for x in spec.get("added_tokens", [])}
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in added}
        made = [ids[raw("".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
        if made != sorted(made) or any(len(b) > 1 for b, i in ids.items() if made and i < made[0]):
            raise ValueError("the ids of A's merged tokens must ascend as its merges do")
        self.a_bytes = {i: b for b, i in ids.items()}
        self.a_size = np.zeros(max(ids.values()) + 1, np.int64)
        for b, i in ids.items():
            self.a_size[i] = len(b)
        self.encode_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([len(b) for b in self.b_bytes], np.int64)
        self.by_units = not any(_SPACE_SIGN in p.lstrip(_SPACE_SIGN) for p in pieces)
        self.known: dict[str, Unit | None] = {}
        #: Numbers of A and B tokens of a span of end labels, by the span.
        self.sizes: dict[bytes, tuple[int, int]] = {}

    def align(self, parts: list[str]) -> list[Unit | None]:
        """The units of the parts, which are aligned as one stretch joined by spaces; None where the bytes differ from space + part."""
        text = " ".join(parts)
        whole = (" " + text).encode("utf-8", "surrogatepass")
        a, b = self.encode_a(" " + text), self.b.encode(text)
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            half = len(parts) // 2
            return [*self.align(parts[:half]), *self.align(parts[half:])] if half else [None]
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        labels = np.zeros(len(whole), np.uint8)
        labels[np.cumsum(self.a_size[a_ids]) - 1] |= _A
        labels[np.cumsum(self.b_size[b_ids]) - 1] |= _B
        ends = np.flatnonzero(labels)
        label = labels[ends]
        # a link for each end label: the A and B tokens that are under way there
        is_a, is_b = label & _A > 0, label & _B > 0
        links = a_ids[np.cumsum(is_a) - is_a] * WIDTH + b_ids[np.cumsum(is_b) - is_b]
        a_text, b_text = list(map(str, a)), list(map(str, b))
        groups, sizes, i, j = [], self.sizes, 0, 0
        for span in _SPAN.findall(label.tobytes()):
            size = sizes.get(span)
            if size is None:
                size = span.count(_A) + 1, span.count(_B) + 1
                if len(span) < 12:
                    sizes[span] = size
            x, y = i + size[0], j + size[1]
            groups.append(f"{','.join(a_text[i:x])}|{','.join(b_text[j:y])}")
            i, j = x, y
        stops = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts])
        to = np.searchsorted(ends, stops)  # each part ends at a label that is both
        before = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[to], prepend=0).tolist()
        n_a, n_b, n_groups = before(is_a), before(is_b), before(label == _BOTH)
        out, at, g, raw = [], 0, 0, links.tobytes()
        for k, stop in enumerate(to.tolist()):
            out.append(Unit(n_a[k], n_b[k], n_groups[k], ";".join(groups[g : g + n_groups[k]]), raw[8 * at : 8 * stop]))
            at, g = stop, g + n_groups[k]
        return out

    def parts(self, text: str) -> list[str]:
        return _CUT.split(text) if self.by_units else [text]

    def units(self, texts: list[list[str]]) -> dict[str, Unit | None]:
        """The units of all parts of a slice of texts, by way of the cache."""
        asked = set().union(*texts)
        new, size = [], 0
        todo = [p for p in asked if p not in self.known]
        for part in [p for p in todo if p.strip() != p]:  # white space at an end would run into the space that joins parts
            self.known[part] = self.align([part])[0]
        todo = [p for p in todo if p not in self.known]
        for k, part in enumerate(todo, 1):
            new.append(part)
            size += len(part)
            if size >= TOGETHER or k == len(todo) or not self.by_units:
                self.known.update(zip(new, self.align(new), strict=True))
                new, size = [], 0
        known = self.known
        if len(known) > CACHE:
            self.known = {p: known[p] for p in asked} if len(asked) <= CACHE else {}
        return known


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python process and pair of files; workers keep theirs, and its cache, from task to task."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2`, null without tokens) and links: the text's linked pairs, each once and ascending, as
    the first and then the differences, packed as 64-bit numbers, and times: how often each stands there, packed as 32-bit numbers."""
    small = pa.schema([(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.string()), ("links", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                rows = []
                texts = [own.parts(text) if text else [] for text in batch.column(1).slice(at, n).to_pylist()]
                known = own.units(texts)
                for parts in texts:
                    units = [known[p] for p in parts]
                    if not units or None in units:
                        rows.append((0, 0, 0, 0, None, b"", b""))
                        continue
                    n_a, n_b, n_groups, groups, pairs = zip(*units, strict=True)
                    pair, times = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_counts=True)
                    a, b, g = sum(n_a), sum(n_b), sum(n_groups)
                    rows.append((a, b, g, a + b - g, ";".join(groups), np.diff(pair, prepend=0).tobytes(), times.astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), small.types, strict=True))], names=[id_col, *small.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, times binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of all rows, and how many each row has."""
    raw = column.to_pylist()
    sizes = np.array([len(x) // 8 for x in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.int64)
    total = np.cumsum(flat)
    ends = np.cumsum(sizes)
    base = np.concatenate([[0], total])[ends - sizes]
    return total - np.repeat(base, sizes), sizes


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): in how many texts each pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            pair, n = np.unique(_unpacked(batch.column(0))[0], return_counts=True)
            if not len(pair):
                continue
            both = np.concatenate([held, pair])
            order = np.argsort(both, kind="stable")
            both, weight = both[order], np.concatenate([counts, n])[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            held, counts = both[first], np.add.reduceat(weight, first)
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])
                held, counts = held[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])

    return links.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _common_from(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` pairs have that count or more. The sizes of 64 classes come to the driver."""
    classes = {r["k"]: r["pairs"] for r in counts.groupBy((F.length(F.bin("n")) - 1).alias("k")).agg(F.count("*").alias("pairs")).collect()}
    total, k = 0, 63
    while k and total + classes.get(k - 1, 0) <= most:
        k -= 1
        total += classes.get(k, 0)
    return 1 << k


def with_link_counts(groups: DataFrame, common: int = COMMON) -> DataFrame:
    """groups (of token_groups, settled, with a `__row` of its own for each row) with n_best and count_sum in place of links and times."""
    spark = groups.sparkSession
    counts = settled(pair_counts(groups), "pair_counts")
    best = counts.groupBy(F.floor(F.col("pair") / WIDTH).cast("int").alias("a")).agg(F.max("n").alias("n")).toArrow()
    start = _common_from(counts, common)
    known = counts.where(F.col("n") >= start).orderBy("pair").toArrow()
    # rarer pairs are looked up through a shuffle, but for count 1
    rarer = start > 2 and bool(counts.where((F.col("n") < start) & (F.col("n") > 1)).take(1))
    top = np.zeros(max(best["a"].to_pylist(), default=0) + 1, np.int64)
    top[best["a"].to_numpy()] = best["n"].to_numpy()
    shared = spark.sparkContext.broadcast((known["pair"].to_numpy().copy(), known["n"].to_numpy().copy(), top))
    fixed = ["__row", *(c for c in groups.columns if c not in ("__row", "links", "times"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, numbers, top = shared.value
        for batch in batches:
            pair, sizes = _unpacked(batch.column("links"))
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), np.int32).astype(np.int64)
            place = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[place] == pair if len(pairs) else np.zeros(len(pair), bool)
            n = np.where(hit, numbers[place], 1) if len(pairs) else np.ones(len(pair), np.int64)
            use = hit | (not rarer)
            before = np.concatenate([[0], np.cumsum(sizes)])
            added = lambda x: (lambda s: s[before[1:]] - s[before[:-1]])(np.concatenate([[0], np.cumsum(x)]))  # noqa: E731, B023
            columns = [batch.column(c) for c in fixed] + [pa.array(added(times * use * (n == top[pair // WIDTH]))), pa.array(added(times * use * n))]
            if rarer:
                rest = ~use
                offsets = pa.array(np.concatenate([[0], np.cumsum(added(rest))]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(pair[rest]), pa.array(times[rest])], names=["pair", "times"])))
            yield pa.RecordBatch.from_arrays(columns, names=[*fixed, "n_best", "count_sum", *["rest"] * rarer])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.select(*fixed).schema) + ", n_best long, count_sum long" + ", rest array<struct<pair:long,times:long>>" * rarer
    found = groups.mapInArrow(run, schema)
    if not rarer:
        return found.drop("__row")
    found = settled(found, "common_links")
    top_of = spark.createDataFrame(best.rename_columns(["a", "top"]))  # at most a row for each id of A
    rare = found.select("__row", F.explode("rest").alias("r")).select("__row", "r.pair", "r.times").join(counts.where(F.col("n") < start), "pair")
    rare = rare.withColumn("a", F.floor(F.col("pair") / WIDTH).cast("int")).join(F.broadcast(top_of), "a")
    sums = rare.groupBy("__row").agg(F.sum(F.col("times") * (F.col("n") == F.col("top")).cast("long")).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
    out = found.drop("rest").join(sums, "__row", "left")
    return out.select(*(c for c in fixed if c != "__row"), (F.col("n_best") + F.coalesce("__best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum"))


def alignment_report(docs: DataFrame, a_path: str, b_path: str, common: int = COMMON) -> DataFrame:
    """Per document the numbers of tokens, groups and links, n_best, count_sum and the digest of the groups."""
    groups = token_groups(docs.select("doc_id", "text"), a_path, b_path).withColumn("groups_sha256", F.coalesce(F.sha2("groups", 256), F.lit(""))).drop("groups")
    groups = settled(groups.withColumn("__row", F.monotonically_increasing_id()), "token_groups")
    return with_link_counts(groups, common).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
