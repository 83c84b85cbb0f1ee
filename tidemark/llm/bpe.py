"""BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a piece there is exactly one token that can end its encoding: the token t, ending where the prefix
does, such that t and the last token of what stands before it are compatible, that is, merging both
together byte by byte gives the two tokens again. A suffix automaton of all tokens gives the tokens that end at each place: the longest
match ending there, then its suffix links. The unique last token is stored for each prefix, and following it back gives the ids.

Two tokens are compatible if no merge across their border happens before the tokens are complete: going back through the merges of
both, latest first, no pair across the border may have a merge of its own that comes earlier than the merge just undone. Tokens that
merging never makes (their own bytes merge into something else) are not in the automaton; the same test tells them, from the parts upwards.

Pieces are cut as the tokenizer file says: strings of added tokens first, then the byte-level pattern. Files with settings that this
module doesn't follow (normalizers, other pre-tokenizers, dropout, unknown tokens, affixes, bytes without a token) are refused. The distinct pieces of a slice of
texts are encoded together in arrays, a prefix that they share once, and those longer than LONG bytes one at a time. Encoded pieces and tried pairs are kept in
caches of bounded size, which change no result. Null and empty texts have no ids and the digests of empty strings. Texts are encoded whole; repeated rows and
null ids are rows like others. Empty tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the byte-level pattern of the tokenizers library.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces in a cache beyond which the older half goes; and the longest that are kept, and encoded with others, in bytes.
CACHE, LONG = 300_000, 64
#: Characters of texts beyond which a slice ends, pieces that are encoded together, and ids that are decoded together.
SLICE, TOGETHER, DECODED = 1_000_000, 16_384, 100_000
#: Rows of a batch that are encoded, and handed on, at once: a whole batch's texts and ids, in Python and in the JVM, take memory of executors that others need too.
ROWS = 1000
#: Tried pairs are kept in so many places, by the upper bits of a product with an odd number.
_FIT_BITS, _ODD = 20, np.uint64(0x9E3779B97F4A7C15)
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class SuffixAutomaton:
    """Of a set of byte strings: its states are the classes of their factors that end at the same places. A string of the set is the longest of its state.

    Arrays hold a state's longest length and suffix link; one dictionary holds all transitions, by state * 256 + byte.
    """

    def __init__(self, strings: Iterable[tuple[bytes, int]]):
        self.length, self.link = array("i", [0]), array("i", [-1])
        self.go: dict[int, int] = {}
        marks: dict[int, int] = {}
        outs: dict[int, list[int]] = {}
        for text, mark in strings:
            at = 0
            for c in text:
                at = self._extend(at, c, outs)
            marks[at] = mark
        n = len(self.length)
        #: The string that a state stands for, or -1; and the nearest state on the suffix links that stands for one, or 0.
        self.mark, self.up = array("i", [-1]) * n, array("i", [0]) * n
        for state, mark in marks.items():
            self.mark[state] = mark
        for state in sorted(range(1, n), key=self.length.__getitem__):
            to = self.link[state]
            self.up[state] = to if self.mark[to] >= 0 else self.up[to]

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int, outs: dict[int, list[int]]) -> int:
        """The part of state q that p reaches by c, as a state of its own."""
        go = self.go
        own = self._new(self.length[p] + 1, self.link[q])
        for b in outs.get(q, ()):
            go[own << 8 | b] = go[q << 8 | b]
        outs[own] = list(outs.get(q, ()))
        self.link[q] = own
        while p >= 0 and go.get(p << 8 | c) == q:
            go[p << 8 | c] = own
            p = self.link[p]
        return own

    def _extend(self, last: int, c: int, outs: dict[int, list[int]]) -> int:
        """The state of the current string's prefix, one byte longer."""
        go = self.go
        q = go.get(last << 8 | c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q, outs)
        new, p = self._new(self.length[last] + 1, 0), last
        while p >= 0 and p << 8 | c not in go:
            go[p << 8 | c] = new
            outs.setdefault(p, []).append(c)
            p = self.link[p]
        if p >= 0:
            q = go[p << 8 | c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q, outs)
        return new

    def ends(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(end, state) for each place, and each string of the set that ends there, longest first."""
        go, length, link, mark, up = self.go, self.length, self.link, self.mark, self.up
        state, size = 0, 0
        for end, c in enumerate(text, 1):
            to = go.get(state << 8 | c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = go.get(state << 8 | c)
            if to is None:
                continue
            state, size = to, size + 1
            here = state if size == length[state] and mark[state] >= 0 else up[state]
            while here:
                yield end, here
                here = up[here]


def refuse(spec: dict) -> None:
    """Raises ValueError for what this module doesn't follow."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    faults = [f"model {k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    faults += ["model type"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * bool(spec.get("normalizer"))
    faults += ["pre_tokenizer"] * (pre.get("type") != "ByteLevel" or bool(pre.get("add_prefix_space")) or not pre.get("use_regex", True))
    faults += ["decoder"] * ((spec.get("decoder") or {}).get("type") != "ByteLevel")
    faults += ["added token"] * any(a.get(k) for a in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    if faults:
        raise ValueError(f"tokenizer settings that are not supported: {', '.join(faults)}")


class BytePairs:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse(spec)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        model = spec["model"]
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.id_of = {raw(s): i for s, i in model["vocab"].items() if s not in self.added}
        if sum(len(b) == 1 for b in self.id_of) < 256:
            raise ValueError("tokenizer settings that are not supported: bytes without a token")
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.added.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        merges = [tuple(raw(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        for k, (a, b) in enumerate(merges):
            self.rank.setdefault((self.id_of[a], self.id_of[b]), k)
        # a token is made by the first of its merges whose parts are made and stay whole until then
        made = {i for b, i in self.id_of.items() if len(b) == 1}
        for k, (a, b) in enumerate(merges):
            left, right, whole = self.id_of[a], self.id_of[b], self.id_of[a + b]
            if whole not in made and left in made and right in made and self.compatible(left, right, k):
                made.add(whole)
                self.parts[whole] = k, left, right
        self.find = SuffixAutomaton((b, i) for b, i in self.id_of.items() if i in made)
        self.split = regex.compile(PATTERN)
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.fits: dict[int, bool] = {}
        self.special = {s: i.to_bytes(4, "little") for s, i in self.added.items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._arrays()

    def _arrays(self) -> None:
        """The automaton, merges, parts and tokens as arrays; sorted keys end with one that nothing is equal to."""
        find, n = self.find, max(self.bytes_of) + 1
        self.length, self.link, self.mark, self.up = (np.array(x, np.int64) for x in (find.length, find.link, find.mark, find.up))
        go = np.array(sorted(find.go.items()), np.int64).reshape(-1, 2)
        self.go_key, self.go_to = np.append(go[:, 0], _NEVER), go[:, 1]
        ranks = np.array(sorted((left << 32 | right, k) for (left, right), k in self.rank.items()), np.int64).reshape(-1, 2)
        self.rank_key, self.rank_of = np.append(ranks[:, 0], _NEVER), np.append(ranks[:, 1], _NEVER)
        self.part_rank, self.part_left, self.part_right = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, part in self.parts.items():
            self.part_rank[i], self.part_left[i], self.part_right[i] = part
        #: Twice the pair's key, and 1 more if it fits.
        self.tried = np.full(1 << _FIT_BITS, -1, np.int64)
        tokens = [self.bytes_of.get(i, b"") for i in range(n)]
        self.token_bytes, self.token_size = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(b) for b in tokens], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size

    def compatible(self, left: int, right: int, own: int | None = None) -> bool:
        """Undoes the merges of both tokens, latest first; `undone` is the rank of the merge undone last. own: the rank of the merge of both, which is no fault."""
        rank, parts, undone = self.rank, self.parts, _NEVER
        while True:
            across = rank.get((left, right))
            if across is not None and across < undone and across != own:
                return False
            l_part, r_part = parts.get(left), parts.get(right)
            l_rank, r_rank = l_part[0] if l_part else -1, r_part[0] if r_part else -1
            if l_rank < 0 and r_rank < 0:
                return True
            # a merge on the left side is undone first among equals: it happens before one of the same rank on the right
            if l_rank > r_rank:
                undone, left = l_rank, l_part[2]
            else:
                undone, right = r_rank + 1, r_part[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        last = [0] * (n + 1)
        size = [0] * (n + 1)
        fits, length, mark = self.fits, self.find.length, self.find.mark
        for end, state in self.find.ends(piece):
            if size[end]:
                continue
            before, token = end - length[state], mark[state]
            if before:
                if not size[before]:
                    continue
                key = last[before] << 32 | token
                ok = fits.get(key)
                if ok is None:
                    ok = self.compatible(last[before], token)
                    if len(fits) >= 2_000_000:
                        fits.clear()
                    fits[key] = ok
                if not ok:
                    continue
            last[end], size[end] = token, length[state]
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`compatible` of many pairs."""
        fit, undone, at = np.ones(len(left), bool), np.full(len(left), _NEVER), np.arange(len(left))
        while len(at):
            key = left << 32 | right
            found = np.searchsorted(self.rank_key, key)
            bad = (self.rank_key[found] == key) & (self.rank_of[found] < undone)
            fit[at[bad]] = False
            l_rank, r_rank = self.part_rank[left], self.part_rank[right]
            on = np.flatnonzero(~bad & (np.maximum(l_rank, r_rank) >= 0))
            at, left, right, l_rank, r_rank = at[on], left[on], right[on], l_rank[on], r_rank[on]
            by_left = l_rank > r_rank
            undone = np.where(by_left, l_rank, r_rank + 1)
            left, right = np.where(by_left, self.part_right[left], left), np.where(by_left, right, self.part_left[right])
        return fit

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`_compatible` by way of the pairs that have been tried."""
        key = left << 32 | right
        place = (key.view(np.uint64) * _ODD >> np.uint64(64 - _FIT_BITS)).view(np.int64)
        got = self.tried[place]
        new = np.flatnonzero(got >> 1 != key)
        if len(new):
            pairs, which = np.unique(key[new], return_inverse=True)
            got[new] = (pairs << 1 | self._compatible(pairs >> 32, pairs & 0xFFFFFFFF))[which]
            self.tried[place[new]] = got[new]
        return got & 1 > 0

    def _advance(self, state: np.ndarray, size: np.ndarray, byte: np.ndarray) -> None:
        """Moves states, and the lengths of their matches, on by a byte each."""
        at = np.arange(len(state))
        while len(at):
            key = state[at] << 8 | byte[at]
            place = np.searchsorted(self.go_key, key)
            found = self.go_key[place] == key
            state[at[found]] = self.go_to[place[found]]
            size[at[found]] += 1
            at = at[~found]
            state[at] = self.link[state[at]]
            size[at] = self.length[state[at]]

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[bytes]:
        """`encode_piece` of sorted pieces that are not empty, their ids packed as little-endian 32-bit integers."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        n, most = len(pieces), int(lengths.max())
        text = np.array(pieces, f"S{most}").view(np.uint8).reshape(n, most)
        # bytes that a piece shares with the piece before: what ends within them is known from there
        same = text[1:] == text[:-1]
        shared = np.where(same.all(axis=1), most, same.argmin(axis=1)) if n > 1 else np.zeros(0, np.int64)
        shared = np.concatenate([[0], np.minimum(shared, np.minimum(lengths[1:], lengths[:-1]))])
        text = np.ascontiguousarray(text.T)
        last, step = np.zeros((most + 1, n), np.int32), np.zeros((most + 1, n), np.int32)
        state, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for end in range(1, most + 1):
            going = np.flatnonzero(lengths >= end)
            first = shared[going] < end
            own = going[first]
            to, matched = state[own], size[own]
            self._advance(to, matched, text[end - 1, own].astype(np.int64))
            here = np.where((matched == self.length[to]) & (self.mark[to] >= 0), to, self.up[to])
            at = own
            while len(at):
                token, length = self.mark[here], self.length[here]
                fit = length == end
                inner = np.flatnonzero(~fit)
                fit[inner] = self._fit(last[end - length[inner], at[inner]].astype(np.int64), token[inner])
                last[end, at[fit]], step[end, at[fit]] = token[fit], length[fit]
                at, here = at[~fit], self.up[here[~fit]]
            by = np.cumsum(first) - 1
            state[going], size[going], last[end, going], step[end, going] = to[by], matched[by], last[end, own][by], step[end, own][by]
        # back from the ends: ids in the last columns of a row each
        ids, n_ids, left, at, column = np.zeros((n, most), "<u4"), np.zeros(n, np.int64), lengths.copy(), np.arange(n), most
        while len(at):
            column -= 1
            ids[at, column] = last[left[at], at]
            n_ids[at] += 1
            left[at] -= step[left[at], at]
            at = at[left[at] > 0]
        packed = ids[np.arange(most) >= most - n_ids[:, None]].tobytes()
        stops = (4 * np.cumsum(n_ids)).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]

    def pieces(self, text: str) -> list[str]:
        """A text's pieces. Strings of added tokens are pieces of their own; no other piece is equal to one, as that would have been cut out."""
        if self.split_added is None or not any(s in text for s in self.added):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [*self.split.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.split.findall(text[at:])

    def _packed(self, texts: list[list[str]]) -> list[bytes]:
        """The packed ids of a slice of texts, given in pieces, by way of the cache."""
        known, new = self.young, []
        for piece in set().union(*texts).difference(known):
            got = self.old.get(piece) or self.special.get(piece)
            if got is None:
                new.append(piece)
            else:
                known[piece] = got
        new.sort()  # by code points, thus their bytes too
        pairs = [(piece, piece.encode("utf-8", "surrogatepass")) for piece in new]
        short, long = [x for x in pairs if len(x[1]) <= LONG], [x for x in pairs if len(x[1]) > LONG]
        known.update((piece, np.array(self.encode_piece(raw), "<u4").tobytes()) for piece, raw in long)
        for k in range(0, len(short), TOGETHER):
            pieces, raws = zip(*short[k : k + TOGETHER])
            known.update(zip(pieces, self.encode_pieces(raws), strict=True))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in texts]
        for piece, _ in long:
            del known[piece]
        if len(known) >= CACHE // 2:
            self.old, self.young = known, {}
        return out

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(self.pieces(text))
            size += len(text)
            if size >= SLICE:
                out += self._packed(held)
                held, size = [], 0
        return out + self._packed(held)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        every, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(every), DECODED):
            part = every[k : k + DECODED]
            sizes = self.token_size[part]
            stops = np.cumsum(sizes)
            out.append(self.token_bytes[np.repeat(self.token_at[part] - stops + sizes, sizes) + np.arange(stops[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_loaded: dict[str, BytePairs] = {}


def tokenizer(path: str) -> BytePairs:
    """One for each Python process; workers keep theirs, and its cache, from task to task."""
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]


DIGESTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encoded(docs: DataFrame, tokenizer_path: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids. The ids are decoded again for the last digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            ids = bpe.encode_all(t or "" for t in batch.column(1).to_pylist())
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids], pa.string()),
            ]
            if with_ids:
                offsets, at = [0], 0
                for x in ids:
                    offsets.append(at := at + len(x) // 4)
                values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(ids))])
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *DIGESTS, *(["ids"] if with_ids else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} {t}" for n, t in DIGESTS.items()) + (", ids array<int>" if with_ids else "")
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
