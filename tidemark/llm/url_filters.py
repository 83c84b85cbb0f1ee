"""URL filters: glob rules as one bit-parallel wildcard automaton.

All rules are packed, one bit a pattern position, into as many 64-bit words as they need. A step of
the Shift-And recurrence moves every position of every rule at once, for a whole batch of URLs:

    next = ((state << 1) & mask[symbol]) | (state & loops)

`loops` has the positions before a `*`. A URL is read as `.` + host + SEPARATOR + path, where
the separator is a symbol that no byte has, so a rule's host part can't match inside a path.

Two automata run: the rules', over host and path as they stand in the url, and the globs', over the canonical url: host without user, port and
trailing dots; host and path with percent-encoded bytes decoded, in lower case (A-Z), empty and `.` path steps left out. Rules and
globs come as objects or as a table of MAX_RULES rows at most (verdict, host, path).

Null urls and urls without `://` have an empty host and path, which no rule fits; the globs' verdict
holds for them (allow by default). Urls of any length are read whole; repeated rows and null ids are rows like others. Empty tables give
empty results; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = 256
ANY, STAR = -1, -2


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Most rows of a table of rules or globs; more raise an error.
MAX_RULES = 20_000
#: Most 64-bit words of the states of the urls that are matched at once.
CELLS = 1_000_000
#: The rules that the query applies, and globs for urls that no rule fits; the last one that fits decides.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
GLOBS = (Rule("block", "*casino*", "*"), Rule("block", "*spam-*", "*"), Rule("block", "*-spam*", "*"), Rule("block", "*", "*/casino/*"))


def symbols_of_rule(rule: Rule) -> list[int]:
    """`*.host` SEPARATOR `path*`: the host and its subdomains, any continuation of the path."""
    return [STAR, ord("."), *rule.host.encode(), SEPARATOR, *rule.path.encode(), STAR]


def symbols_of_glob(glob: Rule) -> list[int]:
    """`*` and `?` as in shells, over the whole host and the whole path."""
    signs = {ord("*"): STAR, ord("?"): ANY}
    host, path = ([signs.get(c, c) for c in part.encode()] for part in (glob.host, glob.path))
    return [ord("."), *host, SEPARATOR, *path]


def listed(rules: Sequence[Rule] | DataFrame) -> list[Rule]:
    """Rules as they are, or from the rows (verdict, host, path) of a table; null parts are empty."""
    if not isinstance(rules, DataFrame):
        return list(rules)
    rows = rules.select("verdict", "host", "path").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [Rule(r["verdict"], r["host"] or "", r["path"] or "") for r in rows]


class WildcardAutomaton:
    """All patterns at once. Each pattern has a start bit and one bit for each symbol."""

    def __init__(self, patterns: Sequence[Sequence[int]]):
        size = sum(1 + sum(s != STAR for s in p) for p in patterns)
        self.words = max(1, -(-size // 64))
        self.mask = np.zeros((SEPARATOR + 1, self.words), np.uint64)
        self.loops = np.zeros(self.words, np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.last: list[tuple[int, np.uint64]] = []
        at = 0
        for pattern in patterns:
            self._set(self.start, at)
            for s in pattern:
                if s == STAR:
                    self._set(self.loops, at)
                    continue
                at += 1
                if s == ANY:
                    for row in self.mask[:SEPARATOR]:
                        self._set(row, at)
                else:
                    self._set(self.mask[s], at)
            self.last.append((at // 64, np.uint64(1) << np.uint64(at % 64)))
            at += 1

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def match(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """A row for each text and a column for each pattern: does the pattern match all of the text?"""
        n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([texts[i] for i in order]) if n else np.zeros(0, np.int16)
        ends = np.cumsum(lengths[order])
        begins = ends - lengths[order]
        state = np.tile(self.start, (n, 1))
        active = n
        one, carry = np.uint64(1), np.uint64(63)
        for step in range(int(lengths.max(initial=0))):
            while active and lengths[order[active - 1]] <= step:
                active -= 1
            now = state[:active]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> carry
            state[:active] = (shifted & self.mask[flat[begins[:active] + step]]) | (now & self.loops)
        out = np.zeros((n, len(self.last)), bool)
        for k, (word, bit) in enumerate(self.last):
            out[order, k] = (state[:, word] & bit) != 0
        return out


_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = m.start() if (m := _HOST_END.search(rest)) else len(rest)
    path = rest[cut:]
    return rest[:cut].translate(_LOWER), path[: m.start()] if (m := _PATH_END.search(path)) else path


def symbols(host: bytes, path: bytes) -> np.ndarray:
    front, back = (np.frombuffer(x, np.uint8).astype(np.int16) for x in (b"." + host, path))
    return np.concatenate([front, np.array([SEPARATOR], np.int16), back])


def as_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


_PORT = re.compile(rb":[0-9]*$")
_LOWER_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def canonical(host: str, path: str) -> tuple[bytes, bytes]:
    """Host and path as the globs see them."""
    h = _PORT.sub(b"", unquote_to_bytes(as_bytes(host.rpartition("@")[2]))).rstrip(b".").translate(_LOWER_BYTES)
    p = unquote_to_bytes(as_bytes(path)).translate(_LOWER_BYTES)
    if b"//" in p or b"/." in p:
        steps = p.split(b"/")
        p = b"/".join([steps[0], *(s for s in steps[1:-1] if s not in (b"", b".")), *(b"" if s == b"." else s for s in steps[-1:])])
    return h, p


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame = RULES,
    globs: Sequence[Rule] | DataFrame = GLOBS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule (the longest that fits, else null), verdict.

    Where no rule fits, the last glob that fits decides, else the url is allowed. One row
    for each input row, repeated rows included.
    """
    rules, globs = listed(rules), listed(globs)
    longest_first = sorted(range(len(rules)), key=lambda i: -len(rules[i].name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, by_glob = WildcardAutomaton([*map(symbols_of_rule, rules)]), WildcardAutomaton([*map(symbols_of_glob, globs)])
        # states are urls times words, and hits urls times patterns: so many urls at a time keep both within bounds for any number of rules
        at_once = max(1, CELLS // max(by_rule.words, by_glob.words, (len(rules) + len(globs)) // 8))
        for batch in (b.slice(at, at_once) for b in batches for at in range(0, b.num_rows, at_once)):
            parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
            hit = by_rule.match([symbols(as_bytes(h), as_bytes(p)) for h, p in parts])
            first = [next((i for i in longest_first if row[i]), None) if row.any() else None for row in hit]
            names = [None if i is None else rules[i].name for i in first]
            verdicts = [None if i is None else rules[i].verdict for i in first]
            left = [k for k, i in enumerate(first) if i is None]
            for k, row in zip(left, by_glob.match([symbols(*canonical(*parts[k])) for k in left])):
                fits = np.flatnonzero(row)
                verdicts[k] = globs[fits[-1]].verdict if len(fits) else "allow"
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    rows = pages.select(id_col, F.col(url_col).cast("string").alias("__url"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
