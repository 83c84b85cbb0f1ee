"""Toxicity: a lexicon trie, intersected with Levenshtein automata, and scores of the context.

Learning, on labelled rows only, MAX_PER_CLASS of each class at most (those with the smallest hashes of their ids): words
and word stems that are surely likelier in toxic documents (the lower bound of their odds is above LEAST_ODDS) go into the lexicon, with
that bound's logarithm as weight, whatever their length or number. Copies share one vote: texts whose smallest and greatest hashes of three
neighbouring words agree count 1 together, or the rare words of a text that is copied often would look like terms; no row is left
out. Word counts are summed by Spark; what the driver gets is bounded by the words of the labelled rows.

Scoring: each distinct word runs through one deterministic automaton, the product of the lexicon's trie and the Levenshtein
automata of its words (one edit for words of FUZZY_FROM letters or more, not in the first letter), whose states are made when first reached.
A stem matches the start of a word, without edits. Words seen in harmless labelled documents don't match by
edits. Each place of a match counts by its context, a window of WINDOW words on either side: in quotation marks (on one line, of any length) or
beside words of report (MENTIONS) it counts QUOTED, else 1. The sum of weights, edits and contexts, as its logarithm,
goes through a logistic curve fitted to the same labelled rows.

Null and empty texts have no matches and the curve's value there, which is below 0.5 always. Null ids count as id '' (held out, hash remainder 0). Labels with null
id or mark are ignored; of repeated labels the higher mark holds. Without a labelled row of each kind, or without terms, the lexicon is empty and all
scores are the share of toxic rows (0.5 without rows), cut to 0.01 .. 0.49. Texts are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_names, settled, text_or_empty

MAX_PER_CLASS = 6000
#: Words of fewer letters are no terms; lengths of stems.
LEAST_LETTERS, STEMS = 3, (4, 5, 6)
FUZZY_FROM = 5
EDIT_WEIGHT = 0.6
QUOTED, WINDOW = 0.35, 4
#: A term stands in this many toxic documents at least (copies count once), is this many times likelier there by its estimate, and, with the deviations DEVIATIONS, by the lower bound.
MIN_DOCS, MIN_RATIO, LEAST_ODDS, DEVIATIONS = 4.0, 20.0, 5.0, 1.64
#: Words of report, and marks of quotation.
MENTIONS = frozenset("said says called calls quoted quote word term wrote dijo dit sagte".split())
MARKS = "\"“”«»„"

_WORD = re.compile(r"[^\W\d_]+")
#: Digits and signs that stand for letters, inside words.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "$": "s", "@": "a"})
_LEET_WORD = re.compile(r"(?<![\w$@])(?=[^\W\d_]*[013457$@])(?:[^\W_]|[$@]){4,}")


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    harmless: frozenset[str]
    slope: float = 0.0
    level: float = 0.0


class Lexicon:
    """The product automaton. A state is a set of (trie node, edits so far, may still insert); transitions are made when first needed."""

    def __init__(self, model: Model):
        self.model = model
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        for at, terms in ((self.word_at, model.words), (self.stem_at, model.stems)):
            for term in terms:
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                    node = self.children[node][c]
                at[node] = term
        # only nodes that lead to a word long enough may use their edit
        self.fuzzy = [False] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            self.fuzzy[node] = len(self.word_at.get(node, "")) >= FUZZY_FROM or any(self.fuzzy[x] for x in self.children[node].values())
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.next: list[dict[str, int]] = []
        self.begin = self._state(frozenset({(0, 0)}))
        self.memo: dict[str, tuple[float, str] | None] = {}

    def _state(self, nodes: frozenset) -> int:
        if nodes not in self.number:
            self.number[nodes] = len(self.states)
            self.states.append(nodes)
            self.next.append({})
        return self.number[nodes]

    def _step(self, state: int, c: str) -> int:
        """One letter: along the trie, or with an edit (replace, insert; deletions of the word's letters are taken before the letter)."""
        out = set()
        for node, edits in self.states[state]:
            kids = self.children[node]
            if c in kids:
                out.add((kids[c], edits))
            if edits == 0 and node and self.fuzzy[node]:
                out.add((node, 1))
                for kid in kids.values():
                    if self.fuzzy[kid]:
                        out.add((kid, 1))
                    if c in self.children[kid]:
                        out.add((self.children[kid][c], 1))
        exact = {n for n, e in out if e == 0}
        return self._state(frozenset((n, e) for n, e in out if e == 0 or n not in exact))

    def look_up(self, word: str) -> tuple[float, str] | None:
        """Weight and term of the best match of a word, or None."""
        got = self.memo.get(word, 0)
        if got != 0:
            return got
        state, best, model = self.begin, None, self.model
        for c in word:
            to = self.next[state].get(c)
            if to is None:
                to = self.next[state][c] = self._step(state, c)
            state = to
            nodes = self.states[state]
            if not nodes:
                break
            for node, edits in nodes:
                if edits == 0 and (stem := self.stem_at.get(node)) and (best is None or model.stems[stem] > best[0]):
                    best = (model.stems[stem], stem)
        else:
            for node, edits in self.states[state]:
                for end in (node, *(self.children[node].values() if edits == 0 and node and word not in model.words else ())):
                    term = self.word_at.get(end)
                    edited = edits or end != node
                    if term and (not edited or len(term) >= FUZZY_FROM and word not in model.harmless):
                        weight = model.words[term] * (EDIT_WEIGHT if edited else 1)
                        if best is None or weight > best[0]:
                            best = (weight, term)
        if len(self.memo) >= 300_000:
            self.memo.clear()
        self.memo[word] = best
        return best


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def raw_score(text: str, lexicon: Lexicon) -> float:
    """The sum over places of weight and context."""
    lower = text.lower()
    hits = {w: h for w in set(_WORD.findall(lower)) if (h := lexicon.look_up(w))}
    total = 0.0
    if hits:
        quoted, at = _quoted_spans(lower), 0
        places = list(_WORD.finditer(lower))
        for k, m in enumerate(places):
            if m[0] not in hits:
                continue
            while at < len(quoted) and quoted[at][1] <= m.start():
                at += 1
            inside = at < len(quoted) and quoted[at][0] < m.start()
            near = any(p[0] in MENTIONS for p in places[max(0, k - WINDOW) : k + WINDOW + 1])
            total += hits[m[0]][0] * (QUOTED if inside or near else 1)
    for m in _LEET_WORD.finditer(lower):
        if hit := lexicon.look_up(m[0].translate(_LEET)):
            total += hit[0] * EDIT_WEIGHT
    return total


def _quoted_spans(text: str) -> list[tuple[int, int]]:
    """Spans between marks of quotation on one line."""
    marks = [m.start() for m in re.finditer(f"[{MARKS}\n]", text)]
    spans, k = [], 0
    while k + 1 < len(marks):
        a, b = marks[k], marks[k + 1]
        if text[a] != "\n" and text[b] != "\n":
            spans.append((a, b))
            k += 2
        else:
            k += 1
    return spans


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, mark_col: str) -> DataFrame:
    """(toxic, text, weight): of each class the MAX_PER_CLASS with the smallest hashes. Texts of a class whose smallest and greatest hashes of three neighbouring words
    are the same are taken for copies of one another and share the weight 1."""
    marks = labels.where(F.col(mark_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(mark_col).cast("int")).alias("toxic"))
    marks = marks.where(~held_out("__id")).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    order = F.xxhash64(F.lit("train"), F.col("__id"))
    chosen = [marks.where(F.col("toxic") == k).orderBy(order, "__id").limit(MAX_PER_CLASS) for k in (0, 1)]
    few = settled(chosen[0].unionByName(chosen[1]), "marks")  # at most 2 * MAX_PER_CLASS rows
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text")).join(F.broadcast(few), "__id")
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")

    def ends(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.struct(F.array_min(hashes).alias("low"), F.array_max(hashes).alias("high"))

    rows = settled(rows.withColumn("__copy", F.element_at(F.transform(F.array(words), ends), 1)), "train")
    classes = rows.groupBy("__copy", "toxic").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    return rows.join(classes, ["__copy", "toxic"]).select("toxic", "text", "weight")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of documents with each word and stem, by mark: sums of this task's rows, sent on whenever they are many."""

    def send() -> pa.RecordBatch:
        keys = list(both[0].keys() | both[1].keys())
        return pa.RecordBatch.from_pydict({"kind": [k[0] for k in keys], "term": [k[1] for k in keys], "neg": [float(both[0][k]) for k in keys], "pos": [float(both[1][k]) for k in keys]}, schema=_COUNTED)

    both = Counter(), Counter()
    for batch in batches:
        for text, toxic, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "weight"))):
            words = {w for w in words_of(text) if len(w) >= LEAST_LETTERS}
            keys = {("word", w) for w in words} | {(f"stem{n}", w[:n]) for n in STEMS for w in words if len(w) > n}
            counts = both[toxic]
            for key in keys:
                counts[key] += weight
        if len(both[0]) + len(both[1]) > 300_000:
            yield send()
            both = Counter(), Counter()
    yield send()


_COUNTED = pa.schema([("kind", pa.string()), ("term", pa.string()), ("neg", pa.float64()), ("pos", pa.float64())])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark_col: str = "toxic") -> Model:
    rows = settled(training_rows(docs, labels, id_col, text_col, mark_col), "weighed")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    n_neg, n_pos = n.get(0, 0.0), n.get(1, 0.0)
    share = n_pos / (n_neg + n_pos) if n_neg + n_pos else 0.5
    flat = Model({}, {}, frozenset(), 0.0, _logit(min(max(share, 0.01), 0.49)))
    if not n_pos or not n_neg:
        return flat
    counts = rows.mapInArrow(_counts, "kind string, term string, neg double, pos double").groupBy("kind", "term").agg(F.round(F.sum("neg"), 6).alias("neg"), F.round(F.sum("pos"), 6).alias("pos"))
    odds = ((F.col("pos") + 0.5) / (n_pos + 1)) / ((F.col("neg") + 0.5) / (n_neg + 1))
    doubt = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    counts = settled(counts, "counts")
    least = F.ln(odds) - DEVIATIONS * doubt
    sure = (F.col("pos") >= MIN_DOCS) & (odds >= MIN_RATIO) & (least >= math.log(LEAST_ODDS))
    terms = counts.where(sure).withColumn("weight", F.least(least, F.lit(6.0)))
    terms = sorted(terms.collect(), key=lambda r: (-r["pos"], -r["weight"], r["kind"], r["term"]))  # words of the labelled rows, each in MIN_DOCS of them
    stems: dict[str, float] = {}
    for r in sorted((r for r in terms if r["kind"] != "word"), key=lambda r: len(r["term"])):
        if not any(r["term"][:k] in stems for k in STEMS):
            stems[r["term"]] = r["weight"]
    words = {r["term"]: r["weight"] for r in terms if r["kind"] == "word"}
    # a stem that only stands for a single word of the lexicon adds nothing; the words of another stem do not either
    pos = {(r["kind"], r["term"]): r["pos"] for r in terms}
    alone = {w[:k] for w in words for k in STEMS if w[:k] in stems and pos["word", w] >= 0.9 * pos[f"stem{k}", w[:k]]}
    stems = {s: w for s, w in stems.items() if s not in alone}
    words = {t: w for t, w in words.items() if not any(t[:k] in stems for k in STEMS)}
    if not words and not stems:
        return flat
    model = Model(words, stems, frozenset(), 1.0, 0.0)
    near = counts.where("kind = 'word' and neg > 0").select("term").mapInPandas(_near(model), "term string")
    model = Model(words, stems, frozenset(r["term"] for r in near.collect()), 1.0, 0.0)  # words of the labelled rows that are near a term
    seen = rows.select("toxic", scorer(model)("text").alias("x")).collect()  # two numbers for each training row
    slope, level = fit([math.log1p(_odds(r["x"])) for r in seen], [1 if r["toxic"] else 0 for r in seen])
    # without any match no text is taken for toxic, however many toxic ones the lexicon misses
    return Model(words, stems, model.harmless, slope, min(level, _logit(0.49)))


def _near(model: Model):
    """Words that the lexicon matches only by an edit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(model)
        for frame in frames:
            yield frame[[bool((h := lexicon.look_up(w)) and w != h[1] and not any(w[:k] in model.stems for k in STEMS)) for w in frame["term"]]]

    return run


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else (e := math.exp(x)) / (1 + e)


def _odds(score: float) -> float:
    """The sum of weights back from the score of an unfitted model (slope 1, level 0): sigmoid(log1p(sum))."""
    return max(0.0, score / (1 - score) - 1)


def fit(xs: Sequence[float], ys: Sequence[int], ridge: float = 0.05, steps: int = 200) -> tuple[float, float]:
    """Slope and level of a logistic curve, classes weighing the same, by Newton's method with a ridge on the slope."""
    n1 = sum(ys)
    w1, w0 = 0.5 / max(1, n1), 0.5 / max(1, len(ys) - n1)
    slope, level = 1.0, -1.0
    for _ in range(steps):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y in zip(xs, ys):
            p = _sigmoid(slope * x + level)
            w, d = (w1 if y else w0), max(p * (1 - p), 1e-6)
            g0, g1 = g0 + w * (p - y), g1 + w * (p - y) * x
            h00, h01, h11 = h00 + w * d, h01 + w * d * x, h11 + w * d * x * x
        g1, h11, h00 = g1 + 1e-3 * ridge * slope, h11 + 1e-3 * ridge, h00 + 1e-9
        det = h00 * h11 - h01 * h01
        if det <= 0:
            break
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        level, slope = level - max(-2.0, min(2.0, d0)), slope - max(-2.0, min(2.0, d1))
        if abs(d0) + abs(d1) < 1e-6:
            break
    return slope, level


def scorer(model: Model):
    """A column function: text to score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model)
        for texts in batches:
            yield texts.map(lambda t: _sigmoid(model.slope * math.log1p(raw_score(t or "", lexicon)) + model.level)).astype(float)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark_col: str = "toxic") -> DataFrame:
    """id, held_out, score, predicted of each row."""
    model = learn(docs, labels, id_col, text_col, mark_col)
    rows = docs.select(F.col(id_col).alias("__id"), held_out(id_col).alias("held_out"), scorer(model)(text_or_empty(text_col)).alias("score"))
    return rows.select(F.col("__id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark_col: str = "toxic") -> DataFrame:
    """The rows of docs scored below 0.5, with the columns of docs."""
    model = learn(docs, labels, id_col, text_col, mark_col)
    plain, name = plain_names(docs)
    return plain.withColumn("__score", scorer(model)(text_or_empty(name[text_col]))).where("__score < 0.5").drop("__score").toDF(*docs.columns)
