"""Each stage of the pipeline against a brute-force version, over the smallest test tables and over odd rows."""

import hashlib
import os
import random
import re
import struct

import pytest
from test_corpus import brute_components, plain_score
from test_corpus import words as odd_words

import corpus_pipeline
from tidemark.llm import mixing, queries, toxicity
from tidemark.llm.common import clean_up, read_table

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0d]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, size string, gram string, weight string"


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def plain_toxicity(spark, rows, docs, sf):
    """Rows scored below 0.5, by the learnt lexicon and plain edit distances."""
    import math

    model = toxicity.learn(docs, read_table(spark, sf, "labels"))
    memo = {}

    def score(text):
        if text not in memo:
            memo[text] = toxicity._sigmoid(model.slope * math.log1p(plain_score(text, model)) + model.level)
        return memo[text]

    return [r for r in rows if score(r["text"] or "") < 0.5]


def plain_dedup(rows):
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0d]", "", r["text"] or "")
        order = -len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0
        if key not in best or order < best[key][0]:
            best[key] = order, r
    return [r for _, r in best.values()]


def plain_jaccard(rows):
    sets, component = brute_components([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    seen, out = set(), []
    for r in rows:
        if r["doc_id"] is None or component[r["doc_id"]] == r["doc_id"] and r["doc_id"] not in seen:
            out.append(r)
            seen.add(r["doc_id"])
    return out


def plain_mixture(rows):
    """Rows as often as the mix takes them."""
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total, share, left = sum(weight[s] for s in open_), left, 0.0
        for s in sorted(open_, key=str):
            target[s] += share * weight[s] / total
        for s in list(open_):
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    out = []
    for s in names:
        at, budget = 0, round(target[s])
        own = [r for r in rows if r["source"] == s]
        for r in sorted(own, key=lambda r: (hashlib.md5(f"mix:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), len(words(r["text"])))):
            n = len(words(r["text"]))
            taken = sum(max(0, min(n, budget - at - e * sizes[s])) for e in range(3))
            at += n
            out += [r] * (int((taken + n / 2) // n) if n else 1)
    return out


def same(got, want):
    key = lambda r: tuple((v is None, str(v)) for v in r.values())
    assert sorted(map(key, got)) == sorted(map(key, want))


def check(spark, docs, sf):
    from tokenizers import Tokenizer

    now = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [r.asDict() for r in now.collect()]
        out = stage(spark, now, sf)
        assert out.columns == docs.columns
        got = [r.asDict() for r in out.collect()]
        want = {"toxicity": lambda: plain_toxicity(spark, rows, now, sf), "exact dedup": lambda: plain_dedup(rows), "n-gram Jaccard join": lambda: plain_jaccard(rows), "mixing sources to target weights": lambda: plain_mixture(rows)}[name]()
        same(got, want)
        now = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in got], docs.schema)
    t = Tokenizer.from_file(queries.tokenizer_path())
    last = [r.asDict() for r in corpus_pipeline.bpe_stage(spark, now, sf).collect()]
    want = []
    for r in now.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want.append({"doc_id": r["doc_id"], "n_tokens": len(ids), "ids_sha256": hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(), "ids": ids})
    same(last, want)
    return last


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_over_the_test_tables(spark):
    last = check(spark, read_table(spark, SF, "documents"), SF)
    same([r.asDict() for r in corpus_pipeline.run(spark, SF).collect()], last)
    assert last and clean_up(spark) > 0 and clean_up(spark) == 0


def test_stages_over_odd_rows(spark, doc_rows, tmp_path):
    """Nulls in each column, empty and long texts, copies, near copies, repeated rows and ids, columns whose names clash; few labels."""
    rng = random.Random(20)
    rows = [(*r, "w") for r in doc_rows] + [(900 + k, " ".join(["you", "wretchling", *odd_words(rng, 12)]), "en", "s1", 1, None, None, None, None, None) for k in range(1, 40)]
    spark.createDataFrame([(r[0], int(r[0] >= 900), 1) for r in rows if r[0] is not None], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    last = check(spark, docs, str(tmp_path))
    assert last and all(r["doc_id"] is None or r["doc_id"] < 900 for r in last)


def test_stages_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert check(spark, spark.createDataFrame([], COLUMNS), str(tmp_path)) == []


def test_without_terms_nothing_is_toxic(spark):
    """Toxic rows that are copies of one text teach no term."""
    docs = spark.createDataFrame([(k, "one and the same" if k % 2 else f"text {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels).collect()} == {0}


def test_mixing_keeps_what_costs_nothing(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s"), (3, " ", "t"), (4, "a " * 90, "u")], "doc_id int, text string, source string")
    assert {1, 2, 3} <= {r["doc_id"] for r in mixing.mixture(df).collect()}
