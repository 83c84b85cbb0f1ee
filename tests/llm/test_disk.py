"""What the operators leave in, and take of, the disk."""

import random
import re

import pyarrow as pa
import pytest
from conftest import SCHEMA
from test_corpus import brute_components, words

from tidemark.llm import bpe, common, exact_dedup, jaccard_join, queries


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def test_jaccard_shuffles_its_sets_once_and_its_elements_in_rounds(spark, monkeypatch):
    """Lists of ids too long to be broadcast, as on large tables."""
    rng = random.Random(31)
    texts = [" ".join(words(rng, 900)) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]] + texts[20:40] + [" ".join(t.split()[450:] + words(rng, 450)) for t in texts]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    took = []

    def measured(df, name):
        before = shuffle_bytes(spark)
        df.write.parquet(path := common.fresh_path(spark, name))
        took.append((sum(n for f, n in shuffle_bytes(spark).items() if f not in before), name))
        return spark.read.schema(df.schema).parquet(path)

    want = brute_components(rows, 5, 80)[1]
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(jaccard_join, "ROUND_ELEMENTS", 1000, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(jaccard_join, "settled", measured)
        assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame, 5, 80).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counted = 8 * sum(len(jaccard_join.counted(s, 80, len(s))) for s in (jaccard_join.shingles(t, 5) for t in texts))
    assert max(n for n, name in took if name in ("left", "here", "peeled")) < 1.5 * counted, (counted, sorted(took)[-9:])


@pytest.mark.parametrize("unique", [True, False])
def test_exact_dedup_leaves_no_copy_of_rows_with_ids_of_their_own(spark, doc_rows, unique):
    rows = [(k, *r[1:]) for k, r in enumerate(doc_rows)] if unique else doc_rows
    with common.Scratch(spark) as own:
        made = exact_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3))
        left = {p.rpartition("/")[2] for p in own.paths}
    assert left == ({"dropped"} if unique else {"rows", "dropped"})
    best = {}
    for r in rows:
        key, order = re.sub(r"[\x20\x09-\x0d]", "", r[1] or ""), (-len(r[1] or ""), r[0] is None, r[0] or 0)
        if key not in best or order < best[key][0]:
            best[key] = order, r
    width = len(rows[0]) if unique else 2  # rows with equal ids and texts may differ in what follows
    assert sorted(repr(tuple(r)[:width]) for r in made.collect()) == sorted(repr(r[:width]) for _, r in best.values())


def test_bpe_hands_on_a_batch_in_parts(spark, monkeypatch):
    frame = spark.createDataFrame([(k, " ".join(words(random.Random(k), k % 40))) for k in range(95)] + [(None, None)], "doc_id long, text string").coalesce(1)
    plain, made = bpe.encoded(frame, queries.tokenizer_path()).collect(), []
    monkeypatch.setattr(bpe, "ROWS", 10, raising=False)
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: made.append(run) or self)
    bpe.encoded(frame, queries.tokenizer_path())
    out = list(made[0](iter([pa.RecordBatch.from_arrays([pa.array([r[c] for r in frame.collect()], t) for c, t in (("doc_id", pa.int64()), ("text", pa.string()))], names=["doc_id", "text"])])))
    assert [b.num_rows for b in out] == [10] * 9 + [6] and [tuple(r.values()) for b in out for r in b.to_pylist()] == [tuple(r) for r in plain]
