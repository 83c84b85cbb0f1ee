"""Each operator against a brute-force version, on rows with nulls, copies, repeated ids, long texts, and on an empty table."""

import base64
import collections
import hashlib
import random
import re
import struct
import zlib
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, fingerprints, jaccard_join, license_scan, mixing, queries, sharding, toxicity, url_filters, warc
from tidemark.llm.components import components

SPACE = re.compile(rb"[\x20\x09-\x0d]+")


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n)]


def ran(df):
    return [r.asDict() for r in df.collect()]


def gram_sets(rows, n):
    out = collections.defaultdict(list)
    for i, t, *_ in rows:
        w = [x for x in SPACE.split((t or "").encode().lower()) if x]
        out[i].append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def brute_components(rows, n, per_cent):
    sets = gram_sets([r for r in rows if r[0] is not None], n)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for a in range(len(flat)):
        for b in range(a):
            (i, s), (j, t) = flat[a], flat[b]
            c = len(s & t)
            if 100 * c >= per_cent * (len(s) + len(t) - c):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return sets, {i: top(i) for i in up}


@pytest.mark.parametrize("n,per_cent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard(docs, doc_rows, n, per_cent):
    sets, want = brute_components(doc_rows, n, per_cent)
    got = ran(jaccard_join.jaccard_components(docs, n, per_cent))
    assert len(got) == len(doc_rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == 1 if n > 1 else 2
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def test_jaccard_random_edits(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(25):
        base = [f"w{rng.integers(0, 400)}" for _ in range(int(rng.integers(5, 150)))]
        for _ in range(int(rng.integers(1, 9))):
            t = list(base)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(0, len(t)))] = f"e{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(t + ["tail"] * int(rng.integers(0, 3)))))
    for n, per_cent in ((4, 85), (2, 70)):
        want = brute_components(rows, n, per_cent)[1]
        got = {r["doc_id"]: r["component_id"] for r in ran(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, per_cent))}
        assert got == want


def test_jaccard_large_blocks_are_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MAX_BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "HUBS", 2)
    rows = [(k, " ".join([f"c{j}" for j in range(60)] + [f"u{k}"])) for k in range(40)] + [(100 + k, " ".join(f"d{j}" for j in range(30 + k))) for k in range(12)]
    # a chain whose ends don't link; and sets with a common half that don't link at all
    rows += [(200 + k, " ".join(f"e{j}" for j in range(2 * k, 2 * k + 50))) for k in range(25)] + [(300 + k, " ".join([f"f{j}" for j in range(40)] + [f"g{k}x{j}" for j in range(40)])) for k in range(15)]
    want = brute_components(rows, 3, 80)[1]
    got = {r["doc_id"]: r["component_id"] for r in ran(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80))}
    assert got == want


def test_jaccard_bounds_blocks_in_elements(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MAX_ELEMENTS", 300)
    rows = [(k, " ".join([f"c{j}" for j in range(60)] + [f"u{k}"])) for k in range(30)] + [(50 + k, " ".join(f"d{j}" for j in range(100 + k))) for k in range(9)]
    want = brute_components(rows, 3, 80)[1]
    assert {r["doc_id"]: r["component_id"] for r in ran(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80))} == want


def test_words_that_collide_under_polynomials_stay_apart():
    """A Thue-Morse word and its complement have one polynomial hash modulo any power of two."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        if len(word) >= 64:
            other = word.translate(str.maketrans("ab", "ba"))
            assert jaccard_join.shingles(word, 1)[0] != jaccard_join.shingles(other, 1)[0]


@pytest.mark.parametrize("per_cent", [85, 80, 50])
def test_part_keys_meet_linked_sets_and_no_others(per_cent):
    rng = np.random.default_rng(3)
    draw = lambda k: np.unique(rng.integers(0, 2**64, k, dtype=np.uint64))
    for size in (1, 2, 3, 5, 6, 7, 8, 11, 20, 33, 90):
        for _ in range(150):
            a = draw(size)
            drop, more = int(rng.integers(0, size)), int(rng.integers(0, size))
            while 100 * (size - drop) < per_cent * (size + more):
                drop, more = drop * 2 // 3, more * 2 // 3
            b = np.unique(np.concatenate([a[drop:], draw(more)]))
            assert len(np.intersect1d(jaccard_join.part_keys(a, per_cent), jaccard_join.part_keys(b, per_cent))), (size, drop, more)
        # unrelated sets don't share a key, however many there are
        keys = collections.Counter(k for _ in range(600) for k in set(jaccard_join.part_keys(draw(size), per_cent).tolist()))
        assert max(keys.values()) == 1


def test_repeated_ids_with_different_texts_keep_all_links(spark):
    """An id whose first row is a copy of a smaller id's text, and whose other text links elsewhere."""
    t = lambda p, k: " ".join(f"{p}{j}" for j in range(k))
    rows = [(1, t("a", 40)), (2, t("a", 40)), (2, t("b", 40)), (3, t("b", 40) + " x"), (4, t("b", 40)), (9, t("c", 30)), (None, t("c", 30))]
    got = {r["doc_id"]: r["component_id"] for r in ran(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80))}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9, None: None}


def test_trie_prunes_nothing_that_links():
    rng = np.random.default_rng(7)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(15)]
        up = list(range(15))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in range(15):
            for b in range(a):
                c = len(np.intersect1d(sets[a], sets[b]))
                if 100 * c >= 60 * (len(sets[a]) + len(sets[b]) - c):
                    up[top(a)] = top(b)
        found = list(range(15))

        def ftop(x):
            while found[x] != x:
                x = found[x]
            return x

        for a, b in jaccard_join.block_links(sets, [len(s) for s in sets], 60):
            found[ftop(a)] = ftop(b)
        group = lambda f: {frozenset(j for j in range(15) if f(j) == f(i)) for i in range(15)}
        assert group(top) == group(ftop)


def test_one_of_each(docs, doc_rows):
    want = brute_components(doc_rows, 5, 80)[1]
    got = ran(jaccard_join.one_of_each(docs))
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(i for i, c in want.items() if i == c)
    assert sum(r["doc_id"] is None for r in got) == 1 and set(got[0]) == set(docs.columns)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (5, 5), (3, 1), (20, 21)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["node"]: r["component"] for r in ran(components(spark.createDataFrame(edges, "a long, b long")))}
    assert got[3] == got[2] == got[1] == 1 and got[10] == got[9] == 8 and got[140] == 100 and 5 not in got


def test_exact_dedup(docs, doc_rows):
    got = ran(exact_dedup.exact_dedup(docs))
    assert len(got) == len(doc_rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in doc_rows:
        groups[norm(t)].append((-len(t or ""), i is None, i, t))
    sha = {hashlib.sha256(n.encode()).hexdigest(): sorted(g, key=lambda x: (x[0], x[1], x[2] or 0)) for n, g in groups.items()}
    for r in got:
        g = sha[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["keep_id"] == g[0][2]
    assert sum(r["kept"] for r in got) == len(groups)
    kept = ran(exact_dedup.deduplicated(docs))
    assert sorted(norm(r["text"]) for r in kept) == sorted(groups) and set(kept[0]) == set(docs.columns)


def test_block_names_tell_all_lengths_apart(spark):
    texts = ["a" * k for k in (0, 1, 2047, 2048, 2049, 4095, 4096, 4097, 6144, 8192, 8193, 10_000)] * 2 + ["a" * 2048 + "b" * 2048, "b" * 2048 + "a" * 2048]
    got = ran(exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {r["doc_id"]: r["group_size"] for r in got} == {k: texts.count(t) for k, t in enumerate(texts)}


def test_names_are_places_in_the_order(spark):
    """The same for any partitioning, from 0 without gaps; and a head that all blocks share, or a block that many rows have, goes to no single task."""
    rng = random.Random(9)
    head = "<html>" * 20
    texts = [head + "".join(rng.choices("abcd", k=12)) for _ in range(3000)] + [head + "same"] * 3000 + [""] * 500
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = []
    for n in (2, 7):
        rows, identity = exact_dedup.identities(df.repartition(n), keep=("doc_id",))
        names.append({r["doc_id"]: (r["__round"], r["__name"]) for r in ran(rows.join(identity, "__rid").select("doc_id", "__round", "__name"))})
    assert names[0] == names[1]
    place = {t: k for k, t in enumerate(sorted(set(texts)))}
    assert names[0] == {k: (0, place[t]) for k, t in enumerate(texts)}
    blocks = df.select(F.encode("text", "utf-8").alias("__block")).distinct()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = exact_dedup._in_order(blocks, ["__block"], [F.col("__block")], "test").groupBy("__part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["count"] for r in parts)
    assert len(sizes) > 1 and sizes[-1] <= 4 * sizes[len(sizes) // 2]


def test_mixing(docs, doc_rows):
    got = ran(mixing.mix_report(docs))
    assert len(got) == len(doc_rows)
    size = collections.Counter()
    for _, t, _, s, *_ in doc_rows:
        size[s] += len([x for x in SPACE.split((t or "").encode()) if x])
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), float(sum(size.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] > 3 * size[s]:
                left += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
                open_.discard(s)
    taken = collections.Counter()
    for r in got:
        (s,) = {x for x in names if size[x] == r["source_size"] and abs(target[x] - r["target"]) < 1e-6}
        taken[s] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = ran(mixing.mix_report(docs.repartition(5)))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(got, key=key) == sorted(again, key=key)
    assert set(mixing.mixture(docs).columns) == set(docs.columns)


def test_sharding(docs, doc_rows):
    got = ran(sharding.shard_rows(docs, 8))
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in doc_rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in ran(sharding.shard_rows(docs.repartition(7), 8))}
    assert again == {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("long"), 11)).collect()]
    assert sorted(got) == list(range(n)) and (n < 50 or got != sorted(got))


def plain_simhash(t, hashes):
    """Bits set by more than half of the pairs' votes; hashes: (seed, word, next word or None) to 64 bits."""
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
    pairs = [(w[0], None)] if len(w) == 1 else list(zip(w, w[1:]))
    out = []
    for k in range(fingerprints.BITS // 64):
        votes = [0] * 64
        for a, b in pairs:
            h = hashes[k, a, b]
            for bit in range(64):
                votes[bit] += h >> bit & 1
        out.append(sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(pairs)))
    return "".join(f"{x:016x}" for x in out)


def test_fingerprints(spark, docs, doc_rows):
    got = ran(fingerprints.fingerprint_report(docs, query_mod=10))
    long = [r for r in doc_rows if len(r[1] or "") >= 5000]
    assert len(long) == 2
    # order of rows with equal ids: any in which each row of the report follows another
    order = sorted(((i, t or "") for i, t, *_ in doc_rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    edits = collections.defaultdict(set)
    for k, (i, t) in enumerate(order):
        cut = len(t) // 3
        later = [x for x in order[k + 1 :] if x[0] != i][:1] or [order[0]]
        nexts = [x for x in order if x[0] == i] + [x for x in order if x[0] == later[0][0]]
        edits[i, t] |= {t[: len(t) - cut] + a[:cut] for _, a in nexts}
    shas = {k: {hashlib.sha256(e.encode()).hexdigest(): e for e in v} for k, v in edits.items()}
    assert collections.Counter((r["doc_id"], r["n_chars"]) for r in got) == collections.Counter((i, len(t or "")) for i, t, *_ in doc_rows)
    ids = {i: [t or "" for j, t, *_ in doc_rows if j == i] for i, *_ in doc_rows}
    texts = {}
    for r in got:
        (edited,) = {shas[r["doc_id"], t][r["edited_sha256"]] for t in ids[r["doc_id"]] if r["edited_sha256"] in shas[r["doc_id"], t] and len(t) == r["n_chars"]}
        (texts[r["doc_id"], r["edited_sha256"]],) = {(t, edited) for t in ids[r["doc_id"]] if len(t) == r["n_chars"] and r["edited_sha256"] in shas[r["doc_id"], t]}
    # fingerprints, bit by bit
    all_texts = {x for pair in texts.values() for x in pair}
    pairs = set()
    for t in all_texts:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
        pairs |= {(w[0], None)} if len(w) == 1 else set(zip(w, w[1:]))
    frame = spark.createDataFrame(list(pairs), "a string, b string")
    hashes = {}
    for r in frame.select("a", "b", *[F.xxhash64(F.lit(k), "a", "b").alias(f"h{k}") for k in range(fingerprints.BITS // 64)]).collect():
        for k in range(fingerprints.BITS // 64):
            hashes[k, r["a"], r["b"]] = r[f"h{k}"] & (2**64 - 1)
    bits = {t: plain_simhash(t, hashes) for t in all_texts if len(t) < 5000 or t.count(" ") < 5}
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    by_fp = collections.defaultdict(list)
    for r in got:
        t, edited = texts[r["doc_id"], r["edited_sha256"]]
        assert t not in bits or r["fingerprint"] == bits[t]
        assert edited not in bits or r["edited_fingerprint"] == bits[edited]
        assert r["near_edited"] == pytest.approx(1 - apart(r["fingerprint"], r["edited_fingerprint"]) / fingerprints.BITS)
        by_fp[r["doc_id"]].append(r["fingerprint"])
        same = [x["doc_id"] for x in got if x["fingerprint"] == r["fingerprint"]]
        assert r["class_id"] == min((i for i in same if i is not None), default=None)
    # the next document's likeness, where both ids stand once; and the search, against all pairs
    alone = [i for i, _ in order if i is not None and len(ids[i]) == 1]
    for r in got:
        if r["doc_id"] in alone:
            later = [i for i, _ in order[[x[0] for x in order].index(r["doc_id"]) + 1 :]]
            if later and later[0] in alone:
                assert r["near_next"] == pytest.approx(1 - apart(r["fingerprint"], by_fp[later[0]][0]) / fingerprints.BITS)
        if r["doc_id"] is not None and r["doc_id"] % 10 == 0:
            near = [x["doc_id"] for x in got if apart(x["fingerprint"], r["fingerprint"]) <= fingerprints.RADIUS]
            heads = {x["class_id"] for x in got if apart(x["fingerprint"], r["fingerprint"]) <= fingerprints.RADIUS}
            assert r["n_near"] == len(near) and r["near_ids"] == sorted(i for i in heads if i is not None)
        else:
            assert r["n_near"] is None and r["near_ids"] is None


def test_ranges_of_ids_are_even(spark):
    """Ids in far clusters, one id and null that hold many rows each: the order is kept and no range holds much more than its share."""
    rows = [(k,) for k in range(2000)] + [(10**15 + 7 * k,) for k in range(500)] + [(5000,)] * 1500 + [(None,)] * 700 + [(-3,)]
    df = spark.createDataFrame(rows, "__id long").withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    df = spark.createDataFrame(df.collect(), "__id long, __tie long")
    got = [(r["__id"], r["__tie"], r["r"]) for r in df.select("__id", "__tie", fingerprints._ranges(df).alias("r")).collect()]
    got.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [r for *_, r in got] == sorted(r for *_, r in got)
    n = fingerprints.RANGES_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(collections.Counter(r for *_, r in got).values()) <= 2.5 * len(rows) / n


def test_fingerprint_votes_are_counted_exactly(spark, monkeypatch):
    text = " ".join(f"w{k % 7}" for k in range(5000))
    df = spark.createDataFrame([(1, text)], "id int, t string")
    a = ran(fingerprints.fingerprints(df, ["id"], F.col("t")))[0]["__fp"]
    monkeypatch.setattr(fingerprints, "CHUNK", 13)
    assert ran(fingerprints.fingerprints(df, ["id"], F.col("t")))[0]["__fp"] == a


def test_block_tables_find_all_within_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, (30, 2))
    fps = [list(map(int, b)) for b in base]
    for b in base[:10]:
        for flips in range(1, 6):
            x = [int(b[0]), int(b[1])]
            for bit in map(int, rng.choice(128, flips, replace=False)):
                v = (x[bit // 64] ^ (1 << (bit % 64))) & (2**64 - 1)
                x[bit // 64] = v - 2**64 if v >> 63 else v
            fps.append(x)
    df = spark.createDataFrame([(f,) for f in fps], "__fp array<long>")
    dist = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))
    for radius in (0, 3, 4):
        got = {(tuple(r["__q"]), tuple(r["__fp"])) for r in ran(fingerprints.within_radius(df, df, radius))}
        assert got == {(tuple(a), tuple(b)) for a in fps for b in fps if dist(a, b) <= radius}


def test_radius_search_with_flipped_bits_finds_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, (4, 2), dtype=np.uint64)
    words = [b for b in base]
    for b in base:
        for flips in (1, 7, 12, 17, 19, 20, 21, 22, 25) * 3:
            x = b.copy()
            for bit in rng.choice(128, flips, replace=False):
                x[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            words.append(x)
    fps = [tuple(map(int, w.view(np.int64))) for w in words]
    df = spark.createDataFrame([(list(f),) for f in fps], "__fp array<long>")
    want = collections.Counter((a, b, d) for a, x in zip(fps, words) for b, y in zip(fps, words) if (d := int(np.bitwise_count(x ^ y).sum())) <= 20)
    for light in (2000, 5):
        monkeypatch.setattr(fingerprints, "LIGHT", light)
        assert collections.Counter((tuple(r["__q"]), tuple(r["__fp"]), r["distance"]) for r in ran(fingerprints.within_radius(df, df, 20))) == want
    for flips in (0, 1, 2, 4):
        for radius in (0, 3, 20, 24):
            plan = fingerprints.block_plan(radius, flips)
            assert sum(allowed + 1 for *_, allowed in plan) == radius + 1


def test_fingerprint_report_finds_near_copies(spark):
    """Copies of 200 and 1,000 words with words changed until their five-word shingles are about 0.8 alike."""
    rng, rows, want = random.Random(3), [], {}
    for k in range(20):
        n = (200, 1000)[k % 2]
        a = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
        b = list(a)
        for p in range(20, n, 50):
            b[p] = "zz" + b[p]
        rows += [(100 * k, " ".join(a)), (100 * k + 1, " ".join(b))]
        want[100 * k] = [100 * k, 100 * k + 1]
    got = {r["doc_id"]: r for r in ran(fingerprints.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")))}
    found = [got[i]["near_ids"] == ids for i, ids in want.items()]
    assert sum(found) >= 18 and all(r["n_near"] == len(r["near_ids"]) if i in want else r["near_ids"] is None for i, r in got.items())


def test_license_scan(docs, doc_rows, spark):
    assert len(ran(license_scan.scan_licenses(docs))) == len(doc_rows)
    cases = {
        "GNU\nGeneral, Public License mit License MIT license": (8, 3, 0, 6, "gpl,mit", {"gpl", "mit"}), "cc-by-nc 4.0": (5, 1, 0, 0, "cc-by", {"cc-by", "cc-by-nc"}), "summit license": (2, 0, None, None, "", set()),
        "// SPDX-License-Identifier: (MIT OR GPL-2.0+) AND BSD-3-Clause": (12, 0, None, None, "", {"mit", "gpl-2.0", "bsd-3-clause"}), "": (0, 0, None, None, "", set()),
    }
    got = {r["t"]: r for r in ran(license_scan.scan_licenses(spark.createDataFrame([(t, t) for t in cases], "t string, text string"), id_col="t"))}
    for t, (n, k, first, last, base, labels) in cases.items():
        r = got[t]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, k, first, last, base) and labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def plain_licenses(text):
    """Word by word: n_words, places, base labels, and the notices' labels."""
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    find = lambda phrase: [k for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.encode().split()]
    places = {p: find(p) for p in [*license_scan.BASE, *license_scan.NOTICES]}
    starts = sorted(k for p in license_scan.BASE for k in places[p])
    base = {license_scan.BASE[p] for p in license_scan.BASE if places[p]}
    missing = 1.0
    for p, at in places.items():
        missing *= (1 - (license_scan.BASE_SURE if p in license_scan.BASE else license_scan.NOTICES[p][1])) ** len(at)
    return len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, base, base | {license_scan.NOTICES[p][0] for p in license_scan.NOTICES if places[p]}, 1 - missing


def test_license_scan_against_word_by_word_search(spark, docs, doc_rows):
    rng = random.Random(11)
    pool = [w for p in [*license_scan.BASE, *license_scan.NOTICES] for w in p.split()] + ["é", "漢字", "under", "x1", "LICENSE", "Apache"]
    texts = [rng.choice([" ", "\n", ", ", "-", "\u00a0"]).join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(400)] + [(t or "") for _, t, *_ in doc_rows]
    texts += [rng.choice([*license_scan.BASE, *license_scan.NOTICES]).upper() + sep + rng.choice([*license_scan.BASE, *license_scan.NOTICES]) for sep in (" ", "/", "x", "\x7f", "\u0130") for _ in range(30)]
    got = {r["k"]: r for r in ran(license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), id_col="k"))}
    for k, t in enumerate(texts):
        r = got[k]
        names = lambda c: set(r[c].split(",")) - {""}
        seen = r["n_words"], r["n_base"], r["first_word"], r["last_word"], names("base_labels"), names("labels"), pytest.approx(r["score"])
        assert seen == plain_licenses(t) and r["labels"] == ",".join(sorted(names("labels"))), t


def test_license_expressions_of_any_length():
    names = [f"lic-{k}" for k in range(199)]
    for text in (" OR ".join(["MIT", *names]), "(" + " AND ".join(["MIT", *names]) + ")"):
        assert license_scan.read_expression(text) == ({"mit", *names}, " OR " in text)
        assert license_scan.read_expression(text + " and more prose follows here") == ({"mit", *names}, " OR " in text)
    assert license_scan.read_expression("MIT OR " + " OR ".join(names[:40]) + " AND GPL-3.0") == ({"mit", *names[:40], "gpl-3.0"}, True)
    assert license_scan.read_expression("(MIT OR " + " OR ".join(names[:40]) + ") AND GPL-3.0") == ({"mit", *names[:40], "gpl-3.0"}, False)
    many = [f"n-{k}" for k in range(50_000)]
    assert license_scan.read_expression(" AND ".join(many)) == (set(many), False)
    rng = random.Random(4)
    for _ in range(3000):
        tokens = rng.choices(["MIT", "GPL-2.0+", "x-1", "Some-Terms", "prose", "AND", "or", "WITH", "(", ")"], k=rng.randint(0, 9))
        want, n = (set(), None), 0
        for n in range(len(tokens), -1, -1):
            try:
                if n and "prose" not in tokens[:n]:
                    want = license_scan.evaluate(license_scan.to_postfix(" ".join(tokens[:n])))
                    break
            except ValueError:
                continue
        tail = tokens[n : tokens.index("prose", n) if "prose" in tokens[n:] else None]
        if tail and not (tail == ["or"] and len(tokens) > n + 1):
            want = want[0] | {t.lower().rstrip("+") for t in tail if t in ("MIT", "GPL-2.0+", "x-1", "Some-Terms")}, False if want[1] is False else None
        assert license_scan.read_expression(" ".join(tokens)) == want, tokens


def test_license_expressions_that_are_cut_are_never_permissive(spark):
    for text, names, holds in [
        ("MIT AND GFDL-1.3-invariants-only", {"mit", "gfdl-1.3-invariants-only"}, None), ("MIT AND BSD-3-Clause-No-Nuclear-License", {"mit", "bsd-3-clause-no-nuclear-license"}, None), ("Apache-2.0 AND (MIT OR CC-BY-3.0-US)", {"apache-2.0", "mit", "cc-by-3.0-us"}, True),
        ("Apache-2.0 AND (GPL-3.0 OR CC-BY-3.0-US)", {"apache-2.0", "gpl-3.0", "cc-by-3.0-us"}, None), ("MIT-Festival", {"mit-festival"}, None), ("GPL-3.0-linking-exception", {"gpl-3.0-linking-exception"}, None), ("CC-BY-3.0-US", {"cc-by-3.0-us"}, None),
        ("MIT AND", {"mit"}, None), ("MIT AND Proprietary", {"mit"}, None), ("MIT AND (ISC OR", {"mit", "isc"}, None), ("MIT Some-Terms", {"mit", "some-terms"}, None), ("GPL-3.0 AND", {"gpl-3.0"}, False), ("MIT WITH Commons-Clause", {"mit", "commons-clause"}, None), ("MIT.", {"mit"}, True),
        ("MIT and so forth", {"mit"}, True), ("MIT https://example.org/mit-1", {"mit"}, True), ("MIT OR Some-Terms", {"mit", "some-terms"}, True), ("GPL-2.0 AND Some-Terms", {"gpl-2.0", "some-terms"}, False), ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl-2.0"}, False), ("see the file", set(), None),
    ]:
        assert license_scan.read_expression(text) == (names, holds), text
        row = license_scan.scan(f"# SPDX-License-Identifier: {text}", license_scan.automaton())
        assert names <= set(row["labels"].split(",")) | {""} and row["permissive"] is holds
    terms = license_scan.Vocabulary.of(spark.createDataFrame([("Éxotic  own licence", "own", 0.5)], "phrase string, label string, sure double"), spark.createDataFrame([("Some-Terms", True), ("MIT", False)], "identifier string, permissive boolean"))
    (r,) = ran(license_scan.scan_licenses(spark.createDataFrame([(1, "Under the éxotic, OWN licence. boost software license\nSPDX-License-Identifier: Some-Terms".replace("é", "É"))], "doc_id long, text string"), terms=terms))
    assert r["labels"] == "own,some-terms" and r["permissive"] is True


def test_license_tags_are_read_once_each_and_without_prose():
    import time

    phrases = license_scan.automaton()
    scan = lambda t: license_scan.scan(t, phrases)
    assert scan("SPDX-License-Identifier: MIT and so forth")["labels"] == "mit" and scan("SPDX-License-Identifier: see the file")["labels"] == ""
    two = scan("# SPDX-License-Identifier: MIT OR GPL-3.0-or-later\n# SPDX-License-Identifier: LicenseRef-Own AND ISC\n")
    assert two["labels"] == "gpl-3.0-or-later,isc,licenseref-own,mit" and two["permissive"] is False and two["score"] == pytest.approx(1 - 0.05**2)
    took = []
    for n in (2000, 16_000):
        began = time.perf_counter()
        assert scan("// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\n" * n)["permissive"] is True
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


def test_shunting_yard():
    assert license_scan.to_postfix("a OR b AND c WITH d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert license_scan.evaluate(license_scan.to_postfix("(MIT OR GPL-2.0) AND Apache-2.0")) == ({"mit", "gpl-2.0", "apache-2.0"}, True)
    assert license_scan.evaluate(license_scan.to_postfix("GPL-2.0 WITH Classpath-exception-2.0 OR ISC")) == ({"gpl-2.0", "isc"}, True)
    assert license_scan.evaluate(license_scan.to_postfix("MIT AND GPL-3.0")) == ({"mit", "gpl-3.0"}, False)
    for bad in ("", "AND a", "a b", "(a", "a)", "a OR"):
        with pytest.raises(ValueError):
            license_scan.to_postfix(bad)


def test_bpe(docs, doc_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in ran(bpe.encoded(docs, queries.tokenizer_path(), with_ids=False)))
    want = collections.Counter()
    for i, x, *_ in doc_rows:
        e = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(e), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest(), hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    ids = {r["doc_id"]: r["ids"] for r in ran(bpe.encoded(docs.where("doc_id < 5"), queries.tokenizer_path()))}
    assert all(ids[i] == t.encode(x, add_special_tokens=False).ids for i, x, *_ in doc_rows[:5])


def test_bpe_special_strings_and_odd_pieces():
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(queries.tokenizer_path()), bpe.BytePairs(queries.tokenizer_path())
    for x in ("a<|endoftext|>b <|endoftext|>", "  \n\n x ", "don't we'll", "  x", "aaaaaaaaaaaaaaaaaaaaa" * 40, "1234567890" * 9, "<|endoftext|", "𝒳é́"):
        e = t.encode(x, add_special_tokens=False).ids
        assert list(memoryview(b.encode(x)).cast("I")) == e and b.decode(b.encode(x)) == t.decode(e, skip_special_tokens=False)


def small_bpe(path, rng, n_merges):
    """A tokenizer file with random merges, many of which are never made or made in two ways."""
    import json

    vocab = {c: k for k, c in enumerate(sorted(bpe.byte_letters()))}
    merges, tokens = [], list("abc")
    while len(merges) < n_merges:
        pair = rng.choice(tokens), rng.choice(tokens)
        if pair not in merges and len(pair[0] + pair[1]) < 9:
            merges.append(pair)
            vocab.setdefault(pair[0] + pair[1], len(vocab))
            tokens.append(pair[0] + pair[1])
    pre = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": pre, "post_processor": None, "decoder": pre, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [list(m) for m in merges]}}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    return spec


def test_bpe_of_random_merges(tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    for k in range(40):
        path = str(tmp_path / f"{k}.json")
        small_bpe(path, rng, rng.randint(1, 40))
        theirs, ours = Tokenizer.from_file(path), bpe.BytePairs(path)
        for _ in range(60):
            text = "".join(rng.choices("abc", k=rng.randint(1, 25)))
            assert list(memoryview(ours.encode(text)).cast("I")) == theirs.encode(text, add_special_tokens=False).ids, (k, text)


def test_bpe_encodes_pieces_together_as_one_at_a_time(tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    for name, value in (("SLICE", 300), ("TOGETHER", 7), ("DECODED", 5), ("CACHE", 40), ("LONG", 12), ("_FIT_BITS", 3)):
        monkeypatch.setattr(bpe, name, value)
    for k in range(12):
        path = str(tmp_path / f"{k}.json")
        small_bpe(path, rng, rng.randint(1, 40))
        theirs, ours = Tokenizer.from_file(path), bpe.BytePairs(path)
        texts = ["".join(rng.choices("aaabbbcc ü\x00", k=rng.choice([0, 1, 5, 30, 200]))) for _ in range(60)]
        for text, got in zip(texts, ours.encode_all(texts), strict=True):
            want = theirs.encode(text, add_special_tokens=False).ids
            assert list(memoryview(got).cast("I")) == want and ours.decode(got) == theirs.decode(want, skip_special_tokens=False), (k, text)
        pieces = ["".join(rng.choices("abc\x00", k=rng.randint(1, 12))).encode() for _ in range(50)]
        assert [list(memoryview(x).cast("I")) for x in ours.encode_pieces(pieces)] == [ours.encode_piece(p) for p in pieces]


def test_bpe_new_pieces_cost_little_more_than_the_split():
    import time

    b, rng = bpe.BytePairs(queries.tokenizer_path()), random.Random(10)
    parts = ["th", "he", "in", "er", "an", "tion", "ouer", "ich", "que", "éa", "ß", "ble"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(3, 7))) for _ in range(60_000)) for _ in range(3)]
    b.encode(texts[0][:1000])
    ratios = []
    for text in texts:
        began = time.process_time()
        b.split.findall(text)
        split = time.process_time()
        b.encode(text)
        ratios.append((time.process_time() - split) / (split - began))
    assert min(ratios) < 18, ratios


def test_suffix_automaton_lists_all_strings_that_end_at_a_place():
    rng = random.Random(8)
    for _ in range(100):
        strings = {"".join(rng.choices("ab", k=rng.randint(1, 6))).encode() for _ in range(rng.randint(1, 12))}
        a = bpe.SuffixAutomaton((s, k) for k, s in enumerate(sorted(strings)))
        text = "".join(rng.choices("abc", k=40)).encode()
        got = [(end, text[end - a.length[x] : end]) for end, x in a.ends(text)]
        assert got == [(end, text[b:end]) for end in range(1, 41) for b in range(end) if text[b:end] in strings]


def test_unsupported_tokenizers_are_refused(tmp_path):
    import json

    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {"ignore_merges": True}}, {"model": {"unk_token": "a"}}):
        spec = small_bpe(str(tmp_path / "x.json"), random.Random(1), 3)
        model = spec["model"] | change.pop("model", {})
        (tmp_path / "y.json").write_text(json.dumps(spec | change | {"model": model}))
        with pytest.raises(ValueError):
            bpe.BytePairs(str(tmp_path / "y.json"))


def test_a_tokenizer_without_some_byte_is_refused(tmp_path):
    import json

    spec = small_bpe(str(tmp_path / "x.json"), random.Random(1), 3)
    del spec["model"]["vocab"]["~"]
    (tmp_path / "y.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.BytePairs(str(tmp_path / "y.json"))


def test_url_filters(spark):
    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        if fit:
            best = max(fit, key=lambda r: len(r.name))
            return host, path, best.name, best.verdict
        bare = re.sub(r":\d*$", "", unquote(host.split("@")[-1])).rstrip(".").lower()
        steps = unquote(path).lower().split("/")
        clean = "/".join([steps[0], *[x for x in steps[1:-1] if x not in ("", ".")], *["" if x == "." else x for x in steps[-1:]]])
        return host, path, None, "block" if any(x in bare for x in ("casino", "spam-", "-spam")) or "/casino/" in clean else "allow"

    urls = [
        None, "", "no scheme", "http://", "http://a.COM/x", "http://com/", "http://com", "http://example.com/en/", "https://www.EXAMPLE.com/en/1?x#y", "http://m.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://a.net/x.com/",
        "http://a.org?b=://c.com/", "http://spam-farm.org/", "http://big-casino.example.org/en/", "http://notexample.com/en/", "http://é.com/ü", "ftp://u@h.com:80/p", "http://example.com/" + "e" * 5000, "http://a.net/es", "http://x.com?/en/",
        "http://spam-user@good.org/", "http://good.org:80/CASINO/x", "http://big%2Dcas%69no.org./", "http://a.org/./casino//b", "http://a.org/casino", "http://a.org/%63asino/", "http://a.org./x", "http://a.org:8080/casino/.", "http://@/", "http://a.org//casino/.",
    ]
    got = {r["page_id"]: r for r in ran(url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")))}
    for k, u in enumerate(urls):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == plain(u), u
    # the same rules and globs as tables
    table = lambda rules: spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    again = {r["page_id"]: r for r in ran(url_filters.judge_urls(df, table(url_filters.RULES), table(url_filters.GLOBS)))}
    assert again == got
    other = {r["page_id"]: r["verdict"] for r in ran(url_filters.judge_urls(df, [], [url_filters.Rule("block", "*", "*"), url_filters.Rule("allow", "?.org", "/b*")]))}
    assert set(other.values()) == {"block"}


def test_wildcards_over_many_words():
    import fnmatch
    import random

    rng = random.Random(3)
    globs = ["".join(rng.choices("ab?*", k=rng.randint(1, 9))) for _ in range(60)]
    a = url_filters.WildcardAutomaton([[url_filters.STAR if c == "*" else url_filters.ANY if c == "?" else ord(c) for c in g] for g in globs])
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 10))) for _ in range(80)]
    hit = a.match([np.frombuffer(t.encode(), np.uint8).astype(np.int16) for t in texts])
    assert a.words > 3
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert hit[i, j] == fnmatch.fnmatchcase(t, g), (t, g)


PAGES = "page_id long, url string, html string, record_type string"


def test_warc(spark):
    big = "<p>" + "ä" * 200_000
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c\r\nInjected: 1", big), (4, "u", None), (5, "u", ""), (9, "u", big), (9, "u", big), (None, "u", "x"), (None, "u", "alone"), (6, "u", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, "c") for r in rows], PAGES).repartition(3)
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in ran(warc.archived_pages(df)))
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = collections.Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        best = None if top[h or ""] < 0 else top[h or ""]
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == best else "revisit", None if i == best else best] += 1
    assert got == want
    index = warc.write_archives(df)
    one = ran(warc.read_records(index.where("page_id = '3'")))[0]
    assert one["url"] == "http://c%0D%0AInjected: 1" and one["record_type"] == "revisit" and index.count() == len(rows)
    nine = ran(warc.read_records(index.where("page_id = '9'")))
    assert all(r["payload"].decode() == big for r in nine)
    few = warc.write_archives(df, min_bytes=1000)
    assert few.where("record_type = 'revisit'").count() == 1


def test_ranges_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (30, 5), (200_000, 5)], gap=20, most=1000) == [(0, 35, [(0, 10), (10, 5), (30, 5)]), (200_000, 200_005, [(200_000, 5)])]
    assert len(warc.coalesced([(0, 600), (600, 600)], gap=0, most=1000)) == 2


def test_toxicity(spark):
    import random

    rng = random.Random(4)
    plain = ["alpha", "bravo", "carrot", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "moro"]
    rows, labels = [], []
    for k in range(900):
        text, bad = [rng.choice(plain) for _ in range(40)], k % 6 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(40)] = rng.choice(["moron", "scumbag", "vexu" + rng.choice("abcdefgh") + "la"])
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    extra = [(5001, "alpha m0ron bravo"), (5002, "alpha scumbagg bravo"), (5003, ""), (5004, None), (5005, "moro bravo"), (5006, "she said “moron” delta"), (5007, "alpha vexuzzz"), (5008, "scubag alpha"), (None, "alpha")]
    docs, lab = spark.createDataFrame(rows + extra, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in ran(toxicity.toxicity(docs, lab))}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all(got[k]["held_out"] == (k in set(held)) for k, _ in labels)
    assert all(got[k]["predicted"] == labels[k][1] for k, _ in labels)
    assert [got[k]["predicted"] for k in (5001, 5002, 5003, 5004, 5005, 5007, 5008)] == [1, 1, 0, 0, 0, 1, 1]
    assert got[5006]["score"] < got[5001 + 1]["score"] and got[5003]["score"] == got[5004]["score"]
    kept = ran(toxicity.without_toxic(docs, lab))
    assert {r["doc_id"] for r in kept} == {k for k, r in got.items() if not r["predicted"]} and set(kept[0]) == {"doc_id", "text"}
    flat = ran(toxicity.toxicity(docs, lab.limit(0)))
    assert {r["predicted"] for r in flat} == {0} and len(flat) == len(rows + extra)


def plain_match(word, model):
    """The best weight of a word: terms and stems as they are, and terms one edit behind the first letter away."""

    def apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    found = [w for s, w in model.stems.items() if word.startswith(s)] + [w for t, w in model.words.items() if t == word]
    if word not in model.harmless:
        edits = [(t, w) for t, w in model.words.items() if len(t) >= toxicity.FUZZY_FROM and t[0] == word[0] and apart(t[1:], word[1:])]
        # a term's prefix that is a term of its own is not taken for the longer one
        found += [w * toxicity.EDIT_WEIGHT for t, w in edits if not (word in model.words and t[:-1] == word)]
    return max(found, default=None)


def plain_score(text, model):
    lower, total = text.lower(), 0.0
    places = [(m.start(), m[0]) for m in re.finditer(r"[^\W\d_]+", lower)]
    quoted, start = set(), 0
    for line in lower.split("\n"):
        marks = [start + k for k, c in enumerate(line) if c in toxicity.MARKS]
        for a, b in zip(marks[::2], marks[1::2]):
            quoted |= set(range(a + 1, b))
        start += len(line) + 1
    for k, (at, word) in enumerate(places):
        weight = plain_match(word, model)
        if weight is not None:
            near = any(w in toxicity.MENTIONS for _, w in places[max(0, k - toxicity.WINDOW) : k + toxicity.WINDOW + 1])
            total += weight * (toxicity.QUOTED if near or at in quoted else 1)
    for m in toxicity._LEET_WORD.finditer(lower):
        total += (plain_match(m[0].translate(toxicity._LEET), model) or 0) * toxicity.EDIT_WEIGHT
    return total


def test_toxicity_scores_against_plain_distances():
    rng = random.Random(12)
    word = lambda low, high: "".join(rng.choices("abc", k=rng.randint(low, high)))
    for _ in range(40):
        terms = {word(3, 9): rng.uniform(2, 6) for _ in range(rng.randint(1, 12))}
        stems = {word(4, 5): rng.uniform(2, 6) for _ in range(rng.randint(0, 2))}
        model = toxicity.Model(terms, stems, frozenset(word(5, 8) for _ in range(20)))
        lexicon = toxicity.Lexicon(model)
        near = [t[:k] + rng.choice("abc") + t[k + rng.randint(0, 1) :] for t in terms for k in range(len(t))] + [t[:k] + t[k + 1 :] for t in terms for k in range(len(t))]
        for w in [*near, *(word(1, 10) for _ in range(200)), *terms, *model.harmless]:
            got = lexicon.look_up(w) if w else None
            assert (got and got[0]) == (plain_match(w, model) if w else None), (w, terms, stems)
        for _ in range(15):
            parts = rng.choices([*near, *terms, "said", "quote", "x", "b4bab", "@bcab", "c0ab"], k=30)
            text = "".join(x + rng.choice([" ", " ", '" ', ' "', "\n", "” ", " “", ", "]) for x in parts)
            assert toxicity.raw_score(text, lexicon) == pytest.approx(plain_score(text, model)), text
    long = "“" + "x " * 500 + "babac ” babac"
    model = toxicity.Model({"babac": 3.0}, {}, frozenset())
    assert toxicity.raw_score(long, toxicity.Lexicon(model)) == pytest.approx(3.0 * toxicity.QUOTED + 3.0)


def test_toxicity_lexicon_has_no_caps(spark):
    """Thousands of terms, of any length, and the last of the alphabet's harmless words."""
    rng = random.Random(13)
    rows, labels = [], []
    terms = [f"zz{'pqrstuvw'[k % 8]}{'abcdefgh'[k // 8 % 8]}{'ijklmno'[k // 64 % 7]}{'abcdef'[k // 448 % 6]}{'xy'[k // 2688 % 2]}" + "e" * (60 if k == 0 else 1) for k in range(5000)]
    for k in range(1200):
        bad = k % 2 == 0
        text = ["plain", "zebraic", *words(rng, 12)]
        if bad:
            text += rng.sample((terms + terms)[k * 25 // 6 % 5000 :][:400], 400) + [terms[0]]
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    lexicon = toxicity.Lexicon(model)
    lacking = [t for t in terms if not lexicon.look_up(t)]
    assert not lacking and not lexicon.look_up("zebraic"), (len(lacking), lacking[:3], len(model.words), len(model.stems))


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = [(k, f"w{k % 5} common {'vile' if k % 3 == 0 else 'kind'}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a = [(k, int(k % 3 == 0)) for k, _ in rows]
    b = [(k, 1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v) for k, v in a]
    score = lambda lab: {r["doc_id"]: r["score"] for r in ran(toxicity.toxicity(docs, spark.createDataFrame(lab, "doc_id long, toxic int")))}
    assert score(a) == score(b)


def test_empty_tables(spark, none):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], PAGES)
    for df in (
        jaccard_join.jaccard_components(none), jaccard_join.one_of_each(none), exact_dedup.exact_dedup(none), exact_dedup.deduplicated(none), mixing.mix_report(none), mixing.mixture(none), sharding.shard_rows(none), fingerprints.fingerprint_report(none),
        license_scan.scan_licenses(none), bpe.encoded(none, queries.tokenizer_path()), toxicity.toxicity(none, lab), toxicity.without_toxic(none, lab), warc.archived_pages(pages), url_filters.judge_urls(pages),
    ):
        assert df.count() == 0


def test_scratch_tables_are_those_of_the_call(spark, docs):
    from tidemark.llm import common

    with common.Scratch(spark) as own:
        mine = common.settled(spark.range(3), "mine")
        with common.Scratch(spark) as inner:
            kept, gone = common.settled(spark.range(4), "kept"), common.settled(spark.range(5), "gone")
            inner.discard(("kept",))
        assert kept.count() == 4
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            gone.count()
        other = common.settled(spark.range(6), "other")
        stays = exact_dedup.deduplicated(docs)
        assert other.count() == 6 and mine.count() == 3
        own.discard(("other",))
        assert other.count() == 6
    outside = common.settled(spark.range(7), "outside")
    jaccard_join.one_of_each(docs).collect()
    assert outside.count() == 7
    common.drop_table(outside)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        outside.count()
    assert stays.columns == docs.columns


CLASHES = ("__key", "__range", "__source", "__size", "__taken", "__score", "__rid", "__norm", "__id", "__tie", "c0", "c1", "id", "rep", "component")


def test_stages_keep_columns_of_any_name(spark, docs, doc_rows):
    wide = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASHES})
    lab = spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(1, 30)], "doc_id long, quality int, toxic int")
    for stage in (lambda d: toxicity.without_toxic(d, lab), exact_dedup.deduplicated, jaccard_join.one_of_each, mixing.mixture):
        out = stage(wide)
        found = ran(out)
        assert out.columns == wide.columns and found
        assert all(r[c] == f"{c}:{'?' if r['doc_id'] is None else r['doc_id']}" for r in found for c in CLASHES)
    assert len(ran(mixing.mix_report(wide))) == len(doc_rows)


def test_mixture_is_one_under_any_partitioning(spark):
    rng = random.Random(9)
    rows = [(7 if k % 2 else None, " ".join(words(rng, 5)), "s", "x" if k % 3 else None) for k in range(200)] + [(k, " ".join(words(rng, 400)), "t", "y") for k in range(20)]
    rows += rows[:30]
    seen = set()
    for n in (1, 3, 7, 12):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(n)
        seen.add(tuple(sorted(mixing.mixture(df).collect(), key=repr)))
    assert len(seen) == 1 and 0 < len(seen.pop())


def test_urls_are_matched_in_slices(spark, monkeypatch):
    rows = [(k, f"http://h{k % 17}.example.com/p{k % 5}/x") for k in range(200)]
    rules = [url_filters.Rule("block", f"h{k}.example.com", f"/p{k % 5}") for k in range(17)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(2)
    whole = sorted(map(tuple, url_filters.judge_urls(pages, rules).collect()))
    monkeypatch.setattr(url_filters, "CELLS", 9)
    assert sorted(map(tuple, url_filters.judge_urls(pages, rules).collect())) == whole and len(whole) == 200
