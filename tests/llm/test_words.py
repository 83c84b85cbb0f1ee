"""Periodic runs, quality rules and token alignment, each against a brute-force version."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex

from tidemark.llm import periodic_runs, quality_rules, queries, token_alignment, word_arrays
from tidemark.llm.common import read_table

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, n_words long, runs string, collapsed string, kept string, links string, `__row` string, `__text` string"


def ran(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def odd_texts():
    rng = random.Random(8)
    some = lambda n, k=50: [f"w{rng.randrange(k)}" for _ in range(n)]
    out = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "a b " * 12, "x " + "a b c " * 9 + "y", "\n".join(["same line here"] * 5), "é ü\x85漢字 ▁x 😀 \x00 <|endoftext|> end", " lead  two   three \n\n x\ty ", "x" * 30_000]
    for _ in range(30):
        period = some(rng.randint(1, 30))
        out.append(" ".join(some(rng.randint(0, 40)) + period * rng.randint(2, 6) + period[: rng.randint(0, len(period))] + some(rng.randint(0, 30), 3)))
    out += [" ".join(some(300, 2)) for _ in range(10)] + [" ".join((some(20) * 3 + ["z"]) * 3 + some(9)) for _ in range(4)] + [" ".join(some(3000, 4000) + ["q", "r"] * 4000)]
    return out


def brute_runs(w, least=24, times=3):
    found = {}
    for q in range(1, len(w) // times + 1):
        at = 0
        while at + q < len(w):
            to = at
            while to + q < len(w) and w[to] == w[to + q]:
                to += 1
            if to > at and to + q - at >= max(least, times * q):
                found.setdefault((at, to + q - at), q)
            at = to + 1
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("least,times", [(24, 3), (5, 2), (12, 4)])
def test_runs(spark, least, times):
    texts = odd_texts()
    rows = [(k if k else None, t, 1, "c", "c", "c", "c", "c", "c") for k, t in enumerate(texts)] + [(5, texts[5], 1, "c", "c", "c", "c", "c", "c")]
    got = ran(periodic_runs.periodic_runs(spark.createDataFrame(rows, ODD).repartition(3), least, times))
    assert len(got) == len(rows)
    seen = 0
    for r in got:
        w = words(texts[r["doc_id"] or 0])
        want = brute_runs(w, least, times) if len(w) < 5000 else [(3000, 8000, 2)] if w[2999] != "r" else None
        assert r["n_words"] == len(w)
        if want is not None:
            assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want
            drop = {i for s, n, q in want for i in range(s + q, s + n)}
            assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in drop)
        seen += len(r["runs"])
    assert seen > 20


def test_runs_random_small(monkeypatch):
    monkeypatch.setattr(word_arrays, "SLICE_BYTES", 300)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    for at, n in word_arrays.slices(pa.array(texts)):
        _, runs, _ = periodic_runs._runs_of_slice(pa.array(texts[at : at + n]), 6, 2)
        for t, found in zip(texts[at : at + n], runs.to_pylist(), strict=True):
            assert [(x["start"], x["length"], x["period"]) for x in found] == brute_runs(t.split(), 6, 2)


def plain_run_report(rows):
    for i, t in rows:
        w = words(t)
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = brute_runs(w)
        drop = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = (None, None, None, None)
        for s, m, q in runs:
            if best[0] is None or m * best[2] > best[1] * q:
                best = s, m, q, 1000 * m // q
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        yield (i, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_run_report(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(1000 + k, t) for k, t in enumerate(odd_texts()[:-1])] + [(None, "a b " * 30)]
    got = [tuple(r) for r in periodic_runs.run_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(plain_run_report(rows), key=key)
    assert sum(r[1] > 0 for r in got) > 20
    assert queries.op11(spark, SF).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_no_rows(spark):
    none = spark.createDataFrame([], ODD)
    assert not ran(periodic_runs.run_report(none)) and not ran(quality_rules.quality_report(none))
    assert not ran(token_alignment.alignment_report(none, queries.tokenizer_path(), queries.tokenizer_path(queries.PIECES)))


def plain_quality(t):
    w, t = words(t), t or ""
    spots = collections.defaultdict(list)
    for k in range(len(w) - 7):
        spots[tuple(w[k : k + 8])].append(k)
    twice = {j for ks in spots.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    letters = len(regex.findall(r"\p{L}", t))
    n, chars, symbols, dup = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
    base = n < 20 or 100 * len(twice) > 30 * n
    own = 10 * symbols > n or 10 * sum(bool(regex.search(r"\p{L}", x)) for x in w) < 8 * n or 2 * len(regex.findall(r"\p{Lu}", t)) > letters or 2 * sum(c in "!?" for c in t) > n
    own = own or 2 * dup > t.count("\n") + 1 or 10 * chars < 25 * n or chars > 15 * n
    return n, chars, symbols, dup, len(twice), base, not (base or own)


def test_quality(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(1000 + k, t) for k, t in enumerate(odd_texts())] + [(None, "no id"), (1003, "a"), (2000, "\n".join(["One line of words stands here."] * 3 + [f"and line {k} of its own" for k in range(3)])), (2001, "LOUD words!! " * 4 + "MORE!! " * 30)]
    full = spark.createDataFrame([(i, t, 1, "c", "c", "c", "c", "c", "c") for i, t in rows], ODD)
    got = [tuple(r.values()) for r in ran(quality_rules.quality_report(full))]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(((i, *plain_quality(t)) for i, t in rows), key=key)


def test_cascade_stops_early_and_order_changes_no_verdict():
    texts = pa.array([t for t in odd_texts() if t] + ["# " * 50, "plain words with letters " * 2 + "and twenty more of them so that no rule of this list has any reason to reject it at all here"])
    rules = [*quality_rules.BASE, *quality_rules.OWN]
    rng, kept = random.Random(1), set()
    for _ in range(8):
        rng.shuffle(rules)
        _, by, made = quality_rules.cascade(texts, rules)
        kept.add(tuple(by < 0))
        assert made[rules[0].measures[0]] == len(texts) and min(made.values()) < len(texts)
    assert len(kept) == 1
    # by hand: the second rule rejects half for a third of the price, then what is left decides
    fails = np.array([[1, 1, 0], [1, 0, 0], [0, 1, 1], [0, 0, 1]] * 5, bool)
    three = [quality_rules.Rule(n, (m,), lambda x: x > 0) for n, m in (("a", "n_symbols"), ("b", "n_calls"), ("c", "n_letters"))]
    assert quality_rules.greedy_order(fails, {"n_symbols": 3.0, "n_calls": 1.0, "n_letters": 2.5}, three) == [1, 2, 0]
    assert quality_rules.greedy_order(fails, {"n_symbols": 3.0, "n_calls": 1.0, "n_letters": 2.5}, three, ["n_symbols"]) == [0, 1, 2]


def test_quality_keeps_good_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.quality_report(read_table(spark, sf, "documents")).join(read_table(spark, sf, "labels"), "doc_id").groupBy("quality").agg({"kept": "count"}).collect()
    by = quality_rules.quality_report(read_table(spark, sf, "documents")).where("kept").join(read_table(spark, sf, "labels"), "doc_id").groupBy("quality").count().collect()
    all_of, kept = {r[0]: r[1] for r in got}, {r[0]: r[1] for r in by}
    assert kept[1] >= 0.97 * all_of[1] and kept.get(0, 0) <= 0.1 * all_of[0]


def plain_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = queries.tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model")
    a_tok, b_tok = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_tok.encode_special_tokens = True
    letter = token_alignment.byte_letters()
    out, links = [], []
    for t in texts:
        whole = (" " + (t or "")).encode()
        a = a_tok.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        a_raw = [bytes(letter[c] for c in a_tok.id_to_token(i)) for i in a]
        b_raw = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(a_raw) != whole or b"".join(b_raw) != whole:
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_raw]), np.cumsum([len(x) for x in b_raw])
        cuts = sorted(set(a_end) & set(b_end))
        groups, i, j = [], 0, 0
        for c in cuts:
            x, y = int(np.searchsorted(a_end, c)) + 1, int(np.searchsorted(b_end, c)) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        own, j = [], 0
        for i, e in enumerate(a_end):
            s = e - len(a_raw[i])
            while b_end[j] <= s:
                j += 1
            k = j
            while k < len(b) and b_end[k] - len(b_raw[k]) < e:
                own.append((a[i], b[k]))
                k += 1
        out.append((len(a), len(b), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    count = collections.Counter(p for own in links for p in set(own))
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(a, b, g, len(own), sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), sha) for (a, b, g, sha), own in zip(out, links, strict=True)]


@pytest.mark.parametrize("common,held,cache", [(1_000_000, 2_000_000, 200_000), (300, 500, 40), (0, 50, 2)])
def test_alignment(spark, monkeypatch, common, held, cache):
    monkeypatch.setattr(token_alignment, "HELD", held)
    monkeypatch.setattr(token_alignment, "CACHE", cache)
    monkeypatch.setattr(token_alignment, "TOGETHER", cache * 10)
    rng = random.Random(4)
    texts = [r["text"] for r in read_table(spark, SF, "documents").select("text").limit(120).collect()] + odd_texts()[:12]
    texts += ["".join(rng.choice(" \n\t ab é漢 ▁​'sT1.,😀\r") for _ in range(rng.randint(1, 40))) for _ in range(150)] + ["don't  stop 　x", "a b c", "tail ", "  ", " a", "<|endoftext|> <s> </s> <unk>", "the same", "the same"]
    rows = [(k, t, 1, "c", "c", "c", "c", "c", "c") for k, t in enumerate(texts)]
    got = ran(token_alignment.alignment_report(spark.createDataFrame(rows, ODD).repartition(4), queries.tokenizer_path(), queries.tokenizer_path(queries.PIECES), common))
    assert sorted(tuple(r.values()) for r in got) == [(k, *w) for k, w in enumerate(plain_alignment(texts))]


def test_repeated_windows_survive_collisions(monkeypatch):
    real, calls = word_arrays._mixed, []

    def poor(a, b, odd):
        calls.append(int(odd))
        return real(a, b, odd) % np.uint64(3) if len(calls) < 8 else real(a, b, odd)

    monkeypatch.setattr(word_arrays, "_mixed", poor)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(60)) for _ in range(20)]
    covered = word_arrays.repeated_windows(word_arrays.words_of(pa.array(texts)), 5)
    want = []
    for t in texts:
        w = t.split()
        spots = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        mask = [False] * len(w)
        for k in range(len(w) - 4):
            if spots[tuple(w[k : k + 5])] > 1:
                mask[k : k + 5] = [True] * 5
        want += mask
    assert covered.tolist() == want and len(set(calls)) > 1
