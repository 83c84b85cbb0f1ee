"""The queries of the corpus operators over the tables in TESTDATA.md, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, fingerprints, jaccard_join, license_scan, mixing, periodic_runs, quality_rules, sharding, token_alignment, toxicity, url_filters, warc
from .common import read_table

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), n=4, per_cent=85)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read_table(spark, sf_dir, "pages"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(read_table(spark, sf_dir, "pages"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read_table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(read_table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(read_table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(read_table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(read_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1,
    "op2_warc": op2,
    "op3_mixing": op3,
    "op4_toxicity": op4,
    "op5_url_filters": op5,
    "op6_sharding": op6,
    "op7_fingerprints": op7,
    "op8_license_scans": op8,
    "op9_exact_dedup": op9,
    "op10_bpe": op10,
    "op11_periodic_runs": op11,
    "op12_quality_rules": op12,
    "op13_token_alignment": op13,
}

_OP3 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, source_size * 3 AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::BIGINT AS w FROM s
), l AS (
  SELECT *, row_number() OVER o AS rn,
    (sum(source_size) OVER () - (sum(cap) OVER o - cap))::DOUBLE / (sum(w) OVER () - (sum(w) OVER o - w))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, rn) FROM l WHERE cap >= level * w) * w) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, budget - start)) + greatest(0, least(size, budget - start - source_size)) + greatest(0, least(size, budget - start - 2 * source_size)))::BIGINT AS taken
FROM p
"""

_OP5 = r"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a
), c AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b
), e AS (
  SELECT *, lower(CASE WHEN host LIKE '%@%' THEN regexp_extract(host, '[^@]*$') ELSE host END) AS h0, lower(path) AS p0 FROM c
), k AS (
  SELECT page_id, host, path, rtrim(regexp_replace(h0, ':[0-9]*$', ''), '.') AS kh, regexp_replace(regexp_replace(p0, '(/\.)+(/|$)', '/', 'g'), '/+', '/', 'g') AS kp FROM e
), r(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT k.page_id, k.host, k.path, kh, kp, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM k LEFT JOIN r ON (k.host = r.h OR ends_with(k.host, '.' || r.h)) AND starts_with(k.path, r.p)
  GROUP BY ALL
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN kh LIKE '%casino%' OR kh LIKE '%spam-%' OR kh LIKE '%-spam%' OR kp LIKE '%/casino/%' THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (
  SELECT n, count(*)::BIGINT AS group_size, (arg_min(doc_id, {'c': -length(t), 'd': doc_id})) AS keep_id FROM d GROUP BY n
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.n) AS text_sha256 FROM d JOIN g USING (n)
"""

_OP12 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), k AS (
  SELECT r, list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) AS k FROM d WHERE len(w) >= 8
), e AS (
  SELECT r, unnest(k) AS k, unnest(range(len(k))) AS i FROM k
), u AS (
  SELECT r, i FROM e QUALIFY count(*) OVER (PARTITION BY r, k) > 1
), c AS (
  SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM u
), p AS (
  SELECT r, sum(n)::BIGINT AS n_repeat_words FROM c GROUP BY r
), l AS (
  SELECT r, unnest(string_split(t, chr(10))) AS line FROM d
), q AS (
  SELECT r, count(*) AS n_lines, count(line) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) - count(DISTINCT line) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_dup_lines FROM l GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
    len(regexp_extract_all(t, '[!?]')) AS n_calls, len(regexp_extract_all(t, '\p{L}')) AS n_letters, len(regexp_extract_all(t, '\p{Lu}')) AS n_capitals
  FROM d JOIN q USING (r) LEFT JOIN p USING (r)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_letter_words < 8 * n_words OR 2 * n_capitals > n_letters OR 2 * n_calls > n_words OR 2 * n_dup_lines > n_lines
    OR 10 * word_chars < 25 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""

ORACLE: dict[str, str] = {"op3_mixing": _OP3, "op5_url_filters": _OP5, "op9_exact_dedup": _OP9, "op12_quality_rules": _OP12}
