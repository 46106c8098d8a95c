"""The registered queries of this subpackage and their DuckDB restatements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.durable import scratch_path
from ledgerlens.llm import bpe, decontamination, hard_negatives, imatch, importance, language_id, merkle, ngram_join, passages, personal_data, quality_rules, secret_scan, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


@query
def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    both = bpe.both_ways(F.col("text").cast("string"), vocabulary)
    docs = table(spark, sf_dir, "documents").select("doc_id", both.alias("both"))
    return docs.select(
        "doc_id",
        F.size("both.ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("both.ids", ","), 256).alias("ids_sha256"),
        F.sha2("both.bytes", 256).alias("decoded_sha256"),
    )


@query
def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.revisits(warc.read_archive(spark, path))


ORACLES["op7_warc_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
owners AS (SELECT html, max(page_id) AS owner FROM p GROUP BY html),
d AS (SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS h, owner FROM p JOIN owners USING (html)),
v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substring(h, 5 * i + 1, 5))::BIGINT) AS v FROM d),
letters AS (
  SELECT *, list_transform(range(32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((v[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)) AS l FROM v)
SELECT page_id, payload_bytes, array_to_string(l, '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM letters
"""


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(table(spark, sf_dir, "documents"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.scan(table(spark, sf_dir, "documents"))


ORACLES["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS grams FROM w),
grams AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, component_id
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = sets.doc_id
"""


@query
def op11_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


# The checksum goes bit by bit over the digits of the id.
ORACLES["op13_merkle_manifest"] = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, n_chars::HUGEINT AS n,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substring(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
  FROM documents),
l AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(n::VARCHAR) || ':' || n, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 AND n IS NOT NULL THEN sha256(head || strlen((n + 1)::VARCHAR) || ':' || (n + 1) || tail) END AS bad FROM d),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM l),
low AS (
  SELECT 0 AS level, lang, idx::BIGINT AS idx, n::BIGINT AS n, leaf AS h FROM ordered
  UNION ALL
  SELECT level + 1, lang, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY level, lang, idx // 2, n),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, idx::BIGINT AS idx, n::BIGINT AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // 2, n),
climb AS (
  SELECT r, lang, false AS up, 0 AS level, idx::BIGINT AS idx, n::BIGINT AS n, '' AS proof, coalesce(bad, leaf) AS h FROM ordered
  UNION ALL
  SELECT r, lang, up, level, idx, n, proof, h FROM (
    SELECT c.r, c.lang, c.up, c.level + 1 AS level, c.idx // 2 AS idx, (c.n + 1) // 2 AS n, c.proof || coalesce(s.h, '') AS proof,
      sha256(CASE WHEN c.idx % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END) AS h
    FROM climb c LEFT JOIN (
      SELECT false AS up, lang, level, idx, h FROM low UNION ALL SELECT true, NULL, level, idx, h FROM high) s
      ON s.up = c.up AND (c.up OR s.lang IS NOT DISTINCT FROM c.lang) AND s.level = c.level AND s.idx = xor(c.idx, 1)
    WHERE c.n > 1
    UNION ALL
    SELECT c.r, c.lang, true, 0, s.idx, s.n, c.proof, c.h
    FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1 AND NOT c.up)),
done AS (SELECT r, proof, h FROM climb WHERE up AND n = 1)
SELECT o.doc_id, o.leaf, s.subroot, root.h AS root, sha256(done.proof) AS proof_sha256, done.h AS folded_root, done.h = root.h AS verified
FROM ordered o JOIN subroots s ON s.lang IS NOT DISTINCT FROM o.lang JOIN done ON done.r = o.r CROSS JOIN (SELECT h FROM high WHERE n = 1) root
"""
