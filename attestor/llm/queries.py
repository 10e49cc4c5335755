"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, licenses, mixing, pii, quality, sharding, simhash, suffix_dedup, topk
from .common import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a run of its own gives its key in this setting; the one here is known to all, and for tests alone
    key = spark.conf.get("spark.attestor.pii.key", "a key for tests")
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key.encode())


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_licenses": op4_licenses,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_html": op9_html,
    "op10_mixing": op10_mixing,
}

#: Brute force in SQL. The mix follows the same schedule point by point; the others know nothing of blocks or anchors.
ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op3_suffix_dedup": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(1, CAST(length(h) // 2 + 1 AS BIGINT))) AS p FROM t),
w AS (SELECT doc_id, p, substr(h, 2 * p - 1, 2) AS byte, CASE WHEN length(h) // 2 >= p + 99 THEN md5(substr(h, 2 * p - 1, 200)) END AS win FROM b),
f AS (SELECT doc_id, p, byte, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS again FROM w),
c AS (SELECT doc_id, p, byte, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p ROWS 99 PRECEDING) AS gone FROM f),
e AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 THEN 1 ELSE 0 END AS opens FROM c),
g AS (SELECT doc_id, sum(gone) AS n_removed, sum(opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT t.doc_id, CAST(length(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN g ON g.doc_id = t.doc_id""",
    "op10_mixing": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w
  WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level <= cap / weight), CAST('inf' AS DOUBLE)) * weight) AS target FROM l),
k AS (SELECT CAST(sum(size) AS BIGINT) AS total, greatest(1, least(4096, CAST(sum(size) AS BIGINT) // 65536)) AS block FROM d),
m AS (SELECT t.*, block, total, CAST(ceil(source_size / block) AS BIGINT) AS blocks, least(CAST(round(target) AS BIGINT), 3 * source_size) AS words FROM t, k WHERE source_size > 0),
points AS (SELECT i AS slot, list_sum(list_transform(range(0, 52), lambda b: ((i >> b) & 1) * pow(2.0, -b - 1))) AS u FROM (SELECT unnest(range(0, CAST(ceil(total / block) AS BIGINT))) AS i FROM k)),
spans AS (SELECT *, (sum(target) OVER o - target) / sum(target) OVER () AS low, CASE WHEN sum(target) OVER o >= sum(target) OVER () THEN 1.0 ELSE sum(target) OVER o / sum(target) OVER () END AS high FROM m WINDOW o AS (ORDER BY source NULLS LAST)),
hit AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN spans ON u >= low AND u < high),
owed AS (SELECT m.source, unnest(range(coalesce(n, 0), words // block + 4 * blocks)) AS rank FROM m LEFT JOIN (SELECT source, count(*) AS n FROM hit GROUP BY source) h ON h.source IS NOT DISTINCT FROM m.source),
slots AS (SELECT m.source, rank % blocks AS block_no, CASE WHEN rank % blocks = blocks - 1 THEN source_size - (blocks - 1) * block ELSE block END AS holds, rank // blocks * source_size + rank % blocks * block AS done, words
  FROM (FROM hit UNION ALL FROM owed) x JOIN m ON m.source IS NOT DISTINCT FROM x.source),
takes AS (SELECT source, block_no, least(holds, words - done) AS n FROM slots WHERE done < words),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY digest, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
pieces AS (SELECT r, source, start, size, unnest(range(CAST(start // block AS BIGINT), CAST((start + size - 1) // block AS BIGINT) + 1)) AS block_no, block FROM p, k WHERE size > 0),
got AS (SELECT r, sum(greatest(0, least(start + size, pieces.block_no * block + n) - greatest(start, pieces.block_no * block))) AS taken
  FROM pieces JOIN takes ON takes.source IS NOT DISTINCT FROM pieces.source AND takes.block_no = pieces.block_no GROUP BY r)
SELECT doc_id, size, t.source_size, t.target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN got ON got.r = p.r""",
}
