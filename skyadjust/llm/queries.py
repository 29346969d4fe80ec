"""Registered queries of the training-data operators and their SQL (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, fingerprint, jaccard, mixing, phrases, quality, sharding, urlfilter, warc
from ._common import Scratch

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_json(name: str = TOKENIZER) -> str:
    """Text of a public tokenizer's definition file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    warc.write(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(scratch.save(warc.read(spark, path, payload=False), "records"))
    # The page is what the joined metadata record says, so a record that missed its capture shows.
    said = F.get(F.filter(F.get("metadata", F.lit(0))["fields"], lambda f: f["key"] == "pageId"), F.lit(0))["value"]
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1).try_cast("long")
    return captures.select(
        said.try_cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(F.col("response.refers_to").isNotNull(), page(F.col("response.refers_to"))).alias("refers_to"),
        F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedup(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The rules that op9 judges by.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Host labels whose pages' canonical URLs make op9's list.
SPAM_HOSTS = r"(^|\.)(spam-farm|cheap-pills)\."


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("url").rlike("://") & urlfilter.host_of(F.col("url")).rlike(SPAM_HOSTS)).select(urlfilter.canonical(F.col("url")).alias("key")).distinct()
    return urlfilter.judge(pages, RULES, listed)


OP1_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest AS d, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, 1::INTEGER AS n_requests, 1::INTEGER AS n_metadata
FROM p LEFT JOIN m ON payload_digest = d
"""

OP9_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canon FROM s),
listed AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.')),
r(rule, rhost, rpath, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
fit AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS v
  FROM c JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT c.page_id, c.host, c.path, fit.rule,
       coalesce(fit.v, CASE WHEN c.canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit ON c.page_id = fit.page_id AND c.host = fit.host AND c.path = fit.path
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.selectExpr("doc_id", "size", "source_size", "round(target, 4) AS target", "taken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_json(), with_ids=False)


OP6_SQL = r"""
WITH base AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln(least(1.0, (CAST('0x' || substr(md5('mix-1/' || CAST(doc_id AS VARCHAR)), 1, 13) AS UBIGINT) + 1)::DOUBLE / 4503599627370496.0))
         / CASE WHEN coalesce(text, '') = '' THEN 0.05
                ELSE 0.05 + (length(text) - length(regexp_replace(text, '\p{L}+', '', 'g')))::DOUBLE / length(text) END AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rk
  FROM base GROUP BY source),
lev AS (
  SELECT *, 2.0 * source_size / w AS brk,
         (1.5 * sum(source_size::DOUBLE) OVER () - coalesce(sum(2.0 * source_size::DOUBLE) OVER (ORDER BY 2.0 * source_size / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2.0 * source_size / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src),
cut AS (SELECT arg_min(level, brk) FILTER (WHERE brk > level) AS level FROM lev),
goal AS (
  SELECT lev.source, source_size, w,
         CASE WHEN cut.level IS NULL OR lev.brk <= cut.level THEN 2.0 * source_size ELSE cut.level * w END::DOUBLE AS target
  FROM lev, cut),
ep AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goal),
run AS (
  SELECT b.*, e.source_size, e.target, e.epochs,
         sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM base b JOIN ep e ON b.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       CAST(size * (epochs + CASE WHEN 2 * upto - size <= 2 * (target - epochs * source_size) AND size > 0 AND epochs < 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_transactions": op1_warc_transactions,
        "op2_fingerprints": op2_fingerprints,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_repeated_phrases": op4_repeated_phrases,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_mix_sources": op6_mix_sources,
        "op7_quality": op7_quality,
        "op8_shards": op8_shards,
        "op9_url_filter": op9_url_filter,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_transactions": OP1_SQL, "op6_mix_sources": OP6_SQL, "op9_url_filter": OP9_SQL}
