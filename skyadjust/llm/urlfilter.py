"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

Entries (rules and listed canonical URLs) are hashed into 64-bit blocks, four bits each.  Every URL
yields its candidate keys; keys whose bits are all set in their block go to an exact join with the
entries, which removes false positives.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_A_KEY = 16
#: Entries up to which the filter (16 bits an entry, at most 16 bytes a block) is broadcast.
BROADCAST_ENTRIES = 4_000_000


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading ``www.`` plus path without trailing slashes; scheme, query and fragment go."""
    return F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""))


def rules(spark: SparkSession, items: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, verdict) of ``(verdict, host/path)`` pairs, as a table of literals."""
    rows = F.array(*[F.struct(F.lit(r).alias("key"), F.lit(v).alias("verdict")) for v, r in items]) if items else F.expr("cast(array() as array<struct<key:string,verdict:string>>)")
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.key", "r.verdict")


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(7))
    bits = [F.expr("1L")] * 4
    for i in range(4):
        bits[i] = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 6 * i), F.lit(64)).cast("int"))
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(entries: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of column ``key``: (block, bits) of the blocks that hold anything."""
    blocks = max(1, n * BITS_A_KEY // 64)
    made = entries.select(_block(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("m")).groupBy("block").agg(F.bit_or("m").alias("bits"))
    return made, blocks


def hits(keys: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """Rows of ``keys`` (column ``key``) whose key is an entry, with the entry's columns."""
    made, blocks = bloom(entries, n)
    made = F.broadcast(made) if n <= BROADCAST_ENTRIES else made
    possible = keys.withColumn("block", _block(F.col("key"), blocks)).join(made, "block").where(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).drop("block", "bits")
    return possible.join(entries.hint("shuffle_hash"), "key")


def judge(pages: DataFrame, rule_items: Sequence[tuple[str, str]], listed: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Verdict of every URL.

    A rule ``host/path`` fits its host and all subdomains when the URL's path starts with the
    rule's; the longest fitting rule wins, of equally long ones the last by code point.  Without a rule, a URL whose canonical form is in
    ``listed`` (column ``key``) is blocked, any other allowed.  Returns (page_id, host, path, rule,
    verdict), one row per input row.  Null URLs and URLs without ``://`` have empty host and path
    and are allowed; repeated rows and ids stay; an empty table or list gives no hits; other columns
    of ``pages`` are not read.  Distinct URLs are judged once, so a very common URL costs one row;
    of a host of many labels only as many are tried as a rule's host has, so a long URL costs its length.
    """
    spark = pages.sparkSession
    url = F.col("url")
    lengths = sorted({len(r) - r.index("/") for _, r in rule_items})
    labels = max((r[: r.index("/")].count(".") + 1 for _, r in rule_items), default=1)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    distinct = own.where(F.instr("url", "://") > 0).select("url").distinct()
    parts = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - (labels - 1)), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    path = path_of(url)
    tails = F.array_compact(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths])) if lengths else F.expr("cast(array() as array<string>)")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(tails, lambda t: F.concat(F.lit("r:"), s, t))))
    keyed = distinct.select("url", F.explode(F.array_distinct(F.concat(keys, F.array(F.concat(F.lit("u:"), canonical(url)))))).alias("key"))
    table = rules(spark, rule_items).select(F.concat(F.lit("r:"), "key").alias("key"), "verdict")
    entries = table.unionByName(listed.select(F.concat(F.lit("u:"), "key").alias("key")).distinct().withColumn("verdict", F.lit("block")))
    found = hits(keyed, entries, entries.count())
    is_rule = F.col("key").startswith("r:")
    text = F.when(is_rule, F.expr("substr(key, 3)"))
    best = found.groupBy(F.col("url").alias("hit_url")).agg(F.max_by(F.struct(text.alias("rule"), F.col("verdict").alias("verdict")), F.struct(is_rule, F.length("key"), F.col("key"))).alias("best"))
    # Null URLs and those without a scheme meet nothing: a key of their row's own spreads them.
    meet = F.when(F.instr(url, "://") > 0, url).otherwise(F.xxhash64("page_id").cast("string"))
    out = own.withColumn("meet", meet).join(best, F.col("meet") == F.col("hit_url"), "left")
    return out.select("page_id", host_of(url).alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"))
