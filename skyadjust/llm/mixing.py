"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / quality``; within its source, documents are taken
in key order until the source's budget of words is spent.  Budgets beyond a source's size first take
complete epochs, then the fractional selection.  The order needs no global sort: keys fall into
fixed buckets, bucket sums are prefix-summed, and only rows of one (source, bucket) meet in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WORD, Scratch, broadcast_if_small, text_or_empty

BUCKETS = 1024


def letter_share() -> Column:
    """Default quality weight, 0.05 to 1.05: the share of a text's code points that are letters, plus 0.05."""
    t = text_or_empty()
    n = F.length(t)
    return F.when(n == 0, F.lit(0.05)).otherwise(F.lit(0.05) + (n - F.length(F.regexp_replace(t, r"\p{L}+", ""))) / n)


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], ratio: float, cap: float) -> dict[str | None, float]:
    """Budget of each source: a share of ``ratio`` times all words by weight, at most ``cap`` times its own size.

    What is above a cap goes to the others by weight until none is above: the level at which
    min(cap, level * weight) uses the whole budget, found by taking sources in order of cap / weight.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    rows = sorted((cap * n / weights[i % len(weights)], i, name, cap * n, float(weights[i % len(weights)])) for i, (name, n) in enumerate(ordered))
    left, weight, out = ratio * sum(n for _, n in sizes), sum(r[4] for r in rows), {}
    for at, _, name, most, w in rows:
        full = at <= left / weight
        out[name] = most if full else left / weight * w
        if full:
            left, weight = left - most, weight - w
    return out


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0, seed: str = "mix-1", quality: Column | None = None) -> DataFrame:
    """Plan of a mix: one row per input row with how many words of it the mix takes.

    Sources in code-point order, null last, weigh ``weights`` in turn.  The number of sources is
    taken to be small (their names and sums are the only rows that reach the driver).  Returns
    (doc_id, source, size, source_size, target, copies, taken).  A null text has size 0 and takes
    nothing; a null source is a source; equal keys (repeated rows) order by doc_id and size; an
    empty table gives an empty plan.  Whole documents only: the one on the budget's edge is taken
    if that brings the source nearer its target.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    u = (F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    base = docs.select(
        F.col("doc_id"), F.col("source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        (-F.log(F.least(u, F.lit(1.0))) / (letter_share() if quality is None else quality)).alias("key"),
    ).withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    base = scratch.save(base, "sized")
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = scratch.save(sums, "sums")
    sizes = [(r[0], int(r[1] or 0)) for r in sums.groupBy("source").agg(F.sum("n")).collect()]
    goal = targets(sizes, weights, ratio, cap)
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("epochs", T.LongType())])
    table = spark.createDataFrame([(s, n, goal[s], int(goal[s] // n) if n else 0) for s, n in sizes], schema)
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = base.withColumn("upto", F.sum("size").over(inside))
    out = out.join(before, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s")))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    picked = (F.col("before") + F.col("upto")) * 2 - F.col("size") <= rest * 2
    copies = (F.col("epochs") + F.when(picked & (F.col("size") > 0) & (F.col("epochs") * 1.0 < cap), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def apply(docs: DataFrame, **settings) -> DataFrame:
    """Rows of ``docs``, all columns, as often as the mix takes them (see ``mix``).

    Rows that share a doc_id are all taken as often as the one of them taken most.
    """
    plan = mix(docs, **settings).groupBy("doc_id").agg(F.max("copies").alias("copies__")).withColumnRenamed("doc_id", "id__").where("copies__ > 0")
    plan = Scratch(docs.sparkSession, "mix").save(plan, "plan")
    joined = docs.join(broadcast_if_small(plan, plan.count()), F.col("doc_id").eqNullSafe(F.col("id__")))
    return joined.withColumn("copy__", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies__")))).select(*docs.columns)
