"""Dense ids in a global order, without a global window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .graph import cut


def dense_ids(df: DataFrame, coarse: list[Column], order: list[Column], name: str) -> DataFrame:
    """Number rows 0, 1, 2 ... in the order of ``coarse`` then ``order``.

    Rows are counted by coarse key, the counts are summed up in key order (one small row a key in one
    task), and rows are numbered inside their key; equal coarse keys must stand together in the order.
    """
    keys = {f"k{i}__": c for i, c in enumerate(coarse)}
    df = df.withColumns(keys)
    w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n__")).withColumn("first__", F.coalesce(F.sum("n__").over(w), F.lit(0))).drop("n__")
    counts = counts.withColumnsRenamed({k: f"c_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys]
    numbered = df.withColumn("r__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = numbered.join(counts, on).withColumn(name, (F.col("first__") + F.col("r__") - 1).cast("long"))
    return out.drop(*keys, *[f"c_{k}" for k in keys], "r__", "first__")


def sorted_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows 0, 1, 2 ... in the order of columns that no two rows share, without coarse keys.

    Rows are sorted in ranges and written with their place, which the result reads until it is given to
    ``drop``; the ranges' counts are summed up.
    """
    at = F.monotonically_increasing_id()
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at__", at), "sorted")
    piece = F.shiftright("at__", 33)
    counts = placed.groupBy(piece.alias("piece__")).agg(F.count(F.lit(1)).alias("n__"))
    w = Window.orderBy("piece__").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("piece__", F.coalesce(F.sum("n__").over(w), F.lit(0)).alias("first__"))
    out = placed.join(F.broadcast(first), piece == F.col("piece__")).withColumn(name, F.col("first__") + F.col("at__").bitwiseAND(F.lit((1 << 33) - 1))).drop("at__", "piece__", "first__")
    out.cut_path = placed.cut_path
    return out


def exact_median(values: DataFrame, name: str) -> float | None:
    """Exact median of a column of doubles that are not negative, NaN largest; null without any.

    The bits of such doubles order as they do, so the two middle ranks are found 16 bits a pass by
    counts, which each task adds up: no task holds the values.  ``values`` is read up to four times.
    """

    def ranked(prefix: int, level: int) -> dict[int, int]:
        """Counts by the next 16 bits of values that begin with ``prefix``, 16 * level bits."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << 16, np.int64)
            for batch in batches:
                x = batch.column(0).drop_null().to_numpy(zero_copy_only=False) + 0.0
                bits = np.where(np.isnan(x), np.nan, np.abs(x)).view(np.uint64)
                if level:
                    bits = bits[bits >> np.uint64(64 - 16 * level) == prefix]
                total += np.bincount(((bits >> np.uint64(48 - 16 * level)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["k", "n"])

        got = map_arrow(values.select(F.col(name).cast("double")), count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        return dict(sorted(map(tuple, got)))

    known: dict[tuple[int, int], dict[int, int]] = {(0, 0): ranked(0, 0)}
    n = sum(known[0, 0].values())
    if not n:
        return None
    ends = []
    for rank in ((n - 1) // 2, n // 2):
        prefix = 0
        for level in range(4):
            if (prefix, level) not in known:
                known[prefix, level] = ranked(prefix, level)
            for k, m in known[prefix, level].items():
                if rank < m:
                    prefix = prefix << 16 | k
                    break
                rank -= m
        ends.append(float(np.array([prefix], np.uint64).view(np.float64)[0]))
    return ends[0] * 0.5 + ends[1] * 0.5
