"""Sharding by balanced label propagation, with DataFrame functions only.

Documents of equal text are linked.  A group's documents that start in the same shard form a cell;
cells, not documents, are the nodes, so a group of any size is at most ``shards`` rows.  Each round
joins cells with the weight their group has in every shard and with the shards' free room, and moves
cells to the shard with most of their group that has room, small cells first, until none can move.  Unlinked documents then
fill what room is left, and a cut of the resulting line into equal parts makes the sizes even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, text_or_empty

GROUP = ["g", "crc", "size"]
#: Quota of a shard while labels move, in mean shard sizes: where most texts have copies, quotas of one mean
#: leave no room to move into.  The cut along the line evens what the quota lets in.
QUOTA = 2.0


def running(df: DataFrame, coarse: Column, n_coarse: int, fine: Column, order: list[Column], value: Column) -> DataFrame:
    """Column ``before``: sum of ``value`` over all rows ahead of a row in (coarse, fine, order).

    ``coarse`` has at most ``n_coarse`` values; their sums are the only rows one task sees.  Rows
    meet in a window only inside one (coarse, fine) part, so many equal keys still spread.
    """
    df = df.withColumns({"c_": coarse, "f_": fine, "v_": value})
    parts = df.groupBy("c_", "f_").agg(F.sum("v_").alias("n_"))
    tops = parts.groupBy("c_").agg(F.sum("n_").alias("t_")).withColumn("above_", F.coalesce(F.sum("t_").over(Window.orderBy("c_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t_")
    inner = Window.partitionBy("c_").orderBy("f_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("left_", F.coalesce(F.sum("n_").over(inner), F.lit(0))).drop("n_").join(F.broadcast(tops) if n_coarse <= 65_536 else tops, "c_")
    rows = Window.partitionBy("c_", "f_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("upto_", F.sum("v_").over(rows)).join(parts, ["c_", "f_"])
    return out.withColumn("before", F.col("upto_") - F.col("v_") + F.col("left_") + F.col("above_")).drop("c_", "f_", "v_", "upto_", "left_", "above_")


def _part(n: int, *cols: str, seed: int = 1) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(n)).cast("int")


def propagate(cells: DataFrame, shards: int, room: float, scratch: Scratch) -> DataFrame:
    """Cells (g, crc, size, c0, bytes, shard) after capacity-bound label propagation, round by round until no cell can move.

    A cell moves only to a shard that holds more of its group (of equal ones, to the smaller number), so
    the sum of squares of a group's bytes by shard rises with every move, and rounds come to an end.
    """
    cells = scratch.save(cells, "cells")
    while True:
        load = cells.groupBy("shard").agg(F.sum("bytes").alias("load"))
        free = cells.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(load), "shard", "left").select("shard", (F.lit(room) - F.coalesce("load", F.lit(0))).alias("free"))
        votes = cells.groupBy(*GROUP, "shard").agg(F.sum("bytes").alias("votes"), F.min("bytes").alias("least")).join(F.broadcast(free), "shard")
        held = votes.groupBy(*GROUP).agg(F.collect_list(F.struct("votes", (-F.col("shard")).alias("back"), "least", "free")).alias("held"))
        rank = lambda v: F.struct(v["votes"], v["back"])
        # A group's most crowded shard with room for a cell from a less crowded one is where its other cells want to go.
        fits = F.filter("held", lambda to: F.exists("held", lambda of: (rank(of) < rank(to)) & (of["least"] <= to["free"])))
        want = held.withColumn("to", F.array_max(F.transform(fits, lambda v: F.struct(v["votes"].alias("votes"), v["back"].alias("back"), v["free"].alias("free")))))
        moved = cells.join(want, GROUP, "left").withColumn("of", F.element_at(F.filter("held", lambda v: v["back"] == -F.col("shard")), 1))
        mover = F.coalesce((rank(F.col("of")) < rank(F.col("to"))) & (F.col("bytes") <= F.col("to.free")), F.lit(False))
        moved = scratch.save(moved.select(*GROUP, "c0", "bytes", "shard", mover.alias("mover"), (-F.col("to.back")).alias("want"), F.col("to.free").alias("free")), "moved")
        wanted = dict(moved.where("mover").groupBy("want").agg(F.sum("bytes")).collect())
        if not wanted:
            return cells
        ahead = F.lit(0)
        for w, n in wanted.items():
            ahead = ahead + F.when(F.col("want") > w, F.lit(n)).otherwise(F.lit(0))
        # Small cells first: what does not fit keeps nothing else out, and the first always fits.
        power = F.floor(F.log2(F.col("bytes"))).cast("int")
        part = F.pmod(F.floor(F.col("bytes") * 16 / F.pow(F.lit(2.0), power)), F.lit(16)).cast("int") * 64 + _part(64, *GROUP, "c0")
        order = [F.col("bytes"), *map(F.col, GROUP), F.col("c0")]
        going = running(moved.where("mover"), F.col("want") * 64 + power, shards * 64, part, order, F.col("bytes"))
        going = going.select(*GROUP, "c0", "bytes", F.when(F.col("before") - ahead + F.col("bytes") <= F.col("free"), F.col("want")).otherwise(F.col("shard")).alias("shard"))
        new = scratch.save(moved.where("not mover").select(*GROUP, "c0", "bytes", "shard").unionByName(going), "cells")
        scratch.drop(cells, moved)
        cells = new


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into one of ``shards`` shards of near equal bytes, equal texts together.

    Size is the text's UTF-8 bytes (null: none) plus 16.  Returns (doc_id, size, text_crc32, shard,
    slot); slots count from 0 without gaps in each shard.  Shard sizes differ from the mean by at
    most about one document.  A group of equal texts larger than a shard is split over several.
    Null and empty texts are equal texts; repeated rows each get a slot; an empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    t = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("crc"), F.xxhash64(t).alias("g"))
    base = scratch.save(base.withColumn("c0", _part(shards, "doc_id")), "base")
    total = base.agg(F.sum("size")).first()[0] or 0
    room = total / shards
    counted = base.groupBy(*GROUP, "c0").agg(F.count(F.lit(1)).alias("n"))
    groups = counted.groupBy(*GROUP).agg(F.sum("n").alias("n_all"))
    cells = counted.join(groups.where("n_all > 1"), GROUP).select(*GROUP, "c0", (F.col("n") * F.col("size")).alias("bytes"), F.col("c0").alias("shard"))
    cells = propagate(cells, shards, room * QUOTA, scratch)
    placed = base.join(cells.select(*GROUP, "c0", F.col("shard").alias("label")), [*GROUP, "c0"], "left")
    placed = scratch.save(placed, "placed")
    linked = placed.where(F.col("label").isNotNull())
    single = running(placed.where(F.col("label").isNull()), _part(1024, "doc_id"), 1024, _part(16, "doc_id", seed=2), [F.col("doc_id"), F.col("g")], F.col("size"))
    loads = dict(linked.groupBy("label").agg(F.sum("size")).collect())
    left = total - sum(loads.values())
    gaps = [max(0.0, room - loads.get(s, 0)) for s in range(shards)]
    scale, ends, at = (left / sum(gaps) if sum(gaps) else 0.0), [], 0.0
    for gap in gaps[:-1]:
        at += gap * scale
        ends.append(at)
    bounds = F.array(*[F.lit(float(x)) for x in ends])
    middle = F.col("before") + F.col("size") / 2
    single = single.withColumn("label", F.size(F.filter(bounds, lambda b: b <= middle)).cast("int")).drop("before")
    line = linked.unionByName(single)
    # Along the line of labels, groups stay together; the cut into equal parts evens what quotas left.
    line = running(line, F.col("label") * 1024 + _part(1024, *GROUP), shards * 1024, _part(64, "doc_id"), [*map(F.col, GROUP), F.col("doc_id")], F.col("size"))
    step = max(1.0, total / shards)
    line = line.withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("before") + F.col("size") / 2) / step)).cast("int")).drop("before")
    line = scratch.save(line.select("doc_id", "size", "crc", "g", "shard"), "line")
    one = F.lit(1).cast("long")
    slots = running(line, F.col("shard") * 256 + _part(256, "doc_id"), shards * 256, F.lit(0), [F.col("doc_id"), F.col("g")], one)
    counts = line.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return slots.join(F.broadcast(first), "shard").select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") - F.col("first")).cast("long").alias("slot"))
