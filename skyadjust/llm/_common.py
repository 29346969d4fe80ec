"""Helpers that every operator of this subpackage uses: shared scratch tables and components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters part words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"

#: Edges that ``components`` joins on the driver at most (16 bytes each); it gives the same beyond, by rounds of jobs.
FEW_EDGES = 300_000

#: Columns of ``documents``, in order.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where unset (tests), a folder of our own, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = "file://" + tempfile.mkdtemp(prefix="skyadjust-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written to the shared folder, so lineage is cut and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; the result carries ``scratch_path`` for ``drop``."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files of steps whose results are saved: it acts when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing lazy reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            at = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            at.getFileSystem(conf).delete(at, True)


def shrink_executors(spark: SparkSession) -> None:
    """Let executors collect garbage, so that heap which an earlier step filled goes back to the system: their Python workers need it.

    A task for each core, which reach all executors where none is busy; nothing depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def broadcast_if_small(df: DataFrame, rows: int, bound: int = 300_000) -> DataFrame:
    """Hint a broadcast for a counted table of narrow rows; beyond ``bound`` rows the join shuffles."""
    return F.broadcast(df) if rows <= bound else df


def hash_share(hashed: Column, rows: int, total: int) -> Column:
    """Whether a 64-bit hash falls into the share of hashes that holds about ``rows`` of ``total`` rows: a sample that reruns draw again."""
    return hashed <= F.lit(min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, rows / max(total, 1)))))


def unite(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the trees of ``p`` and ``q`` in ``root``, in place; every entry is its tree's smallest number."""
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root[:] = root[root]


def _united(edges: pa.Table) -> pa.Table:
    """(node, root) of every node of the edges (u, v)."""
    u, v = (edges.column(i).to_numpy() for i in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(nodes))
    unite(root, at[: len(u)], at[len(u) :])
    return pa.table({"node": nodes, "root": nodes[root]})


def components(spark: SparkSession, edges: DataFrame, a: str, b: str, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` holds pairs of longs; self-loops and repeats may occur.  Returns (node, root) for every
    node that has an edge to another, root being the smallest node of its component.  Each round is a
    pair of grouped aggregations and joins on the node; nothing is collected but the edge-change count.
    At most FEW_EDGES edges are joined on the driver instead: a round takes a dozen stages, however few there are.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u"), F.col("v"))
        if large:
            both = both.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u")
        if large:
            out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = scratch.save(e, "edges")
    if e.count() <= FEW_EDGES:
        found = _united(e.toArrow())
        scratch.drop(e)
        return scratch.save(spark.createDataFrame(found, "node long, root long"), "united")
    before = None
    for _ in range(max_rounds):
        new = scratch.save(star(star(e, True), False), "stars")
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = new
        if tuple(mark) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(mark)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
