"""Python functions on executors that need not have this package installed."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


#: Rows and bytes of an Arrow batch where the session has Spark's own defaults: long texts make 10,000 rows a
#: batch of tens of megabytes, held several times outside the heap by each task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "8388608")}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as a zip that workers import from; and bound Arrow batches."""
    sc = spark.sparkContext
    for key, (default, ours) in BATCH.items():
        if default is None or spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="skyadjust-code-"), "skyadjust.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _SENT.add(sc.applicationId)


def trim() -> None:
    """Give freed memory back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` whose workers can import this package and hand memory back after each batch: idle ones are kept, and count."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from skyadjust.shipping import trim

        def trimmed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                trim()

        try:
            yield from fn(trimmed())
        finally:
            trim()

    return df.mapInArrow(run, schema)
