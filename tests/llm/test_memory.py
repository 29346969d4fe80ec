import tracemalloc

import numpy as np

import corpus_pipeline
from skyadjust.llm import quality
from skyadjust.llm._common import shrink_executors


def full_collections(spark):
    """Full collections of this JVM so far: under a local master it is the executor."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_shrinking_reaches_the_executors(spark):
    before = full_collections(spark)
    shrink_executors(spark)
    assert full_collections(spark) > before


def test_mixing_begins_with_the_memory_given_back(spark, make_docs, prose):
    docs = make_docs([(k, prose(k, 30), "ab"[k % 2]) for k in range(20)])
    before = full_collections(spark)
    corpus_pipeline.mixing_stage(spark, docs, "")
    assert full_collections(spark) > before


def test_the_fit_holds_few_pairs_at_a_time():
    """Differences of all pairs at once, four tables of them, took the driver over its memory in the pipeline's first stage."""
    x = np.random.default_rng(1).random((quality.SAMPLE, quality.N_FEATURES))
    y = (x[:, 0] + x[:, 1] > 1).astype(int)
    tracemalloc.start()
    try:
        found = quality.fit(x, y)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * x.nbytes
    assert ((found.raw(x) > np.median(found.raw(x))) == (y == 1)).mean() > 0.9
