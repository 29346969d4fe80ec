import numpy as np
import pytest

from skyadjust.llm import _common
from skyadjust.llm._common import Scratch, components


def plain(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    while any(root[a] != root[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    return sorted(root.items())


EDGES = [(int(a), int(b)) for a, b in np.random.default_rng(4).integers(-400, 400, (500, 2))] + [(7, 7), (1 << 62, -(1 << 62))] + [(1000 + k, 1001 + k) for k in range(60)]


@pytest.mark.parametrize("few", [300_000, 0])
def test_components_are_the_same_on_the_driver_and_by_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(_common, "FEW_EDGES", few, raising=False)
    table = lambda e: spark.createDataFrame(e, "a long, b long")
    assert sorted(map(tuple, components(spark, table(EDGES), "a", "b", Scratch(spark, "t")).collect())) == plain(EDGES)
    assert components(spark, table([]), "a", "b", Scratch(spark, "t")).count() == 0


def test_few_edges_take_few_jobs(spark):
    """Rounds of stages took op3 over its time where partitions are many and edges few."""
    sc = spark.sparkContext
    sc.setJobGroup("few-edges", "")
    components(spark, spark.createDataFrame(EDGES, "a long, b long"), "a", "b", Scratch(spark, "t"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("few-edges")) <= 8
