"""Tracks, graphs, matching and catalog pieces."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyadjust.errors import MatcherError, WeightFileNotFoundError
from skyadjust.operators import graph, matching, tracks
from skyadjust.operators.order import dense_ids
from skyadjust.sources.artifacts import MATCHES

OBS = "obs_id long, track_id long, image_id int, col double, row double, score double"


def matches(spark, rows):
    return spark.createDataFrame(rows, MATCHES)


FIXTURE = [(0, 1, 0, 10.0, 10.0, 20.0, 20.0, 0.9), (0, 1, 1, 10.2, 10.1, 20.1, 20.1, 0.2), (1, 2, 0, 20.0, 20.0, 30.0, 30.0, 0.8)]


def test_track_of_three_images(spark):
    m = matches(spark, FIXTURE)
    index = tracks.observation_index(m, 0.5)
    assert tracks.match_edges(m, index, 0.5).count() == 3
    got = sorted(tracks.build_tracks(m, 0.5).select("obs_id", "track_id", "image_id", "col", "row", "score").collect())
    assert [tuple(r) for r in got] == [(0, 0, 0, 10.2, 10.1, 0.2), (1, 0, 1, 20.0, 20.0, 0.8), (2, 0, 2, 30.0, 30.0, 0.8)]
    assert tracks.build_tracks(matches(spark, [])).count() == 0


def test_first_seen_ids_and_last_values_against_plain_python(spark):
    r = random.Random(2)
    rows = []
    for i in range(4):
        for j in range(i + 1, 4):
            rows += [(i, j, k, r.randrange(12) / 8, r.randrange(3) / 8, r.randrange(12) / 8, r.randrange(3) / 8, r.choice([None, r.random()])) for k in range(25)]
    seen = {}
    for i, j, _, ci, ri, cj, rj, s in rows:
        for image, c, q in ((i, ci, ri), (j, cj, rj)):
            key = (image, round(c / 0.25), round(q / 0.25))
            seen[key] = (seen[key][0] if key in seen else len(seen), c, q, s)
    got = {(x["image_id"], x["qc"], x["qr"]): (x["obs_id"], x["col"], x["row"], x["score"]) for x in tracks.observation_index(matches(spark, rows).repartition(5)).collect()}
    assert got == seen


def test_components_against_plain_python(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5), (2000, 2000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_reachable(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "a int, b int")
    assert sorted(r[0] for r in graph.reachable(e, "a", "b", 2).collect()) == [0, 1, 2]
    assert [r[0] for r in graph.reachable(e, "a", "b", 9).collect()] == [9]


def test_dense_ids_follow_the_order(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(200)], "a int, b int").repartition(6)
    from pyspark.sql import functions as F

    got = dense_ids(df, [F.col("a")], [F.col("b")], "id").orderBy("a", "b").collect()
    assert [r["id"] for r in got] == list(range(200))


def test_best_view_of_ties_and_nulls(spark):
    rows = [(0, 0, 0, 1.0, 1.0, None), (1, 0, 0, 2.0, 1.0, 0.5), (2, 0, 0, 3.0, 1.0, 0.5), (3, 0, 1, 4.0, 1.0, None), (4, 0, 1, 5.0, 1.0, None)]
    assert sorted(r["obs_id"] for r in tracks.best_views(spark.createDataFrame(rows, OBS)).collect()) == [1, 3]


def test_filters(spark):
    nan = float("nan")
    rows = [(0, 0, 0, 0.0, 0.0, 0.1), (1, 0, 1, 0.0, 0.0, 0.2), (2, 1, 0, 0.0, 0.0, 0.9), (3, 2, 2, 0.0, 0.0, None), (4, 2, 3, 0.0, 0.0, None), (5, 3, 2, 0.0, 0.0, nan), (6, 3, 3, 0.0, 0.0, 0.9), (7, 4, 0, 0.0, 0.0, 0.9), (8, 4, 1, 0.0, 0.0, 0.9), (9, 4, 4, 0.0, 0.0, 0.9)]
    o = spark.createDataFrame(rows, OBS)
    ids = lambda df: sorted({r["track_id"] for r in df.select("track_id").collect()})
    assert ids(tracks.passing(tracks.track_stats(o), 2)) == [0, 2, 3, 4]
    assert ids(tracks.passing(tracks.track_stats(o), 2, 2, 0.15)) == [0, 3]
    assert ids(tracks.passing(tracks.track_stats(o), 2, None, 0.1500001)) == [3, 4]
    assert ids(tracks.filter_tracks(o, 0)) == [0, 4] and ids(tracks.filter_tracks(o, 2)) == [2, 3] and ids(tracks.filter_tracks(o, 77)) == []
    assert ids(tracks.filter_tracks(o, 0, connected=False)) == [0, 2, 3, 4]
    assert [tuple(r) for r in tracks.length_histogram(o).collect()] == [(1, 1), (2, 3), (3, 1)]
    assert tracks.average_length(o).first()[0] == 2.0 and tracks.average_length(o.limit(0)).first()[0] == 0.0


def test_reference_image(spark):
    o = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, None), (1, 0, 1, 0.0, 0.0, None), (2, 1, 0, 0.0, 0.0, None), (3, 1, 2, 0.0, 0.0, None)], OBS)
    images = spark.createDataFrame([(i,) for i in range(4)], "image_id int")
    scores = tracks.reference_scores(o, images)
    assert dict(map(tuple, scores.collect())) == {0: 4, 1: 2, 2: 2, 3: 0}
    assert tracks.select_reference(scores).image_id == 0
    assert tracks.select_reference(scores.where("image_id > 0")).image_id == 1
    fixed = tracks.select_reference(scores, "fixed", 2)
    assert (fixed.image_id, fixed.reason) == (2, "fixed-config")
    with pytest.raises(ValueError):
        tracks.select_reference(scores, "fixed")


def test_registry():
    assert matching.list_matchers() == ["loftr", "sift"]
    with pytest.raises(MatcherError, match="loftr, sift"):
        matching.build_matcher(SimpleNamespace(name="unknown"))
    with pytest.raises(WeightFileNotFoundError):
        matching.build_matcher(SimpleNamespace(name="LoFTR", weights_path="/no/such/file"))
    with pytest.raises(MatcherError):
        matching.register_matcher("sift")(matching.SiftMatcher)


def test_two_nearest_ties_go_to_the_lower_place():
    train = np.array([[1.0, 0], [1.0, 0], [0, 1.0], [5, 5]])
    places, d = matching.two_nearest(np.array([[1.0, 0.0], [0.0, 0.9]]), train)
    assert places.tolist() == [[0, 1], [2, 0]] and d[0].tolist() == [0, 0]


def test_ratio_test_needs_two(spark):
    f = "image_id int, kp_id long, col double, row double, descriptor array<double>"
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "image_i int, image_j int")
    rows = [(0, 0, 1.0, 2.0, [0.0, 0.0]), (1, 0, 3.0, 4.0, [0.1, 0.0]), (1, 1, 5.0, 6.0, [1.0, 0.0]), (2, 0, 7.0, 8.0, [0.0, 0.0])]
    got = matching.nearest_ratio(spark.createDataFrame(rows, f), pairs, 0.6).collect()
    assert [(r["image_j"], r["train_id"], r["col_j"]) for r in got] == [(1, 0, 3.0)] and got[0]["score"] == pytest.approx(1 / (1e-6 + 0.1))


def test_ransac_finds_planted_geometry(spark):
    rng = np.random.default_rng(1)
    pts = rng.uniform(-1, 1, (60, 3)) + [0, 0, 5]
    a = pts[:, :2] / pts[:, 2:] * 800
    turn = np.array([[0.98, 0, 0.199], [0, 1, 0], [-0.199, 0, 0.98]])
    moved = pts @ turn.T + [1, 0.2, 0]
    b = moved[:, :2] / moved[:, 2:] * 800
    wrong = rng.choice(60, 18, replace=False)
    b[wrong] += rng.uniform(40, 90, (18, 2))
    mask = matching.ransac_inliers(a, b, 1.5, seed=3)
    good = np.ones(60, bool)
    good[wrong] = False
    assert mask[good].all() and mask[wrong].mean() < 0.2
    assert not matching.ransac_inliers(a[:7], b[:7], 1.5).any()
    rows = [(0, 1, k, *map(float, a[k]), *map(float, b[k]), 1.0) for k in range(60)] + [(0, 2, k, *map(float, a[k]), *map(float, b[k]), 1.0) for k in range(7)]
    kept = matching.geometric_filter(matches(spark, rows)).collect()
    assert {r["image_j"] for r in kept} == {1} and len(kept) >= 42


def test_ground_distance_limits(spark):
    from .test_geometry import plane

    images = plane(spark, [(0, 10, 10, 0.0, 0.0, 0.0, 0.0), (1, 10, 10, 0.0, 0.0, 0.0, 0.0)])
    m = matches(spark, [(0, 1, 0, 9.0, 45.0, 9.0, 45.0001, 1.0), (0, 1, 1, 9.0, 45.0, 9.0, 45.01, 1.0)])
    d = sorted(r["metres"] for r in matching.ground_distance(m, images).collect())
    assert d[0] == pytest.approx(11.11, abs=0.01) and d[1] == pytest.approx(1111.0, abs=1)
    assert matching.geo_filter(m, images, d[0]).count() == 0 and matching.geo_filter(m, images, d[0] + 1e-6).count() == 1
    assert [r["match_ord"] for r in matching.geo_filter_any(m, images, 100.0).collect()] == [0]


def test_pair_stats(spark):
    raw = matches(spark, [(0, 1, 0, 1.0, 2.0, 1.1, 2.1, 0.9), (0, 1, 1, 5.0, 6.0, 5.1, 6.1, 0.8), (0, 2, 0, 1.0, 1.0, 1.0, 1.0, 1.0)])
    stats = matching.pair_stats(raw, raw.where("image_j = 1"), raw.where("image_j = 1 and match_ord = 0"))
    assert sorted(map(tuple, stats.collect())) == [(0, 1, 2, 2, 1), (0, 2, 1, 0, 0)]
    assert tuple(matching.match_summary(stats, 5).first()) == (5, 1, 4, 1.0)
    assert tuple(matching.match_summary(stats.limit(0), 0).first()) == (0, 0, 0, 0.0)


def test_cliques_give_the_tracks_of_their_matches_with_no_file_of_matches(spark, tmp_path):
    """Ids and tracks as from listed matches; ties, groups of one image and views that groups share occur.  Written files stay below a row a match."""
    from skyadjust.plans import catalogue, testbed

    r = random.Random(11)
    rows = [(g, r.randrange(3), r.randrange(2), r.randrange(6), float(r.randrange(1, 4)), r.randrange(400) / 8, 0.1 * r.randrange(3)) for g in range(150) for _ in range(r.randrange(1, 9))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double")
    lines.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    m = testbed.pair_matches(spark, str(tmp_path))
    index = tracks.observation_index(m)
    label = graph.components(tracks.match_edges(m, index), "obs_a", "obs_b").collect()
    rank = {c: k for k, c in enumerate(sorted({x["component"] for x in label}))}
    want = sorted((x["node"], rank[x["component"]]) for x in label)
    written, cut = [], graph.cut
    with pytest.MonkeyPatch.context() as patch:
        for where in (graph, tracks, catalogue):
            patch.setattr(where, "cut", lambda df, name: written.append(cut(df, name)) or written[-1])
            if where is tracks:
                patch.setattr(where, "drop", lambda df: None)
        got = sorted(map(tuple, catalogue.track_components(spark, str(tmp_path)).collect()))
    assert got == want and 0 < len(rank) < len(label)
    names = [w.cut_path.rsplit("/", 1)[1].split("-")[0] for w in written]
    assert "places" in names and "index" not in names


def test_sorted_ids_follow_the_order(spark):
    from skyadjust.operators.order import sorted_ids

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("int").alias("a"), (F.col("id") % 3).alias("b")).repartition(7)
    got = sorted_ids(df, ["b", "a"], "k").orderBy("k").collect()
    assert [r["k"] for r in got] == list(range(5000)) and [(r["b"], r["a"]) for r in got] == sorted((r["b"], r["a"]) for r in got)
    assert sorted_ids(df.limit(0), ["b", "a"], "k").count() == 0
