"""Cameras, map projection, polygons, footprints."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyadjust.functions import geo, kernels
from skyadjust.operators import overlap


def plane(spark, rows):
    """Images with cameras col = lon + dx + cl*h, row = lat + dy + rl*h; rows: (image_id, w, h, dx, dy, cl, rl)."""
    zero, one = F.lit(0.0), F.lit(1.0)
    df = spark.createDataFrame(rows, "image_id int, width int, height int, dx double, dy double, cl double, rl double")
    return df.select("image_id", "width", "height", geo.affine_camera(zero, zero, (one, zero, F.col("cl"), F.col("dx")), (zero, one, F.col("rl"), F.col("dy"))).alias("camera"))


RPC = {
    "line_off": 5000.0, "samp_off": 4000.0, "lat_off": 30.0, "long_off": 110.0, "height_off": 200.0, "line_scale": 5000.0, "samp_scale": 4000.0, "lat_scale": 0.1, "long_scale": 0.1, "height_scale": 300.0,
    "line_num": [0.001, 0.01, -1.0, 0.02, 0.001] + [0.0] * 15, "line_den": [1.0, 0.001, 0.002] + [0.0] * 17, "samp_num": [0.002, 1.0, 0.01, -0.03] + [0.0] * 16, "samp_den": [1.0, -0.001] + [0.0] * 18,
}


def rational(spark):
    return spark.createDataFrame([(0, 8000, 10000, ("rpc00b", None, tuple(RPC.values())))], "image_id int, width int, height int, camera " + geo.CAMERA_TYPE.simpleString())


def test_projection_of_columns(spark):
    zero, one = F.lit(0.0), F.lit(1.0)
    camera = geo.affine_camera(zero, zero, (one, zero, one, zero), (zero, one, -one, zero))
    c, r = geo.project(F.col("camera"), F.col("lon"), F.col("lat"), F.lit(0.5))
    rows = spark.createDataFrame([(1.0, 4.0), (2.0, 5.0), (3.0, 6.0)], "lon double, lat double").withColumn("camera", camera).select(c.alias("c"), r.alias("r")).collect()
    assert [tuple(x) for x in rows] == [(1.5, 3.5), (2.5, 4.5), (3.5, 5.5)]


def test_rational_columns_equal_the_kernel(spark):
    camera = kernels.Camera("rpc00b", None, RPC)
    lon, lat, h = np.array([109.95, 110.0, 110.07]), np.array([29.93, 30.0, 30.05]), np.array([0.0, 200.0, 450.0])
    c, r = camera.project(lon, lat, h)
    pts = spark.createDataFrame([tuple(map(float, p)) for p in zip(lon, lat, h, strict=True)], "lon double, lat double, h double").crossJoin(rational(spark))
    cc, rr = geo.project(F.col("camera"), F.col("lon"), F.col("lat"), F.col("h"))
    got = sorted(map(tuple, pts.select("lon", cc, rr).collect()))
    assert np.allclose([g[1] for g in got], c) and np.allclose([g[2] for g in got], r)
    back = camera.localize(c, r, h)
    assert np.allclose(back[0], lon, atol=1e-10) and np.allclose(back[1], lat, atol=1e-10)


def test_jacobian(spark):
    zero = F.lit(0.0)
    camera = geo.affine_camera(zero, zero, (F.lit(1.0), F.lit(2.0), F.lit(0.5), zero), (F.lit(3.0), F.lit(-1.0), F.lit(0.2), zero))
    df = spark.range(1).select(camera.alias("k"))
    c, r = geo.project(F.col("k"), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert df.select(c, r).first() == pytest.approx((6.5, 1.6))
    assert df.select(*geo.jacobian(F.col("k"), F.lit(1.0), F.lit(2.0), F.lit(3.0))).first() == pytest.approx((1, 2, 0.5, 3, -1, 0.2), abs=1e-6)


def test_affine_localize_and_singular_camera(spark):
    df = plane(spark, [(0, 10, 10, 5.0, 2.0, 0.1, 0.2)])
    assert df.select(*geo.localize_affine(F.col("camera"), F.lit(6.0), F.lit(4.0), F.lit(10.0))).first() == pytest.approx((0.0, 0.0))
    zero = F.lit(0.0)
    flat = spark.range(1).select(geo.affine_camera(zero, zero, (zero, zero, zero, zero), (zero, zero, zero, zero)).alias("k"))
    assert tuple(flat.select(*geo.localize_affine(F.col("k"), zero, zero, zero)).first()) == (None, None)


def test_quantize_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(0.625,), (0.875,), (-0.125,), (10.2,)], "v double")
    assert [r[0] for r in df.select(geo.quantize(F.col("v"), 0.25)).collect()] == [2, 4, 0, 41]


def test_boundary(spark):
    ring = lambda w, h: [(p["col"], p["row"]) for p in spark.range(1).select(geo.boundary(F.lit(w), F.lit(h))).first()[0]]
    pts = ring(100, 50)
    assert len(pts) == 16 and pts[0] == (0, 0) and pts[4] == (99, 0) and pts[8] == (99, 49) and pts[12] == (0, 49)
    assert sum(r == 0 for _, r in pts) == 5 and ring(1, 1) == [(0.0, 0.0)]


def test_utm(spark):
    df = spark.createDataFrame([(9.0, 45.0), (9.0, -45.0), (179.999, 0.0), (180.0, 0.0), (-180.0, 1.0)], "lon double, lat double").withColumn("epsg", geo.utm_epsg(F.col("lon"), F.col("lat")))
    rows = df.select("epsg", geo.utm(F.col("lon"), F.col("lat"), F.col("epsg")).alias("p")).collect()
    assert [r["epsg"] for r in rows] == [32632, 32732, 32660, 32661, 32601]
    assert rows[0]["p"]["e"] == pytest.approx(500000) and rows[0]["p"]["n"] == pytest.approx(4982950.400, abs=2e-3)
    assert rows[1]["p"]["n"] == pytest.approx(1e7 - 4982950.400, abs=2e-3)


def box(x0, y0, x1, y1):
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)


def test_polygon_areas(spark):
    assert kernels.intersection_area(box(0, 0, 10, 10), box(5, 5, 15, 15)) == pytest.approx(25)
    assert kernels.intersection_area(box(0, 0, 10, 10)[::-1], box(2, 2, 4, 4)) == pytest.approx(4)
    assert kernels.intersection_area(box(0, 0, 1, 1), box(1, 0, 2, 1)) == 0
    arrow = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)
    assert kernels.intersection_area(arrow, arrow) == pytest.approx(abs(kernels.ring_area(arrow)))
    assert kernels.intersection_area(arrow, box(0, 0, 4, 1)) == pytest.approx(4)
    area = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 3.0)],)], "r array<struct<x:double,y:double>>").select(geo.shoelace(F.col("r"))).first()[0]
    assert area == 6.0


@pytest.mark.parametrize("threshold,pairs", [(0.2, [(0, 1)]), (0.25, [(0, 1)]), (0.2501, []), (0.0, [(0, 1), (0, 2), (1, 2)])])
def test_overlap_pairs_and_adjacency(spark, threshold, pairs):
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in box(*b)]) for i, b in enumerate([(0, 0, 10, 10), (5, 5, 15, 15), (20, 20, 30, 30)])] + [(3, None)]
    rings = spark.createDataFrame(rows, "image_id int, ring array<struct<x:double,y:double>>")
    got = overlap.overlap_pairs(rings, threshold, 7.0)
    assert sorted((r["image_i"], r["image_j"]) for r in got.collect()) == pairs
    if threshold == 0.2:
        assert got.first()["overlap"] == pytest.approx(0.25)
        assert {r["image_id"]: r["neighbours"] for r in overlap.adjacency(rings, got).collect()} == {0: [1], 1: [0], 2: [], 3: []}
        boxes = spark.createDataFrame([(i, float(a), float(c), float(b), float(d)) for i, (a, b, c, d) in enumerate([(0, 0, 10, 10), (5, 5, 15, 15), (20, 20, 30, 30)])], "image_id int, x0 double, x1 double, y0 double, y1 double")
        assert [tuple(r) for r in overlap.box_overlap_pairs(boxes, 0.2, 4.0).collect()] == [(0, 1, 0.25)]


def test_footprints_of_rational_cameras(spark):
    ring = overlap.footprints(rational(spark), 200.0).first()["ring"]
    assert len(ring) == 16 and all(3.8e5 < p["x"] < 4.3e5 and 3.2e6 < p["y"] < 3.5e6 for p in ring)


def test_pairs_come_from_an_equi_join(spark):
    rings = spark.createDataFrame([(0, [{"x": 0.0, "y": 0.0}])], "image_id int, ring array<struct<x:double,y:double>>")
    plan = overlap.candidate_pairs(rings, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_losses_agree(spark):
    z = [0.0, 0.25, 1.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    for name in ("linear", "soft_l1", "huber", "cauchy", "arctan"):
        r, s = kernels.loss(name, np.array(z))
        got = df.select(geo.rho(name, F.col("z")), geo.rho_slope(name, F.col("z"))).collect()
        assert np.allclose([g[0] for g in got], r) and np.allclose([g[1] for g in got], s)
    assert kernels.loss("soft_l1", np.array([3.0]))[0][0] == pytest.approx(2 * (math.sqrt(4) - 1))
