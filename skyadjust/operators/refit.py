"""Refit of image corrections over a grid of ground nodes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.kernels import Camera
from ..shipping import ship
from .adjust import PARAMS


def world_grid(images: DataFrame, size: int = 10, h_min: float = -100.0, h_max: float = 100.0) -> DataFrame:
    """(image_id, camera, width, height, col, row, h, lon, lat): size**3 nodes per image, localized (affine cameras)."""
    w, h = (F.greatest(F.col(c).cast("double") - 1, F.lit(1.0)) for c in ("width", "height"))
    nodes = images.select("image_id", "camera", "width", "height", F.explode(geo.linspace(F.lit(0.0), w, size)).alias("col"))
    nodes = nodes.select("*", F.explode(geo.linspace(F.lit(0.0), h, size)).alias("row"))
    nodes = nodes.select("*", F.explode(geo.linspace(F.lit(h_min), F.lit(h_max), size)).alias("h"))
    lon, lat = geo.localize_affine(F.col("camera"), F.col("col"), F.col("row"), F.col("h"))
    return nodes.withColumns({"lon": lon, "lat": lat})


def refit(images: DataFrame, params: DataFrame, size: int = 10) -> DataFrame:
    """(image_id, a0 .. b2, rmse_pixel): least squares of the corrections on [1, cn, rn] over the grid.

    Projection, correction, normal-equation sums and a 3x3 Cramer solve, all Column algebra: one
    grouped aggregation by image.  A singular system (grids of one node a side) gives null.  Images
    without corrections, and corrections without an image, are left out.
    """
    g = world_grid(images, size).join(F.broadcast(params), "image_id")
    c, r = geo.project(F.col("camera"), F.col("lon"), F.col("lat"), F.col("h"))
    norm = geo.image_norm(F.col("width"), F.col("height"))
    g = g.withColumns({"pc": c, "pr": r})
    dc, dr = geo.affine_delta(F.col("pc"), F.col("pr"), [F.col(p) for p in PARAMS], norm)
    g = g.select("image_id", ((F.col("pc") - norm["c0"]) / norm["sc"]).alias("t1"), ((F.col("pr") - norm["r0"]) / norm["sr"]).alias("t2"), dc.alias("dc"), dr.alias("dr"))
    t = [F.lit(1.0), F.col("t1"), F.col("t2")]
    sums = {f"n{i}{j}": F.sum(t[i] * t[j]) for i in range(3) for j in range(i, 3)} | {f"{d}{i}": F.sum(t[i] * F.col(d)) for d in ("dc", "dr") for i in range(3)}
    sums |= {f"{d}_2": F.sum(F.col(d) * F.col(d)) for d in ("dc", "dr")}
    s = g.groupBy("image_id").agg(*[v.alias(k) for k, v in sums.items()])
    m = [[F.col(f"n{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]

    def det(x):
        return x[0][0] * (x[1][1] * x[2][2] - x[1][2] * x[2][1]) - x[0][1] * (x[1][0] * x[2][2] - x[1][2] * x[2][0]) + x[0][2] * (x[1][0] * x[2][1] - x[1][1] * x[2][0])

    solved = s.withColumn("det", det(m))
    found = {}
    for d, names in (("dc", PARAMS[:3]), ("dr", PARAMS[3:])):
        for k, n in enumerate(names):
            found[n] = F.try_divide(det([[F.col(f"{d}{i}") if j == k else m[i][j] for j in range(3)] for i in range(3)]), F.col("det"))
    solved = solved.withColumns(found)
    left = [F.col(f"{d}_2") - sum((F.col(n) * F.col(f"{d}{i}") for i, n in enumerate(names)), F.lit(0.0)) for d, names in (("dc", PARAMS[:3]), ("dr", PARAMS[3:]))]
    return solved.select("image_id", *PARAMS, F.sqrt(F.greatest(left[0] + left[1], F.lit(0.0)) / F.col("n00")).alias("rmse_pixel"))


def refit_any(images: DataFrame, params: DataFrame, size: int = 10) -> DataFrame:
    """``refit`` for cameras of any kind: grid nodes are localized by Newton steps, one image a group of size**3 nodes."""
    ship(images.sparkSession)
    rows = images.join(F.broadcast(params), "image_id").select("image_id", "width", "height", F.to_json("camera").alias("camera"), *PARAMS)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                camera = Camera.of({"affine": None, "rpc": None} | json.loads(r.camera))
                col, row, h = (a.ravel() for a in np.meshgrid(np.linspace(0, max(r.width - 1, 1), size), np.linspace(0, max(r.height - 1, 1), size), np.linspace(-100, 100, size)))
                lon, lat = camera.localize(col, row, h)
                c, q = camera.project(lon, lat, h)
                a = np.stack([np.ones_like(c), (c - r.width / 2) / max(r.width / 2, 1), (q - r.height / 2) / max(r.height / 2, 1)], 1)
                wanted = a @ np.array([[r.a0, r.b0], [r.a1, r.b1], [r.a2, r.b2]])
                found = np.linalg.lstsq(a, wanted, rcond=None)[0]
                out.append((r.image_id, *found[:, 0], *found[:, 1], float(np.sqrt(((a @ found - wanted) ** 2).sum(1).mean()))))
            yield pd.DataFrame(out, columns=["image_id", *PARAMS, "rmse_pixel"])

    return rows.mapInPandas(fit, "image_id int, " + ", ".join(f"{p} double" for p in PARAMS) + ", rmse_pixel double")
