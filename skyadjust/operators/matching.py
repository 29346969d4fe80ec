"""Pairwise matching: registry of matchers, nearest descriptors, geometric and ground-distance filters."""

from __future__ import annotations

import importlib.util
import math
import os
from abc import ABC, abstractmethod
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MatcherError, WeightFileNotFoundError
from ..functions import geo
from ..shipping import ship

#: Smallest number of matches that a fundamental matrix is estimated from.
MIN_POINTS = 8


class Matcher(ABC):
    """Turns images and image pairs into pair matches."""

    def __init__(self, settings):
        self.settings = settings

    def validate(self) -> None:
        """Raise if what the matcher needs at run time is missing."""

    @abstractmethod
    def match(self, images: DataFrame, pairs: DataFrame) -> DataFrame:
        """(image_i, image_j, match_ord, col_i, row_i, col_j, row_j, score)."""


_MATCHERS: dict[str, type[Matcher]] = {}


def register_matcher(name: str) -> Callable[[type[Matcher]], type[Matcher]]:
    def add(kind: type[Matcher]) -> type[Matcher]:
        if name.lower() in _MATCHERS:
            raise MatcherError(f"matcher {name!r} is registered already")
        _MATCHERS[name.lower()] = kind
        return kind

    return add


def list_matchers() -> list[str]:
    return sorted(_MATCHERS)


def build_matcher(settings) -> Matcher:
    """The matcher that ``settings.name`` names in any case, validated."""
    kind = _MATCHERS.get(str(settings.name).lower())
    if kind is None:
        raise MatcherError(f"unknown matcher {settings.name!r}; there are {', '.join(list_matchers())}")
    made = kind(settings)
    made.validate()
    return made


@register_matcher("sift")
class SiftMatcher(Matcher):
    """SIFT features, once an image, then the two nearest descriptors and the ratio test."""

    def validate(self) -> None:
        if importlib.util.find_spec("cv2") is None:
            raise MatcherError("the sift matcher needs OpenCV (cv2) on the executors")

    def features(self, images: DataFrame) -> DataFrame:
        """(image_id, kp_id, col, row, descriptor) of every image's file, read as bytes through Spark."""
        most, contrast = self.settings.max_features, self.settings.contrast_threshold
        paths = images.select("image_id", "image_path")
        files = images.sparkSession.read.format("binaryFile").load([r[0] for r in paths.select("image_path").collect()]).select(F.col("path"), "content")

        def detect(batches):
            import cv2

            for pdf in batches:
                for image_id, content in zip(pdf["image_id"], pdf["content"], strict=True):
                    gray = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_GRAYSCALE)
                    if gray is None:
                        raise MatcherError(f"image {image_id} cannot be decoded")
                    points, vectors = cv2.SIFT_create(nfeatures=most, contrastThreshold=contrast).detectAndCompute(gray, None)
                    if vectors is not None:
                        yield pd.DataFrame({"image_id": image_id, "kp_id": range(len(points)), "col": [float(p.pt[0]) for p in points], "row": [float(p.pt[1]) for p in points], "descriptor": list(vectors.astype(float))})

        ship(images.sparkSession)
        tail = lambda c: F.element_at(F.split(c, "/"), -1)
        held = paths.withColumn("tail", tail(F.col("image_path"))).join(files.withColumn("tail", tail(F.col("path"))), "tail")
        return held.select("image_id", "content").mapInPandas(detect, "image_id int, kp_id int, col double, row double, descriptor array<double>")

    def match(self, images: DataFrame, pairs: DataFrame) -> DataFrame:
        found = nearest_ratio(self.features(images), pairs, self.settings.ratio_test)
        return found.select("image_i", "image_j", F.col("query_id").alias("match_ord"), "col_i", "row_i", "col_j", "row_j", "score")


@register_matcher("loftr")
class LoftrMatcher(Matcher):
    """Stands for a learned matcher: checks its weights and runtime, and computes nothing."""

    def validate(self) -> None:
        weights = self.settings.weights_path
        if weights is None or not os.path.exists(weights):
            raise WeightFileNotFoundError(f"no weights for loftr at {weights}")
        if importlib.util.find_spec("torch") is None:
            raise MatcherError("the loftr matcher needs torch")

    def match(self, images: DataFrame, pairs: DataFrame) -> DataFrame:
        raise NotImplementedError("loftr inference is not part of this library")


def two_nearest(query: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of each query row's two nearest train rows; ties go to the lower place.

    A matrix product finds the few best, whose distances are then computed without cancellation.
    """
    k = min(len(train), 8)
    places, distances = [], []
    for at in range(0, len(query), 1024):
        q = query[at : at + 1024]
        rough = (train * train).sum(1) - 2 * q @ train.T
        near = np.sort(np.argpartition(rough, k - 1, axis=1)[:, :k], axis=1)
        d = np.sqrt(((q[:, None, :] - train[near]) ** 2).sum(2))
        order = np.argsort(d, axis=1, kind="stable")[:, :2]
        places.append(np.take_along_axis(near, order, 1))
        distances.append(np.take_along_axis(d, order, 1))
    return np.concatenate(places), np.concatenate(distances)


def nearest_ratio(features: DataFrame, pairs: DataFrame, ratio: float = 0.6) -> DataFrame:
    """Matches (image_i, image_j, query_id, train_id, col_i ... score) that pass the ratio test.

    Per image pair, each descriptor of image i is held against all of image j; it matches its nearest
    if that is nearer than ``ratio`` times the second.  Fewer than two descriptors in j match nothing.
    A group is one image pair, bounded by the matcher's feature limit; pairs spread over the cluster.
    """
    ship(features.sparkSession)
    side = lambda which, flag: pairs.select("image_i", "image_j").join(features.withColumnRenamed("image_id", which), which).select("image_i", "image_j", F.lit(flag).alias("is_query"), "kp_id", "col", "row", "descriptor")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = (pdf[pdf["is_query"] == flag].sort_values("kp_id") for flag in (True, False))
        if not len(q) or len(t) < 2:
            return pd.DataFrame(columns=names)
        places, d = two_nearest(np.stack(q["descriptor"].to_numpy()).astype(float), np.stack(t["descriptor"].to_numpy()).astype(float))
        ok = d[:, 0] < ratio * d[:, 1]
        q, t, d = q[ok], t.iloc[places[ok, 0]], d[ok, 0]
        first = pdf.iloc[0]
        return pd.DataFrame({
            "image_i": first["image_i"], "image_j": first["image_j"], "query_id": q["kp_id"].to_numpy(), "train_id": t["kp_id"].to_numpy(),
            "col_i": q["col"].to_numpy(), "row_i": q["row"].to_numpy(), "col_j": t["col"].to_numpy(), "row_j": t["row"].to_numpy(), "score": 1 / (1e-6 + d),
        })

    names = ["image_i", "image_j", "query_id", "train_id", "col_i", "row_i", "col_j", "row_j", "score"]
    schema = "image_i int, image_j int, query_id long, train_id long, col_i double, row_i double, col_j double, row_j double, score double"
    return side("image_i", True).unionAll(side("image_j", False)).groupBy("image_i", "image_j").applyInPandas(match, schema)


def _fundamentals(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fundamental matrices (m, 3, 3) of m sets of point pairs (m, k, 2) by the normalized eight-point method, of rank two; NaN where there is none."""

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = p.mean(1)
        spread = np.sqrt(((p - mean[:, None]) ** 2).sum(2)).mean(1)
        s = np.where(spread > 0, np.sqrt(2) / np.where(spread > 0, spread, 1), 1.0)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0], t[:, 1, 1], t[:, 2, 2] = s, s, 1
        t[:, :2, 2] = -s[:, None] * mean
        return np.concatenate([p, np.ones((*p.shape[:2], 1))], 2) @ t.transpose(0, 2, 1), t

    x, s = normal(a)
    y, t = normal(b)
    out = np.full((len(a), 3, 3), np.nan)
    rows = (y[:, :, :, None] * x[:, :, None, :]).reshape(*a.shape[:2], 9)
    good = np.isfinite(rows).all((1, 2))
    try:
        _, _, v = np.linalg.svd(rows[good])
        u, d, w = np.linalg.svd(v[:, -1].reshape(-1, 3, 3))
    except np.linalg.LinAlgError:
        if len(a) > 1:
            return np.concatenate([_fundamentals(a[k : k + 1], b[k : k + 1]) for k in range(len(a))])
        return out
    d[:, 2] = 0
    out[good] = t[good].transpose(0, 2, 1) @ ((u * d[:, None, :]) @ w) @ s[good]
    return out


def ransac_inliers(a: np.ndarray, b: np.ndarray, threshold: float, confidence: float = 0.999, max_rounds: int = 10_000, seed: int = 0, step: int = 128) -> np.ndarray:
    """Mask of matches within ``threshold`` pixels (Sampson distance) of the best fundamental matrix of eight of them; under eight matches none.

    Where there are no more samples of eight than ``max_rounds``, each is tried once; else seeded ones, ``step`` at a time.
    """
    n = len(a)
    best = np.zeros(n, bool)
    if n < MIN_POINTS:
        return best
    rng = np.random.default_rng(seed)
    x, y = np.c_[a, np.ones(n)], np.c_[b, np.ones(n)]
    every = np.array(list(combinations(range(n), MIN_POINTS))) if math.comb(n, MIN_POINTS) <= max_rounds else None
    done, limit = 0, max_rounds if every is None else len(every)

    def inside(f: np.ndarray) -> np.ndarray:
        fx, fy = x @ f.transpose(0, 2, 1), y @ f
        top = (y * fx).sum(2) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            return top / (fx[..., 0] ** 2 + fx[..., 1] ** 2 + fy[..., 0] ** 2 + fy[..., 1] ** 2) <= threshold**2

    while done < limit:
        m = min(step, limit - done)
        pick = np.stack([rng.choice(n, MIN_POINTS, replace=False) for _ in range(m)]) if every is None else every[done : done + m]
        done += m
        masks = inside(_fundamentals(a[pick], b[pick]))
        top = int(masks.sum(1).argmax())
        if masks[top].sum() > best.sum():
            best = masks[top]
            share = best.mean() ** MIN_POINTS
            if share >= 1 or every is None:
                limit = min(limit, done if share >= 1 else int(np.ceil(np.log(1 - confidence) / np.log(1 - share))))
    if best.sum() >= MIN_POINTS:
        again = inside(_fundamentals(a[best][None], b[best][None]))[0]
        if again.sum() >= best.sum():
            best = again
    return best


def geometric_filter(matches: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Matches that agree with their pair's epipolar geometry; the seed follows from the pair, so reruns agree.

    One group is one image pair.  Pairs with fewer than eight matches keep none, so they are not made groups.
    """
    ship(matches.sparkSession)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("match_ord")
        first = pdf.iloc[0]
        seed = int(first["image_i"]) * 1_000_003 + int(first["image_j"])
        return pdf[ransac_inliers(pdf[["col_i", "row_i"]].to_numpy(float), pdf[["col_j", "row_j"]].to_numpy(float), threshold, seed=seed)]

    enough = matches.withColumn("n__", F.count(F.lit(1)).over(Window.partitionBy("image_i", "image_j"))).where(F.col("n__") >= MIN_POINTS).drop("n__")
    return enough.groupBy("image_i", "image_j").applyInPandas(keep, matches.schema)


def ground_distance(matches: DataFrame, images: DataFrame, h_ref: float = 0.0) -> DataFrame:
    """``matches`` of affine cameras with ``metres``: the distance of both ends on the ground at ``h_ref``, in the UTM zone of end i."""
    side = lambda s: F.broadcast(images.select(F.col("image_id").alias(f"image_{s}"), F.col("camera").alias(f"camera_{s}")))
    joined = matches.join(side("i"), "image_i").join(side("j"), "image_j")
    ends = {s: geo.localize_affine(F.col(f"camera_{s}"), F.col(f"col_{s}"), F.col(f"row_{s}"), F.lit(h_ref)) for s in "ij"}
    placed = joined.withColumns({f"{n}_{s}": c for s, e in ends.items() for n, c in zip(("lon", "lat"), e, strict=True)})
    return placed.withColumn("metres", geo.utm_distance(*[F.col(f"{n}_{s}") for s in "ij" for n in ("lon", "lat")])).select(*matches.columns, "metres")


def geo_filter(matches: DataFrame, images: DataFrame, threshold: float = 100.0, h_ref: float = 0.0) -> DataFrame:
    """Matches whose ends lie less than ``threshold`` metres apart; the images table is a counted, small one."""
    return ground_distance(matches, images, h_ref).where(~F.isnan("metres") & (F.col("metres") < threshold)).select(*matches.columns)


def pair_stats(raw: DataFrame, geometric: DataFrame, kept: DataFrame) -> DataFrame:
    """(image_i, image_j, raw_count, geometric_inliers, geo_filtered) of every pair with raw matches, one aggregation."""
    steps = [("raw_count", raw), ("geometric_inliers", geometric), ("geo_filtered", kept)]
    rows = None
    for name, df in steps:
        part = df.select("image_i", "image_j", *[F.lit(int(n == name)).alias(n) for n, _ in steps])
        rows = part if rows is None else rows.unionAll(part)
    return rows.groupBy("image_i", "image_j").agg(*[F.sum(n).cast("long").alias(n) for n, _ in steps])


def match_summary(stats: DataFrame, total_pairs: int) -> DataFrame:
    """One row: total, processed (pairs that kept a match), dropped, and the mean kept matches of processed pairs (0 without any)."""
    kept = stats.where("geo_filtered > 0")
    out = kept.agg(F.count(F.lit(1)).alias("processed_pairs"), F.coalesce(F.avg("geo_filtered"), F.lit(0.0)).alias("average_matches"))
    total = F.lit(total_pairs).cast("long")
    return out.select(total.alias("total_pairs"), "processed_pairs", (total - F.col("processed_pairs")).alias("dropped_pairs"), "average_matches")


def geo_filter_any(matches: DataFrame, images: DataFrame, threshold: float = 100.0, h_ref: float = 0.0) -> DataFrame:
    """``geo_filter`` for cameras of any kind: ends are localized in vectorized batches, distances stay Column arithmetic."""
    from .triangulate import cameras_of, stacked

    spark = matches.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(stacked(cameras_of(images)))

    @F.pandas_udf("lon double, lat double")
    def ground(image: pd.Series, col: pd.Series, row: pd.Series) -> pd.DataFrame:
        cameras = shipped.value
        lon, lat = cameras.localize(cameras.place(image.to_numpy()), col.to_numpy(), row.to_numpy(), h_ref)
        return pd.DataFrame({"lon": lon, "lat": lat})

    ends = matches.withColumns({f"g_{s}": ground(f"image_{s}", f"col_{s}", f"row_{s}") for s in "ij"})
    placed = ends.withColumns({f"{n}_{s}": F.col(f"g_{s}.{n}") for s in "ij" for n in ("lon", "lat")}).where("not isnan(lon_i) and not isnan(lon_j)")
    return placed.where(geo.utm_distance(*[F.col(f"{n}_{s}") for s in "ij" for n in ("lon", "lat")]) < threshold).select(*matches.columns)
