"""Files between the stages, read and written through Spark.

Parquet is the form for large tables; the JSON, JSON-lines, CSV and npz forms of the established tools
are read and written as well.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataModelError
from ..operators.adjust import Adjusted, affine_rows, image_errors, report_row, residuals
from ..operators.tracks import average_length, length_histogram, nested, per_image
from ..shipping import ship

MATCHES = "image_i int, image_j int, match_ord long, col_i double, row_i double, col_j double, row_j double, score double"
TRACKS = "track_id long, observations array<struct<obs_id:bigint,image_id:int,col:double,row:double,score:double>>"
BINS = 20


def write_json(spark: SparkSession, path: str, value) -> None:
    """A JSON document of small, already collected values; int keys become strings."""
    spark.createDataFrame([(json.dumps(value, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    """What ``write_json`` wrote, or a plain JSON file."""
    rows = spark.read.option("wholetext", True).text(path).collect()
    return json.loads("".join(r[0] for r in rows))


def write_matches(matches: DataFrame, folder: str) -> None:
    """Matches as Parquet, sorted by pair within each file, and the manifest of pairs that hold any.

    Pairs have no folders of their own: their number grows with the square of the images.
    """
    matches.sortWithinPartitions("image_i", "image_j", "match_ord").write.mode("overwrite").parquet(f"{folder}/matches")
    pairs = spark_pairs(read_matches(matches.sparkSession, folder))
    pairs.write.mode("overwrite").json(f"{folder}/pairs")


def spark_pairs(matches: DataFrame) -> DataFrame:
    """(pair, file, matches) of every pair, as in the manifest."""
    counts = matches.groupBy("image_i", "image_j").agg(F.count(F.lit(1)).alias("matches"))
    return counts.select(F.array("image_i", "image_j").alias("pair"), F.format_string("pair_%04d_%04d", "image_i", "image_j").alias("file"), "matches")


def read_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches that ``write_matches`` wrote; folders by pair are read too."""
    return spark.read.schema(MATCHES).parquet(f"{folder}/matches")


def import_npz(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """Matches of a manifest ``[{pair, file, matches}]`` and its npz files (pts_i, pts_j, scores).

    A pair listed twice has the matches of its last entry.  Lists end with the shortest; without any
    scores all are 1.
    """
    ship(spark)
    listed = spark.read.option("multiLine", True).json(manifest)
    tail = F.element_at(F.split("file", "/"), -1)
    entries = listed.withColumn("place", F.monotonically_increasing_id()).groupBy(F.col("pair")[0].cast("int").alias("image_i"), F.col("pair")[1].cast("int").alias("image_j")).agg(F.max_by(tail, "place").alias("file"))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, j, content in zip(pdf["image_i"], pdf["image_j"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    a, b = z["pts_i"].reshape(-1, 2), z["pts_j"].reshape(-1, 2)
                    s = z["scores"] if "scores" in z and len(z["scores"]) else np.ones(min(len(a), len(b)))
                n = min(len(a), len(b), len(s))
                yield pd.DataFrame({"image_i": i, "image_j": j, "match_ord": range(n), "col_i": a[:n, 0], "row_i": a[:n, 1], "col_j": b[:n, 0], "row_j": b[:n, 1], "score": s[:n].astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return entries.join(files, "file").select("image_i", "image_j", "content").mapInPandas(load, MATCHES)


def explode_pairs(records: DataFrame) -> DataFrame:
    """Matches of nested records (image_i, image_j, points_i, points_j, confidence); uneven lists raise."""
    n = F.size("points_i")
    even = (F.size("points_j") == n) & ((F.size("confidence") == n) | (F.size("confidence") == 0))
    checked = records.withColumn("ok", F.when(even, True).otherwise(F.raise_error(F.lit("a matcher returned lists of different length")).cast("boolean")))
    one = F.when(F.size("confidence") == 0, F.array_repeat(F.lit(1.0), n)).otherwise(F.col("confidence"))
    rows = checked.where("ok").select("image_i", "image_j", F.posexplode(F.arrays_zip(F.col("points_i").alias("i"), F.col("points_j").alias("j"), one.alias("s"))).alias("match_ord", "m"))
    return rows.select("image_i", "image_j", F.col("match_ord").cast("long"), F.col("m.i")[0].alias("col_i"), F.col("m.i")[1].alias("row_i"), F.col("m.j")[0].alias("col_j"), F.col("m.j")[1].alias("row_j"), F.col("m.s").alias("score"))


def last_of_pair(records: DataFrame, order: str) -> DataFrame:
    """One record per (image_i, image_j): that with the largest ``order``."""
    keys = ["image_i", "image_j"]
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def write_tracks(observations: DataFrame, folder: str) -> None:
    """JSON lines of nested tracks, and a flat CSV."""
    order = F.transform("observations", lambda o: F.struct(o["obs_id"].alias("obs_id"), o["image_id"].alias("image_id"), o["col"].alias("col"), o["row"].alias("row"), o["score"].alias("score")))
    nested(observations).select("track_id", order.alias("observations")).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/tracks")
    write_observations(observations, f"{folder}/observations")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Observations of JSON lines of tracks."""
    t = spark.read.schema(TRACKS).json(path).select("track_id", F.explode("observations").alias("o"))
    return t.select("o.obs_id", "track_id", "o.image_id", "o.col", "o.row", "o.score")


def write_observations(observations: DataFrame, path: str) -> None:
    observations.select("obs_id", "track_id", "image_id", "col", "row", "score").write.mode("overwrite").option("header", True).csv(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a CSV; an empty or ``None`` score is null."""
    raw = spark.read.option("header", True).schema("obs_id long, track_id long, image_id int, col double, row double, score string").csv(path)
    return raw.withColumn("score", F.col("score").try_cast("double"))


def write_points(points: DataFrame, path: str) -> None:
    flag = F.col("triangulation_success").cast("int").alias("triangulation_success")
    points.select("track_id", "lon_init", "lat_init", "h_init", "n_views", "mean_reproj_error", flag).write.mode("overwrite").option("header", True).csv(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).schema("track_id long, lon_init double, lat_init double, h_init double, n_views int, mean_reproj_error double, triangulation_success int").csv(path)
    return raw.withColumn("triangulation_success", F.col("triangulation_success") != 0)


def dataset_counts(images: DataFrame, observations: DataFrame, points: DataFrame) -> DataFrame:
    """One row: images, tracks, observations and points of the adjustment's input."""
    kept = observations.join(points.select("track_id"), "track_id", "left_semi")
    i, p = images.agg(F.count(F.lit(1)).alias("images")), points.agg(F.count(F.lit(1)).alias("points"))
    o = kept.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("tracks"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("observations"))
    return i.join(o).join(p).select("images", "tracks", "observations", "points")


def write_dataset(images: DataFrame, observations: DataFrame, points: DataFrame, reference: int, h_ref: float, folder: str, extra: dict | None = None, parquet: bool = False) -> dict:
    """The adjustment's input: three CSVs and metadata; points only of tracks there are, observations only of kept points.

    ``parquet`` writes the tables as Parquet too.  Returns the metadata.
    """
    spark = images.sparkSession
    points = points.join(observations.select("track_id").distinct(), "track_id", "left_semi")
    kept = observations.join(points.select("track_id"), "track_id", "left_semi")
    path = F.col("image_path") if "image_path" in images.columns else F.lit("")
    images.select("image_id", path.alias("image_path"), "width", "height", (F.col("image_id") == reference).cast("int").alias("is_reference")).write.mode("overwrite").option("header", True).csv(f"{folder}/images")
    write_observations(kept, f"{folder}/observations")
    write_points(points, f"{folder}/points")
    if parquet:
        kept.write.mode("overwrite").parquet(f"{folder}/observations.parquet")
        points.write.mode("overwrite").parquet(f"{folder}/points.parquet")
    note = {"reference_image_id": reference, "h_ref": h_ref, "counts_summary": dataset_counts(images, observations, points).first().asDict(), "export_parquet_requested": parquet} | (extra or {})
    write_json(spark, f"{folder}/metadata", note)
    return note


def read_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """(observations, points, metadata) of ``write_dataset``."""
    note = read_json(spark, f"{folder}/metadata")
    if "reference_image_id" not in note:
        raise DataModelError(f"{folder}/metadata names no reference image")
    return read_observations(spark, f"{folder}/observations"), read_points(spark, f"{folder}/points"), note


def track_summary(matches: DataFrame, raw: DataFrame, kept: DataFrame, reference, scores: DataFrame) -> dict:
    """Counts and histograms of the track stage; histograms have as many entries as lengths and images."""
    count = lambda df: df.select("track_id").distinct().count()
    return {
        "raw_pairs": matches.select("image_i", "image_j").distinct().count(), "raw_matches": matches.count(), "raw_tracks": count(raw), "filtered_tracks": count(kept),
        "average_track_length": average_length(kept).first()[0], "length_histogram": dict(map(tuple, length_histogram(kept).collect())), "tracks_per_image": dict(map(tuple, per_image(kept).collect())),
        "reference_image": {"image_id": reference.image_id, "reason": reference.reason, "scores": dict(map(tuple, scores.collect()))},
    }


def write_results(done: Adjusted, observations: DataFrame, images: DataFrame, folder: str) -> dict:
    """Corrections and points as JSON lines, and the report; the report's residuals are in pixels and weigh as by default."""
    spark = images.sparkSession
    params = done.params_frame(spark)
    affine_rows(params).write.mode("overwrite").json(f"{folder}/affine_params")
    done.points().write.mode("overwrite").json(f"{folder}/points_optimized")
    left = done.table.select("track_id", F.explode(F.arrays_zip("images", "cols", "rows")).alias("o")).select(F.monotonically_increasing_id().alias("obs_id"), "track_id", F.col("o.images").alias("image_id"), F.col("o.cols").alias("col"), F.col("o.rows").alias("row"))
    res = residuals(left, images, done.points(), params)
    row = report_row(res, params.where(F.col("image_id") != done.reference), done.moved()).first()
    report = {
        "stages": done.reports, "mean_reprojection_error": row["mean_error"], "median_reprojection_error": row["median_error"],
        "per_image_error": {r["image_id"]: r["mean_error"] for r in image_errors(res).collect()}, "active_observations": row["active_observations"], "removed_outliers": done.removed,
    }
    write_json(spark, f"{folder}/ba_report", report)
    return report


def write_summary(spark: SparkSession, report: dict, points: int, path: str) -> dict:
    """The one-page report."""
    out = {"images": len(report["per_image_error"]), "points": points, "mean": report["mean_reprojection_error"], "median": report["median_reprojection_error"], "active_observations": report["active_observations"]}
    write_json(spark, path, out)
    return out


def write_refits(refits: DataFrame, folder: str) -> None:
    """One JSON row per image, keyed by image_id, so images with names that are no numbers keep their own."""
    names = ["a0", "a1", "a2", "b0", "b1", "b2"]
    refits.select("image_id", "rmse_pixel", F.struct(*names).alias("coeffs")).write.mode("overwrite").json(folder)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, n) of equal-width bins from the least to the greatest value; the greatest falls into the last."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    place = F.coalesce(F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return df.select(column).join(F.broadcast(ends)).select(F.least(F.lit(bins - 1), F.floor(place * bins)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def plot_tables(points: DataFrame, report: dict, spark: SparkSession) -> dict[str, DataFrame]:
    """The data of the three plots: error by image, histogram of heights, cost by stage."""
    errors = spark.createDataFrame([(int(i), float(e)) for i, e in report["per_image_error"].items()], "image_id int, mean_error double")
    costs = spark.createDataFrame([(i, s["stage"], float(s["cost"])) for i, s in enumerate(report["stages"])], "ord int, stage string, cost double")
    return {"residual_map_summary": errors, "height_hist": histogram(points, "h"), "reproj_hist": costs}
