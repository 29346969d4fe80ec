"""The stages of a run, from images to reports, each reading the files of the one before."""

from __future__ import annotations

import logging
from types import SimpleNamespace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import adjust, matching, overlap, refit, tracks, triangulate
from ..operators.graph import cut
from ..sources import artifacts, catalog

LOG = logging.getLogger("skyadjust")


def _images(spark: SparkSession, options: SimpleNamespace):
    return cut(catalog.scan(spark, options.io.image_dir, options.io.rpc_dir), "images")


def match(spark: SparkSession, options: SimpleNamespace) -> None:
    """Overlapping pairs, matches, both filters, and the manifest of pairs that kept any."""
    m = options.matching
    images = _images(spark, options)
    pairs = cut(overlap.overlap_pairs(overlap.footprints(images, m.h_ref), m.overlap_threshold), "pairs")
    raw = cut(matching.build_matcher(options.matcher).match(images, pairs), "raw")
    good = cut(matching.geometric_filter(raw, m.fundamental_threshold), "geometric")
    kept = cut(matching.geo_filter_any(good, images, m.geo_distance_threshold, m.h_ref), "kept")
    artifacts.write_matches(kept, options.io.output_dir)
    LOG.info("match: %s", matching.match_summary(matching.pair_stats(raw, good, kept), pairs.count()).first())


def build_tracks(spark: SparkSession, options: SimpleNamespace) -> None:
    """Tracks of all matches, filtered around the reference image that all of them choose."""
    t, images = options.tracks, _images(spark, options)
    matches = artifacts.read_matches(spark, options.io.output_dir)
    raw = cut(tracks.build_tracks(matches, t.quantization), "tracks")
    scores = cut(tracks.reference_scores(raw, images), "scores")
    reference = tracks.select_reference(scores, options.reference_image.mode, options.reference_image.image_id)
    kept = cut(tracks.filter_tracks(raw, reference.image_id, t.min_views, t.max_track_length, t.min_score, t.drop_disconnected_from_reference), "kept")
    folder = f"{options.io.output_dir}/tracks"
    artifacts.write_tracks(kept, folder)
    artifacts.write_json(spark, f"{folder}/track_summary", artifacts.track_summary(matches, raw, kept, reference, scores))


def triangulate_init(spark: SparkSession, options: SimpleNamespace) -> None:
    """Initial points of the kept tracks; the reference image is chosen again, among these."""
    t, images = options.triangulation, _images(spark, options)
    kept = artifacts.read_tracks(spark, f"{options.io.output_dir}/tracks/tracks")
    reference = tracks.select_reference(tracks.reference_scores(kept, images), options.reference_image.mode, options.reference_image.image_id).image_id
    h_ref = triangulate.resolve_h_ref(images, t.h_ref_mode, t.h_ref_value)
    points = cut(triangulate.triangulate(kept, images, reference, h_ref, t.max_nfev), "points")
    judged = cut(triangulate.judge_points(points, threshold=t.reproj_error_threshold, min_views=t.min_success_views, h_min=t.h_min, h_max=t.h_max), "judged")
    good = judged.where("reason is null").drop("reason")
    n = judged.agg(F.count_if(F.col("reason").isNull()).alias("a"), F.count_if(F.col("reason").isNotNull()).alias("b")).first()
    note = {"triangulation": {"success": n["a"], "rejected": n["b"], "reject_reasons": dict(map(tuple, triangulate.reject_counts(judged).collect()))}}
    artifacts.write_dataset(images, kept, good, reference, h_ref, f"{options.io.output_dir}/ba_input", note, options.output.export_parquet)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def bundle_adjust(spark: SparkSession, options: SimpleNamespace) -> None:
    """Adjustment, refitted corrections, plot tables and report; skipped if results are there and nothing asks for more."""
    out = options.io.output_dir
    if _exists(spark, f"{out}/ba_results") and not options.runtime.force_recompute and not options.runtime.resume:
        LOG.info("bundle-adjust: results are there")
        return
    images = _images(spark, options)
    observations, points, note = artifacts.read_dataset(spark, f"{out}/ba_input")
    b, r = options.ba, options.runtime
    settings = adjust.Settings(
        b.use_translation_stage, b.use_affine_stage, b.robust_loss, b.final_loss, b.reproj_sigma, b.affine_reg_weight, b.point_reg_weight, b.outlier_threshold, b.max_nfev,
        r.checkpoint_interval, f"{out}/checkpoints", r.resume,
    )
    done = adjust.run(observations, images, points, int(note["reference_image_id"]), settings)
    report = artifacts.write_results(done, observations, images, f"{out}/ba_results")
    if options.rpc_refit.enable:
        artifacts.write_refits(refit.refit_any(images, done.params_frame(spark), options.rpc_refit.grid_size), f"{out}/rpc_refined")
    if options.output.save_plots:
        for name, table in artifacts.plot_tables(done.points(), report, spark).items():
            table.coalesce(1).write.mode("overwrite").json(f"{out}/plots/{name}")
    if options.output.export_report:
        artifacts.write_summary(spark, report, done.table.count(), f"{out}/report")


def run_all(spark: SparkSession, options: SimpleNamespace) -> None:
    for stage in (match, build_tracks, triangulate_init, bundle_adjust):
        stage(spark, options)
