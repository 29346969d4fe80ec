"""Configuration from YAML or JSON, and logging."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from pathlib import Path
from types import SimpleNamespace
from typing import Any

from ..errors import ConfigError


def _maybe(kind: Callable) -> Callable[[Any], Any]:
    return lambda v: None if v is None else kind(v)


def _same(v: Any) -> Any:
    return v


#: (section, option, converter, default, places): the first place that has the option wins, and a place
#: that has it as null wins too.  A place is a dotted path into the file.  Names and defaults are fixed values.
OPTIONS: tuple[tuple[str, str, Callable, Any, tuple[str, ...]], ...] = (
    ("io", "rpc_dir", _maybe(str), None, ("{data}.rpc_dir",)),
    ("io", "output_dir", str, "outputs", ("io.output_dir", "{data}.output_dir")),
    ("matcher", "name", lambda v: str(v).lower(), "sift", ("{matcher}.type", "{matcher}.name")),
    ("matcher", "max_features", int, 8000, ("matching.sift.nfeatures", "{matcher}.max_features")),
    ("matcher", "contrast_threshold", float, 0.04, ("matching.sift.contrastThreshold", "{matcher}.contrast_threshold")),
    ("matcher", "ratio_test", float, 0.6, ("matching.sift.ratio", "{matcher}.ratio_test")),
    ("matcher", "ransac_thresh", float, 1.5, ("{matcher}.ransac_thresh",)),
    ("matcher", "weights_path", _maybe(str), None, ("{matcher}.weights_path", "matching.loftr.weights_path")),
    ("matcher", "extra", dict, {}, ("{matcher}.extra",)),
    ("matching", "overlap_threshold", float, 0.1, ("matching.overlap_threshold",)),
    ("matching", "geo_distance_threshold", float, 100.0, ("matching.geo_distance_threshold",)),
    ("matching", "fundamental_threshold", float, 1.5, ("matching.fundamental_threshold",)),
    ("matching", "h_ref", float, 0.0, ("matching.h_ref",)),
    ("reference_image", "mode", str, "auto", ("reference_image.mode",)),
    ("reference_image", "image_id", _same, None, ("reference_image.image_id",)),
    ("tracks", "min_views", int, 2, ("tracks.min_views",)),
    ("tracks", "max_tracks_per_grid_cell", int, 50, ("tracks.max_tracks_per_grid_cell",)),
    ("tracks", "grid_rows", int, 20, ("tracks.grid_rows",)),
    ("tracks", "grid_cols", int, 20, ("tracks.grid_cols",)),
    ("tracks", "min_score", _same, None, ("tracks.min_score",)),
    ("tracks", "max_track_length", _same, None, ("tracks.max_track_length",)),
    ("tracks", "drop_disconnected_from_reference", bool, True, ("tracks.drop_disconnected_from_reference",)),
    ("tracks", "quantization", float, 0.25, ("tracks.quantization",)),
    ("triangulation", "h_ref_mode", str, "rpc_median_offset", ("triangulation.h_ref_mode",)),
    ("triangulation", "h_ref_value", _same, None, ("triangulation.h_ref_value",)),
    ("triangulation", "reproj_error_threshold", float, 5.0, ("triangulation.reproj_error_threshold",)),
    ("triangulation", "min_success_views", int, 2, ("triangulation.min_success_views",)),
    ("triangulation", "max_nfev", int, 100, ("triangulation.max_nfev",)),
    ("triangulation", "method", str, "trf", ("triangulation.method",)),
    ("triangulation", "h_min", float, -1000.0, ("triangulation.h_min",)),
    ("triangulation", "h_max", float, 10000.0, ("triangulation.h_max",)),
    ("output", "save_plots", bool, False, ("output.save_plots",)),
    ("output", "export_parquet", bool, False, ("output.export_parquet",)),
    ("output", "export_rpc", bool, True, ("output.export_rpc",)),
    ("output", "export_report", bool, True, ("output.export_report",)),
    ("ba", "use_translation_stage", bool, True, ("ba.stages.use_translation_stage",)),
    ("ba", "use_affine_stage", bool, True, ("ba.stages.use_affine_stage",)),
    ("ba", "robust_loss", str, "soft_l1", ("ba.robust_loss",)),
    ("ba", "final_loss", str, "linear", ("ba.final_loss",)),
    ("ba", "reproj_sigma", float, 1.0, ("ba.reproj_sigma",)),
    ("ba", "affine_reg_weight", float, 1e-4, ("ba.affine_reg_weight",)),
    ("ba", "point_reg_weight", float, 1e-6, ("ba.point_reg_weight",)),
    ("ba", "outlier_threshold", float, 5.0, ("ba.outlier_threshold",)),
    ("ba", "max_nfev", int, 200, ("ba.max_nfev",)),
    ("optimization", "use_numba", bool, False, ("optimization.use_numba",)),
    ("optimization", "batch_size", int, 10000, ("optimization.batch_size",)),
    ("rpc_refit", "enable", bool, False, ("rpc_refit.enable",)),
    ("rpc_refit", "grid_size", int, 10, ("rpc_refit.grid_size",)),
    ("logging", "level", str, "INFO", ("logging.level",)),
    ("logging", "log_to_file", bool, True, ("logging.log_to_file",)),
    ("logging", "log_dir", str, "outputs/logs", ("logging.log_dir",)),
    ("runtime", "num_workers", int, 1, ("runtime.num_workers",)),
    ("runtime", "checkpoint_interval", int, 10, ("runtime.checkpoint_interval",)),
    ("runtime", "resume", _same, None, ("runtime.resume",)),
    ("runtime", "force_recompute", bool, False, ("runtime.force_recompute",)),
)


def _has(tree: Any, path: str) -> tuple[bool, Any]:
    for part in path.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return False, None
        tree = tree[part]
    return True, tree


def parse(tree: dict[str, Any]) -> SimpleNamespace:
    """Sections with all options of OPTIONS; a missing image_dir raises KeyError."""
    where = {"data": "dataset" if "dataset" in tree else "io", "matcher": "matching.matcher" if _has(tree, "matching.matcher")[0] else "matcher"}
    out = SimpleNamespace(io=SimpleNamespace(image_dir=str(tree.get(where["data"], {})["image_dir"])))
    for section, option, kind, default, places in OPTIONS:
        hits = [v for ok, v in (_has(tree, p.format(**where)) for p in places) if ok]
        if not hasattr(out, section):
            setattr(out, section, SimpleNamespace())
        setattr(getattr(out, section), option, kind(hits[0]) if hits else default)
    return out


def load(path: str | Path) -> SimpleNamespace:
    """Options of a ``.yaml``/``.yml`` file, or of JSON under any other name."""
    path = Path(path)
    if not path.exists():
        raise ConfigError(f"there is no configuration at {path}")
    text = path.read_text(encoding="utf-8")
    if path.suffix.lower() not in (".yaml", ".yml"):
        return parse(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("reading YAML needs PyYAML") from e
    return parse(yaml.safe_load(text) or {})


def set_up_logging(options: SimpleNamespace) -> logging.Logger:
    """Console output, and a file LOG_FILE in the log folder if asked for."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if options.log_to_file:
        Path(options.log_dir).mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(Path(options.log_dir) / LOG_FILE, encoding="utf-8"))
    logging.basicConfig(level=options.level.upper(), format="%(asctime)s %(levelname)s %(name)s: %(message)s", handlers=handlers, force=True)
    return logging.getLogger("skyadjust")


LOG_FILE = "skyadjust.log"
