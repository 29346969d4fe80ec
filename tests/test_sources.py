"""Files, configuration, command line, and the registered queries."""

import json
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from skyadjust import cli
from skyadjust.errors import ConfigError, DataModelError
from skyadjust.plans.catalogue import ORACLES, QUERIES
from skyadjust.sources import artifacts, catalog, config

from .test_geometry import RPC
from .test_tracks import FIXTURE, OBS, matches

SF = "/root/testdata/sf0.001"


def tiff(width, height, values=None):
    """A header-only TIFF with an optional rational camera tag."""
    entries = [(256, 3, 1, width), (257, 3, 1, height)]
    at = 8 + 2 + 12 * (len(entries) + (values is not None)) + 4
    if values is not None:
        entries.append((50844, 12, 92, at))
    head = b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return head + (struct.pack("<92d", *values) if values is not None else b"")


def flat(rpc):
    return [0.0, 0.0, *[rpc[k] for k in list(RPC)[:10]], *rpc["line_num"], *rpc["line_den"], *rpc["samp_num"], *rpc["samp_den"]]


def test_catalog(spark, tmp_path):
    images, side = tmp_path / "i", tmp_path / "s"
    images.mkdir()
    side.mkdir()
    (images / "b.tif").write_bytes(tiff(30, 40))
    (images / "a.tif").write_bytes(tiff(10, 20, flat(RPC)))
    (images / "c.TIF").write_bytes(b"no")
    (side / "b.json").write_text(json.dumps({k.upper(): v for k, v in (RPC | {"line_off": 7.0}).items()}))
    names = {"line_num": "LINE_NUM_COEFF", "line_den": "LINE_DEN_COEFF", "samp_num": "SAMP_NUM_COEFF", "samp_den": "SAMP_DEN_COEFF"}
    lines = [f"{names[k]}_{i + 1}: {x}" if k in names else f"{k.upper()}: {v} pixels" for k, v in (RPC | {"line_off": 8.0}).items() for i, x in enumerate(v if k in names else [0])]
    (side / "b.txt").write_text("\n".join(lines))
    got = catalog.scan(spark, str(images), str(side)).orderBy("image_id").collect()
    assert [(r["image_id"], r["name"], r["width"], r["height"]) for r in got] == [(0, "a", 10, 20), (1, "b", 30, 40)]
    assert got[0]["camera"]["rpc"]["samp_num"] == RPC["samp_num"] and got[0]["camera"]["rpc"]["height_off"] == 200.0
    assert got[1]["camera"]["rpc"]["line_off"] == 8.0
    (images / "d.tif").write_bytes(tiff(1, 1))
    with pytest.raises(DataModelError, match="d"):
        catalog.scan(spark, str(images), str(side))


def test_sidecar_forms():
    rpb = "IMAGE = {\n" + "\n".join(f"\t{k.replace('_', '')} = {'(' + ', '.join(map(str, v)) + ')' if isinstance(v, list) else v};" for k, v in (RPC | {}).items()).replace("linenum", "lineNumCoef") + "\n}"
    assert catalog.parse_sidecar("x.RPB", rpb)["line_num"] == RPC["line_num"]
    with pytest.raises(DataModelError):
        catalog.parse_sidecar("x.json", "{}")


def test_tag_values(spark):
    df = spark.createDataFrame([("0",), ("(1, 2 3)",), (" abc ",), (None,)], "raw string")
    got = [r[0] for r in df.select(catalog.parse_tag_value(F.col("raw"))).collect()]
    assert got[0]["num"] == 0.0 and got[1]["list"] == [1, 2, 3] and got[2]["str"] == "abc" and got[3] is None


def test_match_files(spark, tmp_path):
    m = matches(spark, FIXTURE)
    artifacts.write_matches(m, str(tmp_path / "o"))
    assert sorted(map(tuple, artifacts.read_matches(spark, str(tmp_path / "o")).select(*m.columns).collect())) == sorted(FIXTURE)
    assert spark.read.json(str(tmp_path / "o/pairs")).count() == 2
    old = tmp_path / "old"
    old.mkdir()
    np.savez(old / "pair_0000_0001.npz", pts_i=np.array([[1.0, 2], [3, 4]]), pts_j=np.array([[5.0, 6], [7, 8]]), scores=np.array([0.5, 0.25]))
    np.savez(old / "later.npz", pts_i=np.array([[1.0, 2], [3, 4]]), pts_j=np.array([[5.0, 6]]), scores=np.array([]))
    (tmp_path / "pairs.json").write_text(json.dumps([{"pair": [0, 1], "file": "m/pair_0000_0001.npz", "matches": 2}, {"pair": [2, 3], "file": "later.npz", "matches": 1}, {"pair": [0, 1], "file": "later.npz", "matches": 1}]))
    got = sorted(map(tuple, artifacts.import_npz(spark, str(tmp_path / "pairs.json"), str(old)).collect()))
    assert got == [(0, 1, 0, 1.0, 2.0, 5.0, 6.0, 1.0), (2, 3, 0, 1.0, 2.0, 5.0, 6.0, 1.0)]


def test_nested_pairs(spark):
    schema = "image_i int, image_j int, points_i array<array<double>>, points_j array<array<double>>, confidence array<double>, ord int"
    rows = [(0, 1, [[1.0, 2.0]], [[3.0, 4.0]], [], 0), (0, 1, [[5.0, 6.0]], [[7.0, 8.0]], [0.5], 1)]
    last = artifacts.last_of_pair(spark.createDataFrame(rows, schema), "ord")
    assert [tuple(r) for r in artifacts.explode_pairs(last).collect()] == [(0, 1, 0, 5.0, 6.0, 7.0, 8.0, 0.5)]
    assert artifacts.explode_pairs(spark.createDataFrame(rows[:1], schema)).first()["score"] == 1.0
    with pytest.raises(Exception, match="different length"):
        artifacts.explode_pairs(spark.createDataFrame([(0, 1, [[1.0, 2.0]], [], [], 0)], schema)).collect()


def test_track_and_dataset_files(spark, tmp_path):
    o = spark.createDataFrame([(0, 0, 0, 10.0, 20.0, 0.9), (1, 0, 1, 11.0, 21.0, None), (2, 1, 0, 1.0, 1.0, 0.1)], OBS)
    artifacts.write_tracks(o, str(tmp_path / "t"))
    assert sorted(map(tuple, artifacts.read_tracks(spark, str(tmp_path / "t/tracks")).collect())) == sorted(map(tuple, o.collect()))
    images = spark.createDataFrame([(0, "x.tif", 5, 6), (1, "y.tif", 7, 8)], "image_id int, image_path string, width int, height int")
    p = spark.createDataFrame([(0, 100.0, 30.0, 50.0, 2, 0.1, True, None), (9, 1.0, 1.0, 1.0, 2, 0.1, True, None)], "track_id long, lon_init double, lat_init double, h_init double, n_views int, mean_reproj_error double, triangulation_success boolean, failure_reason string")
    note = artifacts.write_dataset(images, o, p, 0, 12.5, str(tmp_path / "d"), parquet=True)
    assert note["counts_summary"] == {"images": 2, "tracks": 1, "observations": 2, "points": 1}
    obs, pts, back = artifacts.read_dataset(spark, str(tmp_path / "d"))
    assert back == note and sorted(map(tuple, obs.collect())) == [(0, 0, 0, 10.0, 20.0, 0.9), (1, 0, 1, 11.0, 21.0, None)]
    assert tuple(pts.first()) == (0, 100.0, 30.0, 50.0, 2, 0.1, True)
    (tmp_path / "n.csv").write_text("obs_id,track_id,image_id,col,row,score\n1,2,3,4.0,5.0,None\n")
    assert artifacts.read_observations(spark, str(tmp_path / "n.csv")).first()["score"] is None


def test_histogram(spark):
    df = spark.createDataFrame([(float(i),) for i in range(41)], "h double")
    assert dict(map(tuple, artifacts.histogram(df, "h").collect()))[19] == 3
    assert [tuple(r) for r in artifacts.histogram(df.limit(1), "h").collect()] == [(0, 1)]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"io": {"image_dir": "a"}}))
    c = config.load(tmp_path / "c.json")
    assert c.io.image_dir == "a" and c.io.output_dir == "outputs" and c.matcher.name == "sift" and c.ba.point_reg_weight == 1e-6 and c.tracks.quantization == 0.25
    (tmp_path / "c.yaml").write_text("dataset: {image_dir: b}\nio: {output_dir: o}\nba: {affine_reg_weight: 1e-4, stages: {use_affine_stage: false}}\nmatching: {matcher: {type: LoFTR, weights_path: null}, loftr: {weights_path: w}, sift: {ratio: 0.7}}\n")
    c = config.load(tmp_path / "c.yaml")
    assert (c.io.image_dir, c.io.output_dir, c.matcher.name, c.matcher.weights_path, c.matcher.ratio_test) == ("b", "o", "loftr", None, 0.7)
    assert c.ba.affine_reg_weight == 1e-4 and c.ba.use_affine_stage is False and c.ba.use_translation_stage is True
    with pytest.raises(ConfigError):
        config.load(tmp_path / "none.json")
    with pytest.raises(KeyError):
        config.parse({})


def test_command_line(capsys):
    assert cli.main(["list-matchers"]) == 0 and capsys.readouterr().out.split() == ["loftr", "sift"]
    with pytest.raises(SystemExit):
        cli.main(["match"])


def test_stages_from_matches_to_report(spark, tmp_path):
    """Build tracks, triangulate and adjust over written files; matching itself needs OpenCV."""
    from skyadjust.functions.kernels import Camera
    from skyadjust.plans import stages

    folder = tmp_path / "i"
    folder.mkdir()
    kinds = [RPC | {"samp_num": [0.01 * i, 1.0, 0.01, -0.03 + 0.1 * i] + [0.0] * 16} for i in range(3)]
    for i, k in enumerate(kinds):
        (folder / f"{i}.tif").write_bytes(tiff(8000, 10000, flat(k)))
    rng = np.random.default_rng(0)
    ground = [(110 + rng.uniform(-0.05, 0.05), 30 + rng.uniform(-0.05, 0.05), rng.uniform(100, 300)) for _ in range(25)]
    at = [[tuple(map(float, Camera("rpc00b", None, k).project(*g))) for g in ground] for k in kinds]
    rows = [(i, j, n, *at[i][n], *at[j][n], 1.0) for i in range(3) for j in range(i + 1, 3) for n in range(25)]
    out = f"file://{tmp_path}/out"
    artifacts.write_matches(matches(spark, rows), out)
    options = config.parse({"io": {"image_dir": str(folder), "output_dir": out}, "rpc_refit": {"enable": True, "grid_size": 3}, "output": {"save_plots": True}})
    for stage in (stages.build_tracks, stages.triangulate_init, stages.bundle_adjust, stages.bundle_adjust):
        stage(spark, options)
    report = artifacts.read_json(spark, f"{out}/ba_results/ba_report")
    assert report["active_observations"] == 75 and report["removed_outliers"] == 0 and report["mean_reprojection_error"] < 0.05
    assert artifacts.read_json(spark, f"{out}/report")["points"] == 25
    assert spark.read.json(f"{out}/rpc_refined").count() == 3 and spark.read.json(f"{out}/plots/reproj_hist").count() == 3
    assert artifacts.read_json(spark, f"{out}/tracks/track_summary")["filtered_tracks"] == 25


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "orders", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).first()["score"] > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
