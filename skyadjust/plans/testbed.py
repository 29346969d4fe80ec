"""A synthetic adjustment problem made of the driver's tables.

Suppliers are images with affine cameras, orders are ground points, order lines are observations.
Every table is a lazy plan; SQL holds the same definitions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.order import dense_ids
from ..operators.tracks import best_views

SIZE = 10001
REFERENCE = 0
#: Order in which order lines count as seen; it is total.
LINE_ORDER = ["l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height, camera)."""
    i = F.col("s_suppkey")
    zero, lon0, lat0 = F.lit(0.0), 100 + 0.05 * (i % 10), 30 + 0.05 * F.floor(i / 10)
    camera = geo.affine_camera(lon0, lat0, (F.lit(1e5), zero, 0.01 * (1 + i % 7), zero), (zero, F.lit(-1e5), 0.02 * (i % 5 - 2), zero))
    return _table(spark, sf_dir, "supplier").select(i.cast("int").alias("image_id"), F.lit(SIZE).alias("width"), F.lit(SIZE).alias("height"), camera.alias("camera"))


def rational_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height, camera): the same images with rational cameras, whose polynomials have all 20 terms."""
    i = F.col("s_suppkey")
    small = lambda k, salt: 1e-4 * ((i + 7 * k + salt) % 11 - 5)
    lead = {"samp_num": {1: F.lit(1.0), 3: 0.02 * (i % 7)}, "line_num": {2: F.lit(-1.0), 3: 0.03 * (i % 5 - 2)}}
    salt = {"samp_num": 1, "samp_den": 2, "line_num": 3, "line_den": 4}
    term = lambda name, k: F.lit(1.0) if k == 0 and name.endswith("den") else small(k, salt[name]) + lead.get(name, {}).get(k, F.lit(0.0))
    values = {
        "line_off": F.lit(5000.0), "samp_off": F.lit(5000.0), "lat_off": 30 + 0.05 * (F.floor(i / 10) % 10), "long_off": 100 + 0.05 * (i % 10), "height_off": 100 + 10.0 * (i % 7),
        "line_scale": F.lit(5000.0), "samp_scale": F.lit(5000.0), "lat_scale": F.lit(0.5), "long_scale": F.lit(0.5), "height_scale": F.lit(500.0),
    }
    rpc = F.struct(*[values[n].cast("double").alias(n) for n in (*geo.OFFSETS, *geo.SCALES)], *[F.array(*[term(n, k).cast("double") for k in range(20)]).alias(n) for n in geo.POLYNOMIALS])
    camera = F.struct(F.lit("rational").alias("kind"), F.lit(None).cast("array<double>").alias("affine"), rpc.alias("rpc"))
    return _table(spark, sf_dir, "supplier").select(i.cast("int").alias("image_id"), F.lit(SIZE).alias("width"), F.lit(SIZE).alias("height"), camera.alias("camera"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, lon_t, lat_t, h_t, lon_init, lat_init, h_init)."""
    k = F.col("o_orderkey")
    lon, lat, h = 100 + 0.5 * (k % 997) / 997, 30 + 0.5 * (k % 89) / 89, 100 + F.col("o_totalprice") / 1000
    true = _table(spark, sf_dir, "orders").select(k.alias("track_id"), lon.alias("lon_t"), lat.alias("lat_t"), h.alias("h_t"))
    t = F.col("track_id")
    return true.withColumns({"lon_init": F.col("lon_t") + 1e-6 * (t % 7 - 3), "lat_init": F.col("lat_t") + 1e-6 * (t % 5 - 2), "h_init": F.col("h_t") + (t % 11 - 5)})


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the measured col and row of their point in their image; some columns are 40 pixels off."""
    lines = _table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_discount", "l_returnflag")
    o = lines.join(F.broadcast(images(spark, sf_dir)), F.col("l_suppkey") == F.col("image_id")).join(points(spark, sf_dir).select("track_id", "lon_t", "lat_t", "h_t"), F.col("l_orderkey") == F.col("track_id"))
    c, r = geo.project(F.col("camera"), F.col("lon_t"), F.col("lat_t"), F.col("h_t"))
    wrong = F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 20 == 0), 40.0).otherwise(0.0)
    return o.withColumns({"col": c + (F.col("l_quantity") - 25.5) / 50 + wrong, "row": r + 10 * (F.col("l_discount") - 0.05), "score": F.col("l_discount")})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, track_id, image_id, col, row, score), the best line of each track and image."""
    seen = dense_ids(measured(spark, sf_dir), [F.floor(F.col("l_orderkey") / 4096)], [F.col(c) for c in LINE_ORDER], "obs_id")
    return best_views(seen.select("obs_id", "track_id", "image_id", "col", "row", "score"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as views: those of one order match each other in all pairs of images; they measure price and quantity."""
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER[2:4], F.col("l_suppkey").cast("int").alias("image_id"), F.col("l_extendedprice").alias("col"), F.col("l_quantity").alias("row"))


def pair_matches(spark: SparkSession, sf_dir: str, raw: bool = True) -> DataFrame:
    """Lines of one order in two images, as matches; raw ones measure price and quantity, others the projected point.

    match_ord numbers a pair's matches in the order of both lines.
    """
    if raw:
        lines = _table(spark, sf_dir, "lineitem").select(*LINE_ORDER, F.col("l_discount").alias("score"), F.col("l_extendedprice").alias("col"), F.col("l_quantity").alias("row"))
    else:
        lines = measured(spark, sf_dir).select(*LINE_ORDER, "score", "col", "row")
    lines = lines.withColumn("image", F.col("l_suppkey").cast("int"))
    side = lambda s: lines.select("l_orderkey", *[F.col(c).alias(f"{c}_{s}") for c in (*LINE_ORDER[2:], "score", "col", "row", "image")])
    both = side("i").join(side("j"), "l_orderkey").where("image_i < image_j")
    order = [F.col("l_orderkey"), *[F.col(f"{c}_{s}") for s in "ij" for c in LINE_ORDER[2:]]]
    from pyspark.sql import Window

    ranked = both.withColumn("match_ord", F.row_number().over(Window.partitionBy("image_i", "image_j").orderBy(*order)) - 1)
    return ranked.select("image_i", "image_j", "match_ord", "col_i", "row_i", "col_j", "row_j", F.least("score_i", "score_j").alias("score"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as descriptors: even ids belong to image 0, odd ones to image 1."""
    v = F.col("vec_id")
    return _table(spark, sf_dir, "embeddings").select((v % 2).cast("int").alias("image_id"), v.alias("kp_id"), v.cast("double").alias("col"), v.cast("double").alias("row"), F.col("embedding").cast("array<double>").alias("descriptor"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x0, x1, y0, y1): footprints at height 0 in degrees, which are axis-aligned."""
    ends = {n: geo.localize_affine(F.col("camera"), F.lit(float(c)), F.lit(float(r)), F.lit(0.0)) for n, c, r in (("a", 0, 0), ("b", SIZE - 1, SIZE - 1))}
    return images(spark, sf_dir).select("image_id", ends["a"][0].alias("x0"), ends["b"][0].alias("x1"), ends["b"][1].alias("y0"), ends["a"][1].alias("y1"))


def quality_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with synthetic outcomes of triangulation, for the quality cascade; every reason occurs, as do NaN and edge values."""
    t = F.col("track_id")
    views = observations(spark, sf_dir).groupBy("track_id").agg(F.count(F.lit(1)).cast("int").alias("n_views"))
    p = points(spark, sf_dir).join(views, "track_id")
    error = F.when(t % 17 == 0, float("nan")).when(t % 19 == 0, 5.0).otherwise((t % 60) / 10.0)
    height = F.when(t % 13 == 0, 10000.0).when(t % 29 == 0, -1000.5).otherwise(F.col("h_init"))
    return p.select("track_id", "lon_init", "lat_init", height.alias("h_init"), "n_views", error.alias("mean_reproj_error"), (t % 11 != 0).alias("triangulation_success"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, a0 .. b2): a synthetic correction of each image, none for the reference."""
    i = F.col("image_id")
    terms = [0.1 * (i % 7 - 3), 0.01 * (i % 3), -0.02 * (i % 4), -0.1 * (i % 5), 0.03 * (i % 2), 0.01 * (i % 6)]
    return images(spark, sf_dir).select(i, *[F.when(i == REFERENCE, 0.0).otherwise(v.cast("double")).alias(n) for n, v in zip(("a0", "a1", "a2", "b0", "b1", "b2"), terms, strict=True)])


def initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("track_id", F.col("lon_init").alias("lon"), F.col("lat_init").alias("lat"), F.col("h_init").alias("h"))


def exact(value: Column, digits: int = 4) -> Column:
    """Rounded for comparison, without negative zero.

    The scaled value is rounded, as DuckDB does; Spark's own ``round`` to digits decides by the decimal
    form of the double, which on halves may turn the other way.
    """
    return F.round(value * 10.0**digits) / 10.0**digits + 0.0


#: DuckDB definitions of the tables above, to be put in front of a query in this order.
SQL = {
    "images": """images AS (SELECT s_suppkey::INTEGER AS image_id, 100 + 5e-2 * (s_suppkey % 10) AS lon0, 30 + 5e-2 * (s_suppkey // 10) AS lat0,
  1e-2 * (1 + s_suppkey % 7) AS kc, 2e-2 * (s_suppkey % 5 - 2) AS kr FROM supplier)""",
    "rational": """rational AS (SELECT s_suppkey::INTEGER AS image_id, 100 + 5e-2 * (s_suppkey % 10) AS lon0, 30 + 5e-2 * ((s_suppkey // 10) % 10) AS lat0, 100 + 1e1 * (s_suppkey % 7) AS h0,
  list_transform(range(20), lambda k: 1e-4 * ((s_suppkey + 7 * k + 1) % 11 - 5) + CASE k WHEN 1 THEN 1e0 WHEN 3 THEN 2e-2 * (s_suppkey % 7) ELSE 0e0 END) AS sn,
  list_transform(range(20), lambda k: CASE k WHEN 0 THEN 1e0 ELSE 1e-4 * ((s_suppkey + 7 * k + 2) % 11 - 5) END) AS sd,
  list_transform(range(20), lambda k: 1e-4 * ((s_suppkey + 7 * k + 3) % 11 - 5) + CASE k WHEN 2 THEN -1e0 WHEN 3 THEN 3e-2 * (s_suppkey % 5 - 2) ELSE 0e0 END) AS ln,
  list_transform(range(20), lambda k: CASE k WHEN 0 THEN 1e0 ELSE 1e-4 * ((s_suppkey + 7 * k + 4) % 11 - 5) END) AS ld FROM supplier)""",
    "seen": """local AS (SELECT o.obs_id, o.track_id, r.*, (lon_t - lon0) / 5e-1 AS x, (lat_t - lat0) / 5e-1 AS y, (h_t - h0) / 5e2 AS z FROM observations o JOIN rational r USING (image_id) JOIN points p ON p.track_id = o.track_id),
terms AS (SELECT *, [1e0, x, y, z, x * y, x * z, y * z, x * x, y * y, z * z, x * y * z, x * x * x, x * y * y, x * z * z, x * x * y, y * y * y, y * z * z, x * x * z, y * y * z, z * z * z] AS m FROM local),
seen AS (SELECT obs_id, track_id, image_id, 5e3 + 5e3 * list_dot_product(sn, m) / list_dot_product(sd, m) AS col, 5e3 + 5e3 * list_dot_product(ln, m) / list_dot_product(ld, m) AS row FROM terms)""",
    "points": """points_true AS (SELECT o_orderkey AS track_id, 100 + 5e-1 * (o_orderkey % 997) / 997e0 AS lon_t, 30 + 5e-1 * (o_orderkey % 89) / 89e0 AS lat_t, 100 + o_totalprice / 1e3 AS h_t FROM orders),
points AS (SELECT *, lon_t + 1e-6 * (track_id % 7 - 3) AS lon_init, lat_t + 1e-6 * (track_id % 5 - 2) AS lat_init, h_t + (track_id % 11 - 5) AS h_init FROM points_true)""",
    "measured": """measured AS (SELECT l.*, i.image_id, p.track_id, l_discount AS score,
  1e5 * (lon_t - lon0) + kc * h_t + (l_quantity - 25.5e0) / 50e0 + CASE WHEN l_returnflag = 'R' AND l_partkey % 20 = 0 THEN 40e0 ELSE 0e0 END AS col,
  -1e5 * (lat_t - lat0) + kr * h_t + 10e0 * (l_discount - 5e-2) AS row
  FROM lineitem l JOIN images i ON l_suppkey = image_id JOIN points p ON l_orderkey = track_id)""",
    "observations": """numbered AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_suppkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS obs_id FROM measured),
observations AS (SELECT obs_id, track_id, image_id, col, row, score FROM numbered
  QUALIFY row_number() OVER (PARTITION BY track_id, image_id ORDER BY coalesce(score, -1) DESC, obs_id) = 1)""",
    "raw_lines": "mlines AS (SELECT *, l_suppkey::INTEGER AS image, l_discount AS sc, l_extendedprice AS c, l_quantity AS r FROM lineitem)",
    "geo_lines": "mlines AS (SELECT *, l_suppkey::INTEGER AS image, l_discount AS sc, col AS c, row AS r FROM measured)",
    "pair_matches": """pair_matches AS (SELECT a.image AS image_i, b.image AS image_j, a.c AS col_i, a.r AS row_i, b.c AS col_j, b.r AS row_j, least(a.sc, b.sc) AS score,
  row_number() OVER (PARTITION BY a.image, b.image ORDER BY a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_extendedprice, a.l_quantity, b.l_linenumber, b.l_partkey, b.l_extendedprice, b.l_quantity) - 1 AS match_ord
  FROM mlines a JOIN mlines b ON a.l_orderkey = b.l_orderkey AND a.image < b.image)""",
    "index": """sides AS (SELECT image_i, image_j, match_ord, 0 AS side, image_i AS image_id, col_i AS col, row_i AS row, score FROM pair_matches
  UNION ALL SELECT image_i, image_j, match_ord, 1, image_j, col_j, row_j, score FROM pair_matches),
keyed AS (SELECT *, round_even(col / 25e-2, 0)::BIGINT AS qc, round_even(row / 25e-2, 0)::BIGINT AS qr, row_number() OVER (ORDER BY image_i, image_j, match_ord, side) AS ord FROM sides),
obs_keys AS (SELECT image_id, qc, qr, min(ord) AS first, arg_max(col, ord) AS col, arg_max(row, ord) AS row, arg_max(score, ord) AS score FROM keyed GROUP BY ALL),
obs AS (SELECT row_number() OVER (ORDER BY first) - 1 AS obs_id, * EXCLUDE (first) FROM obs_keys),
edges AS (SELECT a.obs_id AS obs_a, b.obs_id AS obs_b FROM pair_matches m
  JOIN obs a ON a.image_id = image_i AND a.qc = round_even(col_i / 25e-2, 0)::BIGINT AND a.qr = round_even(row_i / 25e-2, 0)::BIGINT
  JOIN obs b ON b.image_id = image_j AND b.qc = round_even(col_j / 25e-2, 0)::BIGINT AND b.qr = round_even(row_j / 25e-2, 0)::BIGINT)""",
    "labels": """both_ways AS (SELECT DISTINCT obs_a AS u, obs_b AS v FROM edges UNION SELECT obs_b, obs_a FROM edges),
labels(node, component) USING KEY (node) AS (SELECT obs_id, obs_id FROM obs
  UNION SELECT v, min(l.component) FROM labels l JOIN both_ways ON u = l.node JOIN recurring.labels r ON r.node = v WHERE l.component < r.component GROUP BY v)""",
    "stats": "stats AS (SELECT track_id, count(*) AS n_views, coalesce(avg(score), 0) AS mean_score FROM observations GROUP BY track_id)",
    "covis": "covis AS (SELECT DISTINCT a.image_id AS image_a, b.image_id AS image_b FROM observations a JOIN observations b ON a.track_id = b.track_id AND a.image_id < b.image_id)",
    "reach": """links AS (SELECT image_a AS u, image_b AS v FROM covis UNION SELECT image_b, image_a FROM covis),
reach(image_id) AS (SELECT 0 UNION SELECT v FROM reach JOIN links ON u = image_id)""",
    "seeds": """seeds AS (SELECT track_id, lon0 + (col - kc * 150e0) / 1e5 AS lon, lat0 - (row - kr * 150e0) / 1e5 AS lat, 150e0 AS h
  FROM (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY image_id <> 0, image_id) = 1) JOIN images USING (image_id))""",
    "judged": """outcome AS (SELECT p.track_id, CASE WHEN p.track_id % 13 = 0 THEN 10000e0 WHEN p.track_id % 29 = 0 THEN -10005e-1 ELSE h_init END AS h, n_views,
  CASE WHEN p.track_id % 17 = 0 THEN 'nan'::DOUBLE WHEN p.track_id % 19 = 0 THEN 5e0 ELSE (p.track_id % 60) / 10e0 END AS err, p.track_id % 11 <> 0 AS ok
  FROM points p JOIN (SELECT track_id, count(*) AS n_views FROM observations GROUP BY 1) USING (track_id)),
judged AS (SELECT *, CASE WHEN NOT ok THEN 'optimizer_failed' WHEN n_views < 2 THEN 'insufficient_views' WHEN NOT isnan(err) AND err > 5 THEN 'high_reprojection_error'
  WHEN h < -1000 OR h > 10000 THEN 'height_out_of_range' END AS reason FROM outcome)""",
    "residuals": """predicted AS (SELECT obs_id, track_id, image_id, col, row, 1e5 * (lon_init - lon0) + kc * h_init AS pc, -1e5 * (lat_init - lat0) + kr * h_init AS pr
  FROM observations JOIN images USING (image_id) JOIN points USING (track_id)),
residuals AS (SELECT obs_id, track_id, image_id, col - pc - (a0 + a1 * (pc - 50005e-1) / 50005e-1 + a2 * (pr - 50005e-1) / 50005e-1) AS rc,
  row - pr - (b0 + b1 * (pc - 50005e-1) / 50005e-1 + b2 * (pr - 50005e-1) / 50005e-1) AS rr FROM predicted JOIN corrections USING (image_id))""",
    "corrections": """corrections AS (SELECT image_id, CASE WHEN image_id = 0 THEN 0e0 ELSE 1e-1 * (image_id % 7 - 3) END AS a0, CASE WHEN image_id = 0 THEN 0e0 ELSE 1e-2 * (image_id % 3) END AS a1,
  CASE WHEN image_id = 0 THEN 0e0 ELSE -2e-2 * (image_id % 4) END AS a2, CASE WHEN image_id = 0 THEN 0e0 ELSE -1e-1 * (image_id % 5) END AS b0,
  CASE WHEN image_id = 0 THEN 0e0 ELSE 3e-2 * (image_id % 2) END AS b1, CASE WHEN image_id = 0 THEN 0e0 ELSE 1e-2 * (image_id % 6) END AS b2 FROM images)""",
    "boxes": "boxes AS (SELECT image_id, lon0 AS x0, lon0 + 10000e0 / 1e5 AS x1, lat0 - 10000e0 / 1e5 AS y0, lat0 AS y1 FROM images)",
    "pairs": """pairs AS (SELECT a.image_id AS image_i, b.image_id AS image_j,
  greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS overlap
  FROM boxes a JOIN boxes b ON a.image_id < b.image_id)""",
}


def with_tables(names: str, query: str) -> str:
    """``query`` after the definitions of the named tables."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names.split()) + "\n" + query
