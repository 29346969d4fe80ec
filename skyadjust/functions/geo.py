"""Camera models, UTM and image geometry as Column expressions (JVM side, inside code generation).

A camera is a struct ``kind STRING, affine ARRAY<DOUBLE>, rpc STRUCT<...>``:

* ``affine`` holds [lon0, lat0, col_lon, col_lat, col_h, col_0, row_lon, row_lat, row_h, row_0]:
  col = col_lon (lon - lon0) + col_lat (lat - lat0) + col_h h + col_0, and row alike.
* ``rpc`` holds ten offsets and scales and four lists of 20 coefficients (the RPC00B form).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFSETS = ("line_off", "samp_off", "lat_off", "long_off", "height_off")
SCALES = ("line_scale", "samp_scale", "lat_scale", "long_scale", "height_scale")
POLYNOMIALS = ("line_num", "line_den", "samp_num", "samp_den")

RPC_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in (*OFFSETS, *SCALES)] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in POLYNOMIALS])
CAMERA_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("affine", T.ArrayType(T.DoubleType())), T.StructField("rpc", RPC_TYPE)])

#: WGS84 (fixed values).
SEMI_MAJOR, FLATTENING, UTM_SCALE = 6378137.0, 1 / 298.257223563, 0.9996
#: Points per image side along the sampled boundary.
SIDE_STEPS = 4


def affine_camera(lon0: Column, lat0: Column, col: tuple[Column, Column, Column, Column], row: tuple[Column, Column, Column, Column]) -> Column:
    """An affine camera struct; ``col`` and ``row`` are (lon, lat, h, constant) terms."""
    values = F.array(*[c.cast("double") for c in (lon0, lat0, *col, *row)])
    return F.struct(F.lit("affine").alias("kind"), values.alias("affine"), F.lit(None).cast(RPC_TYPE).alias("rpc"))


def monomials(x: Column, y: Column, z: Column) -> list[Column]:
    """The 20 monomials of the RPC00B cubic, x longitude, y latitude, z height (normalized)."""
    one = F.lit(1.0)
    return [one, x, y, z, x * y, x * z, y * z, x * x, y * y, z * z, x * y * z, x * x * x, x * y * y, x * z * z, x * x * y, y * y * y, y * z * z, x * x * z, y * y * z, z * z * z]


def _rational(camera: Column, lon: Column, lat: Column, h: Column) -> Column:
    """struct<col, row> of a rational camera.  Lambdas bind the normalized point and its monomials, so each is written once."""
    r = camera["rpc"]
    place = F.struct(((lon - r["long_off"]) / r["long_scale"]).alias("x"), ((lat - r["lat_off"]) / r["lat_scale"]).alias("y"), ((h - r["height_off"]) / r["height_scale"]).alias("z"))
    dot = lambda name, m: F.aggregate(F.zip_with(r[name], m, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    pixel = lambda m: F.struct(
        (r["samp_off"] + r["samp_scale"] * F.try_divide(dot("samp_num", m), dot("samp_den", m))).alias("col"), (r["line_off"] + r["line_scale"] * F.try_divide(dot("line_num", m), dot("line_den", m))).alias("row")
    )
    terms = F.transform(F.array(place), lambda p: F.array(*monomials(p["x"], p["y"], p["z"])))
    return F.transform(terms, pixel)[0]


def project(camera: Column, lon: Column, lat: Column, h: Column) -> tuple[Column, Column]:
    """(col, row) of ground points, for either camera kind."""
    a = camera["affine"]
    dx, dy = lon - a[0], lat - a[1]
    plain = (a[2] * dx + a[3] * dy + a[4] * h + a[5], a[6] * dx + a[7] * dy + a[8] * h + a[9])
    rational, is_affine = _rational(camera, lon, lat, h), camera["kind"] == "affine"
    return F.when(is_affine, plain[0]).otherwise(rational["col"]), F.when(is_affine, plain[1]).otherwise(rational["row"])


def localize_affine(camera: Column, col: Column, row: Column, h: Column) -> tuple[Column, Column]:
    """(lon, lat) at height h by the closed form of affine cameras; null for singular ones.

    Axes that do not mix are divided by their own scale, which rounds once.
    """
    a = camera["affine"]
    u, v = col - a[5] - a[4] * h, row - a[9] - a[8] * h
    det = a[2] * a[7] - a[3] * a[6]
    plain = (a[3] == 0) & (a[6] == 0) & (det != 0)
    dx, dy = F.try_divide(u * a[7] - v * a[3], det), F.try_divide(v * a[2] - u * a[6], det)
    return a[0] + F.when(plain, F.try_divide(u, a[2])).otherwise(dx), a[1] + F.when(plain, F.try_divide(v, a[7])).otherwise(dy)


def jacobian(camera: Column, lon: Column, lat: Column, h: Column, eps: float = 1e-6) -> list[Column]:
    """Forward differences [dcol/dlon, dcol/dlat, dcol/dh, drow/dlon, drow/dlat, drow/dh]."""
    c0, r0 = project(camera, lon, lat, h)
    moved = [project(camera, lon + eps, lat, h), project(camera, lon, lat + eps, h), project(camera, lon, lat, h + eps)]
    return [(c - c0) / eps for c, _ in moved] + [(r - r0) / eps for _, r in moved]


def image_norm(width: Column, height: Column) -> dict[str, Column]:
    """Centre and half size of images: c0, r0, sc, sr; half sizes are at least 1."""
    w, h = width.cast("double") / 2, height.cast("double") / 2
    return {"c0": w, "r0": h, "sc": F.greatest(w, F.lit(1.0)), "sr": F.greatest(h, F.lit(1.0))}


def affine_delta(col: Column, row: Column, p: list[Column], norm: dict[str, Column]) -> tuple[Column, Column]:
    """Correction (dc, dr) by six parameters a0 a1 a2 b0 b1 b2 in normalized image coordinates."""
    cn, rn = (col - norm["c0"]) / norm["sc"], (row - norm["r0"]) / norm["sr"]
    return p[0] + p[1] * cn + p[2] * rn, p[3] + p[4] * cn + p[5] * rn


def affine_matrix(p: list[Column]) -> Column:
    """The exported 2x3 form [[1 + a1, a2, a0], [b1, 1 + b2, b0]]."""
    return F.array(F.array(1 + p[1], p[2], p[0]), F.array(p[4], 1 + p[5], p[3]))


def quantize(value: Column, step: float) -> Column:
    """Grid number of a coordinate; halves go to the even neighbour."""
    return F.rint(value / F.lit(float(step))).cast("long")


def utm_zone(lon: Column) -> Column:
    """Zone by truncation; no exceptions for Norway and Svalbard, and 180 degrees gives 61."""
    return ((lon + 180) / 6).cast("int") + 1


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def _krueger() -> tuple[float, float, list[float]]:
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    return radius, 2 * math.sqrt(n) / (1 + n), alpha


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often the body names it, also where a filter is pushed through."""
    return F.transform(F.array(value), body)[0]


def utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """struct<e, n>: easting and northing in the UTM zone that an EPSG code names, by the Krueger series (below a millimetre)."""
    radius, c, alpha = _krueger()
    start = F.struct(F.sin(F.radians(lat)).alias("s"), F.radians(lon - ((epsg % 100) * 6 - 183)).alias("d"), F.when(epsg >= 32700, 1e7).otherwise(0.0).alias("f"))
    conformal = bind(start, lambda p: F.struct(F.sinh(F.atanh(p["s"]) - c * F.atanh(c * p["s"])).alias("t"), p["d"].alias("d"), p["f"].alias("f")))
    sphere = bind(conformal, lambda p: F.struct(F.atan2(p["t"], F.cos(p["d"])).alias("xi"), F.atanh(F.sin(p["d"]) / F.sqrt(1 + p["t"] * p["t"])).alias("eta"), p["f"].alias("f")))

    def series(p: Column) -> Column:
        east, north = p["eta"], p["xi"]
        for j, a in enumerate(alpha, 1):
            east = east + a * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
            north = north + a * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
        return F.struct((500000 + UTM_SCALE * radius * east).alias("e"), (p["f"] + UTM_SCALE * radius * north).alias("n"))

    return bind(sphere, series)


def utm_distance(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Metres between two points in the UTM zone of the first."""
    epsg = utm_epsg(lon_a, lat_a)
    ends = F.struct(utm(lon_a, lat_a, epsg).alias("a"), utm(lon_b, lat_b, epsg).alias("b"))
    return bind(ends, lambda p: F.hypot(p["a"]["e"] - p["b"]["e"], p["a"]["n"] - p["b"]["n"]))


def boundary(width: Column, height: Column) -> Column:
    """Points (col, row) around an image at quarter steps, clockwise from the top left; repeats are dropped."""
    w, h, k = (width - 1).cast("double"), (height - 1).cast("double"), SIDE_STEPS
    points = [(w * (i / k), F.lit(0.0)) for i in range(k + 1)] + [(w, h * (i / k)) for i in range(1, k + 1)]
    points += [(w * (i / k), h) for i in range(k - 1, -1, -1)] + [(F.lit(0.0), h * (i / k)) for i in range(k - 1, 0, -1)]
    return F.array_distinct(F.array(*[F.struct(F.round(c, 6).alias("col"), F.round(r, 6).alias("row")) for c, r in points]))


def shoelace(ring: Column) -> Column:
    """Signed area of a ring, an array of struct<x, y>; counter-clockwise is positive."""
    n = F.size(ring)
    turn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: ring[i]["x"] * ring[(i + 1) % n]["y"] - ring[(i + 1) % n]["x"] * ring[i]["y"])
    return F.when(n < 3, 0.0).otherwise(F.aggregate(turn, F.lit(0.0), lambda a, b: a + b) / 2)


def rho(loss: str, z: Column) -> Column:
    """Robust loss of squared residuals z."""
    return {
        "linear": lambda: z,
        "soft_l1": lambda: 2 * (F.sqrt(1 + z) - 1),
        "huber": lambda: F.when(z <= 1, z).otherwise(2 * F.sqrt(z) - 1),
        "cauchy": lambda: F.log1p(z),
        "arctan": lambda: F.atan(z),
    }[loss]()


def rho_slope(loss: str, z: Column) -> Column:
    """Derivative of ``rho``, the weight of iteratively reweighted least squares."""
    return {
        "linear": lambda: F.lit(1.0),
        "soft_l1": lambda: 1 / F.sqrt(1 + z),
        "huber": lambda: F.when(z <= 1, 1.0).otherwise(1 / F.sqrt(z)),
        "cauchy": lambda: 1 / (1 + z),
        "arctan": lambda: 1 / (1 + z * z),
    }[loss]()


def match_score(distance: Column) -> Column:
    return 1 / (1e-6 + distance)


def linspace(low: Column, high: Column, n: int) -> Column:
    """n evenly spaced doubles; the low end alone for n = 1."""
    return F.array(low.cast("double")) if n == 1 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / (n - 1))
