"""Image catalog and cameras: GeoTIFF headers, embedded rational cameras, sidecar files."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataModelError
from ..functions.geo import CAMERA_TYPE, OFFSETS, POLYNOMIALS, RPC_TYPE, SCALES
from ..operators.order import dense_ids
from ..shipping import ship

#: Sidecar suffixes in order of preference (fixed values).
SIDECARS = (".RPB", ".rpb", ".xml", ".txt", ".json")
#: TIFF tags: image width, image height, and the 92 doubles of a rational camera (fixed values).
WIDTH_TAG, HEIGHT_TAG, RPC_TAG = 256, 257, 50844
#: Bytes of the TIFF field types that are read, by type number, with their struct codes (fixed values).
TIFF_TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d"), 16: (8, "Q")}


def tiff_fields(data: bytes, wanted: set[int]) -> dict[int, tuple]:
    """Values of ``wanted`` tags in the first directory of a classic or big TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise DataModelError("not a TIFF file")
    (magic,) = struct.unpack_from(order + "H", data, 2)
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at, step, inline = at + (8 if big else 2), 20 if big else 12, 8 if big else 4
    out: dict[int, tuple] = {}
    for i in range(n):
        entry = at + i * step
        tag, kind = struct.unpack_from(order + "HH", data, entry)
        count = struct.unpack_from(order + ("Q" if big else "I"), data, entry + 4)[0]
        if tag in wanted and kind in TIFF_TYPES:
            size, code = TIFF_TYPES[kind]
            place = entry + step - inline
            if size * count > inline:
                place = struct.unpack_from(order + ("Q" if big else "I"), data, place)[0]
            out[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
    return out


def camera_from_tag(values: tuple) -> dict:
    """A rational camera of the tag's 92 doubles: two errors, five offsets, five scales, four polynomials."""
    if len(values) != 92:
        raise DataModelError(f"a rational camera tag holds 92 values, not {len(values)}")
    out = dict(zip((*OFFSETS, *SCALES), values[2:12], strict=True))
    return out | {n: list(values[12 + 20 * i : 32 + 20 * i]) for i, n in enumerate(POLYNOMIALS)}


#: Names of rational camera fields in tags and sidecars, lower case without underscores, by our own name.
ALIASES = {
    "line_off": ("lineoff", "lineoffset"), "samp_off": ("sampoff", "sampoffset", "sampleoff"), "lat_off": ("latoff", "latoffset"), "long_off": ("longoff", "longoffset", "lonoff"),
    "height_off": ("heightoff", "heightoffset", "altoff", "altoffset"), "line_scale": ("linescale",), "samp_scale": ("sampscale", "samplescale"), "lat_scale": ("latscale",),
    "long_scale": ("longscale", "lonscale"), "height_scale": ("heightscale", "altscale"), "line_num": ("linenumcoeff", "linenumcoef", "linenum"), "line_den": ("linedencoeff", "linedencoef", "lineden"),
    "samp_num": ("sampnumcoeff", "sampnumcoef", "sampnum"), "samp_den": ("sampdencoeff", "sampdencoef", "sampden"),
}


def parse_tag_value(raw: Column) -> Column:
    """struct<num, list, str> of a tag's text: a bracketed list of numbers, else a number, else trimmed text; null stays null."""
    text = F.trim(raw)
    items = F.filter(F.split(F.regexp_replace(F.substring(text, 2, 1 << 30), r"\)$", ""), r"[,\s]+"), lambda x: x != "")
    bracket = text.startswith("(") & text.endswith(")")
    number = F.when(~bracket, text.try_cast("double"))
    value = F.struct(number.alias("num"), F.when(bracket, F.transform(items, lambda x: x.try_cast("double"))).alias("list"), F.when(~bracket & number.isNull(), text).alias("str"))
    return F.when(raw.isNotNull(), value)


def parse_sidecar(name: str, text: str) -> dict:
    """A rational camera of a sidecar file: JSON, XML, or ``name = value`` / ``name: value`` lines."""
    found: dict[str, list[float]] = {}
    numbers = lambda s: [float(x) for x in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", s)]

    def add(key: str, value: str) -> None:
        key = re.sub(r"[^a-z0-9]", "", key.lower())
        key = re.sub(r"\d+$", "", key)
        for ours, names in ALIASES.items():
            if key in names and (values := numbers(value)):
                if ours in POLYNOMIALS:
                    found.setdefault(ours, []).extend(values)
                else:
                    found.setdefault(ours, values[:1])

    if name.lower().endswith(".json"):
        for k, v in json.loads(text).items():
            add(k, json.dumps(v))
    elif name.lower().endswith(".xml"):
        for e in ElementTree.fromstring(text).iter():
            add(e.tag.rpartition("}")[2], e.text or "")
    else:
        for k, v in re.findall(r"([A-Za-z_]\w*)\s*[=:]\s*(\([^)]*\)|[^\n;]*)", text):
            add(k, v)
    missing = [n for n in (*OFFSETS, *SCALES, *POLYNOMIALS) if len(found.get(n, ())) < (20 if n in POLYNOMIALS else 1)]
    if missing:
        raise DataModelError(f"{name}: no {', '.join(missing)}")
    return {n: found[n][:20] if n in POLYNOMIALS else found[n][0] for n in (*OFFSETS, *SCALES, *POLYNOMIALS)}


def _tail(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan(spark: SparkSession, image_dir: str, rpc_dir: str | None = None) -> DataFrame:
    """(image_id, name, image_path, width, height, camera) of all ``*.tif`` directly in ``image_dir``.

    image_id is the position in path order, name the file's stem.  The camera is the embedded one, or
    that of the first sidecar by suffix, in ``rpc_dir`` or else beside the image; an image without one
    raises DataModelError.  Files are read through Spark, so any store serves.
    """
    ship(spark)

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                f = tiff_fields(content, {WIDTH_TAG, HEIGHT_TAG, RPC_TAG})
                rows.append((path, int(f[WIDTH_TAG][0]), int(f[HEIGHT_TAG][0]), camera_from_tag(f[RPC_TAG]) if RPC_TAG in f else None))
            yield pd.DataFrame(rows, columns=["image_path", "width", "height", "rpc"])

    rpc = RPC_TYPE.simpleString()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(image_dir).select("path", "content")
    images = files.mapInPandas(headers, f"image_path string, width int, height int, rpc {rpc}")
    images = images.withColumn("name", F.regexp_extract(_tail(F.col("image_path")), r"^(.*)\.tif$", 1))
    found = images.join(sidecars(spark, rpc_dir or image_dir), "name", "left").withColumn("rpc", F.coalesce("rpc", "side_rpc")).drop("side_rpc")
    lost = found.where("rpc is null").select("name").limit(5).collect()
    if lost:
        raise DataModelError(f"no camera for {', '.join(r[0] for r in lost)}")
    ids = dense_ids(found, [F.col("image_path")], [F.col("image_path")], "image_id")
    camera = F.struct(F.lit("rpc00b").alias("kind"), F.lit(None).cast("array<double>").alias("affine"), F.col("rpc")).cast(CAMERA_TYPE)
    return ids.select(F.col("image_id").cast("int").alias("image_id"), "name", "image_path", "width", "height", camera.alias("camera"))


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(name, side_rpc): of each stem's sidecars the one whose suffix comes first in SIDECARS."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "side_rpc": [parse_sidecar(p, bytes(c).decode("utf-8", "replace")) for p, c in zip(pdf["path"], pdf["content"], strict=True)]})

    files = spark.read.format("binaryFile").load(folder).select("path", "content").where(" or ".join(f"endswith(path, '{s}')" for s in SIDECARS))
    rank = F.coalesce(*[F.when(F.col("path").endswith(s), i) for i, s in enumerate(SIDECARS)])
    named = files.withColumns({"name": F.regexp_extract(_tail(F.col("path")), r"^(.*)\.[^.]+$", 1), "rank": rank})
    first = named.groupBy("name").agg(F.min_by(F.struct("path", "content"), "rank").alias("f")).select("name", "f.path", "f.content")
    return first.mapInPandas(read, f"name string, side_rpc {RPC_TYPE.simpleString()}")
