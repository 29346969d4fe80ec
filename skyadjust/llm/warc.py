"""WARC archives: writing captures, reading records, assembling transactions.

Archives are plain WARC/1.1 files.  A record ends with two CRLFs, which is also the line separator
of the text sink, so the JVM writes whole archives to any store Spark can reach.  The reader parses
by Content-Length, never by searching for separators, and accepts gzip members.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ._common import broadcast_if_small

END = "\r\n\r\n"
#: Smallest payload that a revisit record may stand for.
REVISIT_BYTES = 1000
#: A fixed date: archives of one table are equal byte for byte.
DATE = "2026-01-01T00:00:00Z"

RECORD_SCHEMA = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, payload_digest string, payload_bytes long, fields map<string,string>"


def record_id(kind: str, page_id: Column, label: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(f":{kind}"), label, F.lit(">"))


def _record(headers: list[Column], block: Column) -> Column:
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.encode(F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *headers, size), F.lit(END)), "UTF-8"), block)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def write(pages: DataFrame, path: str, captures_per_file: int = 3000) -> None:
    """Write a request, a response or revisit, and a metadata record for every page.

    ``pages`` has page_id, url and html.  The payload is the html in UTF-8, empty for null.  Among
    pages of equal payloads of at least ``REVISIT_BYTES`` the one with the largest page_id is a
    response and the others revisit it, without the payload but with its HTTP headers.  The digests
    that occur more than once are counted before they are broadcast; beyond 300,000 they are joined
    by a shuffle.  Rows that share a page_id are captures of their own: their record ids end with a hash
    of url and payload and a number; a null page_id is written as null.  Null urls have no WARC-Target-URI; white space and control characters in a url
    are percent-encoded.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    repeated = own.groupBy(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("name")).count().where("count > 1").select("name")
    n, first = repeated.count(), [F.max("page_id").alias("first"), F.lit("").alias("first_label")]
    own = own.withColumn("label", F.lit(""))
    if n:
        name = F.coalesce(F.col("page_id").cast("string"), F.lit("null")) == F.col("name")
        repeated = broadcast_if_small(repeated, n)
        equal = F.xxhash64("digest", "url")
        place = F.row_number().over(Window.partitionBy("page_id", equal).orderBy("digest", "url"))
        several = own.join(repeated, name, "left_semi").withColumn("label", F.concat(F.lit(":"), F.hex(equal), F.lit("."), place.cast("string")))
        own = own.join(repeated, name, "left_anti").unionByName(several)
        top = F.max(F.struct("page_id", "label"))
        first = [top["page_id"].alias("first"), top["label"].alias("first_label")]
    twice = own.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(*first, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    n = twice.count()
    own = own.join(broadcast_if_small(twice, n), "digest", "left").withColumn("again", F.coalesce(F.col("first") != F.col("page_id"), F.lit(False)))
    uri = _header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"))
    date, pid, label, length = _header("WARC-Date", F.lit(DATE)), F.col("page_id"), F.col("label"), F.octet_length("payload")
    main_id = F.when(F.col("again"), record_id("revisit", pid, label)).otherwise(record_id("response", pid, label))
    http = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit(END)), "UTF-8")
    path_of = F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), r"://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    concurrent = _header("WARC-Concurrent-To", main_id)
    request = _record(
        [F.lit("WARC-Type: request"), _header("WARC-Record-ID", record_id("request", pid, label)), date, uri, concurrent, F.lit("Content-Type: application/http;msgtype=request")],
        F.encode(F.concat(F.lit("GET "), path_of, F.lit(" HTTP/1.1" + END)), "UTF-8"),
    )
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    response = _record([F.lit("WARC-Type: response"), _header("WARC-Record-ID", main_id), date, uri, digest, F.lit("Content-Type: application/http;msgtype=response")], F.concat(http, F.col("payload")))
    revisit = _record(
        [F.lit("WARC-Type: revisit"), _header("WARC-Record-ID", main_id), date, uri, digest, _header("WARC-Refers-To", record_id("response", F.col("first"), F.col("first_label"))),
         F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.lit("Content-Type: application/http;msgtype=response")],
        http,
    )
    metadata = _record(
        [F.lit("WARC-Type: metadata"), _header("WARC-Record-ID", record_id("metadata", pid, label)), date, uri, concurrent, F.lit("Content-Type: application/warc-fields")],
        F.encode(F.concat(F.lit("pageId: "), F.coalesce(pid.cast("string"), F.lit("null")), F.lit("\r\n")), "UTF-8"),
    )
    end = F.encode(F.lit(END), "UTF-8")
    whole = F.concat(request, end, F.when(F.col("again"), revisit).otherwise(response), end, metadata)
    own.select(whole.cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", captures_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """(headers, block) of every record; header names in lower case, each with all its values."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    view, at = memoryview(data), 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        stop = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or stop < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers: dict[str, list[str]] = {}
        name = ""
        for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and name:
                headers[name][-1] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            name = name.strip().lower()
            headers.setdefault(name, []).append(value.strip())
        size = int(headers["content-length"][0])
        if stop + 4 + size > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, view[stop + 4 : stop + 4 + size]
        at = stop + 4 + size


def _http(block: memoryview) -> tuple[dict[str, str], memoryview]:
    head = bytes(block[: 1 << 16])
    stop = head.find(b"\r\n\r\n")
    if stop < 0:
        return {}, block[len(block) :]
    return {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in head[:stop].decode("latin-1").split("\r\n")[1:])}, block[stop + 4 :]


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of all archives under ``path``; with ``payload``, also the payload's bytes.

    payload_bytes and payload_digest (lower-case hex) of responses are computed from the payload and
    checked against the record's header; a revisit has those of the payload it stands for.  ``fields``
    holds a metadata record's fields.  Records that share a record id are one record; which of them
    stays is not defined unless they are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[tuple] = []
                held = 0
                for h, block in parse(batch.column(0)[i].as_py()):
                    row, body = _row(h, block)
                    rows.append((*row, bytes(body)) if payload else row)
                    held += len(body) if payload else 100
                    if held > 8 << 20:
                        yield _batch(rows, payload)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, payload)

    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), run, RECORD_SCHEMA + (", payload binary" if payload else ""))


def _row(h: dict[str, list[str]], block: memoryview) -> tuple[tuple, memoryview]:
    one = lambda name: h.get(name, [None])[0]
    kind, digest, size, fields = one("warc-type"), None, None, None
    body = block[len(block) :]
    if kind in ("response", "resource", "revisit"):
        said = (one("warc-payload-digest") or "").partition(":")[2].lower() or None
        http, body = _http(block) if kind != "resource" else ({}, block)
        if kind == "revisit":
            digest, size = said, int(http["content-length"]) if "content-length" in http else None
        else:
            digest, size = hashlib.sha1(body).hexdigest(), len(body)
            if said and len(said) == 40 and said != digest:
                raise ValueError(f"{one('warc-record-id')}: the payload's digest is {digest}, its header says {said}")
    elif kind == "metadata":
        fields = [(a.strip(), b.strip()) for a, sep, b in (x.partition(":") for x in bytes(block).decode("utf-8", "replace").splitlines()) if sep]
    return (one("warc-record-id"), kind, one("warc-target-uri"), one("warc-date"), h.get("warc-concurrent-to", []), one("warc-refers-to"), digest, size, fields), body


def _batch(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    s = pa.string()
    kinds = [s, s, s, s, pa.list_(s), s, s, pa.int64(), pa.map_(s, s), *([pa.binary()] if payload else [])]
    names = ["record_id", "type", "target_uri", "date", "concurrent_to", "refers_to", "payload_digest", "payload_bytes", "fields", *(["payload"] if payload else [])]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, requests, metadata).

    ``response`` is the response, revisit or resource record, with all columns of ``records``.
    Requests and metadata belong to the record they name in WARC-Concurrent-To, or that names them,
    directly or through one further record of the transaction; a record that fits several captures
    goes to the one with the smallest id.  Requests and metadata without a response form a capture
    of their own with a null response.  Lists are sorted by record id.
    """
    records = records.dropDuplicates(["record_id"])
    is_main = F.col("type").isin("response", "revisit", "resource")
    main = records.where(is_main)
    side = records.where(~is_main).select("record_id", "type", "target_uri", "date", "concurrent_to", "fields")
    names = lambda df: df.select("record_id", F.explode("concurrent_to").alias("to"))
    mains = main.select(F.col("record_id").alias("capture_id"))
    out = names(side)
    direct = out.join(mains, F.col("to") == F.col("capture_id")).select("record_id", "capture_id").unionByName(names(main).select(F.col("to").alias("record_id"), F.col("record_id").alias("capture_id")))
    far = out.join(direct.select(F.col("record_id").alias("to"), "capture_id"), "to").select("record_id", "capture_id")
    owner = direct.unionByName(far).groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    owned = side.join(owner, "record_id", "left").withColumn("capture_id", F.coalesce("capture_id", "record_id"))
    pick = lambda kind: F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", "target_uri", "date", F.map_entries("fields").alias("fields")))))
    sides = owned.groupBy("capture_id").agg(pick("request").alias("requests"), pick("metadata").alias("metadata"))
    mained = main.select(F.col("record_id").alias("capture_id"), F.struct(*main.columns).alias("response"))
    none = F.expr("cast(array() as array<struct<record_id:string,target_uri:string,date:string,fields:array<struct<key:string,value:string>>>>)")
    return mained.join(sides, "capture_id", "full").select("capture_id", "response", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))
