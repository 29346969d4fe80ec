"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text's paragraphs (lines; long lines are cut where a word's hash says so, about every 8 words)
are hashed to 64-bit digests.  A sketch adds each distinct digest to three cells of (count, XOR of
digests, XOR of check hashes).  Subtracting two sketches cancels what both texts share; peeling pure
cells then recovers the differing digests.  Where peeling stalls, both sketches are rebuilt four
times larger with other hashes, until it succeeds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow, ship
from ._common import text_or_empty
from ._words import BASE, INV, U, Words, mix, powers

#: Cells of the sketch that a fingerprint holds (three parts of 8).
CELLS = 24
#: Mean words of a piece of a long line, a power of two.
PIECE = 8


def paragraph_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, digest) pairs of a list of texts, as two arrays sorted by text."""
    w = Words(pa.array(texts, pa.large_string()))
    h = w.hashes()
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    row = np.repeat(np.arange(len(texts)), w.counts)
    lines = np.concatenate([[0], np.cumsum(w.data == 10)])
    cut = (h & U(PIECE - 1)) == 0
    cut[:-1] |= (row[1:] != row[:-1]) | (lines[w.start[1:]] != lines[w.end[:-1]])
    cut[-1] = True
    stop = np.flatnonzero(cut) + 1
    start = np.concatenate([[0], stop[:-1]])
    total = np.zeros(n + 1, U)
    np.cumsum(h * powers(BASE, n), out=total[1:])
    digest = mix((total[stop] - total[start]) * powers(INV, n + 1)[start] + (stop - start).astype(U))
    at = row[start]
    order = np.lexsort((digest, at))
    at, digest = at[order], digest[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (digest[1:] != digest[:-1])
    return at[new], digest[new]


def _check(digest: np.ndarray) -> np.ndarray:
    return mix(digest + U(0xA5A5A5A5)) & U(0xFFFFFFFF)


def _cells(digest: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Three cells of each digest, one in each third of the sketch."""
    third = U(cells // 3)
    return np.stack([mix(digest + U(0x51ED270B * (3 * seed + k + 1))) % third + third * U(k) for k in range(3)]).astype(np.int64)


class Sketches:
    """``rows`` sketches of ``cells`` cells each, side by side."""

    def __init__(self, rows: int, cells: int, seed: int = 0):
        self.rows, self.cells, self.seed = rows, cells, seed
        self.count = np.zeros(rows * cells, np.int64)
        self.keys = np.zeros(rows * cells, U)
        self.checks = np.zeros(rows * cells, U)

    def add(self, row: np.ndarray, digest: np.ndarray, sign: np.ndarray | int) -> None:
        at = (_cells(digest, self.cells, self.seed) + row * self.cells).ravel()
        np.add.at(self.count, at, np.tile(np.broadcast_to(sign, row.shape), 3))
        np.bitwise_xor.at(self.keys, at, np.tile(digest, 3))
        np.bitwise_xor.at(self.checks, at, np.tile(_check(digest), 3))

    def subtract(self, other: Sketches) -> None:
        self.count -= other.count
        self.keys ^= other.keys
        self.checks ^= other.checks

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, sign) of what could be recovered, and which rows are wholly recovered.  Empties the sketches."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        for _ in range(4 * self.cells):
            pure = look[(np.abs(self.count[look]) == 1) & (self.checks[look] == _check(self.keys[look]))]
            row, digest, sign = pure // self.cells, self.keys[pure], self.count[pure]
            order = np.lexsort((digest, row))
            row, digest, sign = row[order], digest[order], sign[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
            row, digest, sign = row[new], digest[new], sign[new]
            if not len(row):
                break
            found.append((row, digest, sign))
            self.add(row, digest, -sign)
            look = np.unique((_cells(digest, self.cells, self.seed) + row * self.cells).ravel())
            look = look[np.abs(self.count[look]) == 1]
        full = ~((self.count != 0) | (self.keys != 0) | (self.checks != 0)).reshape(self.rows, self.cells).any(axis=1)
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)]
        return parts[0], parts[1], parts[2], full

    def encode(self, sizes: np.ndarray) -> list[str]:
        """One string a sketch: the number of its digests, then the cells."""
        blob = np.empty((self.rows, self.cells), np.dtype([("n", "<u2"), ("k", "<u8"), ("c", "<u4")]))
        blob["n"] = (self.count & 0xFFFF).reshape(self.rows, self.cells)
        blob["k"] = self.keys.reshape(self.rows, self.cells)
        blob["c"] = self.checks.reshape(self.rows, self.cells)
        return [f"{n}:" + base64.b64encode(b.tobytes()).decode() for n, b in zip(sizes.tolist(), blob, strict=True)]


def _pick(owner: np.ndarray, digest: np.ndarray, first: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of ``texts`` in that order, numbered by place."""
    sizes = first[texts + 1] - first[texts]
    row = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[texts], sizes)
    return row, digest[at]


def likeness(owner: np.ndarray, digest: np.ndarray, n_texts: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard likeness of text pairs (a, b) by subtract, peel, retry; and how many digests each pair differs in.

    Two texts without paragraphs are alike (1), one with and one without are not (0).
    """
    first = np.searchsorted(owner, np.arange(n_texts + 1))
    size = np.diff(first)
    differ, todo, cells, seed = np.full(len(a), -1), np.arange(len(a)), CELLS, 0
    while len(todo):
        left, right = Sketches(len(todo), cells, seed), Sketches(len(todo), cells, seed)
        left.add(*_pick(owner, digest, first, a[todo]), 1)
        right.add(*_pick(owner, digest, first, b[todo]), 1)
        left.subtract(right)
        row, _, _, full = left.peel()
        differ[todo[full]] = np.bincount(row, minlength=len(todo))[full]
        todo, cells, seed = todo[~full], cells * 4, seed + 1
    both = size[a] + size[b]
    same = (both - differ) / 2
    return np.where(both == 0, 1.0, same / np.maximum(both - same, 1)), differ


def fingerprints(owner: np.ndarray, digest: np.ndarray, n_texts: int) -> list[str]:
    s = Sketches(n_texts, CELLS)
    s.add(owner, digest, 1)
    return s.encode(np.bincount(owner, minlength=n_texts))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; a map over rows, no shuffle.  Null: as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in _parts(texts):
                owner, digest = paragraph_digests(part)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(map(len, part), pa.int64()), pa.array(fingerprints(owner, digest, len(part)))], names=["doc_id", "n_chars", "fingerprint"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, "doc_id long, n_chars long, fingerprint string")


def _parts(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1024
        if held >= limit:
            yield at, texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def compare_edits(docs: DataFrame, block_rows: int = 500, max_blocks: int = 4096) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the
    next document's, in ascending order of doc_id; after the last comes the first.  Returns (doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, differing).

    Rows go to blocks of consecutive ids and the first row of a block also to the block before, so
    each text is shuffled once and nothing needs a global window.  Only block bounds (at most
    ``max_blocks``) reach the driver.  Null texts are empty; rows that share a doc_id order by text;
    a single document is its own next; null ids come first; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), text_or_empty().alias("text"))
    ids = own.select("doc_id")
    n = ids.count()
    blocks = max(1, min(max_blocks, n // block_rows))
    splits = np.unique(np.array(ids.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)) if blocks > 1 else [], np.int64))

    @F.pandas_udf(T.LongType())
    def block_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, x.to_numpy(), side="right"))

    lows = ids.groupBy(block_of("doc_id").alias("block")).agg(F.min("doc_id").alias("low")).collect()
    lows = sorted((r["block"], r["low"]) for r in lows)
    before = {low: lows[i - 1][0] for i, (_, low) in enumerate(lows)}

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def places(x: pd.Series) -> pd.Series:
        own_block = np.searchsorted(splits, x.to_numpy(), side="right").tolist()
        return pd.Series([[b, ~before[i]] if i in before else [b] for b, i in zip(own_block, x.tolist(), strict=True)])

    # A place b is the row's own block; ~b marks the copy that only serves as the block's next document.
    dealt = own.withColumn("place", F.explode(places("doc_id"))).withColumn("block", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")))
    dealt = dealt.select("block", (F.col("place") < 0).alias("guest"), "doc_id", "no_id", "text").repartition("block").sortWithinPartitions("block", "guest", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                held += len(row[4]) + 1024
                if held > 1 << 20 and len(rows) > 1:
                    yield from _compare(rows)
                    rows, held = rows[-1:], len(rows[-1][4]) + 1024
        if rows:
            yield from _compare([*rows, None])

    return map_arrow(dealt, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, differing long")


def _compare(rows: list) -> Iterator[pa.RecordBatch]:
    """Results of all rows but the last, which is only the next of the one before."""
    keep = [i for i in range(len(rows) - 1) if not rows[i][1]]
    if not keep:
        return
    texts = [r[4] if r else "" for r in rows]
    follow = [i + 1 if rows[i + 1] and rows[i + 1][0] == rows[i][0] else i for i in keep]
    edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2] for i, j in zip(keep, follow, strict=True)]
    n = len(texts) + len(edited)
    owner, digest = paragraph_digests(texts + edited)
    prints = fingerprints(owner, digest, n)
    mine, next_, changed = np.array(keep), np.array(follow), np.arange(len(texts), n)
    near, differ = likeness(owner, digest, n, np.concatenate([mine, mine]), np.concatenate([changed, next_]))
    k = len(keep)
    yield pa.RecordBatch.from_arrays(
        [pa.array([None if rows[i][3] else rows[i][2] for i in keep], pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
         pa.array([prints[i] for i in keep]), pa.array(prints[len(texts):]), pa.array(near[:k]), pa.array(near[k:]), pa.array(differ[:k], pa.int64())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "differing"],
    )
