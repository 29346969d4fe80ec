"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is a linear score of text features.  The score is learned from preference
pairs (a document labelled 1 beats one labelled 0) by logistic loss on feature differences, drawn
from a bounded sample; the threshold is the quantile of the scores of all labelled documents that
the share of 0 among their labels marks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ._common import Scratch, text_or_empty
from ._words import SPACE, Words, slices

#: Score at and above which a document counts as good.
THRESHOLD = 0.3
#: Labelled documents the fit uses at most: those first by a hash of doc_id.
SAMPLE = 6000
#: Preference pairs drawn from them.
PAIRS = 30_000
#: Pairs whose differences are held at a time (about a kilobyte each): all of them together would be the driver's largest tables.
BLOCK = 1000
N_FEATURES = 128 + 11


def features(texts: pa.Array) -> np.ndarray:
    """Rows of N_FEATURES numbers of whole texts: shares of each ASCII byte and of the rest, then shapes of words and lines."""
    w = Words(texts)
    n = len(texts)
    size = np.diff(w.offsets)
    row = np.repeat(np.arange(n), size)
    kind = np.minimum(w.data, 127)
    share = np.bincount(row * 128 + kind, minlength=n * 128).reshape(n, 128) / np.maximum(size, 1)[:, None]
    of = np.repeat(np.arange(n), w.counts)
    words = np.maximum(w.counts, 1)
    length = (w.end - w.start).astype(float)
    per = lambda v: np.bincount(of, v, n) / words
    last, head = w.data[w.end - 1], w.data[w.start]
    mean = per(length)
    letters = np.zeros(256, bool)
    letters[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    upper = np.zeros(256, bool)
    upper[65:91] = True
    if len(w.data):
        space = SPACE[w.data]
        lines = np.bincount(row, w.data == 10, n)
        odd = np.bincount(row, ~(letters[w.data] | space), n)
        caps = np.bincount(row, upper[w.data], n)
    else:
        lines = odd = caps = np.zeros(n)
    h = w.hashes()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    repeats = per(again)
    distinct = np.bincount(of[order], new, n) / words
    more = np.stack([
        np.log1p(w.counts) / 10, mean / 10, np.sqrt(np.maximum(per(length**2) - mean**2, 0)) / 10,
        per(~letters[last]), per(upper[head]), lines / words, odd / np.maximum(size, 1), caps / np.maximum(size, 1),
        repeats, np.sqrt(repeats), distinct,
    ], axis=1)
    return np.concatenate([np.sqrt(share), more], axis=1)


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking: the raw score weighs (x - centre) / scale; ``cut`` is the threshold's raw score."""

    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Raw scores; a row's does not depend on the rows beside it, to the last bit."""
        return ((x - self.centre) / self.scale * self.weight).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; THRESHOLD exactly at the cut."""
        raw = self.raw(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25, seed: int = 7) -> Ranking:
    """Newton steps on the mean logistic loss of ``PAIRS`` seeded preference pairs plus a ridge.

    With one label only, or no rows, there is no preference: the weights are zero and every document
    scores THRESHOLD, which keeps it.  The cut is left at zero: ``train`` takes it from all labelled rows.
    """
    d = N_FEATURES
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    centre, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = (x - centre) / scale
    rng = np.random.default_rng(seed)
    won, lost = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    w = np.zeros(d)
    for _ in range(steps):
        grad, hess = ridge * w, ridge * np.eye(d)
        for lo in range(0, PAIRS, BLOCK):
            diff = z[won[lo : lo + BLOCK]] - z[lost[lo : lo + BLOCK]]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad -= diff.T @ p / PAIRS
            hess += (diff * (p * (1 - p))[:, None]).T @ diff / PAIRS
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Ranking(centre, scale, w, 0.0)


def _map(df: DataFrame, columns: str, fn) -> DataFrame:
    """``fn(features)`` for column 1 of ``df``; column 0 is carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), *fn(features(batch.column(1)))], names=[c.split()[0] for c in columns.split(", ")])

    return map_arrow(df, run, columns)


def middle(values: DataFrame, k: int, parts: int = 4096) -> float:
    """Mean of the k-th and the next smallest number of column ``v`` (k from 1, of more than k rows).

    Exact at any size: counts of ``parts`` ranges are collected, and the range that holds the k-th
    is parted again until it holds one number.
    """
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    ahead = 0
    while lo < hi:
        part = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / parts)), F.lit(parts - 1))
        for _, n, lo, hi in sorted(values.where(F.col("v").between(lo, hi)).groupBy(part.alias("p")).agg(F.count("v"), F.min("v"), F.max("v")).collect()):  # noqa: B020
            if ahead + n >= k:
                break
            ahead += n
    upto, after = values.agg(F.count_if(F.col("v") <= lo), F.min(F.when(F.col("v") > lo, F.col("v")))).first()
    return lo if upto > k else (lo + after) / 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Weights from at most ``sample`` labelled documents, the threshold from all of them; none that is held out.

    Held out is a doc_id whose crc32 mod 5 is 0.  The sample is what orders first by a hash of
    doc_id: a top-k, so the driver holds ``sample`` rows; of rows that share a doc_id it takes the
    smallest text.  Null labels are no labels; of a document's repeated labels the largest counts.
    All labelled rows are scored for the threshold; labels too many to broadcast meet scores, not texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    own = scratch.save(own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y")), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select(F.struct("doc_id", "y").alias("key"), "text")
    got = _map(rows, "key struct<doc_id:bigint,y:int>, x array<double>", lambda x: [pa.array(list(x), pa.list_(pa.float64()))]).toArrow()
    key, x = (got.column(c).combine_chunks() for c in ("key", "x"))
    order = np.argsort(key.field("doc_id").to_numpy())
    # The driver's heap that collecting took goes back before the fit and before the last pass.
    scratch.release()
    ranking = fit(x.flatten().to_numpy().reshape(len(x), N_FEATURES)[order], key.field("y").to_numpy()[order])
    del got, key, x
    if not ranking.weight.any():
        return ranking
    few = own.count() <= 300_000
    scored = _map(texts.join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi") if few else texts, "doc_id long, v double", lambda x: [pa.array(ranking.raw(x), pa.float64())])
    scored = scratch.save(scored.join(F.broadcast(own) if few else own, "doc_id").select("y", "v"), "scored")
    cut = float(middle(scored.select("v"), scored.where("y = 0").count()))
    scratch.release()
    return replace(ranking, cut=cut)


def classify(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; only the text goes into the score.

    Null and empty texts have features of zero and a score like any other; repeated rows each give a
    row; other columns are not read.  A map over rows: no shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = _map(rows, "doc_id long, score double", lambda x: [pa.array(ranking.score(x), pa.float64())])
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores at least THRESHOLD."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, place):
                yield batch.filter(pa.array(ranking.score(features(batch.column(place))) >= THRESHOLD))

    return map_arrow(docs, run, docs.schema)
