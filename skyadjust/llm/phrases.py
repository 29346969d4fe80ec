"""Substring dedup by repeated-phrase automata.

A window is 35 consecutive words.  Equal windows share their anchor, the eight-word phrase of lowest
hash among the window's 28, so only windows whose anchor recurs need be counted.  Those are counted
exactly, by group of documents first; the windows that start in two places are the confirmed recurring
passages.  Their anchors are compiled into Aho-Corasick automata over word numbers, one for each
bounded group of documents, and every document of the group with a recurring anchor streams through it:
the automaton locates the phrases, the windows around them that are confirmed are marked, and marked
words go.

Texts that are equal as a whole are one text with a number of copies: each of their windows recurs,
so a text of copies loses all its words, and only distinct texts travel further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ._common import Scratch, broadcast_if_small, text_or_empty
from ._words import U, Words, mix, ngrams, slices

WINDOW = 35
PHRASE = 8
#: Distinct texts that share one automaton.
GROUP = 1500
#: A key that holds one row in SHARES or more is not shuffled.
SHARES = 4096


def _lowest(x: np.ndarray, want: int) -> np.ndarray:
    """Minimum of every ``want`` consecutive items."""
    span = 1
    while span * 2 <= want:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (want - span)], x[want - span :]) if span < want else x


def anchors(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, row, anchor, left, right) of every window that lies in one text.

    ``anchor`` is the hash of the window's lowest phrase; ``left`` and ``right`` are the first and the
    last place in the window where that phrase stands.
    """
    n = len(h)
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U), none, none
    phrase = ngrams(h, PHRASE)
    bits = U(max(24, n.bit_length()))
    place, mask = np.arange(len(phrase), dtype=U), (U(1) << bits) - U(1)
    top = (phrase >> bits) << bits
    left = (_lowest(top | place, WINDOW - PHRASE + 1) & mask).astype(np.int64)
    right = (mask - (_lowest(top | (mask - place), WINDOW - PHRASE + 1) & mask)).astype(np.int64)
    row = np.repeat(np.arange(len(w.counts)), w.counts)
    start = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
    left, right = left[start], right[start]
    return start, row[start], phrase[left], left, right


def _runs(row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """First index of each run of windows of one text with one anchor."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    return np.flatnonzero(new)


def _profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_words, sha, anchors): distinct anchors of a text, flagged where they recur in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, 2):
                w = Words(batch.column(2))
                rows = batch.num_rows
                raw = w.data.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)]
                _, row, anchor, left, right = anchors(w, w.hashes())
                first = _runs(row, anchor)
                moves = np.minimum.reduceat(left, first) != np.maximum.reduceat(right, first) if len(first) else np.zeros(0, bool)
                # Of copies within this task only one sends its anchors.
                fresh = np.array([not (t in seen or seen.add(t)) for t in batch.column(1).to_pylist()])
                if len(seen) > 200_000:
                    seen.clear()
                on = fresh[row[first]]
                row, anchor, moves = row[first][on], anchor[first][on], moves[on]
                order = np.lexsort((anchor, row))
                row, anchor, moves = row[order], anchor[order], moves[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                at = np.flatnonzero(new)
                size = np.diff(np.append(at, len(row)))
                twice = (size > 1) | (np.logical_or.reduceat(moves, at) if len(at) else np.zeros(0, bool))
                offsets = np.searchsorted(row[at], np.arange(rows + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(anchor[at].view(np.int64)), pa.array(twice)], names=["a", "t"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(w.counts, pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["doc_id", "th", "n_words", "sha", "anchors"]
                )

    return map_arrow(docs.select("doc_id", "th", "text"), run, "doc_id long, th long, n_words long, sha string, anchors array<struct<a:bigint,t:boolean>>")


def _marks(live: DataFrame) -> DataFrame:
    """(th, anchor, phrase, whs): for each recurring anchor of a text its words' numbers and the hashes of the windows it anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                w = Words(batch.column(2))
                h = w.hashes()
                start, row, anchor, left, _ = anchors(w, h)
                if not len(start):
                    continue
                lists = batch.column(1)
                known = lists.flatten().to_numpy().view(U)
                of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                name = lambda r, a: mix(a + r.astype(U) * U(0x9E3779B97F4A7C15))
                on = np.isin(name(row, anchor), name(of, known))
                start, row, anchor, left = start[on], row[on], anchor[on], left[on]
                if not len(start):
                    continue
                order = np.lexsort((start, anchor, row))
                start, row, anchor, left = start[order], row[order], anchor[order], left[order]
                first = _runs(row, anchor)
                wh = ngrams(h, WINDOW)[start]
                ids = (h & U(0xFFFFFFFF)).astype(np.uint32)
                names = [ids[p : p + PHRASE].tobytes() for p in left[first].tolist()]
                offsets = np.append(first, len(row)).astype(np.int32)
                th = batch.column(0).take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays(
                    [th, pa.array(anchor[first].view(np.int64)), pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(wh.view(np.int64)))], names=["th", "anchor", "phrase", "whs"]
                )

    return map_arrow(live.select("th", "known", "text"), run, "th long, anchor long, phrase binary, whs array<long>")


class PhraseLocator:
    """An automaton over word numbers, and the hashes of the confirmed windows around its phrases."""

    def __init__(self, phrases: list[bytes], windows: np.ndarray):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, p in enumerate(phrases):
            self.automaton.add_word(tuple(np.frombuffer(p, np.uint32).tolist()), i)
        if phrases:
            self.automaton.make_automaton()
        self.empty = not phrases or not len(windows)
        self.windows = np.unique(windows)

    def covered(self, h: np.ndarray) -> np.ndarray:
        """Which words of one text, given as word hashes, lie in a confirmed window."""
        n = len(h)
        starts = np.zeros(n + 1, np.int64)
        if self.empty or n < WINDOW:
            return starts[:n].astype(bool)
        ends = np.array([e for e, _ in self.automaton.iter(tuple((h & U(0xFFFFFFFF)).tolist()))], np.int64)
        p = ends - PHRASE + 1
        np.add.at(starts, np.maximum(p - (WINDOW - PHRASE), 0), 1)
        np.add.at(starts, p + 1, -1)
        maybe = np.flatnonzero(np.cumsum(starts)[: n - WINDOW + 1] > 0)
        wh = ngrams(h, WINDOW)[maybe]
        at = np.minimum(np.searchsorted(self.windows, wh), len(self.windows) - 1)
        hit = maybe[self.windows[at] == wh]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        return np.cumsum(cover)[:n] > 0


def _locate(rows: DataFrame) -> DataFrame:
    """Stream each group's texts through the group's automaton: (th, n_removed, kept).

    ``rows`` (grp, kind, th, phrase, whs, text) lie sorted by (grp, kind): phrases first, then texts,
    of which only the current one is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, phrases, windows, locator = None, [], [], None
        for batch in batches:
            grp, kind, th = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple[int, int, str]] = []
            for i in range(batch.num_rows):
                if grp[i] != group:
                    group, phrases, windows, locator = grp[i], [], [], None
                if kind[i] == 0:
                    phrases.append(batch.column(3)[i].as_py())
                    windows.append(batch.column(4)[i].values.to_numpy().view(U))
                    continue
                if locator is None:
                    locator = PhraseLocator(phrases, np.concatenate(windows) if windows else np.zeros(0, U))
                w = Words(batch.column(5).slice(i, 1))
                gone = locator.covered(w.hashes())
                kept = b" ".join(w.data[a:b].tobytes() for a, b, g in zip(w.start.tolist(), w.end.tolist(), gone.tolist(), strict=True) if not g)
                out.append((th[i], int(gone.sum()), kept.decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["th", "n_removed", "kept"])

    return map_arrow(rows, run, "th long, n_removed long, kept string")


def _join_keys(rows: DataFrame, keys: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` whose key is among ``keys`` (key, n), n rows each: of ``total`` rows at most SHARES keys hold one in SHARES, which are broadcast; the rest shuffle."""
    hot = F.broadcast(keys.where(F.col("n") * SHARES >= total).select(key))
    rest = keys.where(F.col("n") * SHARES < total).select(key)
    return rows.join(hot, key, "left_semi").unionByName(rows.join(hot, key, "left_anti").join(rest, key, "left_semi"))


def text_hash(text_col: str = "text"):
    """A text's 64-bit key; equal texts share it."""
    t = text_or_empty(text_col)
    return F.xxhash64(t, F.octet_length(t))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(profiles, changed): (doc_id, th, n_words, sha) per row, and (th, n_removed, kept) per distinct text that loses words.

    ``changed`` holds one row per text, however many copies there are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("th", text_hash())
    profiles = scratch.save(_profiles(own), "profiles")
    classes = scratch.save(profiles.groupBy("th").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words")), "classes")
    spots = profiles.select("th", F.explode("anchors").alias("x")).select("th", F.col("x.a").alias("a"), F.col("x.t").alias("t"))
    often = scratch.save(spots.groupBy("a").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.max("t").alias("t"), F.count(F.lit(1)).alias("n")).where("lo < hi or t").select("a", "n"), "often")
    total = often.agg(F.sum("n")).first()[0] or 0
    known = scratch.save(_join_keys(spots, often, "a", total).groupBy("th").agg(F.collect_set("a").alias("known")), "known")
    need = scratch.save(classes.join(known.select("th"), "th").select("th", F.col("rep").alias("doc_id")), "need")
    n_need = need.count()
    # Null ids never join: their texts are found by the hash alone.
    ids = broadcast_if_small(need.select("doc_id", F.col("th").alias("want")), n_need)
    live = own.join(ids, own["doc_id"].eqNullSafe(ids["doc_id"]) & (own["th"] == ids["want"])).select("th", "text").dropDuplicates(["th"])
    live = scratch.save(live, "live")
    marks = scratch.save(_marks(live.join(known, "th")), "marks")
    scratch.drop(often, known, need)
    scratch.release()
    spread = max(1, n_need // GROUP)
    group = F.pmod(F.col("th"), F.lit(spread)).cast("int")
    occ = marks.select(group.alias("grp"), "anchor", F.explode("whs").alias("wh"))
    # A window of many texts is one row a group before any row moves by its hash alone.
    held = occ.groupBy("wh", "grp").agg(F.min("anchor").alias("anchor"), F.count(F.lit(1)).alias("n"))
    confirmed = held.withColumn("all", F.sum("n").over(Window.partitionBy("wh"))).where("all > 1")
    sure = confirmed.groupBy("grp", "anchor").agg(F.collect_list("wh").alias("whs"))
    names = marks.groupBy(group.alias("grp"), "anchor").agg(F.min("phrase").alias("phrase"))
    patterns = scratch.save(sure.join(names, ["grp", "anchor"]), "patterns")
    scratch.drop(marks)
    scratch.release()
    phrases = patterns.select("grp", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("th"), "phrase", "whs", F.lit(None).cast("string").alias("text"))
    texts = live.select(group.alias("grp"), F.lit(1).alias("kind"), "th", F.lit(None).cast("binary").alias("phrase"), F.lit(None).cast("array<long>").alias("whs"), "text")
    located = _locate(phrases.unionByName(texts).repartition("grp").sortWithinPartitions("grp", "kind"))
    whole = classes.where(f"copies > 1 and n_words >= {WINDOW}").select("th", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))
    changed = scratch.save(located.where("n_removed > 0").join(whole.select("th"), "th", "left_anti").unionByName(whole), "changed")
    scratch.drop(classes, live, patterns)
    return profiles.select("doc_id", "th", "n_words", "sha"), changed


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every whole text.

    Removed is each word covered by a window of 35 words whose word sequence also starts anywhere
    else, in any text or the same; kept words are joined by one space.  Null and empty texts have no
    words; texts under 35 words lose none; repeated rows are copies of each other; an empty table
    gives no rows; other columns are not read.  Windows are compared by 64-bit hashes of hashes.
    """
    profiles, changed = find(docs, id_col, text_col)
    out = profiles.join(changed.select("th", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("new")), "th", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("new", "sha").alias("kept_sha256"))


def strip(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring passages removed from ``text``; texts that lose nothing stay as they are.

    ``n_chars``, where there is one, follows the new text.
    """
    _, changed = find(docs)
    n = changed.count()
    marked = docs.withColumn("th__", text_hash())
    keys = changed.select(F.col("th").alias("th__"))
    same = marked.join(broadcast_if_small(keys, n), "th__", "left_anti")
    new = marked.join(broadcast_if_small(keys, n), "th__", "left_semi").join(changed.select(F.col("th").alias("th__"), "kept"), "th__")
    cols = [F.col("kept").alias(c) if c == "text" else F.length("kept").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return same.select(*docs.columns).unionByName(new.select(*cols))
