"""N-gram Jaccard join by parity sketches.

Each shingle of a document's set flips one bit of a long, sparse bit sketch, so the Hamming distance
of two sketches is at most the symmetric difference of the sets.  Sets of a and b shingles with
Jaccard likeness of 3/4 or more differ in at most (a + b) / 7 shingles.  The sketch of a size band is
cut into chunks, about as many as the band's largest set has shingles; a chunk is named by the XOR of
the 64-bit names of its set bits.

Pigeonhole: take a set's first t + 1 + s chunks, in any order that all sets share, where
t = (n + 4n/3) / 7 bounds the difference for every partner.  At most t of them differ from the other
set's, so at least s + 1 are equal, and the first ones of these are among the other's first as well.
So sets meet in an equi-join on (size band, place, chunk), and pairs that meet in fewer than s + 1
chunks are no candidates; s is n / 48.  Chunks that hold several bits come first in the order, very
common ones late and empty ones last, so chance meetings are few.  The same sketch folded to about a
bit a shingle gives the Hamming distance that a pair must keep to be verified.

Meeting sets are not expanded into all pairs.  In a few rounds, each set is verified against the
member of another component that it meets most, and linked sets are merged.  Sets that then still meet
other components are candidates: those connected by large buckets are compared by their folded
sketches in tiles, pairs that meet in small buckets alone one by one.  The candidates' graph falls into
parts of sets that are truly near; the members of a part are verified in tiles that hold their texts.
A tile gives only the pairs that connect what it has not connected yet, so rows grow with the members
and not with their pairs, and no link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ._common import Scratch, broadcast_if_small, components, hash_share, text_or_empty
from ._words import BASE, INV, U, Words, mix, powers, slices

SHINGLE = 5
#: Band k has sets of 2**k up to 2**(k+1) shingles; a set near the end of its band also serves in the next.
#: Chunks of a sketch per shingle of its band's largest set, and the fewest.
DENSITY, LEAST_CHUNKS = 0.8, 8
#: Fewest bits of a folded sketch; it has at least a bit a shingle, in a power of two.
LEAST_BITS = 512
#: Rounds of star comparisons before the exact one.
ROUNDS = 3
#: Documents sampled to find very common chunks, sampled sets a common one is in, and how many are kept at most: they are broadcast.
SAMPLE, COMMON, COMMON_MOST = 4096, 6, 50_000
#: Buckets with more members than this are compared together, by the parts that they connect.
HOT = 32
#: Members of a part, and bytes of their sketches or texts, that are compared with each other in one task; larger parts are tiled.
TILE, TILE_BYTES = 4096, 8 << 20


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): the set of row r is ``hashes[first[r]:first[r+1]]``, ascending.

    A-Z count as a-z.  A text with fewer than ``size`` words has its whole word sequence as its one
    shingle; a text without words has an empty set.
    """
    w = Words(texts)
    h = w.hashes(lower=True)
    n, rows = len(h), len(texts)
    total = np.zeros(n + 1, U)
    np.cumsum(h * powers(BASE, n), out=total[1:])
    per = np.where(w.counts >= size, w.counts - size + 1, np.minimum(w.counts, 1))
    owner = np.repeat(np.arange(rows), per)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(w.first[:-1], per)
    stop = start + np.minimum(w.counts, size)[owner]
    s = mix((total[stop] - total[start]) * powers(INV, n + 1)[start] + (stop - start).astype(U))
    order = np.lexsort((s, owner))
    owner, s = owner[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (s[1:] != s[:-1])
    owner, s = owner[new], s[new]
    return np.searchsorted(owner, np.arange(rows + 1)), s


def class_ids(first: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A 64-bit id of each whole set (the order of members does not matter)."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(s ^ U(0xC2B2AE3D27D4EB4F)), dtype=U)])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U)).view(np.int64)


def roles(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, band) of every band that a set of size n serves in; sets of one or two shingles have no partner but equals."""
    own = np.flatnonzero(n >= 3)
    band = np.frexp(n[own].astype(float))[1].astype(np.int64) - 1
    again = 4 * n[own] // 3 >= 2 << band
    return np.concatenate([own, own[again]]), np.concatenate([band, band[again] + 1])


def sketch_chunks(first: np.ndarray, s: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, item, late): the chunks of each set's sketches, each hashed with its band and place.

    Without ``common`` all that are not empty.  With it, sorted items that are to come late and are
    flagged so, the first t + 1 + s of each sketch; a sketch with fewer chunks that are not empty
    gives empty ones too, flagged late.
    """
    n = np.diff(first)
    which, band = roles(n)
    size = n[which]
    role = np.repeat(np.arange(len(which)), size)
    if not len(role):
        return role, np.zeros(0, U), np.zeros(0, bool)
    x = s[np.arange(len(role)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[:-1][which], size)]
    chunks = np.maximum(LEAST_CHUNKS, (DENSITY * (2 << band)).astype(np.int64))
    place = ((x >> U(32)) * chunks.astype(U)[role]) >> U(32)
    new = np.ones(len(x), bool)
    new[1:] = (role[1:] != role[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(new)
    chunk = np.bitwise_xor.reduceat(mix(x), at)
    alone = np.diff(np.append(at, len(x))) == 1
    role, place = role[at], place[at]
    named = lambda chunk, place, band: mix(chunk ^ (place * U(0x9E3779B97F4A7C15)) ^ (band.astype(U) * U(0xD6E8FEB86659FD93)))
    item = named(chunk, place, band[role])
    late = np.zeros(len(item), bool)
    if common is None:
        return which[role], item, late
    if len(common):
        late = common[np.minimum(np.searchsorted(common, item), len(common) - 1)] == item
    order = np.lexsort(((item >> U(2)) | (alone.astype(U) << U(62)) | (late.astype(U) << U(63)), role))
    want = ((n + 4 * n // 3) // 7 + n // 48 + 1)[which]
    begin = np.searchsorted(role, np.arange(len(which) + 1))
    have = np.diff(begin)
    keep = order[np.arange(len(item)) - begin[role] < want[role]]
    out = [which[role[keep]], item[keep], late[keep]]
    short = np.flatnonzero(have < want)
    if len(short):
        empty = [np.setdiff1d(np.arange(chunks[r], dtype=U), place[begin[r] : begin[r + 1]])[: want[r] - have[r]] for r in short.tolist()]
        of = np.repeat(short, [len(e) for e in empty])
        more = named(np.zeros(len(of), U), np.concatenate(empty), band[of])
        out = [np.concatenate(v) for v in zip(out, [which[of], more, np.ones(len(of), bool)], strict=True)]
        order = np.argsort(out[0], kind="stable")
        out = [v[order] for v in out]
    return out[0], out[1], out[2]


def parity_sketches(first: np.ndarray, s: np.ndarray) -> list[bytes]:
    """One folded sketch per set: a power of two of bits, at least a bit a shingle."""
    n = np.diff(first)
    bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    owner = np.repeat(np.arange(len(n)), n)
    at = (mix(s + U(77)) & (bits[owner] - 1).astype(U)).astype(np.int64) + (ends - bits)[owner]
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[(e - b) // 8 : e // 8] for e, b in zip(ends.tolist(), bits.tolist(), strict=True)]


def fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches as sketches of fewer words: parts lie on top of each other, XORed."""
    return sketches if sketches.shape[1] == words else np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def distances(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Hamming distances of pairs of folded sketches, each pair at the smaller one's size."""
    out = np.zeros(len(a), np.int64)
    la, lb = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) // 8 for x in (a, b))
    for p, q in set(zip(la.tolist(), lb.tolist(), strict=True)):
        at = np.flatnonzero((la == p) & (lb == q))
        x, y = (np.frombuffer(b"".join(v.take(pa.array(at)).to_pylist()), U).reshape(len(at), -1) for v in (a, b))
        out[at] = np.bitwise_count(fold(x, min(p, q)) ^ fold(y, min(p, q))).sum(axis=1, dtype=np.int64)
    return out


def _common_chunks(docs: DataFrame) -> np.ndarray:
    """Chunks that are in many sets of a bounded sample; they only set the order, never what is found."""
    sample = docs.where(hash_share(F.xxhash64("doc_id", "text"), SAMPLE, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                first, s = shingle_sets(batch.column(1))
                ids = class_ids(first, s)
                owner, item, _ = sketch_chunks(first, s)
                yield pa.RecordBatch.from_arrays([pa.array(item.view(np.int64)), pa.array(ids[owner])], names=["item", "cls"])

    items = map_arrow(sample.repartition(16, "doc_id"), run, "item long, cls long")
    rows = items.distinct().groupBy("item").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "item").limit(COMMON_MOST).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(U))


def _profiles(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, n, cls, sketch, sigs, late): ``sigs`` the chunks a set meets others by, ``late`` the common ones among them."""
    shipped = docs.sparkSession.sparkContext.broadcast(common)
    names = ["doc_id", "n", "cls", "sketch", "sigs", "late"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, 1):
                first, s = shingle_sets(batch.column(1))
                n, ids = np.diff(first), class_ids(first, s)
                owner, item, late = sketch_chunks(first, s, shipped.value)
                # Of copies within this task only one sends its chunks.
                fresh = np.array([not (c in seen or seen.add(c)) for c in ids.tolist()]) & (n > 0)
                if len(seen) > 200_000:
                    seen.clear()

                def lists(on: np.ndarray, owner=owner, item=item, rows=len(n)) -> pa.Array:
                    of, sig = owner[on], item[on].view(np.int64)
                    order = np.argsort(of, kind="stable")
                    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[order], np.arange(rows + 1)).astype(np.int32)), pa.array(sig[order]))

                none = n == 0
                bits = parity_sketches(first, s)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(n, pa.int64()), pa.array(ids, mask=none), pa.array(bits, pa.binary(), mask=none), lists(fresh[owner] & ~late), lists(fresh[owner] & late),
                ], names=names)

    return map_arrow(docs, run, "doc_id long, n long, cls long, sketch binary, sigs array<long>, late array<long>")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of (a, b), the pairs whose folded sketches allow the likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(distances(batch.column(3), batch.column(4)) * 7 <= batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b")
    return map_arrow(known.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "sa", "sb"), run, "a long, b long")


def _texts(wanted: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, text) of the classes' first documents: texts are less to move than sets.  Ids may repeat, so other texts may come too."""
    need = scratch.save(wanted.select("cls").distinct().join(classes.select("cls", "rep"), "cls").select("cls", F.col("rep").alias("rep_id")), "need")
    ids = broadcast_if_small(need, need.count())
    texts = scratch.save(docs.join(ids, docs["doc_id"].eqNullSafe(ids["rep_id"])).select("cls", "text"), "texts")
    scratch.drop(need)
    return texts


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Of (a, b), the pairs whose sets have 100 * intersection >= 75 * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3, 1 << 19):
                (fa, a), (fb, b) = shingle_sets(batch.column(2)), shingle_sets(batch.column(3))
                inner = []
                for i in range(batch.num_rows):
                    both = np.concatenate([a[fa[i] : fa[i + 1]], b[fb[i] : fb[i + 1]]])
                    both.sort()
                    inner.append(int((both[1:] == both[:-1]).sum()))
                inner = np.array(inner, np.int64)
                good = 100 * inner >= 75 * (np.diff(fa) + np.diff(fb) - inner)
                # Only texts that still have their class's set count: ids may repeat.
                good &= (class_ids(fa, a) == batch.column(0).to_numpy()) & (class_ids(fb, b) == batch.column(1).to_numpy())
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    texts = _texts(pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))), docs, classes, scratch)
    with_b = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    whole = with_b.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    out = scratch.save(map_arrow(whole, check, "a long, b long"), "links")
    scratch.drop(texts)
    scratch.release()
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, int, int]]:
    """(columns, start, stop) of every group of a stream sorted by its first ``keys`` columns, which are longs or ints."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        now = batch if held is None else pa.concat_batches([held, batch])
        if not now.num_rows:
            continue
        cols = [now.column(i) for i in range(now.num_columns)]
        new = np.zeros(now.num_rows - 1, bool)
        for c in cols[:keys]:
            new |= np.diff(c.to_numpy()) != 0
        ends = [0, *(np.flatnonzero(new) + 1).tolist()]
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            if hi - lo > 1:
                yield cols, lo, hi
        held = now.slice(ends[-1])
    if held is not None and held.num_rows > 1:
        yield [held.column(i) for i in range(held.num_columns)], 0, held.num_rows


def _fits(n: Column, m: Column) -> Column:
    return F.least(n, m) * 4 >= F.greatest(n, m) * 3


def _floor48(n: Column, m: Column) -> Column:
    return F.floor(F.least(n, m) / 48).cast("int")


def _bucket_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, s) of different components, different parts and fitting sizes, one row for each bucket that they meet in.

    ``rows``: sig, cls, root, n, hot, part (the class itself where it is in none), of buckets of at most
    HOT members; ``hot`` counts the class's larger buckets, in which it may meet the other as well.
    """
    x, y = rows.alias("x"), rows.alias("y")
    on = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.part") != F.col("y.part")) & _fits(F.col("x.n"), F.col("y.n"))
    return x.join(y, on).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), (_floor48(F.col("x.n"), F.col("y.n")) - F.least("x.hot", "y.hot")).alias("s"))


class _Near:
    """Members of a tile or two whose pairs are looked at: sizes, folded sketches, components, and labels that merge as pairs are found."""

    def __init__(self, n: np.ndarray, sketches: list[bytes], root: np.ndarray, side: np.ndarray | None, use: np.ndarray, label: np.ndarray):
        self.n, self.sketches, self.root, self.side, self.use, self.label = n, sketches, root, side, use, label

    def rows(self, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(i, partners): members of other components and labels, and sides if there are any, whose sizes and sketches allow the likeness.

        Each pair once; ``most`` words of sketches are compared at a time.
        """
        n, words = self.n, np.array([len(b) // 8 for b in self.sketches], np.int64)
        for p in np.unique(words).tolist():
            at = np.flatnonzero((words == p) & self.use)
            x = np.frombuffer(b"".join([self.sketches[i] for i in at.tolist()]), U).reshape(-1, p)
            for q in (p, 2 * p):
                on = np.flatnonzero((words == q) & self.use)
                if not len(on) or not len(at):
                    continue
                y = fold(np.frombuffer(b"".join([self.sketches[j] for j in on.tolist()]), U).reshape(-1, q), p)
                # Folded further, a sketch still bounds the difference from below: most pairs fall at its first glance.
                coarse = min(p, LEAST_BITS // 64)
                xc, yc = fold(x, coarse), fold(y, coarse)
                step = max(1, most // (len(on) * coarse))
                for lo in range(0, len(at), step):
                    i = at[lo : lo + step, None]
                    ok = (self.root[on] != self.root[i]) & (np.minimum(n[on], n[i]) * 4 >= np.maximum(n[on], n[i]) * 3)
                    if q == p:
                        ok &= on > i
                    if self.side is not None:
                        ok &= self.side[on] != self.side[i]
                    far = np.zeros(ok.shape, np.int32)
                    for w in range(coarse):
                        far += np.bitwise_count(xc[lo : lo + step, w, None] ^ yc[:, w])
                    k, j = np.nonzero(ok & (far * 7 <= n[on] + n[i]))
                    near = np.ones(len(k), bool)
                    for a in range(0, len(k) if p > coarse else 0, max(1, most // p)):
                        few = slice(a, a + max(1, most // p))
                        near[few] = np.bitwise_count(y[j[few]] ^ x[lo + k[few]]).sum(axis=1, dtype=np.int64) * 7 <= n[on[j[few]]] + n[at[lo + k[few]]]
                    k, j = k[near], on[j[near]]
                    ends = np.append(np.flatnonzero(np.diff(k)) + 1, len(k))
                    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                        if b > a:
                            i = int(at[lo + k[a]])
                            left = j[a:b][self.label[j[a:b]] != self.label[i]]
                            if len(left):
                                yield i, left

    def merge(self, i: int, others: np.ndarray) -> Iterator[int]:
        """Those of ``others`` that join a new label to that of i."""
        for j in others.tolist():
            if self.label[j] != self.label[i]:
                self.label[self.label == self.label[j]] = self.label[i]
                yield j


def spanning_candidates(n: np.ndarray, sketches: list[bytes], cls: np.ndarray, root: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (a, b) that connect all members which pairs of different components with near sketches connect, and no others."""
    near = _Near(n, sketches, root, side, np.ones(len(n), bool), np.arange(len(n)))
    return [(int(cls[i]), int(cls[j])) for i, others in near.rows() for j in near.merge(i, others)]


def spanning_links(texts: pa.Array, cls: np.ndarray, root: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that merge all components which links between the given texts connect, and no others.

    With ``side``, only texts of different sides are compared.  A pair is verified if its sizes fit
    and its folded sketches are near enough; pairs already in one component are not looked at.
    """
    first, sets = np.zeros(1, np.int64), []
    for batch in slices(pa.record_batch([texts], names=["text"]), 0):
        f, s = shingle_sets(batch.column(0))
        first, sets = np.concatenate([first, f[1:] + first[-1]]), [*sets, s]
    s = np.concatenate(sets)
    n, number = np.diff(first), np.unique(s, return_inverse=True)[1]
    # Only texts that still have their class's set count: ids may repeat.
    near = _Near(n, parity_sketches(first, s), root, side, class_ids(first, s) == cls, np.unique(root, return_inverse=True)[1])
    flag = np.zeros(int(number.max()) + 1 if len(number) else 1, bool)
    out: list[tuple[int, int]] = []
    for i, j in near.rows():
        mine = number[first[i] : first[i + 1]]
        flag[mine] = True
        begin = np.cumsum(n[j]) - n[j]
        inner = np.add.reduceat(flag[number[np.arange(int(n[j].sum())) + np.repeat(first[j] - begin, n[j])]].astype(np.int64), begin)
        flag[mine] = False
        out += [(int(cls[i]), int(cls[k])) for k in near.merge(i, j[100 * inner >= 75 * (n[j] + n[i] - inner)])]
    return out


def _tiled(members: DataFrame, data: str) -> DataFrame:
    """Members (part, cls, root, n, ``data``) dealt to the pairs of tiles that they meet others in: (part, t1, t2, tile, cls, root, n, ``data``).

    Sets that fit lie in one size cell or in neighbouring ones; a tile meets the tiles of these cells only.
    """
    members = members.withColumn("cell", F.floor(F.log("n") / float(np.log(4 / 3))).cast("long"))
    amount = F.greatest(F.count(F.lit(1)) / TILE, F.sum(F.octet_length(data)) / TILE_BYTES)
    tiles = members.groupBy("part", "cell").agg(F.ceil(amount).cast("long").alias("tiles"))
    tiles = tiles.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("cell", "tiles"))).alias("tiles"))
    number = lambda cell, k: cell * 1_000_000 + k
    near = lambda cell: F.when(F.try_element_at("tiles", cell).isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.try_element_at("tiles", cell) - 1), lambda k: number(cell, k)))
    around = F.flatten(F.array_compact(F.array(*[near(F.col("cell") + d) for d in (-1, 0, 1)])))
    dealt = members.join(tiles, "part").withColumn("tile", number(F.col("cell"), F.pmod(F.xxhash64("cls"), F.try_element_at("tiles", F.col("cell"))))).withColumn("other", F.explode(around))
    dealt = dealt.select("part", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "cls", "root", "n", data)
    return dealt.repartition("part", "t1", "t2").sortWithinPartitions("part", "t1", "t2")


def _in_tiles(dealt: DataFrame, by_text: bool) -> DataFrame:
    """Pairs (a, b) of the tiles that ``_tiled`` deals out, by texts or by sketches; of each group at most one less than it has members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, lo, hi in _groups(batches, 3):
            tile, cls, root, n = (c.slice(lo, hi - lo).to_numpy() for c in cols[3:7])
            side, data = None if cols[1][lo].as_py() == cols[2][lo].as_py() else tile, cols[7].slice(lo, hi - lo)
            found = spanning_links(data, cls, root, side) if by_text else spanning_candidates(n, data.to_pylist(), cls, root, side)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], names=["a", "b"])

    return map_arrow(dealt, run, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of every whole text: (doc_id, n_shingles, component_id).

    Two documents link when 100 * |A and B| >= 75 * |A or B| for their shingle sets; component_id is
    the smallest doc_id reachable by links.  Documents with equal sets are one class and travel as
    one.  Null, empty and blank texts have an empty set and link with nothing.  Rows that repeat a
    doc_id each give a row; ids are taken as they are, a null id never becomes a component_id unless
    all of its component is null.  Very long texts are whole sets like any other.  An empty table
    gives no rows.  Other columns are not read.

    Chunks of sketches and sets are 64-bit hashes; results are exact unless two different ones meet.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    profiles = scratch.save(_profiles(own, _common_chunks(own)), "profiles")
    classes = profiles.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    classes = scratch.save(classes, "classes")
    size = F.col("n").cast("int").alias("n")

    def by_sig(rows: DataFrame, **of: Column) -> DataFrame:
        """Aggregates over each bucket, beside its rows.  Common chunks, at most COMMON_MOST besides empty ones, are summed up first: one may hold any share of the rows."""
        same = Window.partitionBy("sig")
        rare = rows.where("not late").withColumns({k: v.over(same) for k, v in of.items()})
        sums = rows.where("late").groupBy("sig").agg(*[v.alias(k) for k, v in of.items()])
        return rare.unionByName(rows.where("late").join(F.broadcast(sums), "sig").select(*rare.columns))

    explode = lambda name: profiles.select(F.explode(name).alias("sig"), "cls", size, F.lit(name == "late").alias("late"))
    met = by_sig(explode("sigs").unionByName(explode("late")), lo=F.min("cls"), hi=F.max("cls")).where("lo < hi").select("sig", "cls", "n", "late")
    met = scratch.save(met.distinct(), "met")
    rows = scratch.save(profiles.select("doc_id", "n", "cls"), "rows")
    scratch.drop(profiles)
    scratch.release()
    roots = spark.createDataFrame([], "node long, root long")
    links = tested = spark.createDataFrame([], "a long, b long")

    def apart() -> DataFrame:
        """Members of buckets where components meet: (sig, cls, n, late, root, low, size), low being a member of the smallest component."""
        tagged = met.drop("root").join(roots, F.col("cls") == F.col("node"), "left").select("sig", "cls", "n", "late", F.coalesce("root", "cls").alias("root"))
        return by_sig(tagged, low=F.min(F.struct("root", "cls", "n")), hi=F.max("root"), size=F.count(F.lit(1))).where("low.root < hi").drop("hi")

    def enough(pairs: DataFrame) -> DataFrame:
        """Untested pairs (a, b, met) of (a, b, s) that meet in at least s + 1 chunks."""
        return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.min("s").alias("s")).where("met > s").select("a", "b", "met").join(tested, ["a", "b"], "left_anti")

    def merge(found: DataFrame) -> None:
        """Join the components that new links connect."""
        nonlocal links, roots
        new = scratch.save(links.unionByName(found), "links")
        roots = components(spark, new, "a", "b", scratch)
        links = new

    for _ in range(ROUNDS):
        held = scratch.save(apart(), "held")
        # Buckets of one component never matter again.
        scratch.drop(met)
        scratch.release()
        met = held
        sizes = F.col("n"), F.col("low.n")
        stars = held.where(F.col("root") != F.col("low.root")).where(_fits(*sizes)).select(F.least("cls", "low.cls").alias("a"), F.greatest("cls", "low.cls").alias("b"), _floor48(*sizes).alias("s"))
        best = enough(stars).select(F.explode(F.array("a", "b")).alias("of"), "a", "b", "met")
        best = best.groupBy("of").agg(F.max_by(F.struct("a", "b"), F.struct("met", "a", "b")).alias("p")).select("p.a", "p.b")
        best = scratch.save(best.distinct(), "best")
        if best.isEmpty():
            break
        near = scratch.save(_near(best, classes), "near")
        tested = scratch.save(tested.unionByName(best), "tested")
        if near.isEmpty():
            break
        merge(_verify(near, own, classes, scratch))

    last = scratch.save(apart(), "apart")
    scratch.drop(met)
    scratch.release()
    # Pairs that meet in large buckets alone do so in s + 1 of them, so only sets in more than the smallest partner's s are members.
    large = last.where(F.col("size") > HOT)
    hot = scratch.save(large.groupBy("cls").agg(F.count(F.lit(1)).cast("int").alias("hot"), F.first("root").alias("root"), F.first("n").alias("n")), "hot")
    members = hot.where(F.col("hot") > F.floor(F.floor(F.col("n") * 3 / 4) / 48))
    part = components(spark, large.join(members.select("cls"), "cls").select("cls", F.col("low.cls").alias("low")), "cls", "low", scratch)
    members = members.join(part.select(F.col("node").alias("cls"), F.col("root").alias("part")), "cls", "left").select("cls", "root", "n", F.coalesce("part", "cls").alias("part"))
    members = scratch.save(members.join(classes.select("cls", "sketch"), "cls"), "hot-members")
    few = last.where(F.col("size") <= HOT).select("sig", "cls", "root", "n").join(hot.select("cls", "hot"), "cls", "left").join(members.select("cls", "part"), "cls", "left")
    few = few.select("sig", "cls", "root", "n", F.coalesce("hot", F.lit(0)).alias("hot"), F.coalesce("part", "cls").alias("part"))
    few = scratch.save(enough(_bucket_pairs(few)).select("a", "b"), "few")
    many = scratch.save(_in_tiles(_tiled(members, "sketch"), False), "many")
    near = scratch.save(_near(few, classes).unionByName(many).distinct(), "near")
    scratch.drop(last)
    if not near.isEmpty():
        part = components(spark, near, "a", "b", scratch).select(F.col("node").alias("cls"), F.col("root").alias("part"))
        members = part.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "part", F.coalesce("root", "cls").alias("root")).join(classes.select("cls", "n"), "cls")
        members = scratch.save(members.select("part", "cls", "root", F.col("n").cast("int").alias("n")), "members")
        texts = _texts(members, own, classes, scratch)
        found = scratch.save(_in_tiles(_tiled(members.join(texts, "cls"), "text"), True).distinct(), "found")
        scratch.drop(texts)
        if not found.isEmpty():
            merge(found)

    placed = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    final = placed.join(placed.groupBy("root").agg(F.min("rep").alias("component")), "root").select("cls", "component")
    with_set = rows.where("cls is not null").join(final, "cls").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return with_set.unionByName(rows.where("cls is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns: of each near-duplicate component the one with the smallest doc_id.

    Rows that share a doc_id are judged by their own texts, of equal ones one is kept; rows with a null
    doc_id all stay.
    """
    scratch = Scratch(docs.sparkSession, "first")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = join(docs).where("doc_id != component_id").select(F.col("doc_id").alias("gone__")).distinct()
        gone = scratch.save(gone, "gone")
        return docs.join(broadcast_if_small(gone, gone.count()), F.col("doc_id") == F.col("gone__"), "left_anti")
    keyed = docs.withColumn("row__", F.xxhash64("doc_id", text_or_empty()))
    found = join(keyed, "row__").select(F.col("doc_id").alias("row__"), "component_id").distinct()
    named = keyed.where("doc_id is not null").select("row__", "doc_id").distinct()
    first = found.join(named, "row__").groupBy("component_id").agg(F.min(F.struct("doc_id", "row__")).alias("first")).select("first.row__")
    first = scratch.save(first, "kept")
    kept = keyed.where("doc_id is not null").join(first, "row__", "left_semi").dropDuplicates(["row__"])
    return kept.unionByName(keyed.where("doc_id is null")).select(*docs.columns)
