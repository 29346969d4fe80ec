"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each distinct pre-token is encoded once per worker: the tree's leaves are the ranks of adjacent
pairs, its root yields the leftmost pair of lowest rank, a merge updates at most three leaves in
logarithmic time, and encoding ends when the root holds no mergeable pair.  A bounded cache keeps
the ids of pre-tokens seen before.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ._common import text_or_empty
from ._words import slices

#: The byte-level pre-tokenizer's public pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class PairTree:
    """Minimum segment tree: leaf i holds rank * width + i of the pair that starts at i, or NONE."""

    def __init__(self, keys: list[int]):
        self.width = 1 << max(0, (len(keys) - 1).bit_length())
        self.node = [NONE] * self.width + keys + [NONE] * (self.width - len(keys))
        for i in range(self.width - 1, 0, -1):
            a, b = self.node[2 * i], self.node[2 * i + 1]
            self.node[i] = a if a < b else b

    def root(self) -> int:
        return self.node[1]

    def put(self, i: int, key: int) -> None:
        node = self.node
        i += self.width
        node[i] = key
        while i > 1:
            i >>= 1
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a < b else b
            if node[i] == low:
                return
            node[i] = low


class Tokenizer:
    """A byte-level BPE tokenizer read from the JSON text of the public ``tokenizers`` format."""

    CACHE = 250_000

    def __init__(self, definition: str):
        spec = json.loads(definition)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_id = [vocab[s] for s in symbols]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        of = {s: b for b, s in enumerate(symbols)}
        self.bytes = {i: bytes(of[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.bytes}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.cache = _Cache(self)

    def merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in piece.encode()]
        n, pairs = len(ids), self.pairs
        if n < 2:
            return tuple(ids)
        width = 1 << 32

        def key(i: int, j: int) -> int:
            hit = pairs.get((ids[i], ids[j])) if j < n else None
            return hit[0] * width + i if hit else NONE

        tree = PairTree([key(i, i + 1) for i in range(n - 1)])
        after, before, live = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        while (low := tree.root()) != NONE:
            i = low % width
            j = after[i]
            ids[i] = pairs[ids[i], ids[j]][1]
            live[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            if j < n - 1:
                tree.put(j, NONE)
            tree.put(i, key(i, k))
            if (p := before[i]) >= 0:
                tree.put(p, key(p, i))
        return tuple(x for x, on in zip(ids, live, strict=True) if on)

    def encode(self, text: str) -> list[int]:
        """Ids as the public library gives them without added special tokens; special strings in the text become their ids."""
        if self.split is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(map(self.cache.__getitem__, self.find(text))))
        out: list[int] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += chain.from_iterable(map(self.cache.__getitem__, self.find(part)))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes of all ids, special ones included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Cache(dict):
    """Pre-token to ids in two generations: when the younger is full the elder goes, so memory stays bounded."""

    def __init__(self, owner: Tokenizer):
        self.owner, self.elder = owner, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.elder.get(piece) or self.owner.merge(piece)
        if len(piece) <= 64:
            if len(self) >= self.owner.CACHE:
                self.elder = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_LIVE: dict[str, Tokenizer] = {}


def tokenizer(definition: str) -> Tokenizer:
    """The worker's tokenizer for a definition, kept with its cache from task to task."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _LIVE:
        _LIVE.clear()
        _LIVE[key] = Tokenizer(definition)
    return _LIVE[key]


def encode(docs: DataFrame, definition: str, with_ids: bool = True, packed: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text.

    ``definition`` is the tokenizer's JSON text (about 1-2 MB), sent to each worker as a broadcast
    variable of that fixed size.  Returns (doc_id, n_tokens, ids [with_ids], ids_sha256,
    decoded_sha256).  ``packed`` makes ids a binary of little-endian unsigned integers, of 16 bits where
    the vocabulary allows it, else 32.  Null and empty texts: no tokens and the digests of the empty string; repeated
    rows each give a row; other columns of ``docs`` are not read.  A map over rows: no shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(shipped.value)
        decimal = tok.decimal.__getitem__
        width = "<u2" if max(tok.bytes) < 1 << 16 else "<u4"
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                counts, lists, enc, dec = [], [], [], []
                for text in batch.column(1).to_pylist():
                    ids = tok.encode(text)
                    counts.append(len(ids))
                    enc.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                    dec.append(hashlib.sha256(tok.decode(ids).encode()).hexdigest())
                    if with_ids:
                        lists.append(np.array(ids, width).tobytes() if packed else ids)
                cols = [batch.column(0), pa.array(counts, pa.int64()), *([pa.array(lists, pa.binary() if packed else pa.list_(pa.int32()))] if with_ids else []), pa.array(enc, pa.string()), pa.array(dec, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"])

    ids = f"ids {'binary' if packed else 'array<int>'}, " if with_ids else ""
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, f"doc_id long, n_tokens long, {ids}ids_sha256 string, decoded_sha256 string")
