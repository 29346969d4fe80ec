"""Words of a whole Arrow batch at once: boundaries and 64-bit hashes by numpy over the text buffer.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Those bytes never occur inside
a multi-byte UTF-8 character, so working on bytes equals working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_M = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _M
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M
        out.append(z ^ (z >> 31))
    return np.array(out, U)


BASE = int(_splitmix(1, 11)[0]) | 5
INV = pow(BASE, -1, 1 << 64)
BYTE = _splitmix(256, 17)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown in the worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, U)
        step[0] = 1
        have = _POWERS[base] = np.cumprod(step, dtype=U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Words:
    """``start``/``end``: byte positions in ``data``; words of row r are ``first[r]:first[r+1]``."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = data, offsets - offsets[0]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        space = SPACE[data]
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= space[:-1]
        after[:-1] |= space[1:]
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One 64-bit hash a word; with ``lower``, A-Z count as a-z."""
        n = len(self.data)
        total = np.zeros(n + 1, U)
        np.cumsum((LOWER if lower else BYTE)[self.data] * powers(BASE, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * powers(INV, n + 1)[self.start]
        return mix(h + (self.end - self.start).astype(U) * U(0x9E3779B97F4A7C15))


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``limit`` bytes (arrays over them take a hundred times that), a row counting 1 KB more; one longer text is a part by itself."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes + 1024, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n items of ``h`` (rows not minded), by a rolling sum modulo 2**64."""
    if len(h) < n:
        return np.zeros(0, U)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(BASE, len(h)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(INV, len(h) - n + 1))
