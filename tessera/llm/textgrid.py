"""Vectorised word tables: words, hashes and windows of many texts at once, in numpy.

Words are runs of bytes other than space and 0x09-0x0D. A word's hash is a
polynomial over its UTF-8 bytes modulo 2**64, passed through a mixer; words of
more than LONG_WORD bytes, for which such polynomials have known collisions,
are hashed with BLAKE2b instead.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import SparkSession

LONG_WORD = 255
CHUNK_BYTES = 1_000_000

_BASE = 0x9E6C63D0876A9A47 | 1
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ODD = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            up[0] = 1
            down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            down[0] = 1
            _powers, _inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """Words of a list of texts: byte offsets in ``data``, index of the text, hash."""

    __slots__ = ("data", "start", "end", "text", "hash", "n_texts", "first")

    def __init__(self, texts: list[str | None], fold: bool = False):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.n_texts = len(parts)
        self.data = b"\n".join(parts)
        raw = np.frombuffer(self.data, np.uint8)
        n = len(raw)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        gap = np.ones(n + 2, bool)
        np.take(_SEPARATOR, raw, out=gap[1:-1])
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        _tables(n + 1)
        with np.errstate(over="ignore"):
            terms = np.zeros(n + 1, np.uint64)
            np.take(_ODD[_FOLD] if fold else _ODD, raw, out=terms[1:])
            terms[1:] *= _powers[:n]
            np.cumsum(terms, out=terms)
            h = mix((terms[self.end] - terms[self.start]) * _inverse[self.start])
        for i in np.flatnonzero(self.end - self.start > LONG_WORD):
            word = self.data[self.start[i] : self.end[i]]
            if fold:
                word = _FOLD[np.frombuffer(word, np.uint8)].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self.hash = h
        self.text = np.searchsorted(ends, self.start).astype(np.int32)
        #: first[i]:first[i + 1] are the words of text i
        self.first = np.searchsorted(self.text, np.arange(self.n_texts + 1))

    def __len__(self) -> int:
        return len(self.hash)

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].decode("utf-8", "surrogatepass")

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of ``size`` words of one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            base = self.hash if not seed else mix(self.hash + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            total = np.zeros(n, np.uint64)
            k = pow(_BASE, 3 + seed, 1 << 64)
            factor = 1
            for j in range(size):
                factor = factor * k & (1 << 64) - 1
                total += base[j : j + n] * np.uint64(factor)
            keep = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
            return keep, mix(total[keep])


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters at most; a longer text is alone."""
    begin = size = 0
    i = -1
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if i >= begin:
        yield begin, i + 1


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending uint64 values as compressed byte planes of their differences."""
    import pyarrow as pa

    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def unpack_sorted(b: bytes) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def pack_ints(x: np.ndarray) -> bytes:
    """Unsigned integers in any order as compressed byte planes."""
    import pyarrow as pa

    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def unpack_ints(b: bytes) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500, size: str = "8MB"):
    """Arrow batches of at most so many rows and about so many bytes, for what runs inside.

    A row of these operators may hold a whole text or the members of a group, so
    that batches of the usual row count need too much memory on both sides.
    """
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def slices(batches, rows: int = 500):
    """Arrow batches of so few rows that their texts fit in memory as strings; at the end, freed memory goes back."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    release_memory()


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are done.

    It does so when the driver's JVM collects their plans, which with a large driver heap may come after the disk is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_memory() -> None:
    """Give the freed memory of this worker back, as it waits for other tasks without ending."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
