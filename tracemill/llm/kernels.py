"""Vectorised text kernels over Arrow string columns, shared by the operators of this subpackage.

Everything here works on one bounded slice of an Arrow batch at a time, inside a Spark task: a
text column is seen as one byte array plus row offsets, words are (start, end) pairs in it, and
hashes of words or character n-grams are differences of a prefix sum of ``T[byte] * R**i`` modulo
2**64 (``T`` a fixed random table, ``R`` odd and so invertible), passed through a final mixer.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)
_RINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)

#: True where a byte is one of \x20 \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def doc_key(doc_id: str = "doc_id") -> Column:
    """doc_id as text; a null doc_id counts as the empty text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def crc_mod(n: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(doc_key(doc_id)) % n


_held: dict[str, Callable[[], None]] = {}
_entered = None


def holds(module: str, free: Callable[[], None]) -> None:
    """Names what frees the memory that a module's functions keep in a worker from batch to batch."""
    _held[module] = free


def entered(module: str) -> None:
    """To be called where a worker begins a module's work: what other modules kept is freed, as workers live on from stage to stage."""
    global _entered
    if module != _entered:
        for name, free in _held.items():
            if name != module:
                free()
        _entered = module
        released()


def released() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


@functools.lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict | pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with `fn` applied to bounded slices of every batch; the first column of `df` ends with the text to slice by."""
    names = [x.split()[0].strip("`") for x in _fields(schema)]

    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered(module)
        for batch in batches:
            for part in slices(batch):
                for out in fn(part):
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([_array(out[n]) for n in names], names)
            released()

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


def _array(x) -> pa.Array:
    return x if isinstance(x, pa.Array) else pa.array(x)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with at most `limit` bytes of text each, or a single longer row."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(np.asarray(size, dtype=np.int64))
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A text column with nulls as empty texts."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the offsets of its rows (first 0)."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(offs):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i below a power of two."""
    out = []
    for r in (_R, _RINV):
        p = np.ones(1, _U)
        base, step = np.full(1, r), np.full(1, r)
        while len(p) < size:
            p = np.concatenate([p, p * step])
            step = p[-1:] * base
        out.append(p)
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Sums:
    """Prefix sums of a byte array, from which the hash of any range follows in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        self.n = len(data)
        size = 1 << max(20, int(self.n).bit_length())
        power, self.inverse = _powers(size)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(_TABLE[data] * power[: self.n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(_U))

    def buckets(self, n: int, bits: int) -> np.ndarray:
        """Hash buckets below 2**bits of all n-byte ranges, by start; an empty array's are none."""
        m = max(self.n - n + 1, 0)
        h = (self.sums[n : n + m] - self.sums[:m]) * self.inverse[:m]
        return ((h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53) >> _U(64 - bits)).astype(np.int64)

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all n-byte ranges, by start."""
        m = self.n - n + 1
        if m <= 0:
            return np.zeros(0, _U)
        return mix((self.sums[n:] - self.sums[:m]) * self.inverse[:m] + _U(n))


def words(data: np.ndarray, offs: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that aren't blank; runs end at row ends."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~blank[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the distinct k-word shingles of each text, A-Z lower-cased.

    A text of 1 to k-1 words has its whole sequence as its one shingle; a text without words none.
    Sorted by row, then hash.
    """
    data, offs = raw(texts)
    data = LOWER[data]
    start, end, row = words(data, offs)
    if not len(start):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    w = Sums(data).ranges(start, end)
    n = len(w)
    h = w[: n - k + 1].copy() if n >= k else w[:0].copy()
    for j in range(1, k):
        h = mix(h * _U(0x9E3779B97F4A7C15) + w[j : j + len(h)] + _U(j)) if len(h) else h
    ok = row[: len(h)] == row[k - 1 : k - 1 + len(h)] if len(h) else np.zeros(0, bool)
    h, at = h[ok], row[: len(ok)][ok]
    count = np.bincount(row, minlength=len(offs) - 1)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        begin = np.searchsorted(row, short)
        extra = np.zeros(len(short), _U)
        for j in range(k - 1):
            on = j < count[short]
            extra[on] = mix(extra[on] * _U(0x9E3779B97F4A7C15) + w[begin[on] + j] + _U(101 + j))
        h, at = np.concatenate([h, extra]), np.concatenate([at, short])
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return h[new], at[new]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array with counts[i] of the values in row i."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
