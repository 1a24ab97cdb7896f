"""Helpers that several operators share: bounded text slices and vectorised hashes.

Every Python step of the package works on slices of at most ``SLICE_BYTES`` of
text (one very long text may be larger and is then a slice of its own), so the
memory of a task depends on its longest text and not on the rows of a batch.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

#: Multipliers of the 64-bit finaliser in ``mix`` (fixed values, public domain splitmix64).
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
GOLDEN = 0x9E3779B97F4A7C15


def carried(df, columns: list[str] | None = None) -> Column:
    """The columns of ``df`` (default all) as one struct, so that none clashes with a name used on the way; ``_row.*``
    gives them back."""
    return F.struct(*[df[f"`{c}`"] for c in columns or df.columns]).alias("_row")


def release_memory() -> None:
    """Hand back what Arrow and the allocator keep: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@contextmanager
def small_batches(spark, rows: int):
    """Jobs started inside hand at most ``rows`` rows to a Python task at once; the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into zero-copy slices of about ``limit`` bytes of ``column``."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        total = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """A hash of ``x`` for one of several independent hash functions."""
    return mix(x + np.uint64((GOLDEN * (seed + 1)) & 0xFFFFFFFFFFFFFFFF))


def concat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind one another and the offsets of each (nulls are empty)."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


#: A fixed 64-bit value per byte, for rolling hashes of words.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
#: Odd base of the rolling hash and its inverse modulo 2**64.
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    filled = 1
    while filled < n:
        step = np.uint64(pow(base, filled, 1 << 64))
        more = min(filled, n - filled)
        np.multiply(out[:more], step, out=out[filled:filled + more])
        filled += more
    return out


_POWER_CACHE: dict[str, np.ndarray] = {}


def powers(base_name: str, n: int) -> np.ndarray:
    """The first n powers of BASE or its inverse; the longest asked for is kept."""
    have = _POWER_CACHE.get(base_name)
    if have is None or len(have) < n:
        have = _powers(BASE if base_name == "base" else BASE_INVERSE, max(n, 1 << 16))
        if n <= 4 * SLICE_BYTES:
            _POWER_CACHE[base_name] = have
    return have[:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for many spans at once (by prefix sums of a rolling hash)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers("base", len(codes)), out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * powers("inverse", len(codes) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(GOLDEN))


#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: The leading 0 to 8 bytes of a little-endian 64-bit value.
_LEADING = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each [start, end), eight at a time; other seeds give independent ones."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.uint64, padded.data, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    start = (GOLDEN * (seed + 1)) & 0xFFFFFFFFFFFFFFFF
    h = mix(size.astype(np.uint64) + np.uint64(start))
    live, done = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        left = size[live] - done
        h[live] = mix((h[live] + np.uint64(start)) ^ (eight[starts[live] + done] & _LEADING[np.minimum(left, 8)]))
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of the runs of word bytes, never across documents.

    ``is_word`` maps each byte value to whether it belongs to a word.
    """
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def pack(values: np.ndarray) -> bytes:
    """The bytes of an array, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as their steps, in planes of like bytes: the leading bytes of steps are mostly zero."""
    steps = np.diff(values, prepend=np.uint64(0))
    return pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = unpack(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)
