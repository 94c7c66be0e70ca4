"""Array kernels over Arrow text columns: words, word hashes and word windows of whole texts.

A word is a run of bytes other than space and 0x09-0x0D. All functions work on the UTF-8 bytes of a batch
at once; no Python object is made per word. Texts of any length are read in blocks cut at white space.
"""

from __future__ import annotations

import ctypes
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK = 1 << 19
BATCH_ROWS = 1000
U = np.uint64


def text_batches(df: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of this session hold BATCH_ROWS rows instead of Spark's default of 10,000.

    Texts are long, and both the executor and its Python workers hold whole batches. A setting of one's own stays.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


class Words(NamedTuple):
    """Words of a batch in text order: byte span in the batch buffer, row, 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def release() -> None:
    """Give freed memory back to the system: a worker shares its executor's memory with the JVM and lives over tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = np.asarray(x, dtype=U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def constants(n: int, seed: int = 1) -> np.ndarray:
    """n odd 64-bit multipliers that depend on the seed only."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed * 1_000_003)) * U(0x9E3779B97F4A7C15)) | U(1)


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, dtype=U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK):
    """Byte ranges of about `size` that end at a row end or at white space."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + size)
        while to < n:
            row_end = offsets[np.searchsorted(offsets, to)]
            piece = data[to:to + (1 << 16)]
            gap = np.flatnonzero((piece == 32) | ((piece >= 9) & (piece <= 13)))
            if row_end == to:
                break
            if len(gap) and to + gap[0] < row_end:
                to += int(gap[0])
                break
            if row_end <= to + len(piece):
                to = int(row_end)
                break
            to += len(piece)
        yield at, to
        at = to


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """All words of a batch; `lower` folds A-Z before hashing.

    A word's hash is a polynomial of its bytes modulo 2^64, finalised by `mix`; it depends on the bytes of
    the word only.
    """
    letter = constants(256, seed=7)
    if lower:
        letter[65:91] = letter[97:123]
    up = down = np.zeros(0, dtype=U)
    found = []
    cuts = np.zeros(len(data) + 1, dtype=bool)
    cuts[offsets] = True
    for at, to in blocks(data, offsets):
        b = data[at:to]
        n = len(b)
        inside = ~_SPACE[b]
        edge = cuts[at:to].copy()
        edge[0] = True
        before = np.empty(n, dtype=bool)
        before[0] = True
        np.logical_not(inside[:-1], out=before[1:])
        start = np.flatnonzero(inside & (before | edge))
        after = np.empty(n, dtype=bool)
        after[-1] = True
        after[:-1] = ~inside[1:] | edge[1:]
        end = np.flatnonzero(inside & after) + 1
        if not hashed:
            found.append((start + at, end + at, np.zeros(0, dtype=U)))
            continue
        if len(up) < n:
            up, down = powers(max(n, min(BLOCK, len(data))), _BASE), powers(max(n, min(BLOCK, len(data))), _INVERSE)
        total = np.empty(n + 1, dtype=U)
        total[0] = 0
        np.cumsum(letter[b] * up[:n], out=total[1:])
        found.append((start + at, end + at, mix((total[end] - total[start]) * down[start])))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, np.zeros(0, dtype=U))
    start, end, hashes = (np.concatenate([x[i] for x in found]) for i in range(3))
    return Words(start, end, np.searchsorted(offsets, start, side="right") - 1, hashes)


def windows(hashes: np.ndarray, row: np.ndarray, k: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of all windows of k consecutive words of one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    factor = constants(k, seed)
    out = hashes[:n] * factor[0]
    for j in range(1, k):
        out += hashes[j:j + n] * factor[j]
    at = np.flatnonzero(row[:n] == row[k - 1:])
    return at, mix(out[at])


def row_starts(row: np.ndarray, n: int) -> np.ndarray:
    """First position of each row in a sorted row array, with the total at the end."""
    return np.searchsorted(row, np.arange(n + 1))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are sorted and do not overlap."""
    letter = constants(256, seed=7)
    out, i = np.zeros(len(begin), dtype=U), 0
    up = down = np.zeros(0, dtype=U)
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + BLOCK, side="right")))
        at, to = int(begin[i]), int(end[j - 1])
        if len(up) < to - at:
            up, down = powers(max(to - at, BLOCK), _BASE), powers(max(to - at, BLOCK), _INVERSE)
        total = np.empty(to - at + 1, dtype=U)
        total[0] = 0
        np.cumsum(letter[data[at:to]] * up[:to - at], out=total[1:])
        out[i:j] = mix((total[end[i:j] - at] - total[begin[i:j] - at]) * down[begin[i:j] - at])
        i = j
    return out


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 24):
    """The batch in row ranges of at most `limit` bytes of text (one row at least), so that arrays stay small."""
    release()
    offsets = text_buffer(batch.column(text))[1]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def first_seen(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each (row, hash) is the first of its kind in the given order."""
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    out = np.zeros(len(row), bool)
    if len(row):
        out[order[np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])]] = True
    return out


def prefix_hashes(data: np.ndarray, start: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the first k bytes after each start, for each k of `sizes`; starts are sorted."""
    letter = constants(256, seed=7)
    out = [np.zeros(len(start), dtype=U) for _ in sizes]
    reach, i = max(sizes), 0
    up, down = powers(min(len(data), BLOCK) + reach + 1, _BASE), powers(min(len(data), BLOCK) + reach + 1, _INVERSE)
    while i < len(start):
        at = int(start[i])
        j = int(np.searchsorted(start, at + BLOCK, side="left"))
        part = data[at:int(start[j - 1]) + reach]
        total = np.zeros(len(part) + reach + 1, dtype=U)
        np.cumsum(letter[part] * up[:len(part)], out=total[1:len(part) + 1])
        total[len(part) + 1:] = total[len(part)]
        inner = start[i:j] - at
        for o, k in zip(out, sizes):
            o[i:j] = mix((total[inner + k] - total[inner]) * down[inner] + U(k))
        i = j
    return out


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, over tasks; it may be empty at any time."""
    import sys
    import types

    return sys.modules.setdefault("_tidemark_worker_cache", types.ModuleType("cache")).__dict__.setdefault(name, {})
