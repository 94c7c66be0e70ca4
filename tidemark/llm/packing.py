"""Packing along a space-filling curve.

A document becomes a hashed word-count vector, which a fixed sign matrix projects to few dimensions; the projections
are cut into cells of a grid by the normal distribution's bounds, and the cell's place on the Hilbert curve is the
document's key. Documents are range-sorted by key and their token streams laid end to end, so documents that lie
near each other share sequences; the stream is cut every `capacity` tokens. Only the last sequence can be short.

Tokens are computed once and written with the key. Range bounds come from a light scan of keys, the length of the
stream before each range from one sum a range, so ranges are packed independently and a hot cell of the curve is
spread by a hash of the id. The pieces keep their token ids.

Defined cases: NULL text is empty and has the end token only; a NULL id is packed like any other row; equal keys
are ordered by a hash of the id, then the id; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import first_of_runs, partitions
from tidemark.llm.text import U, mix, slices, span_hashes, text_batches, text_buffer, words, worker_cache
from tidemark.session import materialize

CAPACITY, END = 2048, 1
BUCKETS, DIMENSIONS, DEPTH = 256, 4, 8
TOKENS = "doc_id bigint, curve bigint, n bigint, width int, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def projection(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Fixed matrix of signs."""
    bits = mix(np.arange(buckets * dimensions, dtype=U) + U(77)) & U(1)
    return (2.0 * bits.astype(np.float64) - 1).reshape(buckets, dimensions)


def hilbert(cells: np.ndarray, depth: int) -> np.ndarray:
    """Place on the Hilbert curve of points of a grid with 2^depth cells a side, one row a point.

    Gray-code form: from the highest bit down, each axis that has the bit inverts the lower bits of the first axis,
    each that has not swaps them with it; the bits interleaved are then the Gray code of the place.
    """
    x = [c.astype(np.int64).copy() for c in cells.T]
    for level in range(depth - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(len(x)):
            has = (x[i] >> level & 1).astype(bool)
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(has, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    code = np.zeros(len(cells), np.int64)
    for level in range(depth - 1, -1, -1):
        for axis in x:
            code = code << 1 | (axis >> level & 1)
    width = depth * len(x)
    place, shift = code, 1
    while shift < width:
        place = place ^ (place >> shift)
        shift *= 2
    return place


def curve_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert key of each row's hashed word vector; rows without words lie at the centre's key."""
    n = len(offsets) - 1
    w = words(data, offsets, lower=True)
    bucket = (w.hash % U(BUCKETS)).astype(np.int64)
    sign = 1.0 - 2.0 * (w.hash >> U(63)).astype(np.float64)
    vector = np.bincount(w.row * BUCKETS + bucket, weights=sign, minlength=n * BUCKETS).reshape(n, BUCKETS)
    norm = np.sqrt((vector ** 2).sum(axis=1, keepdims=True))
    point = vector @ projection() / np.where(norm > 0, norm, 1)
    cell = np.floor((np.tanh(0.8 * point) + 1) / 2 * (1 << DEPTH)).clip(0, (1 << DEPTH) - 1).astype(np.int64)
    return hilbert(cell, DEPTH)


def _tokenizer(path: str):
    """The tokenizer and the byte length of each of its tokens."""
    from tokenizers import Tokenizer

    kept = worker_cache("tokenizers")
    if path not in kept:
        tokenizer = Tokenizer.from_file(path)
        special = {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
        lengths = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, i in tokenizer.get_vocab().items():
            lengths[i] = special.get(i, len(token))
        kept[path] = tokenizer, lengths
    return kept[path]


class Pieces(NamedTuple):
    """Token ids of pieces by the pieces' sorted hashes."""

    hash: np.ndarray
    start: np.ndarray
    count: np.ndarray
    ids: np.ndarray


def _piece_ids(data, blank, begin, end, hashes, path: str, most: int = 1 << 19) -> Pieces:
    """Ids of pieces with sorted distinct hashes; up to `most` pieces are remembered for the worker's next batches."""
    kept = worker_cache("pieces")
    known = kept.get(path, Pieces(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)))
    place = np.minimum(np.searchsorted(known.hash, hashes), max(len(known.hash) - 1, 0))
    new = known.hash[place] != hashes if len(known.hash) else np.ones(len(hashes), bool)
    ids, counts = _encode(data, blank, begin[new], end[new], path)
    merged = np.concatenate([known.hash, hashes[new]])
    order = np.argsort(merged, kind="stable")
    start = np.concatenate([known.start, len(known.ids) + np.cumsum(counts) - counts])
    found = Pieces(merged[order], start[order], np.concatenate([known.count, counts])[order], np.concatenate([known.ids, ids]))
    if len(merged) <= most:
        kept[path] = found
    return found


def _blank(data: np.ndarray) -> np.ndarray:
    """Bytes that are, or could belong to, white space or control characters (one more at each end)."""
    out = np.ones(len(data) + 2, bool)
    out[1:-1] = (data <= 32) | (data == 127)
    for lead, size in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(data == lead)
        for k in range(size):
            out[np.minimum(at + 1 + k, len(data))] = True
    return out


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows one after the other, and the bounds of each row.

    A token of a byte-level tokenizer never reaches over a single space between two visible characters, so texts
    are cut there and each distinct piece (by a 64-bit hash) is tokenised once.
    """
    n = len(offsets) - 1
    blank = _blank(data)
    cut = (data == 32) & ~blank[:-2] & ~blank[2:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    cut[inner] = False
    cut[inner - 1] = False
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(data))[:len(begin)]
    hashes = span_hashes(data, begin, end)
    order = np.argsort(hashes, kind="stable")
    run = first_of_runs(hashes[order])
    distinct = hashes[order[run]]
    pieces = _piece_ids(data, blank, begin[order[run]], end[order[run]], distinct, path)
    place = np.searchsorted(pieces.hash, distinct)
    which = np.empty(len(hashes), np.int64)
    which[order] = np.repeat(place, np.diff(np.append(run, len(order))))
    length = pieces.count[which]
    shift = pieces.start[which] - (np.cumsum(length) - length)
    flat = pieces.ids[np.repeat(shift, length) + np.arange(int(length.sum()))]
    per_row = np.bincount(np.searchsorted(offsets, begin, side="right") - 1, weights=length, minlength=n).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(per_row)])


def _encode(data, blank, begin, end, path) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each piece and their number.

    Pieces that start with a space and end visibly are joined to long strings; the bytes of the tokens tell where
    each piece ends. The others are encoded one by one.
    """
    tokenizer, token_bytes = _tokenizer(path)
    size = end - begin
    joined = (data[begin] == 32) & (size > 1) & ~blank[end]
    joined[joined] &= ~blank[begin[joined] + 2]
    alone = np.flatnonzero(~joined)
    single = tokenizer.encode_batch_fast([data[a:b].tobytes().decode() for a, b in zip(begin[alone].tolist(), end[alone].tolist())], add_special_tokens=False)
    fit = np.flatnonzero(joined)
    upto = np.cumsum(size[fit])
    cuts = np.flatnonzero(np.diff(upto >> 16)) + 1
    groups = np.split(fit, cuts) if len(fit) else []
    text = data[np.repeat(begin[fit] - (upto - size[fit]), size[fit]) + np.arange(int(upto[-1]) if len(fit) else 0)].tobytes()
    bounds = [0, *(upto[cuts - 1].tolist()), len(text)]
    codes = tokenizer.encode_batch_fast([text[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])] if groups else [], add_special_tokens=False)
    counts = np.zeros(len(begin), np.int64)
    counts[alone] = [len(code.ids) for code in single]
    parts, order = [np.array(code.ids, np.uint32) for code in single], [alone]
    for g, code in zip(groups, codes):
        ids = np.array(code.ids, np.uint32)
        ends = np.cumsum(token_bytes[ids])
        want = np.cumsum(size[g])
        stop = np.searchsorted(ends, want)
        if len(ends) == 0 or ends[-1] != want[-1] or (ends[stop] != want).any():
            raise ValueError("a token reaches over a cut")
        counts[g] = np.diff(stop + 1, prepend=0)
        parts.append(ids)
        order.append(g)
    flat, order = np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate(order).astype(np.int64)
    start = np.empty(len(begin), np.int64)
    start[order] = np.cumsum(counts[order]) - counts[order]
    return flat[np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(len(flat))], counts


def tokenized(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """(doc_id, curve, n, ids): Hilbert key, number of ids with the end id, compressed ids."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def scan(stream):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        codec = pa.Codec("zstd", compression_level=1)
        for whole in stream:
            for batch in slices(whole, "text", 1 << 23):
                data, offsets = text_buffer(batch.column("text"))
                ids, bounds = token_ids(data, offsets, path)
                ids = ids.astype(np.uint32)
                low = ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids
                packed = [codec.compress(low[a:b].tobytes() + np.array([end], low.dtype).tobytes(), asbytes=True) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.record_batch([batch.column("doc_id"), pa.array(curve_keys(data, offsets)), pa.array(np.diff(bounds) + 1), pa.array(np.full(batch.num_rows, low.itemsize, np.int32)), pa.array(packed, pa.binary())], names=["doc_id", "curve", "n", "width", "ids"])

    return text_batches(rows).mapInArrow(scan, TOKENS)


def packed_sequences(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row a piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])."""
    tokens = materialize(tokenized(docs, path, doc_id, text))
    place = F.shiftleft(F.col("curve"), 30).bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id"), 34)).alias("place")
    light = tokens.select(place, "n")
    count = max(1, partitions(docs))
    bounds = light.agg(F.percentile_approx("place", [(i + 1) / count for i in range(count - 1)] or [0.5], 20 * count)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))

    def ranged(stream):
        for batch in stream:
            yield batch.append_column("range", pa.array(np.searchsorted(bounds, np.asarray(batch.column("place")), side="right").astype(np.int32)))

    sums = {r["range"]: r["n"] for r in light.mapInArrow(ranged, "place bigint, n bigint, range int").groupBy("range").agg(F.sum("n").alias("n")).collect()}
    base = np.cumsum([0] + [sums.get(i, 0) for i in range(len(bounds) + 1)])

    def pack(stream):
        codec, at, current = pa.Codec("zstd"), 0, -1
        for batch in stream:
            out: list[list] = [[] for _ in range(8)]
            for doc, n, width, body, where in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "width", "ids", "range"))):
                if where != current:
                    at, current = int(base[where]), where
                ids = np.frombuffer(codec.decompress(body, n * width), dtype=f"<u{width}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    offset = at % capacity
                    length = min(n - start, capacity - offset)
                    part = ids[4 * start:4 * (start + length)]
                    for column, value in zip(out, (doc, start, length, zlib.crc32(part), n, at // capacity, offset, part if with_ids else None)):
                        column.append(value)
                    start, at = start + length, at + length
            yield pa.record_batch([pa.array(v, pa.int64()) for v in out[:7]] + [pa.array(out[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    dealt = tokens.select("doc_id", place, "n", "width", "ids").mapInArrow(ranged, "doc_id bigint, place bigint, n bigint, width int, ids binary, range int")
    ordered = dealt.repartition(count, "range").sortWithinPartitions("range", "place", "doc_id", "n", "ids")
    pieces = ordered.mapInArrow(pack, PIECES)
    return pieces if with_ids else pieces.drop("ids")
