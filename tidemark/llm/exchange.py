"""Chunked set exchange: which of a chunk's many hashes matter elsewhere, at about four bytes a hash.

Documents are dealt to chunks of bounded bytes. Every chunk sends its distinct hashes, cut by their leading
bits into buckets, as one packed row a bucket; a bucket sees one entry for each chunk that holds a hash,
however often the chunk repeats it, so a value with a third of all occurrences brings at most one entry a
chunk. The bucket's answer goes back to the chunks. The number of buckets and chunks follows the bytes read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import U, release, text_batches, text_buffer

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 48 << 20


class Sizes(NamedTuple):
    chunks: int
    bits: int


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def plan(docs: DataFrame, text: str = "text") -> Sizes:
    """Chunks of about CHUNK_BYTES of text, and at least as many buckets as there are shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = partitions(docs)
    buckets = max(least, total // BUCKET_BYTES, 2)
    return Sizes(max(least, -(-total // CHUNK_BYTES)), int(buckets - 1).bit_length())


NO_ID = np.iinfo(np.int64).max
BODY = "chunk int, raw bigint, body binary"


def chunked(docs: DataFrame, sizes: Sizes, doc_id: str = "doc_id", text: str = "text", chunk: Column | None = None, level: int = 1, limit: int = 1 << 24) -> DataFrame:
    """(chunk, raw, body): compressed bundles of documents; NULL text becomes empty, NULL id becomes NO_ID.

    The deal depends on the id only (or is the given column), so a rerun of any task finds the same chunks. Bundles of one
    task are cut from `limit` bytes of rows at a time and compressed at `level`.
    """
    by = F.pmod(F.xxhash64(doc_id), F.lit(sizes.chunks)) if chunk is None else chunk
    rows = docs.select(by.cast("int").alias("chunk"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def bundle(stream):
        codec = pa.Codec("zstd", compression_level=level)
        for batches in gathered(stream, limit):
            table = pa.Table.from_batches(batches)
            chunk = np.asarray(table.column("chunk"))
            order = np.argsort(chunk, kind="stable")
            table = table.take(pa.array(order))
            ids = np.asarray(table.column("doc_id").combine_chunks().fill_null(NO_ID), dtype=np.int64)
            data, offsets = text_buffer(table.column("text"))
            chunk = chunk[order]
            first = first_of_runs(chunk)
            body, raw = [], []
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(chunk)]):
                part = np.array([j - i], np.int64).tobytes() + ids[i:j].tobytes() + np.diff(offsets[i:j + 1]).tobytes() + data[offsets[i]:offsets[j]].tobytes()
                raw.append(len(part))
                body.append(codec.compress(part, asbytes=True))
            yield pa.record_batch([pa.array(chunk[first], pa.int32()), pa.array(raw, pa.int64()), pa.array(body, pa.binary())], names=["chunk", "raw", "body"])

    return text_batches(rows).mapInArrow(bundle, BODY)


def gathered(stream, limit: int = 1 << 24):
    """Lists of batches of about `limit` bytes: more documents of a chunk in a bundle compress better."""
    kept, size = [], 0
    for batch in stream:
        kept.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield kept
            kept, size = [], 0
            release()
    if kept:
        yield kept


def opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, text bytes and row offsets of a chunk."""
    release()
    codec = pa.Codec("zstd")
    ids, lengths, data = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for raw, body in zip(table.column("raw").to_pylist(), table.column("body").to_pylist()):
        part = np.frombuffer(codec.decompress(body, raw), dtype=np.uint8)
        n = int(part[:8].view(np.int64)[0])
        ids.append(part[8:8 + 8 * n].view(np.int64))
        lengths.append(part[8 + 8 * n:8 + 16 * n].view(np.int64))
        data.append(part[8 + 16 * n:])
    return np.concatenate(ids), np.concatenate(data), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and bounds of sorted 64-bit keys by their leading bits."""
    bucket = (keys >> U(64 - bits)).astype(np.int64)
    found, first = np.unique(bucket, return_index=True)
    return found, np.append(first, len(keys))


def packed(chunk: int, by: np.ndarray, bits: int, **payload: np.ndarray) -> pa.Table:
    """One row a bucket: `by` are sorted 64-bit hashes, each payload lies beside them."""
    found, bounds = cut(by, bits)
    spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    columns = {"bucket": pa.array(found.astype(np.int32)), "chunk": pa.array(np.full(len(found), chunk, np.int32))}
    for name, values in payload.items():
        columns[name] = pa.array([values[a:b].tobytes() for a, b in spans], pa.binary())
    return pa.table(columns)


def low32(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits behind the bucket bits: with the bucket, 32 + bits bits of the hash."""
    return (keys >> U(32 - bits)).astype(np.uint32)


def unpack(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and the table row that each came from."""
    parts = [np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.repeat(np.arange(len(parts)), lengths)


def first_of_runs(values: np.ndarray) -> np.ndarray:
    """Positions where a sorted array changes."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def reply(chunks: np.ndarray, rows: np.ndarray, bucket: int, **payload: np.ndarray) -> pa.Table:
    """One row for each chunk that gets an answer; `rows` says from which chunk each value came."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = first_of_runs(rows)
    bounds = np.append(first, len(rows))
    columns = {"chunk": pa.array(chunks[rows[first]].astype(np.int32)), "bucket": pa.array(np.full(len(first), bucket, np.int32))}
    for name, values in payload.items():
        values = values[order]
        columns[name] = pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
    return pa.table(columns)


def answers(table: pa.Table, name: str, kind, **payload) -> tuple[np.ndarray, ...]:
    """A chunk's answers joined over buckets: bucket of each value, values, payloads."""
    values, row = unpack(table, name, kind)
    bucket = np.asarray(table.column("bucket"), dtype=np.int64)[row] if table.num_rows else np.zeros(0, np.int64)
    return bucket, values, *(unpack(table, n, k)[0] for n, k in payload.items())


def batches(table: pa.Table, step: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=step)
