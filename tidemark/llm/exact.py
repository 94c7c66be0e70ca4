"""Exact dedup by composable polynomial fingerprints.

A text is cut into chunks of 64 KiB. A chunk's hash is the polynomial of its bytes in a fixed base modulo two
primes below 2^31; the hash of two pieces one after another is `left + right * base^length(left)`, so the hashes of
chunks, whoever computed them, combine to the hash of the whole. Texts of equal length and fingerprint are then
compared chunk by chunk with the text of their group that stays; what differs forms a group of its own and is
compared again, until nothing differs.

Defined cases: NULL text equals empty text; a NULL id counts as smaller than any id; rows with the same id and the
same text are all kept if that id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import U, text_batches, text_buffer
from tidemark.session import materialize

CHUNK = 1 << 16
# The two largest primes below 2^31, and a base for each.
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1597334677)
FINGERPRINTS = "doc_id bigint, probe bigint, n_bytes bigint, fp_a bigint, fp_b bigint, text_sha256 string"


def combine(left: tuple[int, int], right: tuple[int, int], base: int, modulus: int) -> tuple[int, int]:
    """(hash, length) of two pieces one after the other."""
    return (left[0] + right[0] * pow(base, left[1], modulus)) % modulus, left[1] + right[1]


def _powers(n: int, base: int, modulus: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=U)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have:have + take] = out[:take] * U(pow(base, have, modulus)) % U(modulus)
        have += take
    return out


def chunk_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, base: int, modulus: int, chunk: int = CHUNK) -> np.ndarray:
    """Polynomial hash of each span [start, start + length) of at most `chunk` bytes."""
    power = _powers(chunk, base, modulus)
    out, i = np.zeros(len(start), dtype=U), 0
    ends = np.cumsum(length)
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 21), side="right")))
        lengths = length[i:j]
        inner = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(inner, lengths)
        block = data[start[i]:start[j - 1] + lengths[-1]]
        out[i:j] = np.add.reduceat((block.astype(U) + U(1)) * power[place], inner) % U(modulus)
        i = j
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, base: int, modulus: int, chunk: int = CHUNK) -> np.ndarray:
    """Fingerprint of each row, combined from its chunks' hashes."""
    size = np.diff(offsets)
    pieces = -(-size // chunk)
    row = np.repeat(np.arange(len(size)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[:-1][row] + number * chunk
    length = np.minimum(chunk, offsets[1:][row] - start)
    shift = _powers(int(pieces.max()) if len(pieces) else 1, pow(base, chunk, modulus), modulus)
    hashes = chunk_hashes(data, start, length, base, modulus, chunk) * shift[number] % U(modulus)
    out = np.zeros(len(size), dtype=U)
    some = np.flatnonzero(pieces)
    if len(some):
        out[some] = np.add.reduceat(hashes, (np.cumsum(pieces) - pieces)[some]) % U(modulus)
    return out


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", moduli: tuple[int, int] = MODULI) -> DataFrame:
    """(doc_id, probe, n_bytes, fp_a, fp_b, text_sha256); `probe` tells rows of one id apart by their text."""
    def scan(stream):
        for batch in stream:
            data, offsets = text_buffer(batch.column("text"))
            a, b = (fingerprints(data, offsets, base, modulus) for base, modulus in zip(BASES, moduli))
            digest = [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.record_batch([batch.column("doc_id"), batch.column("probe"), pa.array(np.diff(offsets)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(digest)],
                                  names=["doc_id", "probe", "n_bytes", "fp_a", "fp_b", "text_sha256"])

    return text_batches(_rows(docs, doc_id, text)).mapInArrow(scan, FINGERPRINTS)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("probe"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", moduli: tuple[int, int] = MODULI, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, probe, keep_id, group_size, kept, text_sha256), one row per row of `docs`."""
    prints = materialize(fingerprinted(docs, doc_id, text, moduli).withColumn("part", F.lit(0)))
    group = ["n_bytes", "fp_a", "fp_b", "part"]
    texts = None
    while True:
        # written, so that joins with it shuffle both sides and Spark can split a large group's partition
        groups = materialize(prints.groupBy(*group).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
        if texts is None:
            doubtful = prints.join(groups.where("group_size > 1 AND n_bytes > 0"), group).select("doc_id", "probe", *group[:3]).distinct()
            found = _rows(docs, doc_id, text).alias("r").join(doubtful.alias("d"), F.expr("r.doc_id <=> d.doc_id AND r.probe = d.probe"))
            pieces = found.select("r.doc_id", "r.probe", *group[:3], F.encode("text", "UTF-8").alias("body")).select(
                "doc_id", "probe", *group[:3], "body", F.explode(F.sequence(F.lit(0), ((F.col("n_bytes") - 1) / chunk).cast("int"))).alias("number"))
            texts = materialize(pieces.withColumn("body", F.expr(f"substring(body, number * {chunk} + 1, {chunk})")))
            pieces = texts.withColumn("part", F.lit(0))
        else:
            pieces = texts.join(prints.select("doc_id", "probe", "part").distinct().alias("p").withColumnsRenamed({"doc_id": "p_id", "probe": "p_probe"}), F.expr("doc_id <=> p_id AND probe = p_probe")).drop("p_id", "p_probe")
        # the group's text that stays: of rows of one id with several texts, the one with the smallest probe
        kept = pieces.join(groups.where("group_size > 1").withColumnRenamed("group_size", "n"), group).where("doc_id <=> keep_id")
        stays = kept.join(kept.groupBy(*group).agg(F.min("probe").alias("probe")), [*group, "probe"]).select(*group, "number", F.col("body").alias("stays")).dropDuplicates([*group, "number"])
        differ = pieces.join(stays, [*group, "number"]).where("body <> stays").select("doc_id", "probe").distinct()
        differ = materialize(differ.withColumnsRenamed({"doc_id": "d_id", "probe": "d_probe"}))
        if differ.isEmpty():
            break
        prints = materialize(prints.join(differ, F.expr("doc_id <=> d_id AND probe = d_probe"), "left").withColumn("part", F.col("part") + F.col("d_probe").isNotNull().cast("int")).drop("d_id", "d_probe"))
    return prints.join(groups, group).select("doc_id", "probe", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")
