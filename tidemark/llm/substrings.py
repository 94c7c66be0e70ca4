"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of seven words (the reference index); every rolling window
of seven words probes it. A repeat of thirteen words holds a whole block of the document that it repeats, so
each such repeat is hit. Hits are extended: all thirteen-word windows around a hit are compared by a wide
fingerprint over the corpus, and the union of the windows that also start in a document with a smaller id is
the maximal exact repeat that goes.

Three passes read the same chunk exchange of documents; hashes travel as packed sets (see `exchange`), so a
passage that a third of all documents share costs one entry a chunk. A window's fingerprint has 64 + b bits
(b: bits of the bucket count, which grows with the corpus).

Defined cases: NULL or empty text has no words and the digest of the empty string; texts of fewer than 13
words lose nothing; repeats inside one document stay; rows that share an id are not smaller than each other;
a row without id loses nothing and takes nothing from others; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.exchange import NO_ID, answers, chunked, first_of_runs, low32, opened, packed, plan, reply, unpack
from tidemark.llm.text import U, row_starts, windows, words

WINDOW = 13


def anchor_length(window: int) -> int:
    """Longest block such that every run of `window` words holds a whole block of a non-overlapping cut."""
    return (window + 1) // 2


def _grams(chunk, window: int, size: int):
    """Words of a chunk, first word of each row, rolling windows of `size` words in rows that can hold a repeat."""
    ids, data, offsets = chunk
    w = words(data, offsets)
    first = row_starts(w.row, len(ids))
    at, h = windows(w.hash, w.row, size, seed=size)
    usable = ((np.diff(first) >= window) & (ids != NO_ID))[w.row[at]]
    return w, first, at[usable], h[usable]


def _fingerprints(w, at: np.ndarray, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 64-bit value of the windows that start at `at`, from two independent hashes."""
    everywhere, wide = windows(w.hash, w.row, window, seed=99)
    _, lead = windows(w.hash, w.row, window, seed=98)
    pick = np.searchsorted(everywhere, at)
    return (lead[pick] >> U(64 - bits)).astype(np.int64), wide[pick]


def _find(sorted_set: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Position of each value in a sorted set, or -1."""
    if not len(sorted_set):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return np.where(sorted_set[at] == values, at, -1)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed, spans): documents without what an earlier document has.

    `spans` are the removed word ranges [start, end), flattened; `kept_text` has single spaces between words.
    """
    sizes = plan(docs, text)
    bits, block = sizes.bits, anchor_length(window)
    shift = U(32 - bits)

    def probe(key, table):
        """Distinct rolling blocks of a chunk; flag 1: one of them is a reference block, 2: in two rows."""
        w, first, at, h = _grams(opened(table), window, block)
        code = h >> shift
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[order]
        run = first_of_runs(code)
        if not len(run):
            return packed(0, code[:0], bits, keys=low32(code[:0], bits), flags=np.zeros(0, np.uint8))
        row = w.row[at]
        anchor = (at - first[row]) % block == 0
        flags = np.logical_or.reduceat(anchor, run).astype(np.uint8)
        flags |= (row[run] != row[np.append(run[1:], len(row)) - 1]).astype(np.uint8) << 1
        keys = code[run] << shift
        return packed(key[0].as_py(), keys, bits, keys=low32(keys, bits), flags=flags)

    def hit(key, table):
        """Blocks that are a reference block somewhere and occur in two documents."""
        chunk = np.asarray(table.column("chunk"))
        keys, row = unpack(table, "keys", np.uint32)
        flags, _ = unpack(table, "flags", np.uint8)
        order = np.argsort(keys, kind="stable")
        keys, row, flags = keys[order], row[order], flags[order]
        run = first_of_runs(keys)
        length = np.diff(np.append(run, len(keys)))
        either = np.bitwise_or.reduceat(flags, run)
        shared = np.repeat(((either & 1) > 0) & ((length > 1) | (either > 1)), length)
        return reply(chunk, row[shared], key[0].as_py(), keys=keys[shared])

    def extend(key, table, hits):
        """Fingerprints of all windows that hold a hit block, with the smallest id that has each."""
        docs_chunk = opened(table)
        w, first, at, h = _grams(docs_chunk, window, block)
        bucket, low = answers(hits, "keys", np.uint32)
        wanted = np.sort((bucket.astype(U) << U(32)) | low.astype(U))
        flag = np.zeros(len(w.hash) + 1, np.int64)
        flag[at[_find(wanted, h >> shift) >= 0]] = 1
        total = np.concatenate([[0], np.cumsum(flag)])
        at, _ = windows(w.hash, w.row, window)
        at = at[(total[at + window - block + 1] > total[at]) & (docs_chunk[0] != NO_ID)[w.row[at]]]
        group, wide = _fingerprints(w, at, window, bits)
        order = np.lexsort((wide, group))
        group, wide, ids = group[order], wide[order], docs_chunk[0][w.row[at]][order]
        run = np.flatnonzero(np.concatenate([[True], (wide[1:] != wide[:-1]) | (group[1:] != group[:-1])])) if len(wide) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(ids, run) if len(run) else ids
        many = np.maximum.reduceat(ids, run) != least if len(run) else np.zeros(0, bool)
        return packed(key[0].as_py(), group[run].astype(U) << U(64 - bits), bits, keys=wide[run], ids=least, many=many.astype(np.uint8))

    def judge(key, table):
        """Windows that go in some document of a chunk; foreign: the smallest id lies in another chunk."""
        chunk = np.asarray(table.column("chunk"))
        keys, row = unpack(table, "keys", U)
        ids, _ = unpack(table, "ids", np.int64)
        many, _ = unpack(table, "many", np.uint8)
        order = np.argsort(keys, kind="stable")
        keys, row, ids, many = keys[order], row[order], ids[order], many[order]
        run = first_of_runs(keys)
        foreign = ids > np.repeat(np.minimum.reduceat(ids, run), np.diff(np.append(run, len(keys))))
        gone = foreign | (many > 0)
        return reply(chunk, row[gone], key[0].as_py(), keys=keys[gone], foreign=foreign[gone].astype(np.uint8))

    def remove(key, table, found):
        doc_ids, data, offsets = docs_chunk = opened(table)
        w, first, at, _ = _grams(docs_chunk, window, window)
        group, wide = _fingerprints(w, at, window, bits)
        bucket, keys, foreign = answers(found, "keys", U, foreign=np.uint8)
        order = np.argsort(keys, kind="stable")
        bucket, keys, foreign = bucket[order], keys[order], foreign[order]
        place = _find(keys, wide)
        match = place >= 0
        match[match] = bucket[place[match]] == group[match]
        at, place = at[match], place[match]
        ids = doc_ids[w.row[at]]
        least = np.full(len(keys), NO_ID)
        np.minimum.at(least, place, ids)
        at = at[(foreign[place] > 0) | (ids > least[place])]
        edge = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        lost = np.concatenate([[0], np.cumsum(gone)])
        n_removed = lost[first[1:]] - lost[first[:-1]]
        kept, spans = [], []
        for i in range(len(doc_ids)):
            parts, span = data[offsets[i]:offsets[i + 1]].tobytes().split(), []
            if n_removed[i]:
                mask = gone[first[i]:first[i + 1]]
                parts = compress(parts, (~mask).tolist())
                span = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()
            kept.append(b" ".join(parts))
            spans.append(span)
        return pa.table({
            "doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64()))})

    answer = "chunk int, bucket int, keys binary"
    rows = chunked(docs, sizes, doc_id, text)
    sets = rows.groupBy("chunk").applyInArrow(probe, "bucket int, chunk int, keys binary, flags binary")
    hits = sets.groupBy("bucket").applyInArrow(hit, answer)
    wide = rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, "bucket int, chunk int, keys binary, ids binary, many binary")
    found = wide.groupBy("bucket").applyInArrow(judge, answer + ", foreign binary")
    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(remove, "doc_id bigint, kept_text string, n_words bigint, n_removed bigint, spans array<bigint>")
