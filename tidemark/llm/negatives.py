"""Hard negatives by a secondary-sort shuffle.

Anchors are a stated query set against all rows. Rows are packed into blocks of vectors, anchors into blocks of ANCHORS,
and each block of rows meets each block of anchors in one matrix product; the grid is an equi-join on block numbers.
A first pass over the grid keeps, for every anchor and block, the best rows of the anchor's label, and gives the
positives. A second pass keeps, for every anchor, positive and block, the best rows of other labels in the positive's
score window: no row that a window could emit is left out, and all others are never shuffled.

The pairs kept are packed into 24-byte keys (anchor, descending score, id), dealt by anchor and sorted by
`repartitionAndSortWithinPartitions`. A streaming iterator reads each anchor's pairs in that order, opens a window at
each positive, and emits the negatives that fall into it. It holds the open windows (as many as there are
positives) and the first few negatives of the current score, never an anchor's pairs.

Scores are exact: products that fit the 53 bits of a double are made in doubles, larger ones in Python integers.

Defined cases: rows with NULL label, NULL vector, or a NULL or non-finite component take no part; a NULL id neither; rows of
the anchor's own id are the anchor, not other rows; of several rows of an anchor's id the least (label, vector) is
the anchor; other repeated rows count as often as they stand there; shorter vectors end in zeros; scores and components beyond 64
bits count as the largest 64-bit number; an anchor without positives or without negatives gives no rows; an
empty table gives an empty result; only the three columns are read, so other columns and their names do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.exchange import partitions
from tidemark.session import materialize

ROWS, ANCHORS = 4096, 1024
HELD = 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1
PAIRS = "key binary, anchor_id bigint, id bigint, score bigint, positive boolean"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(df: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(id, label, vec) of the rows that take part; components are floor(256 x)."""
    rows = df.select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(~odd).withColumn("vec", F.transform("vec", lambda x: F.floor(x * 256).cast("bigint")))


def packed(rows: pa.RecordBatch | pa.Table) -> tuple[bytes, bytes, bytes, str]:
    """Ids, labels, components and their type; every vector is as long as the longest, with zeros at the end."""
    column = rows.column("vec")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    sizes, flat = np.diff(offsets), np.asarray(column.values)[offsets[0]:offsets[-1]]
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    kind = next(k for k in ("int16", "int32", "int64") if np.iinfo(k).min <= out.min(initial=0) and out.max(initial=0) <= np.iinfo(k).max)
    return np.asarray(rows.column("id")).tobytes(), np.asarray(rows.column("label")).tobytes(), out.astype(kind).tobytes(), kind


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """(ids, labels, vecs, kind): blocks of at most `size` rows."""
    def pack(stream):
        for batch in stream:
            for at in range(0, batch.num_rows, size):
                yield pa.record_batch([pa.array([x]) for x in packed(batch.slice(at, size))], names=["ids", "labels", "vecs", "kind"])

    return rows.mapInArrow(pack, "ids binary, labels binary, vecs binary, kind string")


def anchor_blocks(anchors: DataFrame, n: int) -> DataFrame:
    """(block, a_ids, a_labels, a_vecs, a_kind, a_windows): anchors dealt to n blocks by their id's hash."""
    def pack(table: pa.Table) -> pa.Table:
        ids, labels, vecs, kind = packed(table)
        windows = pa.array([table.column("windows").to_pylist()], pa.list_(pa.list_(pa.int64())))
        return pa.Table.from_arrays([table.column("block").slice(0, 1), pa.array([ids]), pa.array([labels]), pa.array([vecs]), pa.array([kind]), windows], names=["block", "a_ids", "a_labels", "a_vecs", "a_kind", "a_windows"])

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, a_ids binary, a_labels binary, a_vecs binary, a_kind string, a_windows array<array<bigint>>")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if most(a) * most(b) * max(width, 1) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, allowed: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first `most` allowed rows by descending score, then id."""
    at = np.flatnonzero(allowed)
    if len(at) > 4 * most:
        floor = np.partition(score[at], len(at) - most)[len(at) - most]
        at = at[score[at] >= floor]
    return at[np.lexsort((ids[at], ~score[at]))][:most]


def sort_keys(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """24 bytes that sort by anchor, descending score, id."""
    flip = np.uint64(1 << 63)
    words = np.stack([anchor.astype(np.uint64) ^ flip, ~(score.astype(np.uint64) ^ flip), ids.astype(np.uint64) ^ flip], axis=1).astype(">u8")
    raw = words.tobytes()
    return [raw[i:i + 24] for i in range(0, len(raw), 24)]


def opened(key: bytes) -> tuple[int, int, int]:
    a, s, i = (int.from_bytes(key[k:k + 8], "big") for k in (0, 8, 16))
    return a - (1 << 63), (1 << 63) - 1 - s, i - (1 << 63)


class Best:
    """Running best pairs of the anchors of one block: for each anchor and wanted list at most `most` pairs."""

    def __init__(self, anchors: dict, most: int, low: int, windows: bool) -> None:
        self.ids, self.labels = np.frombuffer(anchors["a_ids"], np.int64), np.frombuffer(anchors["a_labels"], np.int64)
        self.vecs = np.frombuffer(anchors["a_vecs"], anchors["a_kind"]).reshape(len(self.ids), -1)
        self.most, self.low, self.windows = most, low, anchors["a_windows"] if windows else None
        self.kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def add(self, rows: dict) -> None:
        ids, labels = np.frombuffer(rows["ids"], np.int64), np.frombuffer(rows["labels"], np.int64)
        score = products(self.vecs, np.frombuffer(rows["vecs"], rows["kind"]).reshape(len(ids), -1))
        for i in range(len(self.ids)):
            same = labels == self.labels[i]
            if self.windows is None:
                self._merge((i, 0), score[i], ids, same & (ids != self.ids[i]))
                continue
            for p in set(self.windows[i]):
                if p >= 0:
                    inside = (score[i] <= p) & (score[i] >= -(-p * self.low // 100))
                    self._merge((i, p), score[i], ids, inside & ~same & (ids != self.ids[i]))

    def _merge(self, slot: tuple[int, int], score: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        at = best(score, ids, allowed, self.most)
        if not len(at):
            return
        score, ids = score[at], ids[at]
        if slot in self.kept:
            score, ids = np.concatenate([self.kept[slot][0], score]), np.concatenate([self.kept[slot][1], ids])
            at = best(score, ids, np.ones(len(ids), bool), self.most)
            score, ids = score[at], ids[at]
        self.kept[slot] = score, ids

    def pairs(self) -> Iterator[pa.RecordBatch]:
        """The pairs kept; those of several windows of an anchor once for each time they stand in the data."""
        anchor, score, ids = [], [], []
        by_anchor: dict[int, dict[tuple[int, int], int]] = {}
        for (i, _), (s, d) in self.kept.items():
            here: dict[tuple[int, int], int] = {}
            for pair in zip(s.tolist(), d.tolist()):
                here[pair] = here.get(pair, 0) + 1
            mine = by_anchor.setdefault(i, {})
            for pair, times in here.items():
                mine[pair] = max(mine.get(pair, 0), times)
        for i, mine in by_anchor.items():
            for (s, d), times in mine.items():
                anchor += [int(self.ids[i])] * times
                score += [s] * times
                ids += [d] * times
        a, s, d = (np.array(x, np.int64) for x in (anchor, score, ids))
        yield pa.record_batch([pa.array(sort_keys(a, s, d), pa.binary()), pa.array(a), pa.array(d), pa.array(s), pa.array(np.full(len(a), self.windows is None))], names=["key", "anchor_id", "id", "score", "positive"])


def grid_pairs(rows: DataFrame, anchors: DataFrame, most: int, low: int, windows: bool) -> DataFrame:
    """The best pairs of each anchor over the blocks that a task sees; the tasks' lists are merged by the sort."""
    grid = rows.join(anchors, "block").select("block", *rows.drop("block").columns, *[c for c in anchors.columns if c != "block"])

    def score(stream):
        held: dict[int, Best] = {}
        for batch in stream:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["block"] not in held:
                    if len(held) >= HELD:
                        yield from held.pop(next(iter(held))).pairs()
                    held[row["block"]] = Best(row, most, low, windows)
                held[row["block"]].add(row)
        for one in held.values():
            yield from one.pairs()

    return grid.mapInArrow(score, PAIRS)


def windows_of(pairs: Iterator[tuple[bytes, bool]], positives: int, negatives: int, low: int) -> Iterator[tuple]:
    """Result rows from sorted (key, whether the labels are equal); memory does not depend on the number of pairs."""
    anchor = score = None
    open_: list[list] = []  # [positive, its score, negatives emitted]
    ties: list[int] = []  # the first negatives of the current score
    found = 0

    def emit(window: list, negative: int, s: int) -> tuple:
        window[2] += 1
        return anchor, window[0], window[2], negative, window[1], s

    for key, same in pairs:
        a, s, i = opened(key)
        if a != anchor:
            anchor, score, open_, ties, found = a, None, [], [], 0
        if s != score:
            score, ties = s, []
            open_ = [w for w in open_ if w[2] < negatives and 100 * s >= low * w[1]]
        if same:
            if found < positives:
                found += 1
                open_.append([i, s, 0])
                if 100 * s >= low * s:  # a negative score lies below its own window
                    for negative in ties:
                        yield emit(open_[-1], negative, s)
        else:
            if len(ties) < negatives:
                ties.append(i)
            for w in open_:
                if w[2] < negatives and low * w[1] <= 100 * s:
                    yield emit(w, i, s)


def hard_negatives(df: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `is_anchor` is a condition on the given columns; `low` is the least negative score in per cent of the positive's.
    """
    rows = usable(df, vec_id, vector, label)
    asked = materialize(usable(df.where(is_anchor), vec_id, vector, label).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec"))
    n = max(1, -(-asked.count() // ANCHORS))
    packs = materialize(blocks_of(rows, ROWS)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    first = materialize(grid_pairs(packs, anchor_blocks(asked.withColumn("windows", F.array().cast("array<bigint>")), n), positives, low, False))
    leading = first.withColumn("place", F.row_number().over(W.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id"))).where(F.col("place") <= positives)
    scores = leading.groupBy("anchor_id").agg(F.collect_list("score").alias("windows"))
    opened_at = asked.join(scores, asked["id"] == scores["anchor_id"]).select("id", "label", "vec", "windows")
    second = grid_pairs(packs, anchor_blocks(opened_at, n), negatives, low, True)
    pairs = first.unionByName(second).select("key", "positive").rdd.map(lambda r: (bytes(r[0]), r[1]))
    dealt = pairs.repartitionAndSortWithinPartitions(partitions(df), partitionFunc=lambda key: zlib.crc32(key[:8]))
    return df.sparkSession.createDataFrame(dealt.mapPartitions(lambda part: windows_of(part, positives, negatives, low)), RESULT)
