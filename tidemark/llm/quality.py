"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Features are hashed n-grams of whole texts: words and word pairs, the same over word shapes (which classes of
characters a word has), and whether a pair of words has been seen before in the text. A feature's value is its share
of its kind's occurrences, so long and short texts weigh alike, and a score is a sparse dot product: the sum of the
weights met, by kind. FTRL-proximal keeps two numbers a coordinate and gives sparse weights.

The model is fitted on a bounded sample of labelled rows: those with the smallest hashes of their id, about
`most_rows` of them (a parameter). The weights have 2^20 entries, which bounds what is sent to the tasks.

Defined cases: NULL and empty text score the model's bias; labels other than 0 and 1, or NULL, teach nothing; a row
labelled twice teaches twice; without any usable label every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language import fold_of
from tidemark.llm.text import U, constants, first_seen, mix, row_starts, slices, text_batches, text_buffer, words

SIZE = 1 << 20
KINDS = 5
SCORES = "doc_id bigint, held_out boolean, score double, predicted int"


def shapes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of the set of character classes of each word; every ASCII punctuation mark is a class of its own."""
    bit = np.zeros(256, dtype=U)
    bit[33:48], bit[58:65], bit[91:97], bit[123:127] = (U(1) << (U(8) + np.arange(n, dtype=U) + U(s)) for n, s in ((15, 0), (7, 15), (6, 22), (4, 28)))
    bit[48:58], bit[65:91], bit[97:123], bit[128:] = U(1), U(2), U(4), U(4)
    return mix(np.bitwise_or.reduceat(bit[data], start)) if len(start) else np.zeros(0, dtype=U)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each kind: feature numbers and their rows, sorted by row."""
    w = words(data, offsets)
    shape = shapes(data, w.start)
    pair = np.flatnonzero(w.row[1:] == w.row[:-1])
    a, b = constants(2, seed=60)
    both = mix(w.hash[pair] * a + w.hash[pair + 1] * b)
    again = (~first_seen(w.row[pair], both)).astype(U)
    hashes = [w.hash, both, shape, mix(shape[pair] * a + shape[pair + 1] * b), again]
    rows = [w.row, w.row[pair], w.row, w.row[pair], w.row[pair]]
    seed = constants(KINDS, seed=61)
    return [(mix(h ^ s) & U(SIZE - 1)).astype(np.int32) for h, s in zip(hashes, seed)], rows


def dot(weights: np.ndarray, numbers: list[np.ndarray], rows: list[np.ndarray], n: int) -> np.ndarray:
    """Sum over kinds of the mean weight of a row's features of that kind."""
    out = np.zeros(n)
    for number, row in zip(numbers, rows):
        count = np.bincount(row, minlength=n)
        out += np.bincount(row, weights=weights[number], minlength=n) / np.maximum(count, 1)
    return out


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from (feature numbers, values, label) in the given order."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for _ in range(epochs):
        for number, value, label in examples:
            zi, ni = z[number], n[number]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            z[number] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[number] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:SIZE], float(w[SIZE])


SCALE = 10.0


def example(numbers: list[np.ndarray], label: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One row's features as distinct numbers and values; number SIZE is the bias."""
    joined = np.concatenate([*numbers, np.array([SIZE], np.int32)])
    share = np.concatenate([*(np.full(len(x), SCALE / max(len(x), 1)) for x in numbers), [1.0]])
    number, which = np.unique(joined, return_inverse=True)
    return number, np.bincount(which, weights=share), label


def sampled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, folds: int, held_fold: int, most_rows: int) -> DataFrame:
    """(order, text, y): about most_rows labelled rows outside the held-out fold, those with the smallest hashes."""
    known = labels.select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("y")).where("y IN (0, 1)").where(fold_of("k", folds) != held_fold)
    known = known.withColumn("order", F.xxhash64("k", F.lit(5)))
    count = known.count()
    low = -(1 << 63)
    bound = min(low + int((1 << 64) * min(1.0, most_rows / max(count, 1))), (1 << 63) - 1)
    few = known.where(F.col("order") <= bound)
    return docs.select(F.col(doc_id).alias("k"), F.col(text).cast("string").alias("text")).join(few, "k").select("order", "text", "y")


def train(sample: DataFrame, epochs: int = 4) -> tuple[np.ndarray, float]:
    """Weights (divided by SCALE's share) and bias; the sample is bounded, its updates run in the order of hashes."""
    def learn(stream):
        examples, order = [], []
        for whole in stream:
            for batch in slices(whole, "text", 1 << 22):
                data, offsets = text_buffer(batch.column("text"))
                numbers, rows = features(data, offsets)
                bounds = [row_starts(r, batch.num_rows) for r in rows]
                for i, (y, o) in enumerate(zip(batch.column("y").to_pylist(), batch.column("order").to_pylist())):
                    examples.append(example([x[b[i]:b[i + 1]] for x, b in zip(numbers, bounds)], float(y)))
                    order.append(o)
        if examples:
            w, bias = ftrl([examples[i] for i in np.argsort(np.array(order), kind="stable").tolist()], epochs)
            yield pa.record_batch([pa.array([(w * SCALE).astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    found = text_batches(sample).repartition(1).mapInArrow(learn, "w binary, bias double").collect()
    return (np.frombuffer(found[0]["w"], np.float32), found[0]["bias"]) if found else (np.zeros(SIZE, np.float32), 0.0)


def scored(docs: DataFrame, weights: np.ndarray, bias: float, doc_id: str = "doc_id", text: str = "text", folds: int = 3, held_fold: int = 1, threshold: float = 0.5) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (fold_of(doc_id, folds) == held_fold).alias("held_out"), F.col(text).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def score(stream):
        for whole in stream:
            for batch in slices(whole, "text", 1 << 22):
                data, offsets = text_buffer(batch.column("text"))
                p = 1 / (1 + np.exp(-np.clip(dot(model.value, *features(data, offsets), batch.num_rows) + bias, -35, 35)))
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return text_batches(rows).mapInArrow(score, SCORES)


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = 12_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""
    weights, bias = train(sampled(docs, labels, label, doc_id, text, 3, 1, most_rows))
    return scored(docs, weights, bias, doc_id, text)
