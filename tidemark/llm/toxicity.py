"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its distinct hashed words (runs of
letters, A-Z folded) and their prefixes; a document's is the noisy-or of one empty sentence and of what each sentence adds to an
empty one: one minus the product of what they leave. A sentence whose words do not speak for toxicity adds nothing, so
a text does not become toxic by its length. Only
documents are labelled; the gradient of the document's log-likelihood flows to each sentence by what it adds, so the
model learns which words make a sentence offend, and the sentences that do can be named afterwards.

The model is fitted on a bounded sample of labelled rows (`most_rows`, a parameter; the smallest hashes of their
ids). The weights have 2^20 entries, which bounds what is sent to the tasks.

Defined cases: a sentence ends at `.`, `!`, `?`, a line break or the text's end; a text without letters scores what
one empty sentence does; labels other than 0 and 1, or NULL, teach nothing; without usable labels every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language import FOLD, fold_of
from tidemark.llm.quality import sampled
from tidemark.llm.text import U, first_seen, prefix_hashes, row_starts, slices, text_batches, text_buffer, words

SIZE = 1 << 20
PREFIXES = (4, 5, 6, 7, 8, 9)
SCORES = "doc_id bigint, held_out boolean, score double, predicted int, sentences array<struct<start:bigint,end:bigint,score:double>>"
_END = np.zeros(256, dtype=bool)
_END[[10, 13, 33, 46, 63]] = True


def sentence_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each sentence's distinct words: (number, sentence), and (row, first byte) of each sentence.

    A word gives itself and its proper prefixes of PREFIXES bytes, so words built on one stem share features.
    """
    letters = FOLD[data]
    w = words(letters, offsets)
    ends = np.concatenate([[0], np.cumsum(_END[data])])
    key = ends[w.start]
    new = np.concatenate([[True], (w.row[1:] != w.row[:-1]) | (key[1:] != key[:-1])]) if len(w.row) else np.zeros(0, bool)
    sentence = np.cumsum(new) - 1
    keep = first_seen(sentence, w.hash)
    start, size, of = w.start[keep], (w.end - w.start)[keep], sentence[keep]
    numbers, sentences = [w.hash[keep]], [of]
    for k, h in zip(PREFIXES, prefix_hashes(letters, start, PREFIXES)):
        longer = size > k
        numbers.append(h[longer])
        sentences.append(of[longer])
    number, of = (np.concatenate(numbers) & U(SIZE - 1)).astype(np.int32), np.concatenate(sentences)
    order = np.argsort(of, kind="stable")
    return number[order], of[order], w.row[new], w.start[new]


def evidence(weights: np.ndarray, number: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """Sum of the weights of each sentence's features."""
    return np.bincount(sentence, weights=weights[number], minlength=n)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def noisy_or(z: np.ndarray, row: np.ndarray, n: int, bias: float) -> np.ndarray:
    """Document probabilities from the evidence of sentences: 1 - (1 - p0) * prod((1 - p) / (1 - p0)) over sentences with
    positive evidence z, where p = logistic(z + bias) and p0 = logistic(bias)."""
    added = np.where(z > 0, np.logaddexp(0, z + bias) - np.logaddexp(0, bias), 0)
    return -np.expm1(-np.logaddexp(0, bias) - np.bincount(row, weights=added, minlength=n))


def learn_bags(bags: list[tuple[np.ndarray, np.ndarray, int, float]], epochs: int = 12, rate: float = 0.5, bias: float = -6.0, decay: float = 1e-5, deviation: float = 4.0) -> tuple[np.ndarray, float]:
    """Weights and bias from (feature numbers, sentences, number of sentences, label), by adaptive gradient steps.

    Only features whose share of toxic bags lies `deviation` standard deviations off the mean share get a weight:
    the others tell single bags, not what offends.
    """
    w, seen = np.zeros(SIZE), np.full(SIZE, 1e-1)
    df, toxic = np.zeros(SIZE), np.zeros(SIZE)
    for number, _, _, label in bags:
        distinct = np.unique(number)
        df[distinct] += 1
        toxic[distinct] += label
    share = sum(label for *_, label in bags) / max(len(bags), 1)
    telling = (toxic - df * share) ** 2 >= deviation ** 2 * df * share * (1 - share)
    telling &= df > 2
    bags = [(number[telling[number]], sentence[telling[number]], n, label) for number, sentence, n, label in bags]
    bias_seen = 1.0
    for _ in range(epochs):
        for number, sentence, n, label in bags:
            z = evidence(w, number, sentence, n)
            active, p, empty = z >= 0, logistic(z + bias), float(logistic(np.array(bias)))
            clean = 1 - float(noisy_or(z, np.zeros(n, np.int64), 1, bias)[0])
            # d(log-likelihood)/d(sentence logit): p * clean / (1 - clean) where toxic, -p where not
            factor = clean / max(1 - clean, 1e-9) if label else -1.0
            g = np.where(active, p * factor, 0.0)
            slope = factor * (empty + (p - empty)[active].sum())
            each = g[sentence]
            step = each - decay * w[number]
            np.add.at(seen, number, each * each)
            np.add.at(w, number, rate * step / np.sqrt(seen[number]))
            bias_seen += slope ** 2
            bias = min(bias + 0.1 * slope / np.sqrt(bias_seen), -3.0)
    return w, bias


def train(sample: DataFrame, epochs: int = 12) -> tuple[np.ndarray, float]:
    """The sample is bounded; its updates run in one task in the order of hashes."""
    def learn(stream):
        bags, order = [], []
        for whole in stream:
            for batch in slices(whole, "text", 1 << 22):
                data, offsets = text_buffer(batch.column("text"))
                number, sentence, row, _ = sentence_words(data, offsets)
                of_row, of_sentence = row_starts(row, batch.num_rows), row_starts(sentence, len(row))
                for i, (y, o) in enumerate(zip(batch.column("y").to_pylist(), batch.column("order").to_pylist())):
                    a, b = of_row[i], of_row[i + 1]
                    if b > a:
                        part = slice(of_sentence[a], of_sentence[b])
                        bags.append((number[part], sentence[part] - a, int(b - a), float(y)))
                        order.append(o)
        if any(bag[3] for bag in bags):
            w, bias = learn_bags([bags[i] for i in np.argsort(np.array(order), kind="stable").tolist()], epochs)
            yield pa.record_batch([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    found = text_batches(sample).repartition(1).mapInArrow(learn, "w binary, bias double").collect()
    return (np.frombuffer(found[0]["w"], np.float32), found[0]["bias"]) if found else (np.zeros(SIZE, np.float32), -35.0)


def scored(docs: DataFrame, weights: np.ndarray, bias: float, doc_id: str = "doc_id", text: str = "text", folds: int = 3, held_fold: int = 1, threshold: float = 0.7, locate: bool = True, offends: float = 0.5) -> DataFrame:
    """Scores of all rows; with `locate`, the byte ranges of the sentences that score at least `offends`."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (fold_of(doc_id, folds) == held_fold).alias("held_out"), F.col(text).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def score(stream):
        for whole in stream:
            for batch in slices(whole, "text", 1 << 22):
                data, offsets = text_buffer(batch.column("text"))
                n = batch.num_rows
                number, sentence, row, start = sentence_words(data, offsets)
                z = evidence(model.value, number, sentence, len(row))
                p, total = logistic(z + bias), noisy_or(z, row, n, bias)
                spans: list[list] = [[] for _ in range(n)]
                if locate and len(row):
                    stops = np.flatnonzero(_END[data])
                    for i in np.flatnonzero(p >= offends).tolist():
                        at = np.searchsorted(stops, start[i])
                        end = min(int(stops[at]) + 1 if at < len(stops) else len(data), int(offsets[row[i] + 1]))
                        spans[row[i]].append({"start": int(start[i] - offsets[row[i]]), "end": int(end - offsets[row[i]]), "score": float(p[i])})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(total), pa.array((total >= threshold).astype(np.int32)), pa.array(spans, kind)], names=["doc_id", "held_out", "score", "predicted", "sentences"])

    return text_batches(rows).mapInArrow(score, SCORES)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 12_000) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences) for every row of `docs`."""
    weights, bias = train(sampled(docs, labels, label, doc_id, text, 3, 1, most_rows))
    return scored(docs, weights, bias, doc_id, text)
