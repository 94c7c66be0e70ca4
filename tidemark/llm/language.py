"""Language identification by multilingual mixture inference.

Every language has a distribution over hashed byte trigrams of letters, counted by Spark over all labelled documents
of the learning part. A document's words are draws from a mixture of languages; expectation-maximisation estimates
its proportions from the words' n-gram likelihoods. The language set is the one whose likelihood, less a penalty for
each language, is best among the sets of its most present languages; the prediction is the set's largest language.

Trigrams of one word overlap, so a word's log-likelihood is a third of their sum. Every labelled language is learned
and may be in a set, whatever its size. The model has 2^16 numbers (256 KB) a language; it is collected by the driver
and sent whole, which is what limits the number of languages (`most_languages`, unset, can keep the largest only).

Defined cases: NULL text and text without a letter get `und`, score 0 and an empty set; a NULL id is in the learning
part's complement only if CRC32 of the empty text says so; without any labelled row every prediction is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.text import slices, text_batches, text_buffer

GRAMS = 1 << 16
UNKNOWN = "und"
PREDICTIONS = "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>"

# Bytes as the model sees them: ASCII letters folded, bytes of other characters as they are, all else a space.
FOLD = np.full(256, 32, dtype=np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def fold_of(doc_id: str, folds: int) -> Column:
    """CRC32 of the id's text modulo `folds`."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, first gram of each word, row of each word) over runs of letter bytes."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    b = FOLD[data].astype(np.uint32)
    before = np.concatenate([[32], b[:-1]]).astype(np.uint32) if len(b) else b
    before[edge[:-1]] = 32
    after = np.concatenate([b[1:], [32]]).astype(np.uint32) if len(b) else b
    after[edge[1:]] = 32
    at = np.flatnonzero(b != 32)
    code = (before[at] << 16) | (b[at] << 8) | after[at]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    first = np.flatnonzero(before[at] == 32)
    return code, first, np.searchsorted(offsets, at[first], side="right") - 1


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) and, as gram -1, the number of documents, over rows with a language."""
    def count(stream):
        total: dict[str, np.ndarray] = {}
        for whole in stream:
            for batch in slices(whole, "text", 1 << 22):
                labels, which = np.unique(np.asarray(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                data, offsets = text_buffer(batch.column("text"))
                code, first, row = grams(data, offsets)
                label = np.repeat(which[row], np.diff(np.append(first, len(code)))) if len(first) else np.zeros(0, np.int64)
                n = np.bincount(label * GRAMS + code, minlength=len(labels) * GRAMS).reshape(-1, GRAMS)
                for i, name in enumerate(labels.tolist()):
                    have = total.setdefault(name, np.zeros(GRAMS + 1, np.int64))
                    have[:GRAMS] += n[i]
                    have[GRAMS] += int((which == i).sum())
        for name, have in total.items():
            at = np.flatnonzero(have)
            yield pa.record_batch([pa.array([name] * len(at)), pa.array(np.where(at == GRAMS, -1, at).astype(np.int32)), pa.array(have[at])], names=["lang", "gram", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    return text_batches(rows).mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, most_languages: int | None = None, smooth: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities [gram, language]; the collected table has at most 2^16 rows a language."""
    named = counts.where("gram = -1").orderBy(F.col("n").desc(), "lang")
    named = (named if most_languages is None else named.limit(most_languages)).select("lang")
    table = counts.where("gram >= 0").join(F.broadcast(named), "lang").toArrow()
    languages = sorted(r["lang"] for r in named.collect())
    n = np.zeros((GRAMS, len(languages)), np.float64)
    place = {name: i for i, name in enumerate(languages)}
    if table.num_rows:
        n[np.asarray(table.column("gram")), [place[x] for x in table.column("lang").to_pylist()]] = np.asarray(table.column("n"))
    return languages, np.log((n + smooth) / (n.sum(axis=0) + smooth * GRAMS)).astype(np.float32)


def _by_row(values: np.ndarray, start: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((n, *values.shape[1:]))
    if len(rows):
        out[rows] = np.add.reduceat(values, start, axis=0)
    return out


def _estimated(like: np.ndarray, row: np.ndarray, size: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages and the log-likelihood they reach, by row."""
    n = len(size)
    rows, start = np.unique(row, return_index=True)
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    for _ in range(steps):
        part = like * share[row]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        share = _by_row(part, start, n, rows) / np.maximum(size, 1)[:, None]
    return share, _by_row(np.log(np.maximum((like * share[row]).sum(axis=1), 1e-300)), start, n, rows)


def mixture(word_ll: np.ndarray, row: np.ndarray, n: int, most: int | None = None, steps: int = 8, penalty: float = 1.0) -> np.ndarray:
    """Proportions [row, language] of the best language set of each row; rows without words are zero.

    Sets grow by the next most present language as long as one that still has a share could pay for itself: the
    mixture of all bounds what is left to gain. `most` limits the size of sets, by default nothing does.

    Sets of more than one language are only tried where the mixture of all gains over the best single language at
    least half of what a second language costs: no subset fits better than all.
    """
    k = word_ll.shape[1]
    size = np.bincount(row, minlength=n).astype(np.float64)
    like = np.exp(word_ll - word_ll.max(axis=1, keepdims=True)) if k else word_ll
    share, full = _estimated(like, row, size, np.ones((n, k)), steps)
    present = (share > 0).sum(axis=1)
    order = np.argsort(-share, axis=1, kind="stable")
    price = penalty * np.log(np.maximum(size, 2))
    best = np.zeros((n, k))
    if k:
        np.put_along_axis(best, order[:, :1], 1.0, axis=1)
    _, found = _estimated(like, row, size, best, 0)
    open_rows = np.flatnonzero(full - found > price / 2)
    if len(open_rows):
        value_of = found[open_rows] - price[open_rows]
        active = np.arange(len(open_rows))
        for m in range(2, min(most or k, k) + 1):
            # A set of m languages reaches at most the likelihood of all (with the same slack as above) less m prices.
            at = open_rows[active]
            active = active[(present[at] >= m) & (full[at] - (m - 0.5) * price[at] > value_of[active])]
            if not len(active):
                break
            at = open_rows[active]
            words_of = np.flatnonzero(np.isin(row, at))
            allowed = np.zeros((len(at), k))
            np.put_along_axis(allowed, order[at, :m], 1.0, axis=1)
            share, value = _estimated(like[words_of], np.searchsorted(at, row[words_of]), size[at], allowed, steps)
            value -= m * price[at]
            better = value > value_of[active]
            best[at[better]], value_of[active[better]] = share[better], value[better]
    best[size == 0] = 0
    return best


def predict(docs: DataFrame, languages: list[str], table: np.ndarray, doc_id: str = "doc_id", text: str = "text", folds: int = 5, most: int | None = None, carry: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, proportions) for every row; with `carry` the row itself as struct `row`."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (fold_of(doc_id, folds) == 0).alias("held_out"), F.col(text).cast("string").alias("text"))
    if carry:
        rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), (fold_of(doc_id, folds) == 0).alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(table)

    def score(stream):
        table = model.value
        for whole in stream:
            whole = whole.append_column("text", whole.column("row").field(text).cast(pa.string())) if carry else whole
            for batch in slices(whole, "text", min(1 << 20, (1 << 25) // max(len(languages), 1))):
                data, offsets = text_buffer(batch.column("text"))
                n = batch.num_rows
                code, first, row = grams(data, offsets)
                ll = np.add.reduceat(table[code], first, axis=0).astype(np.float64) / 3 if len(first) else np.zeros((0, len(languages)))
                share = mixture(ll, row, n, most) if languages else np.zeros((n, 0))
                known = share.sum(axis=1) > 0
                ascii_letter = np.concatenate([[0], np.cumsum((FOLD[data] < 128) & (FOLD[data] != 32))])
                doubtful = np.flatnonzero(known & (ascii_letter[offsets[1:]] == ascii_letter[offsets[:-1]]))
                for i in doubtful.tolist():
                    known[i] = any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode(errors="replace"))
                share[~known] = 0
                order = np.argsort(-share, axis=1, kind="stable")
                sets = [[j for j in o if share[i, j] > 0] for i, o in enumerate(order.tolist())]
                yield pa.record_batch([*([batch.column("row")] if carry else []),
                    batch.column("doc_id"), batch.column("held_out"), pa.array([languages[s[0]] if s else UNKNOWN for s in sets]), pa.array([float(share[i, s[0]]) if s else 0.0 for i, s in enumerate(sets)]),
                    pa.array([[languages[j] for j in s] for s in sets], pa.list_(pa.string())), pa.array([[float(share[i, j]) for j in s] for i, s in enumerate(sets)], pa.list_(pa.float64()))],
                    names=[*(["row"] if carry else []), "doc_id", "held_out", "lang_pred", "score", "languages", "proportions"])

    found = StructType.fromDDL(PREDICTIONS)
    return text_batches(rows).mapInArrow(score, StructType([*([rows.schema["row"]] if carry else []), *found.fields]))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, most_languages: int | None = None, carry: bool = False, most: int | None = None) -> DataFrame:
    """Learn from the labelled rows outside fold 0 and predict every row."""
    learning = docs.where(F.col(lang).isNotNull() & (fold_of(doc_id, folds) != 0))
    languages, table = fit(gram_counts(learning, text, lang), most_languages)
    return predict(docs, languages, table, doc_id, text, folds, most, carry)
