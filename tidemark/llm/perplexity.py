"""Quality rules with n-gram perplexity bands.

Spark numbers the words of all documents, by language, under 64-bit codes, counts the pairs of numbers, and from them how
many different words follow and precede each word. A document's words are scored by a modified Kneser-Ney model of those counts: pairs first,
then the number of words that precede a word, then the word's spelling under a Kneser-Ney model of 4-grams of character
classes, so that a word nobody else uses has a probability too. What a document and its copies bring is taken off the counts
before it is scored. Perplexity is over words. A document is rejected where its log-perplexity lies further above the upper
quartile than twice `reach` times the distance from the median, over the distinct texts of its language that pass the base
rules. A low word perplexity says that other texts share passages, which is not junk, so there the band ends at 0; what
is too uniform is found by letters: the spelling model's log-perplexity of all characters must lie within `reach`
interquartile ranges of its quartiles; it counts each text once (more often where rows share both text and id).
A band ends LEAST_WORDS or LEAST_SPELLING beyond its quartiles at least.

The pair counts grow with the corpus; they stay spread over buckets (see `exchange`), and a pair or word that many
documents share costs one entry a chunk. A spelling model has 64 classes, so at most 64^4 entries. Every language with at
least LEAST_TEXTS distinct texts has its own models and band, however many languages there are; only rows without a
language and languages with fewer texts, which have no quartiles, share one. Spelling models of up to `most_bytes` are
sent to the tasks; beyond that they meet the chunks of their language.

Defined cases: NULL and empty text has zeros everywhere, fails the base rules and, like text without a word, has perplexity NULL; equal lines
and windows are compared by 64-bit hashes within a document; a language all of whose documents fail the base rules
has an open band; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import NO_ID, Sizes, chunked, first_of_runs, opened, partitions, unpack
from tidemark.llm.text import U, Words, first_seen, mix, row_starts, slices, span_hashes, text_batches, text_buffer, windows, words
from tidemark.session import materialize

ORDER, CLASS_BITS = 4, 6
REPEAT = 8
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
OTHER, OWN = "", "="
LEAST_TEXTS = 4
STATS = "doc_id bigint, model string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, log_perplexity double, log_spelling double, print bigint"
MODEL = "model string, size int, codes binary, log_p binary, log_back binary"
NOTHING = pa.table({f.split()[0]: pa.array([], {"string": pa.string(), "double": pa.float64()}.get(f.split()[1], pa.int64())) for f in STATS.split(", ")})
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 24 << 20
RANK_BITS = 24
# Kinds of answers; those of a spelling model's levels are negative.
NAMES, PAIRS, WORDS = 0, 1, 2
# Least distance between a quartile and the band's end, a word and a character.
LEAST_WORDS, LEAST_SPELLING = 1.0, 0.1

# Character classes by byte: 0 blank, letters singly, digits, four kinds of punctuation, bytes of other characters.
CLASSES = np.zeros(256, dtype=np.int32)
CLASSES[33:127] = 57
CLASSES[97:123] = np.arange(1, 27)
CLASSES[65:91] = np.arange(27, 53)
CLASSES[48:58] = 53
CLASSES[list(b".,")] = 54
CLASSES[list(b"-'\"():;")] = 55
CLASSES[list(b"!?")] = 56
CLASSES[128:192] = 58 + np.arange(64) % 4
CLASSES[192:256] = 63
CLASSES[0xC3] = 62


def codes(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Packed code of the n-gram that ends at each byte; before a row's start there are blanks."""
    c = CLASSES[data]
    out = c.copy()
    since = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order):
        shifted = np.zeros_like(c)
        shifted[k:] = c[:-k] if k <= len(c) else 0
        shifted[since < k] = 0
        out |= shifted << (CLASS_BITS * k)
    return out


def with_model(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, lang, text) with their model's name: the language if it has LEAST_TEXTS distinct texts, else OTHER."""
    texts = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("text").alias("print")).distinct()
    own = materialize(texts.groupBy("lang").count().where(F.col("count") >= LEAST_TEXTS).select(F.col("lang").alias("own"), F.concat(F.lit(OWN), "lang").alias("name")))
    return rows.join(own, F.col("lang") == F.col("own"), "left").select("doc_id", F.coalesce("name", F.lit(OTHER)).alias("model"), "text")


def distinct_texts(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, model, text) without copies; of equal texts of a model those with the smallest id stay."""
    print_of = (F.xxhash64("text"), F.octet_length("text"))
    groups = rows.select("doc_id", F.col("model").alias("of"), print_of[0].alias("print"), print_of[1].alias("size")).groupBy("of", "print", "size")
    shared = materialize(groups.agg(F.min("doc_id").alias("stays"), F.count("*").alias("n")).where("n > 1"))
    found = rows.join(shared, (F.col("model") == F.col("of")) & (print_of[0] == F.col("print")) & (print_of[1] == F.col("size")), "left")
    return found.where(F.expr("n IS NULL OR doc_id <=> stays")).select("model", "text")


def count_ngrams(rows: DataFrame) -> DataFrame:
    """(model, code, n) over all rows (model, text)."""
    def merged(parts):
        key, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        first = first_of_runs(key[order])
        return key[order][first], np.add.reduceat(n[order], first) if len(first) else n

    def count(stream):
        total: dict[str, list] = {}
        for whole in stream:
            for batch in slices(whole, "text", 1 << 21):
                data, offsets = text_buffer(batch.column("text"))
                code = codes(data, offsets)
                labels, which = np.unique(np.asarray(batch.column("model").to_pylist(), dtype=object).astype(str), return_inverse=True)
                of = np.repeat(which.astype(np.int32), np.diff(offsets)) if len(labels) > 1 else None
                for i, name in enumerate(labels.tolist()):
                    key = np.sort(code if of is None else code[of == i])
                    first = first_of_runs(key)
                    parts = total.setdefault(name, [])
                    parts.append((key[first], np.diff(np.append(first, len(key)))))
                    if len(parts) >= 8:
                        total[name] = [merged(parts)]
        for name, parts in total.items():
            key, n = merged(parts)
            for i in range(0, len(key), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.record_batch([pa.array([name] * len(key[part])), pa.array(key[part], pa.int32()), pa.array(n[part], pa.int64())], names=["model", "code", "n"])

    return text_batches(rows.select("model", "text")).mapInArrow(count, "model string, code int, n bigint").groupBy("model", "code").agg(F.sum("n").alias("n"))


def discounts(n: np.ndarray) -> np.ndarray:
    """Discount of counts 0, 1, 2 and more, from the numbers of counts 1 to 4; 0.5, 1, 1.5 where those are missing."""
    d = [0.0, 0.5, 1.0, 1.5]
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in range(1, 4):
            if n[k - 1]:
                d[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05)
    return np.array(d)


def kneser_ney(code: np.ndarray, n: np.ndarray, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, log-probabilities, log back-off of the contexts), lowest order first; order 0 is one uniform entry.

    Entry k of order m is the probability of the last class of codes[k] after its others, interpolated with lower
    orders; the back-off array belongs to the contexts that order m+1 uses, so it is as long as the codes of order m.
    """
    levels = [(code, n.astype(np.float64))]
    for size in range(order - 1, 0, -1):
        suffix, count = np.unique(levels[-1][0] & ((1 << (CLASS_BITS * size)) - 1), return_counts=True)
        levels.append((suffix, count.astype(np.float64)))
    levels.reverse()
    lower, lower_codes = np.array([1.0 / (1 << CLASS_BITS)]), np.zeros(1, np.int64)
    out, backs = [(lower_codes, lower)], []
    for size, (key, count) in enumerate(levels, 1):
        d = discounts(np.array([(count == k).sum() for k in range(1, 5)], float))[np.minimum(count, 3).astype(int)]
        context = key >> CLASS_BITS if size > 1 else np.zeros(len(key), key.dtype)
        names, first = np.unique(context, return_index=True)
        total = np.add.reduceat(count, first)
        rest = np.add.reduceat(d, first) / total
        which = np.searchsorted(names, context)
        below = key & ((1 << (CLASS_BITS * (size - 1))) - 1)
        p = (count - d) / total[which] + rest[which] * lower[np.searchsorted(lower_codes, below)]
        back = np.zeros(len(lower_codes))
        place = np.minimum(np.searchsorted(lower_codes, names), len(lower_codes) - 1)
        inside = lower_codes[place] == names
        back[place[inside]] = np.log(rest[inside])
        backs.append(back)
        out.append((key, p))
        lower, lower_codes = p, key
    backs.append(np.zeros(len(lower_codes)))
    return [(key.astype(np.int32), np.log(p).astype(np.float32), back.astype(np.float32)) for (key, p), back in zip(out, backs)]


def log_p(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], code: np.ndarray, window: np.ndarray | None = None) -> np.ndarray:
    """Log-probability of each code's last class; a code not in the model backs off through lower orders."""
    key, p, _ = levels[-1]
    if window is not None:
        window[key] = p
        out = window[code]
        window[key] = np.nan
    else:
        place = np.minimum(np.searchsorted(key, code), len(key) - 1)
        out = np.where(key[place] == code, p[place], np.nan)
    gone = np.flatnonzero(np.isnan(out))
    if len(gone):
        order, c = len(levels) - 1, code[gone]
        below_key, _, back = levels[-2]
        context = c >> CLASS_BITS
        place = np.minimum(np.searchsorted(below_key, context), len(below_key) - 1)
        weight = np.where(below_key[place] == context, back[place], 0.0)
        out[gone] = weight + log_p(levels[:-1], c & ((1 << (CLASS_BITS * (order - 1))) - 1))
    return out


def fit(counts: DataFrame) -> DataFrame:
    """The model's table; one language's counts are at most 64^4 rows."""
    def learn(key, table):
        code, n = np.asarray(table.column("code")), np.asarray(table.column("n"))
        order = np.argsort(code)
        levels = kneser_ney(code[order], n[order])
        return pa.table({"model": pa.array([key[0].as_py()] * len(levels)), "size": pa.array(np.arange(len(levels)), pa.int32()),
                         **{name: pa.array([x[i].tobytes() for x in levels], pa.binary()) for i, name in enumerate(("codes", "log_p", "log_back"))}})

    return counts.groupBy("model").applyInArrow(learn, MODEL)


def loaded(rows: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["model"], r["size"])):
        out.setdefault(r["model"], []).append((np.frombuffer(r["codes"], np.int32), np.frombuffer(r["log_p"], np.float32), np.frombuffer(r["log_back"], np.float32)))
    return out


def base_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    w = words(data, offsets)
    first = row_starts(w.row, n)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = IS_SYMBOL[data]
    sums = lambda mark: np.diff(np.concatenate([[0], np.cumsum(mark)])[offsets])
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(breaks + 1, offsets[:-1])
    start = start[start < len(data)]
    row = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(data)), offsets[row + 1]) if len(start) else start
    end = end - ((end > start) & (data[end - 1] == 10)) if len(start) else end
    visible = np.concatenate([[0], np.cumsum(~blank)])
    some = visible[end] > visible[start]
    start, end, row = start[some], end[some], row[some]
    again = ~first_seen(row, span_hashes(data, start, end))
    at, h = windows(w.hash, w.row, REPEAT, seed=70)
    order = np.argsort(h)
    order = order[np.argsort(w.row[at][order].astype(np.min_scalar_type(n)), kind="stable")]
    r, h = w.row[at][order], h[order]
    same = (r[1:] == r[:-1]) & (h[1:] == h[:-1]) if len(h) else np.zeros(0, bool)
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, at[order[twice]], 1)
    np.add.at(edge, at[order[twice]] + REPEAT, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    return {"n_words": np.diff(first), "word_chars": sums(~blank & ((data & 0xC0) != 0x80)), "n_symbols": sums(symbol),
            "n_dup_lines": np.bincount(row[again], minlength=n), "n_repeat_words": inside[first[1:]] - inside[first[:-1]]}


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One position of each distinct key in key order, the number of each position's key, and the uses of each key."""
    digits = len(key).bit_length()
    if len(key) and key.dtype == np.int64 and int(key.max()) < 1 << 63 - digits:
        key = key << digits
        key |= np.arange(len(key))
        key.sort()
        order = key & (1 << digits) - 1
        key >>= digits
    else:
        order = np.argsort(key)
        key = key[order]
    first = first_of_runs(key)
    which = np.empty(len(key), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    return order[first], which, np.diff(np.append(first, len(key)))


def terms(data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the sorted 64-bit codes of the distinct ones and of a text's start, and by position the numbers of the word before and of the word; codes depend on the model's seed."""
    w = words(data, offsets)
    code = np.append(mix(w.hash ^ U(seed)), mix(np.array([seed], U)))
    at, which, _ = _distinct(code)
    own = which[:-1]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[first_of_runs(w.row)] = which[-1]
    return w, code[at], before, own


def text_codes(data: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    return mix(span_hashes(data, offsets[:-1], offsets[1:]) ^ U(seed))


def paired(before: np.ndarray, own: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_distinct of the pairs in the order they are dealt, by bucket, block and ids, and their buckets; a hot word's pairs lie in all buckets."""
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids)] = np.arange(len(ids))
    at, which, n = _distinct(place[before] * len(ids) + place[own])
    bucket = (ids[before[at]] + ids[own[at]]) & ((1 << bits) - 1)
    order = np.argsort(block_of(width(ids)[before[at]], width(ids >> bits)[own[at]]), kind="stable")
    order = order[np.argsort(bucket[order].astype(np.min_scalar_type((1 << bits) - 1)), kind="stable")]
    dealt = np.empty_like(order)
    dealt[order] = np.arange(len(order))
    return at[order], dealt[which], n[order], bucket[order]


def shrunk(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed byte planes: small numbers and small differences leave little but zeros."""
    codec = pa.Codec("zstd", compression_level=1)
    bodies = [codec.compress(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes(), asbytes=True) for c in columns]
    return np.array([(len(c), len(b)) for c, b in zip(columns, bodies)], np.int64).tobytes() + b"".join(bodies)


def regrown(body: bytes, *kinds_of: type) -> list[np.ndarray]:
    codec = pa.Codec("zstd")
    out, at = [], 16 * len(kinds_of)
    for (n, size), kind in zip(np.frombuffer(body, np.int64, 2 * len(kinds_of)).reshape(-1, 2).tolist(), kinds_of):
        width = np.dtype(kind).itemsize
        raw = np.frombuffer(codec.decompress(body[at:at + size], n * width), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view(kind))
        at += size
    return out


def rises(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _bounds(bucket: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Where each bucket's entries lie among those sorted by bucket, also of empty ones, so that every bucket answers every chunk."""
    at = np.searchsorted(bucket, np.arange((1 << bits) + 1)).tolist()
    return list(zip(at[:-1], at[1:]))


def _lead(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U(64 - bits)).astype(np.int64)


def _dealt(source: int, bodies: list[bytes]) -> pa.Table:
    """One row a bucket."""
    return pa.table({"bucket": pa.array(np.arange(len(bodies), dtype=np.int32)), "chunk": pa.array(np.full(len(bodies), source, np.int32)), "body": pa.array(bodies, pa.binary())})


def width(numbers: np.ndarray) -> np.ndarray:
    """The number of binary digits."""
    return np.frexp(numbers.astype(np.float64))[1].astype(np.uint8)


def block_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.uint16) << np.uint16(8) | second


def _least(digits: np.ndarray) -> np.ndarray:
    """The smallest number of so many digits."""
    return np.where(digits > 0, np.int64(1) << np.maximum(digits, 1) - 1, 0)


def _low_bits(values: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """The last `digits` bits of each value, values of few bits first."""
    parts = [np.zeros(0, np.uint8)]
    for k in np.unique(digits[digits > 0]).tolist():
        some = np.unpackbits(values[digits == k].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        parts.append(np.packbits(some[:, :k]))
    return np.concatenate(parts)


def _with_low_bits(values: np.ndarray, digits: np.ndarray, body: np.ndarray) -> np.ndarray:
    out, i = values.astype(np.int64) << digits, 0
    for k in np.unique(digits[digits > 0]).tolist():
        found = np.flatnonzero(digits == k)
        size = -(-len(found) * k // 8)
        some = np.zeros((len(found), 64), np.uint8)
        some[:, :k] = np.unpackbits(body[i:i + size], count=len(found) * k).reshape(-1, k)
        out[found] |= np.packbits(some, axis=1, bitorder="little").view("<i8")[:, 0]
        i += size
    return out


def pair_body(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs sorted by block and both numbers, as rises of their place in the block.

    A block has the pairs whose numbers have the same widths. Numbers go by frequency, so a block's pairs lie about evenly
    in it; a rise there takes little more than the bits of the mean rise, which are sent as they are.
    """
    first, second = first.astype(np.int64), second.astype(np.int64)
    block = block_of(width(first), width(second))
    run = first_of_runs(block)
    length = np.diff(np.append(run, len(block)))
    one, two = (block >> 8).astype(np.int64), (block & 255).astype(np.int64)
    place = first - _least(one) << np.maximum(two, 1) - 1 | second - _least(two)
    rise = rises(place)
    rise[run] = place[run]
    digits = np.maximum(width(np.floor(0.7 * place[run + length - 1] / length)).astype(np.int64) - 1, 0)
    each = np.repeat(digits, length)
    return shrunk(block[run], length.astype(np.uint32), digits.astype(np.uint8), (rise >> each).astype(np.uint32), n.astype(np.uint32), _low_bits(rise, each))


def pair_lists(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    block, length, digits, rise, n, low = regrown(body, np.uint16, np.uint32, np.uint8, np.uint32, np.uint32, np.uint8)
    length = length.astype(np.int64)
    run = np.cumsum(length) - length
    rise = _with_low_bits(rise, np.repeat(digits.astype(np.int64), length), low)
    total = np.cumsum(rise)
    place = total - np.repeat(total[run] - rise[run], length)
    one, two = np.repeat((block >> 8).astype(np.int64), length), np.repeat((block & 255).astype(np.int64), length)
    bits = np.maximum(two, 1) - 1
    return (place >> bits) + _least(one), (place & (np.int64(1) << bits) - 1) + _least(two), n


def by_frequency(weight: np.ndarray) -> np.ndarray:
    """Numbers of words that lie in key order: the heaviest get the smallest; numbers of one width are in key order."""
    order = np.argsort(-weight, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    order = np.argsort(width(rank), kind="stable")
    rank[order] = np.arange(len(order))
    return rank


def ranked(rank: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """The numbers (see by_frequency) as widths in key order and rises in their own order, in which the columns follow."""
    order = np.argsort(rank)
    return [width(rank), rises(rank[order]).astype(np.uint32), *(c[order] for c in columns)]


def unranked(digits: np.ndarray, rise: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(digits, kind="stable")
    out = []
    for c in (np.cumsum(rise, dtype=np.int64), *columns):
        back = np.empty_like(c)
        back[order] = c
        out.append(back)
    return out


def around_body(total: np.ndarray) -> np.ndarray:
    """Uses, followers seen once, twice and more often, preceding words: uses without the least that the followers take, the last less the followers."""
    out = total.copy()
    out[0] -= total[1] + 2 * total[2] + 3 * total[3]
    out[4] -= total[1:4].sum(axis=0)
    out[4] = out[4] << 1 ^ out[4] >> 63
    return out


def around_of(body: np.ndarray) -> np.ndarray:
    out = body.copy()
    out[0] += body[1] + 2 * body[2] + 3 * body[3]
    out[4] = (body[4] >> 1 ^ -(body[4] & 1)) + body[1:4].sum(axis=0)
    return out


def kinds(n: np.ndarray) -> np.ndarray:
    return np.clip(n, 0, 3).astype(np.int64)


def counts_of_counts(n: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """[group, 6]: how many of a group's counts are 1, 2, 3, 4 and more than 0, and their sum."""
    marks = [*(n == k for k in range(1, 5)), n > 0, n]
    return np.stack([np.bincount(group, weights=m, minlength=groups) for m in marks], axis=1).astype(np.int64)


def word_log_p(w: Words, before: np.ndarray, key: np.ndarray, pair: np.ndarray, n_rows: int, uses: np.ndarray, first_uses: np.ndarray, followers: np.ndarray,
               preceded: np.ndarray, of_pairs: np.ndarray, of_words: np.ndarray, base: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Log-probability of each word after the word before it, by the counts of all other texts.

    Words (`before`, `key`) and pairs are the chunk's numbers of them. By position: corpus counts of the pair (`uses`), of the word before as a first word (`first_uses`), of its
    followers seen once, twice and more often, and of the words that precede the word (`preceded`); beside them the
    counts of counts of pairs and of preceding words. What the document and its copies (`copies` by row) bring is taken off each.
    """
    d2, d1 = discounts(of_pairs[:4]), discounts(of_words[:4])
    by_row = lambda number: _distinct(w.row.astype(np.int64) * (int(number.max(initial=0)) + 1) + number)
    at, which, own = by_row(pair)
    v_at, v_which, v_own = by_row(before)
    w_at, w_which, _ = by_row(key)
    rest = uses[at] - own * copies[w.row[at]]
    left = np.maximum(first_uses[v_at] - v_own * copies[w.row[v_at]], 0).astype(np.float64)
    types = followers[v_at].astype(np.float64)
    for k in (1, 2, 3):
        types[:, k - 1] += np.bincount(v_which[at], weights=(kinds(rest) == k) * 1.0 - (kinds(uses[at]) == k), minlength=len(v_at))
    back = np.where(left > 0, types @ d2[1:] / np.maximum(left, 1), 1.0)
    high = np.maximum(rest - d2[kinds(rest)], 0) / np.maximum(left[v_which[at]], 1)
    gone = (rest <= 0) * 1.0
    precede = preceded[w_at] - np.bincount(w_which[at], weights=gone, minlength=len(w_at))
    total = of_words[5] - np.bincount(w.row[at], weights=gone, minlength=n_rows)
    known = np.tile([of_words[0], of_words[1], of_words[4] - of_words[0] - of_words[1]], (n_rows, 1)).astype(np.float64)
    for k in (1, 2, 3):
        known[:, k - 1] += np.bincount(w.row[w_at], weights=(kinds(precede) == k) * 1.0 - (kinds(preceded[w_at]) == k), minlength=n_rows)
    unknown = np.where(total > 0, known @ d1[1:] / np.maximum(total, 1), 1.0)
    low = np.maximum(precede - d1[kinds(precede)], 0) / np.maximum(total[w.row[w_at]], 1)
    log = lambda p: np.log(np.maximum(p, 1e-300))
    lower = np.logaddexp(log(low)[w_which], log(unknown)[w.row] + base)
    return np.logaddexp(log(high)[which], log(back)[v_which] + lower)


def spelling(data: np.ndarray, offsets: np.ndarray, levels: list, window: np.ndarray) -> np.ndarray:
    """Sums of the log-probabilities of the first 0, 1, 2, ... bytes under the character model."""
    total = np.zeros(len(data) + 1)
    for i in range(0, len(data), 1 << 20):
        j, since = min(len(data), i + (1 << 20)), max(0, i - ORDER)
        code = codes(data[since:j], np.unique(np.clip(offsets, since, j)) - since)[i - since:]
        total[i + 1:j + 1] = total[i] + np.cumsum(log_p(levels, code, window), dtype=np.float64)
    return total


def scored(rows: DataFrame, model: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """Statistics of all rows (doc_id, model, text) under the written character model and the counts of word pairs.

    Documents lie in chunks of one model each. A chunk sends the codes of its distinct words and texts to the codes' buckets,
    which number the words, those of many chunks first, and count equal texts. Then it sends each distinct pair of
    numbers with its count, which takes two or three bytes; the pair's bucket answers with the count of all other chunks, and
    sums what its pairs bring to their words for the words' buckets, which answer last. Buckets add the model's counts of
    counts to their answers. A word's number is its rank in its bucket before the bucket's bits; a bucket stands for at most
    twice BUCKET_BYTES of text or thereabouts, so a rank needs fewer than RANK_BITS bits.
    """
    spark = rows.sparkSession
    size = [(r["model"], r["bytes"] or 0) for r in rows.groupBy("model").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy("model").collect()]
    all_bytes = sum(n for _, n in size)
    chunk_bytes = max(1, min(CHUNK_BYTES, all_bytes // partitions(rows)))
    parts = [max(1, -(-n // chunk_bytes)) for _, n in size]
    firsts = np.cumsum([0, *parts])[:-1]
    names = [name for name, _ in size]
    seeds = [int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in names]
    bits = int(max(partitions(rows), all_bytes // BUCKET_BYTES, 2)).bit_length() - 1
    amount = spark.createDataFrame([(n, int(f), int(p)) for n, f, p in zip(names, firsts, parts)], "model string, first int, parts int")
    place = rows.join(F.broadcast(amount), "model")
    docs = chunked(place, Sizes(sum(parts), bits), chunk=F.col("first") + F.pmod(F.xxhash64("doc_id", "text"), F.col("parts")), level=5, limit=1 << 25)

    def number(chunk):
        return np.searchsorted(firsts, chunk, side="right") - 1

    def ask(key, table):
        chunk = key[0].as_py()
        _, data, offsets = opened(table)
        seed = seeds[number(chunk)]
        _, codes_of, before, own = terms(data, offsets, seed)
        uses = width(np.bincount(before, minlength=len(codes_of)) + np.bincount(own, minlength=len(codes_of)))
        texts = text_codes(data, offsets, seed)
        at, _, n = _distinct(texts)
        texts = texts[at]
        spans = zip(_bounds(_lead(codes_of, bits), bits), _bounds(_lead(texts, bits), bits))
        return _dealt(chunk, [shrunk(rises(codes_of[i:j]), rises(texts[k:m]), n[k:m].astype(np.uint32), uses[i:j]) for (i, j), (k, m) in spans])

    def by_model(chunk):
        """The models of rows sorted by chunk, and the rows of each."""
        of = number(chunk)
        first = first_of_runs(of)
        return of[first].tolist(), list(zip(first.tolist(), [*first[1:].tolist(), len(of)]))

    def numbered(table):
        """Of a bucket's words: their ranks in their model and the bounds of each row's, each model's number of words; the copies of each row's texts."""
        table = table.sort_by("chunk")
        chunk = np.asarray(table.column("chunk"))
        asked = [regrown(body, U, U, np.uint32, np.uint8) for body in table.column("body").to_pylist()]
        keys, texts = (np.concatenate([np.cumsum(x[i], dtype=U) for x in asked]) for i in (0, 1))
        ends, t_ends = (np.cumsum([0, *(len(x[i]) for x in asked)]) for i in (0, 1))
        uses = np.ldexp(1.0, np.concatenate([x[3] for x in asked]).astype(np.int32))
        rank, found = np.empty(len(keys), np.int64), np.zeros(len(names), np.int64)
        for model, (i, j) in zip(*by_model(chunk)):
            part = slice(ends[i], ends[j])
            at, which, _ = _distinct(keys[part])
            rank[part] = by_frequency(np.bincount(which, weights=uses[part], minlength=len(at)))[which]
            found[model] = len(at)
        t_at, t_which, _ = _distinct(texts)
        copies = np.bincount(t_which, weights=np.concatenate([x[2] for x in asked]), minlength=len(t_at)).astype(np.int64)[t_which]
        return chunk, rank, ends, found, copies, t_ends

    def told(kind, bucket, chunk, bodies, stats=None):
        same = lambda x: pa.array(np.full(len(chunk), x, np.int32))
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "bucket": same(bucket), "kind": same(kind), "body": pa.array(bodies, pa.binary()),
                         "stats": pa.array([b""] * len(chunk) if stats is None else [stats[m].tobytes() for m in number(chunk).tolist()], pa.binary())})

    def number_words(key, table):
        chunk, rank, ends, *_ = numbered(table)
        return told(NAMES, key[0].as_py(), chunk, [shrunk(*ranked(rank[i:j])) for i, j in zip(ends[:-1], ends[1:])])

    def read(table, kind, opened_body):
        """A chunk's answers over all buckets: the bucket of each value of the first column, the columns, and the counts of counts."""
        part = table.filter(pc.equal(table.column("kind"), kind)).sort_by("bucket")
        found = [opened_body(body) for body in part.column("body").to_pylist()]
        bucket = np.repeat(np.asarray(part.column("bucket"), dtype=np.int64), [len(x[0]) for x in found])
        return bucket, [np.concatenate(x) for x in zip(*found)], unpack(part, "stats", np.int64)[0].reshape(-1, 6).sum(axis=0)

    def send(key, table, found):
        chunk = key[0].as_py()
        _, data, offsets = opened(table)
        _, _, before, own = terms(data, offsets, seeds[number(chunk)])
        bucket, (rank,), _ = read(found, NAMES, lambda body: unranked(*regrown(body, np.uint8, np.uint32)))
        ids = rank << bits | bucket
        at, _, n, to = paired(before, own, ids, bits)
        first, second = ids[before[at]], rank[own[at]]
        return _dealt(chunk, [pair_body(first[i:j], second[i:j], n[i:j]) for i, j in _bounds(to, bits)])

    def tallied(table):
        """A bucket's pairs: each row's chunk and length, counts, the number of each one's pair; the model of each pair, its code and its sum."""
        table = table.sort_by("chunk")
        chunk = np.asarray(table.column("chunk"))
        sent_pairs = [pair_lists(body) for body in table.column("body").to_pylist()]
        first, second, n = (np.concatenate(x) for x in zip(*sent_pairs))
        code = first << RANK_BITS | second
        ends = np.cumsum([0, *(len(x[2]) for x in sent_pairs)])
        which, codes_of, models = np.empty(len(code), np.int64), [], []
        for model, (i, j) in zip(*by_model(chunk)):
            part = slice(ends[i], ends[j])
            at, of, _ = _distinct(code[part])
            which[part] = of + sum(map(len, codes_of))
            codes_of.append(code[part][at])
            models.append(np.full(len(at), model))
        code = np.concatenate(codes_of)
        return chunk, ends, n, which, np.concatenate(models), code, np.bincount(which, weights=n, minlength=len(code)).astype(np.int64)

    def tally(key, table):
        """The count of every pair in all other chunks."""
        chunk, ends, n, which, model, _, sums = tallied(table)
        others = sums[which] - n
        return told(PAIRS, key[0].as_py(), chunk, [shrunk(others[i:j]) for i, j in zip(ends[:-1], ends[1:])], counts_of_counts(sums, model, len(names)))

    def bring(key, table):
        """What a bucket's pairs bring to their words: uses as a first word, followers seen once, twice and more often, preceding words."""
        bucket, last = key[0].as_py(), (1 << bits) - 1
        *_, model, code, sums = tallied(table)
        first, second = code >> RANK_BITS, code & ((1 << RANK_BITS) - 1)
        model_bits = len(names).bit_length()
        word = lambda bucket_of, rank: (bucket_of << model_bits | model) << RANK_BITS | rank
        both = np.concatenate([word(first & last, first >> bits), word((bucket - first) & last, second)])
        some, which, _ = _distinct(both)
        both, v, x = both[some], which[:len(first)], which[len(first):]
        add = lambda i, y: np.bincount(i, weights=y, minlength=len(some)).astype(np.int64)
        seen = [add(v, kinds(sums) == k) for k in (1, 2, 3)]
        columns = [add(v, sums - kinds(sums)), *seen, add(x, None)]
        rank = both & ((1 << model_bits + RANK_BITS) - 1)
        return _dealt(bucket, [shrunk(rises(rank[i:j]), *(c[i:j] for c in columns)) for i, j in _bounds(both >> model_bits + RANK_BITS, bits)])

    def weigh(key, table, brought):
        """The number of every word with its counts, and the copies of every text."""
        chunk, rank, ends, sizes_of, copies, t_ends = numbered(table)
        before = np.cumsum(sizes_of) - sizes_of
        total = np.zeros((5, sizes_of.sum()), np.int64)
        for body in brought.column("body").to_pylist():
            rise, *columns = regrown(body, *[np.int64] * 6)
            word = np.cumsum(rise)
            columns[0] = columns[0] + columns[1] + 2 * columns[2] + 3 * columns[3]
            total[:, before[word >> RANK_BITS] + (word & ((1 << RANK_BITS) - 1))] += np.stack(columns)
        counted = counts_of_counts(total[4], np.repeat(np.arange(len(names)), sizes_of), len(names))
        sent_words = around_body(total)
        bodies = [shrunk(*ranked(rank[i:j], *sent_words[:, before[m] + rank[i:j]]), copies[k:l])
                  for m, i, j, k, l in zip(number(chunk).tolist(), ends[:-1], ends[1:], t_ends[:-1], t_ends[1:])]
        return told(WORDS, key[0].as_py(), chunk, bodies, counted)

    def words_told(body):
        digits, rise, *columns, copies = regrown(body, np.uint8, np.uint32, *[np.int64] * 6)
        return *unranked(digits, rise, *columns), copies

    levels_size = model.agg(F.sum(F.octet_length("codes") + F.octet_length("log_p") + F.octet_length("log_back"))).first()[0] or 0
    sent = spark.sparkContext.broadcast(loaded(model.collect())) if levels_size <= most_bytes else None

    def finish(key, table, found):
        chunk = key[0].as_py()
        name = names[number(chunk)]
        if sent is not None:
            levels = sent.value.get(name)
        else:
            given = found.filter(pc.less(found.column("kind"), 0))
            levels = loaded([{"model": name, "size": -1 - f, **dict(zip(("codes", "log_p", "log_back"), (k[:len(k) // 3], k[len(k) // 3:2 * (len(k) // 3)], k[2 * (len(k) // 3):])))}
                             for f, k in zip(given.column("kind").to_pylist(), given.column("body").to_pylist())]).get(name)
        ids, data, offsets = opened(table)
        seed = seeds[number(chunk)]
        w, _, before, own = terms(data, offsets, seed)
        w = w._replace(hash=w.hash[:0].copy())
        texts = text_codes(data, offsets, seed)
        bucket, (rank, *words_of, copies), of_words = read(found, WORDS, words_told)
        copies = copies[_distinct(texts)[1]]
        words_of = around_of(np.stack(words_of)).T
        _, which, n, _ = paired(before, own, rank << bits | bucket, bits)
        _, (others,), of_pairs = read(found, PAIRS, lambda body: regrown(body, np.int64))
        uses = (others + n)[which]
        del others, n, bucket, rank
        total, spelled, size = np.full(len(ids), np.nan), np.full(len(ids), np.nan), np.diff(offsets)
        if len(data):
            sums = spelling(data, offsets, levels, np.full(1 << (CLASS_BITS * ORDER), np.nan, np.float32))
            spelled[size > 0] = -np.diff(sums[offsets])[size > 0] / size[size > 0]
            base = sums[np.minimum(w.end + 1, offsets[w.row + 1])] - sums[w.start]
            del sums
            p = word_log_p(w, before, own, which, len(ids), uses, words_of[before, 0], words_of[before, 1:4], words_of[own, 4], of_pairs, of_words, base, copies)
            n = np.bincount(w.row, minlength=len(ids))
            total[n > 0] = -np.bincount(w.row, weights=p, minlength=len(ids))[n > 0] / n[n > 0]
        stats, i = [], 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 21), side="right")) - 1)
            stats.append(base_stats(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
            i = j
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "model": pa.array([name] * len(ids), pa.string()),
                         **{k: pa.array(np.concatenate([s[k] for s in stats]), pa.int64()) for k in stats[0]}, "log_perplexity": pa.array(total, mask=np.isnan(total)), "log_spelling": pa.array(spelled, mask=np.isnan(spelled)), "print": pa.array(texts.view(np.int64))})

    reply = "chunk int, bucket int, kind int, body binary, stats binary"
    sets = "bucket int, chunk int, body binary"
    asked = docs.groupBy("chunk").applyInArrow(ask, sets)
    names_of = asked.groupBy("bucket").applyInArrow(number_words, reply)
    sent_pairs = docs.groupBy("chunk").cogroup(names_of.groupBy("chunk")).applyInArrow(send, sets)
    by_pair = sent_pairs.groupBy("bucket")
    around = asked.groupBy("bucket").cogroup(by_pair.applyInArrow(bring, sets).groupBy("bucket")).applyInArrow(weigh, reply)
    right = by_pair.applyInArrow(tally, reply).unionByName(around)
    if sent is None:
        spread = model.join(F.broadcast(amount), "model").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = right.unionByName(spread.select((F.col("first") + F.col("part")).alias("chunk"), F.lit(-1).alias("bucket"), (-1 - F.col("size")).alias("kind"), F.concat("codes", "log_p", "log_back").alias("body"), F.lit(b"").alias("stats")))
    return docs.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(lambda key, a, b: finish(key, a, b) if a.num_rows else NOTHING, STATS)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", reach: float = 4.0, most_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, the base statistics, base_failed, kept, log_perplexity, lower, upper, log_spelling and its band) for every row."""
    renamed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = with_model(renamed)
    model = materialize(fit(count_ngrams(distinct_texts(rows))))
    stats = materialize(scored(rows, model, most_bytes))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    quarter = stats.where(~failed).groupBy("model", "print").agg(F.min("log_perplexity").alias("log_perplexity"), F.min("log_spelling").alias("log_spelling")).groupBy("model").agg(F.percentile_approx("log_perplexity", [0.5, 0.75], 10000).alias("q"), F.percentile_approx("log_spelling", [0.25, 0.75], 10000).alias("s"))
    above = F.greatest(2 * reach * (F.col("q")[1] - F.col("q")[0]), F.lit(LEAST_WORDS))
    width = F.greatest(reach * (F.col("s")[1] - F.col("s")[0]), F.lit(LEAST_SPELLING))
    bands = materialize(quarter.select("model", F.lit(0.0).alias("lower"), (F.col("q")[1] + above).alias("upper"), (F.col("s")[0] - width).alias("spelling_lower"), (F.col("s")[1] + width).alias("spelling_upper")))
    out = stats.join(F.broadcast(bands), "model", "left").withColumn("base_failed", failed)
    within = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True)) & F.coalesce(F.col("log_spelling").between(F.col("spelling_lower"), F.col("spelling_upper")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & within).drop("model", "print")
