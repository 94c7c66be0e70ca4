"""Fill-in-the-middle transformation over a wavelet matrix of character classes.

The bytes of a batch are mapped to eight classes and kept as a wavelet matrix: three bit vectors with running counts,
in which the number of bytes of any class before any position is three look-ups. Ranks of the classes that end a
unit add up to the number of unit boundaries before a position, and ranks of the class of continuation bytes turn
byte positions into code points. Both cuts of all texts of a batch are found together by bisection on those ranks;
no list of units is made, so a text of one long line and a text of a million lines cost the same.

A unit is a run of characters up to and with one that ends it, or what follows the last of these. The id's SHA-256
draws the two cuts, whether a text is transformed at all, and the order of the parts, so every rerun and every
partitioning gives the same result. `restored` rebuilds the text from output and form with column functions.

Defined cases: NULL text is empty; an empty text, and one that holds a sentinel, stays plain; a NULL id is hashed as
an empty string; rows of one id are cut by the same draw, each over its own units; an empty table gives an empty
result; only the id and the text are read, so other columns and their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import slices, text_batches, text_buffer

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OTHER, CONTINUATION, NEWLINE, SPACE, DIGIT, STOP, PUNCTUATION, LEAD = range(8)
#: The classes whose characters end a unit.
UNITS = {"lines": (NEWLINE,), "sentences": (NEWLINE, STOP), "words": (NEWLINE, SPACE)}
OUTPUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def byte_classes() -> np.ndarray:
    """Class of each byte of UTF-8."""
    out = np.full(256, OTHER, np.uint8)
    for c in range(33, 127):
        if not chr(c).isalnum():
            out[c] = PUNCTUATION
    out[[ord(c) for c in ".!?"]] = STOP
    out[48:58] = DIGIT
    out[[9, 11, 12, 13, 32]] = SPACE
    out[10] = NEWLINE
    out[128:192] = CONTINUATION
    out[192:] = LEAD
    return out


class WaveletMatrix:
    """Rank over a sequence of small codes: `bits` bit vectors, each sorted stably by the bits above it."""

    def __init__(self, codes: np.ndarray, bits: int = 3) -> None:
        self.bits, self.levels, self.first = bits, [], {}
        for shift in range(bits - 1, -1, -1):
            one = (codes >> shift & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.zeros(len(packed) // 8 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((words, before, len(codes) - int(before[-1])))
            codes = np.concatenate([codes[~one], codes[one]])

    def _down(self, code: int, at: np.ndarray) -> np.ndarray:
        for shift, (words, before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & mask)
            at = zeros + ones if code >> shift & 1 else at - ones
        return at

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often the code occurs before each position."""
        if code not in self.first:
            self.first[code] = int(self._down(code, np.zeros(1, np.int64))[0])
        return self._down(code, np.asarray(at, np.int64)) - self.first[code]

    def ranks(self, codes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(c, at) for c in codes)

    def after(self, codes: tuple[int, ...], k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """End of the k-th occurrence from `low` on: the least position with k of them behind it, else `high`."""
        base, low, high = self.ranks(codes, low), low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            reached = self.ranks(codes, middle) - base >= k
            high = np.where(open_ & reached, middle, high)
            low = np.where(open_ & ~reached, middle + 1, low)
        return low


def cuts(matrix: WaveletMatrix, offsets: np.ndarray, ends: tuple[int, ...], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, first cut, second cut) of each text; cuts are byte positions in the batch."""
    low, high = offsets[:-1], offsets[1:]
    n = matrix.ranks(ends, high) - matrix.ranks(ends, low)
    last = np.maximum(high - 1, low)
    n += (high > low) & (matrix.ranks(ends, high) == matrix.ranks(ends, last))
    a, b = h1 % (n + 1), h2 % (n + 1)
    return n, matrix.after(ends, np.minimum(a, b), low, high), matrix.after(ends, np.maximum(a, b), low, high)


def strings(parts: list[bytes]) -> pa.Array:
    """A string column of UTF-8 bytes."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.StringArray.from_buffers(len(parts), pa.py_buffer(offsets), pa.py_buffer(b"".join(parts)))


def draw(doc_id: str, seed: int, number: int) -> Column:
    """The number-th group of eight digits of the id's SHA-256."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("bigint").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 8 * number - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, units: str = "lines", rate: int = 100, spm: int = 50, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row; `rate` and `spm` are per cent of the texts.

    One pass without a shuffle; a task holds one slice of a batch, or one text where that is longer.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    held = F.greatest(*[whole.contains(s) for s in (PREFIX, SUFFIX, MIDDLE)])
    form = F.when((whole == "") | held | (draw(doc_id, seed, 3) % 100 >= rate), "plain").when(draw(doc_id, seed, 4) % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole.alias("text"), form.alias("form"), draw(doc_id, seed, 1).alias("h1"), draw(doc_id, seed, 2).alias("h2"))
    ends, classes = UNITS[units], byte_classes()
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def transform(stream):
        for batch in stream:
            for part in slices(batch, "text", 1 << 23):
                data, offsets = text_buffer(part.column("text"))
                matrix = WaveletMatrix(classes[data])
                n, first, second = cuts(matrix, offsets, ends, np.asarray(part.column("h1")), np.asarray(part.column("h2")))
                chars = lambda a, b: b - a - matrix.rank(CONTINUATION, b) + matrix.rank(CONTINUATION, a)
                prefix, middle = chars(offsets[:-1], first), chars(first, second)
                forms = part.column("form").to_pylist()
                plain, out, raw = np.array([f == "plain" for f in forms], bool), [], data.tobytes()
                for i, f in enumerate(forms):
                    a, b, c, d = int(offsets[i]), int(first[i]), int(second[i]), int(offsets[i + 1])
                    if f == "plain":
                        out.append(raw[a:d])
                    elif f == "psm":
                        out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
                    else:
                        out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), part.column("form"), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), strings(out)],
                                      names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return text_batches(rows).mapInArrow(transform, OUTPUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
