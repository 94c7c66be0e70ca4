"""Packing: exact ids, gapless sequences, and a curve without jumps."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.packing import curve_keys, hilbert, packed_sequences, token_ids
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.text import text_buffer


@pytest.mark.parametrize("depth,axes", [(2, 2), (4, 2), (2, 3), (3, 3), (2, 4)])
def test_hilbert_visits_every_cell_by_unit_steps(depth, axes):
    grid = np.stack(np.meshgrid(*[np.arange(1 << depth)] * axes, indexing="ij"), -1).reshape(-1, axes)
    place = hilbert(grid, depth)
    assert sorted(place.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_token_ids_equal_the_tokenizers_own():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    pieces = ["a", " ", "  ", "\n", "é ", " ", "  ", " 　", "<|endoftext|>", " <|endoftext|> ", "'s", "don't ", "12 3", "...", "日本 語", "\t", "x y z ", "🙂 ", "\x1f", "\x85", "ß", " b"]
    texts = [None, ""] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for part in (texts, texts[::-1]):
        ids, bounds = token_ids(*text_buffer(pa.array(part)), tokenizer_path())
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.ids for e in tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)]


def test_like_documents_lie_near_each_other():
    rng = random.Random(4)
    topics = [[f"t{t}w{i}" for i in range(30)] for t in range(2)]
    texts = [" ".join(rng.choice(topics[i % 2]) for _ in range(300)) for i in range(60)]
    keys = curve_keys(*text_buffer(pa.array(texts)))
    order = np.argsort(keys) % 2
    assert (np.diff(order) != 0).sum() <= 12


def test_every_id_lies_in_one_piece_and_only_the_last_sequence_is_short(messy, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = [r["text"] or "" for r in messy.collect()]
    streams = {}
    for e in tokenizer.encode_batch(texts, add_special_tokens=False):
        ids = np.array([*e.ids, 1], "<u4").tobytes()
        streams[ids] = streams.get(ids, 0) + 1
    rows = packed_sequences(messy, tokenizer_path(), capacity=512).collect()
    by_sequence = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    total, flat = [], b""
    for number in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[number], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            flat += r["ids"]
        total.append(at)
    assert sorted(by_sequence) == list(range(len(total))) and set(total[:-1]) <= {512} and total[-1] <= 512
    found, at = {}, 0
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        if r["start"] == 0:
            ids = flat[4 * at:4 * (at + r["doc_tokens"])]
            found[ids] = found.get(ids, 0) + 1
        at += r["length"]
    assert found == streams
    assert packed_sequences(nothing, tokenizer_path()).count() == 0
