import random

import numpy as np
import pyarrow as pa

from tidemark.llm import text as kernels


def test_words_are_runs_of_visible_bytes():
    rng = random.Random(1)
    texts = ["", None, "  a b\tc\x0bd  ", "é ü\x1fw x", "q" * 5000 + " tail " + "b" * 70000] + ["".join(rng.choice("ab \nC") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    for block in (64, 1 << 21):
        data, offsets = kernels.text_buffer(pa.array(texts))
        old, kernels.blocks.__defaults__ = kernels.blocks.__defaults__, (block,)
        w = kernels.words(data, offsets)
        kernels.blocks.__defaults__ = old
        expected = [(i, x) for i, t in enumerate(texts) for x in (t or "").encode().split()]
        assert [(int(r), bytes(data[s:e])) for s, e, r in zip(w.start, w.end, w.row)] == expected
        seen = {}
        for (_, x), h in zip(expected, w.hash.tolist()):
            assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)


def test_windows_stay_in_their_row():
    data, offsets = kernels.text_buffer(pa.array(["a b c", "a b", "b c d a b c"]))
    w = kernels.words(data, offsets)
    at, h = kernels.windows(w.hash, w.row, 3)
    assert at.tolist() == [0, 5, 6, 7, 8] and h[0] == h[4] and len(set(h.tolist())) == 4


def test_prefix_and_span_hashes_depend_on_bytes_only():
    data = np.frombuffer(b"abcde abcxx abcde", np.uint8)
    start = np.array([0, 6, 12])
    three, five = kernels.prefix_hashes(data, start, (3, 5))
    assert three[0] == three[1] == three[2] and five[0] == five[2] != five[1]
    spans = kernels.span_hashes(data, start, start + 5)
    assert spans[0] == spans[2] != spans[1]


def test_first_seen():
    assert kernels.first_seen(np.array([0, 0, 1, 1, 0]), np.array([5, 5, 5, 6, 6], np.uint64)).tolist() == [True, False, True, True, True]
