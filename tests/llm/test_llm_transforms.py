"""Chat formatting, hard negatives and fill-in-the-middle against plain versions on messy rows."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, negatives
from tidemark.llm.chat import Template, Turn, digests, escaped, formatted, unescaped
from tidemark.llm.infill import CONTINUATION, NEWLINE, UNITS, WaveletMatrix, byte_classes, fill_in_middle, restored
from tidemark.llm.negatives import hard_negatives, opened, products, sort_keys, windows_of

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# chat formatting

HARD = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> \\[INST] [\\\\INST]", "[", "<", " </s", "s>", "[ROLE] x [TEXT] y [/TEXT]", "$0 \\ $1", "[inst]", "\n\n", " ", "", None, "é😀[ANS]", "[/INST", "/INST]"]


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(1)
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(HARD)]
    rows += [(2, i, ("system", *["user", "assistant"] * 200)[i], f"turn {i} {rng.choice(HARD)}") for i in range(301)]
    rows += [(3, 0, "user", "a"), (3, 1, "user", "b"), (3, 2, "assistant", "c"), (4, 5, "tool [TEXT] ", "x [/TEXT]"), (5, None, "user", "first"), (5, 1, None, "n"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 2, "assistant", "x" * 3_000_000 + "</s>")]
    rows += [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (6, 0, "assistant", "early"), (7, 0, "user", "open end"), (8, -40, "user", "q"), (8, 40, "assistant", "r")]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, 1, "x", True) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, segments string, own boolean")


def plain_conversations(rows):
    found = {}
    for k, r in enumerate(rows):
        key = (r["conv_id"], None if r["conv_id"] is not None else k)
        found.setdefault(key, []).append(((r["turn"] is not None, r["turn"]), (r["role"] or "").encode(), (r["text"] or "").encode(), r["role"] or "", r["text"] or ""))
    for (conv, _), turns in found.items():
        turns.sort(key=lambda t: (t[0][0], t[0][1] or 0, t[1], t[2]))
        state, good = "start", True
        for *_, role, _ in turns:
            state = Template().order.get(state, {}).get(role, "error")
        good = state == "assistant"
        said, loss = "".join(f"{r}\n{t}\n" for *_, r, t in turns), "".join(t for *_, r, t in turns if r == "assistant")
        yield conv, len(turns), sha(said), len(loss), sha(loss), good


@pytest.mark.parametrize("part, group", [(32, 1024), (3, 2)])
def test_conversations_are_read_back(talks, part, group, monkeypatch):
    monkeypatch.setattr(chat, "PART", part)
    monkeypatch.setattr(chat, "GROUP", group)
    got = digests(formatted(talks)).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert order([(r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["valid"]) for r in got]) == order(plain_conversations(talks.collect()))


def test_parts_do_not_change_the_output(talks, monkeypatch):
    def whole():
        rows = sorted(formatted(talks).where("conv_id is not null").collect(), key=lambda r: (r["conv_id"], r["part"]))
        out, bad = {}, {}
        for r in rows:
            out[r["conv_id"]] = out.get(r["conv_id"], "") + r["text"]
            bad[r["conv_id"]] = bad.get(r["conv_id"], 0) + r["bad_turns"]
            assert r["text"] == "".join(s["text"] for s in r["segments"])
        return out, bad

    first = whole()
    monkeypatch.setattr(chat, "PART", 2)
    assert whole() == first
    assert first[0][3] == "<s>[INST] a [/INST][INST] b [/INST][ANS] c </s>" and first[1][3] == 2
    assert first[1][2] == 0 and first[1][6] == 1 and first[1][7] == 0
    assert all(text.count("<s>") == 1 for text in first[0].values())


def test_escapes_are_undone_and_hide_controls(spark):
    rng, template = random.Random(2), Template()
    bits = ["[", "]", "<", ">", "\\", "/", "s", "INST", "SYS", "TEXT", " ", "<s>", "[/INST]", "</s>", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [t or "" for t in HARD]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", escaped(F.col("t"), template))
    rows = df.withColumn("u", unescaped(F.col("e"), template)).collect()
    assert all(r["u"] == r["t"] and not any(c in r["e"] for c in template.controls) for r in rows)
    assert len({r["e"] for r in rows}) == len({r["t"] for r in rows})


def test_another_template(spark):
    made = Template(begin="<b>", roles={"q": Turn("<q>", "</q>"), "a": Turn("<a>", "</a>", True)}, other=("<r>", "<t>", "</t>"), order={"start": {"q": "asked"}, "asked": {"a": "start"}}, ends=("start",))
    turns = spark.createDataFrame([(1, 0, "q", "x</q>"), (1, 1, "a", "<b>"), (2, 0, "q", "y"), (3, 0, "z<t>", "w")], "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: r for r in digests(formatted(turns, made), made).collect()}
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False}
    assert got[1]["turns_sha256"] == sha("q\nx</q>\na\n<b>\n") and got[1]["loss_sha256"] == sha("<b>") and got[3]["turns_sha256"] == sha("z<t>\nw\n")


def test_chat_of_nothing(talks):
    assert digests(formatted(talks.where("1 = 0"))).count() == 0


# hard negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, block int, ids string, score double, key binary"


def vectors(spark, rng, n=900, dim=6):
    rows = []
    for i in range(n):
        v = [rng.choice((-0.5, -0.25, 0.0, 0.25, 0.5, rng.uniform(-1, 1))) for _ in range(dim)]
        rows.append([i, v, rng.choice((0, 0, 0, 1, 2))])
    rows += [[100 * k, list(rows[3][1]), 1] for k in range(20, 24)] + [[5000 + i, list(rows[3][1]), i % 2] for i in range(300)]
    rows += [[6000, None, 1], [6100, [0.1, None, 0.2, 0.1, 0.0, 0.1], 1], [6200, [0.1, float("nan"), 0.2, 0.1, 0.0, 0.1], 1], [6300, [float("inf")] * dim, 0], [6400, [0.5] * dim, None], [None, [0.5] * dim, 1], [6500, [], 1], [6600, [0.5], 2], [rows[5][0], list(rows[5][1]), 1], [rows[5][0], list(rows[5][1]), 1], [700, [0.9] * dim, 2]]
    return spark.createDataFrame([(*r, 1, "x", 0.5, None) for r in rows], VECTORS)


def brute_negatives(rows, positives=5, negatives=5, low=80):
    use = []
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is not None and r["label"] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((r["vec_id"], r["label"], [math.floor(256 * x) for x in v]))
    out = []
    anchors = {}
    for i, lab, v in use:
        if i % 100 == 0 and (i not in anchors or (lab, v) < anchors[i]):
            anchors[i] = (lab, v)
    for i, (lab, v) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, k) for j, k, w in use if j != i)
        same, other = [x for x in scored if x[2] == lab][:positives], [x for x in scored if x[2] != lab]
        for p, j, _ in same:
            inside = [x for x in other if low * -p <= 100 * -x[0] <= 100 * -p][:negatives]
            out += [(i, j, k + 1, x[1], -p, -x[0]) for k, x in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 1024, 16), (16, 3, 1)])
def test_negatives_match_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("ROWS", "ANCHORS", "HELD"), sizes):
        monkeypatch.setattr(negatives, name, value)
    df = vectors(spark, random.Random(3))
    got = hard_negatives(df.repartition(7), F.col("label"), F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(df.collect())
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_negatives_of_nothing(spark):
    df = vectors(spark, random.Random(3), 30)
    assert hard_negatives(df.where("1 = 0"), F.col("label"), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives(df, F.lit(1), F.col("vec_id") % 100 == 0).count() == 0


def test_large_products_are_exact():
    a = np.array([[2 ** 40, -3, 7], [2 ** 62, 2 ** 62, 0]])
    assert products(a, a).tolist() == [[2 ** 63 - 1, 2 ** 63 - 1], [2 ** 63 - 1, 2 ** 63 - 1]]
    b = np.array([[2 ** 29 + 1, 2 ** 29 - 1, 1]])
    assert products(b, b).tolist() == [[(2 ** 29 + 1) ** 2 + (2 ** 29 - 1) ** 2 + 1]]
    assert products(a, a[:, :0]).tolist() == [[0, 0], [0, 0]]


def test_keys_sort_as_their_values():
    rng = random.Random(4)
    values = [tuple(rng.choice((0, 1, -1, 2 ** 63 - 1, -2 ** 63, rng.randint(-10 ** 6, 10 ** 6))) for _ in range(3)) for _ in range(300)]
    keys = sort_keys(*(np.array(x, np.int64) for x in zip(*values)))
    assert [opened(k) for k in keys] == values
    assert [opened(k) for k in sorted(keys)] == sorted(values, key=lambda v: (v[0], -v[1], v[2]))


def test_the_iterator_does_not_hold_an_anchor():
    def stream():
        yield sort_keys(*(np.array([x], np.int64) for x in (1, 10 ** 6, 5)))[0], True
        for i in range(100_000):
            yield sort_keys(*(np.array([x], np.int64) for x in (1, 10 ** 6 - i // 3, i)))[0], False

    out = windows_of(stream(), 5, 5, 80)
    assert [next(out)[3] for _ in range(5)] == [0, 1, 2, 3, 4] and list(out) == []


# fill in the middle

def brute_infill(doc_id, text, units="lines"):
    ends = {"lines": "\n", "sentences": "\n.!?", "words": "\n \t\r\v\f"}[units]
    parts = re.findall(f"[^{re.escape(ends)}]*[{re.escape(ends)}]|[^{re.escape(ends)}]+", text)
    h = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(parts)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", sorted(UNITS))
def test_infill_matches_a_plain_version(spark, messy, nothing, units):
    extra = [(900 + i, t) for i, t in enumerate(["\n", "\n\n\n", "a\n", "a\nb", "<P>x\ny", "<", "<P", "P>\n<S\n>M", "é\n😀\n\nü", "a. b! c?\nd", "\r\n" * 50, "x" * 200_000 + "\n", "line\n" * 100_000])]
    docs = messy.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"), allowMissingColumns=True)
    out = fill_in_middle(docs, units=units).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    given = docs.select("doc_id", "text").collect()
    row = lambda *x: tuple(map(str, x))
    assert sorted(row(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out) == sorted(row(r["doc_id"], *brute_infill(r["doc_id"], r["text"] or "", units), r["text"] or "") for r in given)
    assert fill_in_middle(nothing).count() == 0


def test_rates_move_only_what_they_name(messy):
    forms = lambda **x: {r["doc_id"]: r["form"] for r in fill_in_middle(messy, **x).collect()}
    whole, none, some = forms(), forms(rate=0), forms(rate=40)
    assert set(none.values()) == {"plain"} and "psm" not in forms(spm=100).values()
    assert all(f in ("plain", whole[i]) for i, f in some.items()) and len(set(some.values())) == 3


def test_wavelet_matrix_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        codes = rng.integers(0, 8, n).astype(np.uint8)
        matrix, at = WaveletMatrix(codes), np.arange(n + 1)
        for c in range(8):
            assert matrix.rank(c, at).tolist() == [0, *np.cumsum(codes == c).tolist()]
        places = np.flatnonzero(codes == NEWLINE)
        k = np.arange(1, len(places) + 1)
        assert matrix.after((NEWLINE,), k, np.zeros(len(k), np.int64), np.full(len(k), n)).tolist() == (places + 1).tolist()
    text = "aé😀\n\tü"
    kinds = byte_classes()[np.frombuffer(text.encode(), np.uint8)]
    assert (kinds != CONTINUATION).sum() == len(text) and pa.array([text])[0].as_py() == text
