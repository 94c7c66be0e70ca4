"""Exact copies, near copies and repeated passages against brute force on messy rows."""

import hashlib
import re

import pytest

from tidemark.llm.exact import BASES, MODULI, combine, exact_groups, fingerprints
from tidemark.llm.graph import components
from tidemark.llm.jaccard import similar_groups
from tidemark.llm.substrings import anchor_length, remove_repeats


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(rows):
    sets = {}
    for i, r in enumerate(rows):
        w = folded(r["text"])
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = {r["doc_id"] for r in rows if r["doc_id"] is not None}
    up = {d: d for d in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    live = [i for i in sets if sets[i] and rows[i]["doc_id"] is not None]
    for a in live:
        for b in live:
            o = len(sets[a] & sets[b])
            if a < b and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((top(rows[a]["doc_id"]), top(rows[b]["doc_id"])))
                up[y] = x
    return [(r["doc_id"], len(sets[i]), None if r["doc_id"] is None else top(r["doc_id"])) for i, r in enumerate(rows)]


def key(row):
    return tuple((x is not None, x) for x in row)


def test_jaccard_components(messy, nothing):
    got = [tuple(r) for r in similar_groups(messy).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=key) == sorted(brute_components(messy.collect()), key=key)
    assert similar_groups(nothing).count() == 0


def test_chain_of_borderline_links(spark):
    base = [f"w{i}" for i in range(104)]
    chain = [" ".join(base[:i] + [f"x{i}_{j}" for j in range(0)] + base[i:]) for i in range(1)]
    for step in range(1, 9):
        chain.append(" ".join([*[f"new{k}" for k in range(3 * step)], *base[3 * step:]]))
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(chain)]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id bigint, text string")
    got = [tuple(r) for r in similar_groups(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_repeats(rows, k=13):
    first = {}
    for r in rows:
        w = words_of(r["text"])
        for i in range(len(w) - k + 1):
            if r["doc_id"] is not None:
                first[tuple(w[i:i + k])] = min(first.get(tuple(w[i:i + k]), r["doc_id"]), r["doc_id"])
    out = []
    for r in rows:
        w, gone = words_of(r["text"]), set()
        for i in range(len(w) - k + 1):
            if r["doc_id"] is not None and first[tuple(w[i:i + k])] < r["doc_id"]:
                gone |= set(range(i, i + k))
        out.append((r["doc_id"], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_repeats_go_but_their_first_document_keeps_them(messy, nothing):
    got = [tuple(r) for r in remove_repeats(messy).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got, key=key) == sorted(brute_repeats(messy.collect()), key=key)
    spans = remove_repeats(messy).where("n_removed > 0").collect()
    assert spans and all(sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])) == r["n_removed"] for r in spans)
    assert remove_repeats(nothing).count() == 0
    assert [anchor_length(k) for k in (1, 2, 13, 14)] == [1, 1, 7, 7]


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    out = []
    for r in rows:
        g = groups[r["text"] or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((r["doc_id"], keep, len(g), r["doc_id"] == keep, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("moduli", [MODULI, (2, 1)])
def test_exact_groups_even_where_fingerprints_collide(messy, nothing, moduli):
    got = [tuple(r) for r in exact_groups(messy.where("doc_id IS NULL OR doc_id < 70"), moduli=moduli).drop("probe").collect()]
    assert sorted(got, key=key) == sorted(brute_exact(messy.where("doc_id IS NULL OR doc_id < 70").collect()), key=key)
    assert exact_groups(nothing).count() == 0


def test_fingerprints_compose():
    import numpy as np

    data = np.frombuffer(bytes(range(256)) * 700, np.uint8)
    for base, modulus in zip(BASES, MODULI):
        whole = fingerprints(data, np.array([0, len(data)]), base, modulus)[0]
        for cut in (0, 1, 65536, 100_000, len(data)):
            a, b = (int(fingerprints(x, np.array([0, len(x)]), base, modulus)[0]) for x in (data[:cut], data[cut:]))
            assert combine((a, cut), (b, len(data) - cut), base, modulus) == (int(whole), len(data))
