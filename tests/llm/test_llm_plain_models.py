"""Learned operators against plain loops: FTRL updates, scores as dot products, mixtures over all language sets."""

import math
from itertools import combinations

import numpy as np
import pyarrow as pa

from tidemark.llm import language, quality
from tidemark.llm.text import text_buffer


def plain_ftrl(examples, epochs, alpha, beta, l1, l2):
    """One coordinate at a time, in dictionaries."""
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(ni)) / alpha + l2)

    for _ in range(epochs):
        for numbers, values, label in examples:
            used = {int(i): weight(int(i)) for i in numbers}
            p = 1 / (1 + math.exp(-sum(used[int(i)] * v for i, v in zip(numbers, values))))
            for i, v in zip(map(int, numbers), values):
                g = (p - label) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * used[i], n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def examples_of(rng, n):
    out = []
    for _ in range(n):
        numbers = np.unique(np.append(rng.integers(0, 40, size=rng.integers(1, 12)), quality.SIZE)).astype(np.int32)
        out.append((numbers, rng.random(len(numbers)) * 3, float(rng.random() < 0.5)))
    return out


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(3)
    for l1 in (1e-4, 0.4):
        examples = examples_of(rng, 200)
        w, bias = quality.ftrl(examples, epochs=3, alpha=0.5, beta=1.0, l1=l1, l2=1e-2)
        plain = plain_ftrl(examples, 3, 0.5, 1.0, l1, 1e-2)
        assert math.isclose(bias, plain.pop(quality.SIZE), abs_tol=1e-9)
        assert np.allclose([w[i] for i in plain], list(plain.values()), atol=1e-9)
        assert np.count_nonzero(w) == sum(v != 0 for v in plain.values())
        if l1 > 0.1:
            assert any(v == 0 for v in plain.values())


def test_scores_are_dot_products_of_single_texts():
    """A batch's scores equal those of its texts alone, summed feature by feature; empty and NULL texts score nothing."""
    texts = ["One two three. One two, three!", "", "wörter ΑΒΓ 123 a-b", None, "x " * 300, "same same same same"]
    weights = np.random.default_rng(1).normal(size=quality.SIZE).astype(np.float32)
    together = quality.dot(weights, *quality.features(*text_buffer(pa.array(texts, pa.string()))), len(texts))
    for text, got in zip(texts, together):
        numbers, _ = quality.features(*text_buffer(pa.array([text], pa.string())))
        want = sum(sum(float(weights[i]) for i in kind.tolist()) / len(kind) for kind in numbers if len(kind))
        assert math.isclose(got, want, abs_tol=1e-6)
    assert together[1] == together[3] == 0.0


def plain_em(like, allowed, steps):
    share = {j: 1 / len(allowed) for j in allowed}
    for _ in range(steps):
        total = dict.fromkeys(allowed, 0.0)
        for word in like:
            whole = sum(share[j] * word[j] for j in allowed)
            for j in allowed:
                total[j] += share[j] * word[j] / whole
        share = {j: total[j] / len(like) for j in allowed}
    return share, sum(math.log(sum(share[j] * word[j] for j in allowed)) for word in like)


def test_mixture_against_all_language_sets():
    """Up to five languages, every set tried by plain EM: nested sets may miss the best one, but rarely and by little."""
    rng = np.random.default_rng(11)
    missed, cases = 0, 150
    for _ in range(cases):
        k, size = int(rng.integers(2, 6)), int(rng.integers(3, 80))
        truth = rng.choice(k, size=int(rng.integers(1, k + 1)), replace=False)
        ll = rng.normal(-9, 1.0, size=(size, k))
        ll[np.arange(size), rng.choice(truth, size=size)] += rng.uniform(1.5, 5)
        found = language.mixture(ll, np.zeros(size, np.int64), 1)[0]
        like = np.exp(ll - ll.max(axis=1, keepdims=True)).tolist()
        price = math.log(max(size, 2))
        value = {}
        for m in range(1, k + 1):
            for allowed in combinations(range(k), m):
                share, reached = plain_em(like, allowed, 8 if m > 1 else 0)
                value[allowed] = (reached - m * price, share)
        best = max(value, key=lambda s: value[s][0])
        chosen = tuple(np.flatnonzero(found > 0).tolist())
        if chosen != best:
            missed += 1
            assert value[best][0] - value[chosen][0] < price
        else:
            assert np.allclose(found[list(best)], [value[best][1][j] for j in best], atol=1e-9)
        assert math.isclose(found.sum(), 1.0, abs_tol=1e-9)
    assert missed <= 0.1 * cases, missed


def test_mixture_deals_with_rows_apart():
    """Many rows at once give what each gives alone; rows without words have no share."""
    rng = np.random.default_rng(2)
    ll = rng.normal(-9, 2.5, size=(300, 4))
    row = np.sort(rng.integers(0, 12, size=300))
    row[row == 5] = 6
    whole = language.mixture(ll, row, 13)
    assert whole[5].sum() == 0 and whole[12].sum() == 0
    for r in np.unique(row).tolist():
        alone = language.mixture(ll[row == r], np.zeros((row == r).sum(), np.int64), 1)[0]
        assert np.allclose(whole[r], alone)
