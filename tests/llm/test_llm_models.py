"""Learned operators: known values, planted signals, held-out accuracy on the given tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import perplexity as ppl
from tidemark.llm.language import identify
from tidemark.llm.perplexity import kneser_ney, log_p, quality_rules
from tidemark.llm.quality import quality, sampled
from tidemark.llm.toxicity import logistic, noisy_or, scored, toxicity, train


@pytest.fixture(scope="module")
def tables(spark):
    base = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


def test_language_held_out_and_edge_rows(tables, messy, nothing):
    docs, _ = tables
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    edge = identify(messy).collect()
    assert len(edge) == messy.count() and all(0 <= r["score"] <= 1 for r in edge)
    text = {r["doc_id"]: r["text"] for r in messy.collect()}
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in text[r["doc_id"]] or "")) for r in edge if r["doc_id"] is not None)
    assert identify(nothing).count() == 0
    assert {r["lang_pred"] for r in identify(messy.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixture_finds_both_languages(spark, tables):
    docs, _ = tables
    pool = {k: " ".join(r["text"] for r in docs.where((F.col("lang") == k) & (F.col("doc_id") % 5 == 1)).limit(4).collect()).split()[:300] for k in ("de", "fr")}
    mixed = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**6, " ".join(pool["de"] + pool["fr"]), None)], "doc_id bigint, text string, lang string"))
    row = identify(mixed).where("doc_id = 1000000").first()
    assert set(row["languages"]) == {"de", "fr"} and abs(row["proportions"][0] - 0.5) < 0.15


def test_quality_held_out_and_edge_rows(tables, messy, nothing):
    docs, labels = tables
    rows = quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    odd = labels.limit(3).unionByName(labels.limit(2).withColumn("quality", F.lit(None).cast("int")).select(*labels.columns))
    edge = quality(messy, odd).collect()
    assert len(edge) == messy.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in edge)
    assert quality(nothing, labels).count() == 0 and {r["score"] for r in quality(messy, labels.where("1 = 0")).collect()} == {0.5}


def test_toxicity_finds_the_offending_sentence(spark, messy, nothing):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs, labels = [], []
    for i in range(1200):
        sentences = [" ".join(word() for _ in range(8)) + "." for _ in range(6)]
        toxic = i % 4 == 0
        if toxic:
            k = rng.randrange(6)
            sentences[k] = sentences[k].replace(" ", f" {rng.choice(('vile', 'foul', 'nasty'))} ", 1)
        docs.append((i, " ".join(sentences)))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    rows = toxicity(d, y).join(y, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.97
    text = dict(docs)
    for r in rows:
        if r["toxic"] and r["predicted"]:
            found = [text[r["doc_id"]].encode()[s["start"]:s["end"]].decode() for s in r["sentences"]]
            assert found and all(re.search("vile|foul|nasty", f) for f in found)
    edge = toxicity(messy, y).collect()
    assert len(edge) == messy.count() and all(0 <= r["score"] <= 1 for r in edge) and toxicity(nothing, y).count() == 0
    assert {r["predicted"] for r in toxicity(messy, y.where("1 = 0")).collect()} == {0}


def test_noisy_or():
    p = lambda x: 1 / (1 + math.exp(-x))
    got = noisy_or(np.array([2.0, 1.0, -3.0, 0.0, 4.0]), np.array([0, 0, 0, 1, 3]), 4, -1.0)
    left = (1 - p(1.0)) * (1 - p(0.0)) / (1 - p(-1.0))
    assert np.allclose(got, [1 - left, p(-1.0), p(-1.0), p(3.0)])


def test_gradient_of_the_noisy_or():
    """What learn_bags follows is the slope of the log-likelihood, by finite differences."""
    z, bias = np.array([0.7, 1.9, -0.4, 0.2]), -2.0
    one = lambda z, b: float(noisy_or(z, np.zeros(4, np.int64), 1, b)[0])
    for label in (0, 1):
        value = lambda z, b: math.log(one(z, b) if label else 1 - one(z, b))
        clean, p, empty = 1 - one(z, bias), logistic(z + bias), float(logistic(np.array(bias)))
        factor = clean / (1 - clean) if label else -1.0
        for i in range(4):
            step = np.eye(4)[i] * 1e-6
            assert abs((value(z + step, bias) - value(z - step, bias)) / 2e-6 - (factor * p[i] if z[i] > 0 else 0)) < 1e-6
        slope = factor * (empty + (p - empty)[z > 0].sum())
        assert abs((value(z, bias + 1e-6) - value(z, bias - 1e-6)) / 2e-6 - slope) < 1e-6


def test_length_alone_is_not_toxic(spark, sf_dir):
    """Clean sentences of the given documents, ten thousand in one text; the same with one offending sentence among them."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights, bias = train(sampled(docs, labels, "toxic", "doc_id", "text", 3, 1, 12_000))
    known = docs.join(labels, "doc_id").where("text IS NOT NULL").orderBy("doc_id").select("text", "toxic").collect()
    cut = lambda t: [s for s in re.findall(r"[^.!?\n]+[.!?\n]", t) if any(c.isalpha() for c in s)]
    clean = [s for r in known if not r["toxic"] for s in cut(r["text"])]
    clean = (clean * (10_000 // len(clean) + 1))[:10_000]
    toxic = [r["text"] for r in known if r["toxic"]]
    rows = spark.createDataFrame([(0, "".join(clean)), *((1 + i, t) for i, t in enumerate(toxic))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in scored(rows, weights, bias).collect()}
    assert got[0]["predicted"] == 0 and got[0]["score"] < 0.5
    worst = max((i for i in got if i), key=lambda i: got[i]["score"])
    span = max(got[worst]["sentences"], key=lambda s: s["score"])
    offending = toxic[worst - 1].encode()[span["start"]:span["end"]].decode()
    mixed = spark.createDataFrame([(9, "".join([*clean[:5000], offending, *clean[5000:]]))], "doc_id bigint, text string")
    found = scored(mixed, weights, bias).first()
    assert found["predicted"] == 1 and len(found["sentences"]) >= 1



def test_kneser_ney_against_a_plain_version():
    rng = np.random.default_rng(1)
    text = rng.choice(6, 4000, p=[0.4, 0.25, 0.15, 0.1, 0.07, 0.03])
    grams = Counter(tuple(text[max(0, i - 2):i + 1].tolist()) for i in range(2, len(text)))
    pack = lambda g: sum(int(x) << (ppl.CLASS_BITS * (len(g) - 1 - i)) for i, x in enumerate(g))
    keys = np.array(sorted(pack(g) for g in grams))
    levels = kneser_ney(keys, np.array([{pack(g): c for g, c in grams.items()}[k] for k in keys.tolist()]), 3)
    counts = {3: grams}
    for size in (2, 1):
        counts[size] = Counter(g[1:] for g in counts[size + 1])

    def discount(size, c):
        n = [sum(1 for v in counts[size].values() if v == k) for k in range(1, 5)]
        d = {1: 0.5, 2: 1.0, 3: 1.5}
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            for k in (1, 2, 3):
                if n[k - 1]:
                    d[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05)
        return d[min(c, 3)]

    def p(g):
        size = len(g)
        if size == 0:
            return 1 / 64
        same = {k: c for k, c in counts[size].items() if k[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        own = max(same[g] - discount(size, same[g]), 0) / total if g in same else 0
        return own + sum(discount(size, c) for c in same.values()) / total * (p(g[1:]) if size > 1 else 1 / 64)

    probe = list(grams)[:60] + [(5, 5, 5), (5, 5, 0), (9, 9, 9), (0, 0, 40)]
    got = log_p(levels, np.array([pack(g) for g in probe]))
    assert np.allclose(got, [math.log(p(g)) for g in probe], atol=1e-4)
    context = (0, 0)
    assert abs(sum(math.exp(log_p(levels, np.array([pack((*context, w))]))[0]) for w in range(64)) - 1) < 1e-4


def brute_base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    window = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    marked = {j for i in range(len(w) - 7) if window[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)


def test_base_rules_and_bands(spark, messy, nothing):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    extra = spark.createDataFrame([(900, "a b\na b\n\n \na b", "en"), (901, "x y z " * 40, "en"), (902, "# * $ <é> |\r\n# * $ <é> |\r\n", None)], "doc_id bigint, text string, lang string")
    docs = messy.select("doc_id", "text", "lang").unionByName(extra)
    for most in (256 << 20, 0):
        rows = quality_rules(docs, most_bytes=most).collect()
        assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == Counter((r["doc_id"], *brute_base(r["text"])) for r in docs.collect())
        for r in rows:
            failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
            assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert quality_rules(nothing).count() == 0


def test_perplexity_rejects_what_no_language_writes(tables):
    docs, labels = tables
    noise = docs.sparkSession.createDataFrame([(10**6 + i, " ".join("".join(random.Random(i * 100 + j).choice("#$%qxzQXZ0123456789~^") for _ in range(7)) for j in range(60)), "en") for i in range(3)], "doc_id bigint, text string, lang string")
    rows = quality_rules(docs.select("doc_id", "text", "lang").unionByName(noise)).join(labels, "doc_id", "left").collect()
    assert not any(r["kept"] for r in rows if r["doc_id"] >= 10**6)
    clean = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert np.mean(clean) > 0.95


def test_shuffled_words_have_a_higher_perplexity(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    follow = {x: rng.sample(vocabulary, 3) for x in vocabulary}
    texts = []
    for _ in range(200):
        text = [rng.choice(vocabulary)]
        while len(text) < 100:
            text.append(rng.choice(follow[text[-1]]))
        texts.append(text)
    rows = [(i, " ".join(t), "en") for i, t in enumerate(texts)] + [(1000 + i, " ".join(rng.sample(t, len(t))), "en") for i, t in enumerate(texts[:10])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert min(found[1000 + i]["log_perplexity"] for i in range(10)) > max(found[i]["log_perplexity"] for i in range(200)) + 1
    assert all(found[i]["kept"] for i in range(200)) and not any(found[1000 + i]["kept"] for i in range(10))
    bundled = {r["doc_id"]: r["log_perplexity"] for r in quality_rules(docs, most_bytes=0).collect()}
    assert all(abs(bundled[i] - found[i]["log_perplexity"]) < 1e-9 for i in found)


def test_many_copies_do_not_close_the_band(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(80)]
    docs = spark.createDataFrame([(i, texts[max(0, i - 119)], "en") for i in range(199)], "doc_id bigint, text string, lang string")
    rows = quality_rules(docs).collect()
    assert len(rows) == 199 and all(r["kept"] and r["lower"] < r["log_perplexity"] < r["upper"] for r in rows)
    assert len({round(r["log_perplexity"], 9) for r in rows if r["doc_id"] <= 119}) == 1


def test_every_language_has_its_own_band(spark):
    rng = random.Random(8)
    rows = []
    for k in range(70):
        letters = [chr(97 + (k + j) % 26) for j in range(4)] + [chr(0xE0 + k % 20)]
        vocabulary = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(60)]
        rows += [(100 * k + i, " ".join(rng.choice(vocabulary) for _ in range(60)), f"l{k}") for i in range(5)]
    rows += [(10**6 + i, "one short row of a rare language", lang) for i, lang in enumerate(("rare", None))]
    found = quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    bands = {r["doc_id"] // 100: r["upper"] for r in found if r["doc_id"] < 10**6}
    assert len(found) == len(rows) and len(set(bands.values())) > 60


def test_more_than_three_languages_in_a_document(spark):
    rng = random.Random(9)
    letters = {f"l{k}": [chr(97 + 4 * k + j) for j in range(4)] for k in range(6)}
    prose = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(6)) for _ in range(n))
    rows = [(100 * k + i, prose(lang, 100), lang) for k, lang in enumerate(letters) for i in range(20)]
    rows += [(10**6 + n, " ".join(prose(f"l{k}", 60) for k in range(n)), None) for n in (4, 5, 6)]
    found = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).where("doc_id >= 1000000").collect()}
    for n in (4, 5, 6):
        r = found[10**6 + n]
        assert set(r["languages"]) == {f"l{k}" for k in range(n)} and abs(r["score"] - 1 / n) < 0.05


def test_rare_languages_are_learned(spark):
    from tidemark.llm.language import fit

    many = spark.range(600).select(F.format_string("l%04d", "id").alias("lang"), F.explode(F.array(F.lit(-1), F.lit(3))).alias("gram"), (1 + F.col("id") % 2).alias("n"))
    assert len(fit(many)[0]) == 600


def test_pairs_of_words_take_a_few_bytes():
    rng = np.random.default_rng(5)
    text = " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, 60000), 20000)).encode()
    _, names, before, own = ppl.terms(np.frombuffer(text, np.uint8), np.array([0, 30000, len(text)]), 9)
    bits, ids = 2, rng.permutation(len(names)).astype(np.int64)
    at, which, n, to = ppl.paired(before, own, ids, bits)
    first, second = ids[before[at]], ids[own[at]] >> bits
    bodies = [ppl.pair_body(first[i:j], second[i:j], n[i:j]) for i, j in ppl._bounds(to, bits)]
    assert sum(map(len, bodies)) < 4 * len(at)
    found = {}
    for bucket, body in enumerate(bodies):
        for x, y, k in zip(*(c.tolist() for c in ppl.pair_lists(body))):
            found[x, y << bits | (bucket - x) & 3] = k
    plain = {}
    for x, y in zip(ids[before].tolist(), ids[own].tolist()):
        plain[x, y] = plain.get((x, y), 0) + 1
    assert found == plain and n.sum() == len(own) and (ids[own[at]][which] == ids[own]).all()


def test_pairs_numbered_by_frequency_take_little_more_than_a_byte():
    rng = np.random.default_rng(6)
    text = " ".join(f"w{int(x)}" for x in np.exp(rng.random(200000) * np.log(50000))).encode()
    _, names, before, own = ppl.terms(np.frombuffer(text, np.uint8), np.array([0, 600000, len(text)]), 9)
    uses = np.bincount(before, minlength=len(names)) + np.bincount(own, minlength=len(names))
    bits, bucket = 2, (names >> np.uint64(62)).astype(np.int64)
    rank = np.empty(len(names), np.int64)
    for b in range(1 << bits):
        rank[bucket == b] = ppl.by_frequency(uses[bucket == b])
    ids = rank << bits | bucket
    at, which, n, to = ppl.paired(before, own, ids, bits)
    first, second = ids[before[at]], rank[own[at]]
    bodies = [ppl.pair_body(first[i:j], second[i:j], n[i:j]) for i, j in ppl._bounds(to, bits)]
    assert sum(map(len, bodies)) < 1.3 * len(at)
    read = [np.concatenate(x) for x in zip(*map(ppl.pair_lists, bodies))]
    assert all((x == y).all() for x, y in zip(read, (first, second, n)))


def test_numbers_and_counts_of_words_come_back():
    rng = np.random.default_rng(7)
    weight = rng.zipf(1.5, 5000).astype(float)
    rank = ppl.by_frequency(weight)
    assert sorted(rank.tolist()) == list(range(5000)) and weight[rank < 8].min() >= weight[rank >= 8].max()
    some = np.flatnonzero(rng.random(5000) < 0.3)
    seen = rng.integers(0, 9, (3, 5000))
    total = np.stack([seen[0] + 2 * seen[1] + 4 * seen[2], *seen, rng.integers(0, 40, 5000)])
    body = ppl.shrunk(*ppl.ranked(rank[some], *ppl.around_body(total)[:, some]))
    found, *columns = ppl.unranked(*ppl.regrown(body, np.uint8, np.uint32, *[np.int64] * 5))
    assert (found == rank[some]).all() and (ppl.around_of(np.stack(columns)) == total[:, some]).all()
    names = ppl.shrunk(*ppl.ranked(rank[some]))
    assert len(names) < 0.8 * len(ppl.shrunk(rank[some].astype(np.uint32)))
    assert all(len(x) == 0 for x in ppl.unranked(*ppl.regrown(ppl.shrunk(*ppl.ranked(rank[:0])), np.uint8, np.uint32)))
