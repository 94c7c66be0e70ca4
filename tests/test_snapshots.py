"""Dated model snapshots, their validity, and the non-negative fit over all supports."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import asof, studies
from tidemark.plans import learning
from tidemark.session import materialize
from tidemark.sources import tables as src


def test_validity_and_days_before_the_first_snapshot(spark, rows):
    snaps = spark.createDataFrame(
        [("a", "2024-01-02", 0, 1.0), ("a", "2024-01-02", 1, 2.0), ("a", "2024-01-05", 0, None), ("b", "2024-01-03", 0, 7.0)], "family string, t string, ord int, v double")
    dated = asof.validity(snaps.withColumn("t", F.to_date("t")), ("family",), "t")
    days = spark.createDataFrame([(f"2024-01-0{i}",) for i in range(1, 7)], "d string").select(F.to_date("d").alias("d"))
    got = rows(asof.snapshot_on_calendar(days, dated, ("family",)).select("family", F.dayofmonth("d").alias("d"), "ord", "v", F.dayofmonth("valid_to").alias("until")), "family", "d", "ord")
    seen = [(r["family"], r["d"], r["ord"], r["v"], r["until"]) for r in got]
    assert seen == [
        ("a", 1, None, None, None), ("a", 2, 0, 1.0, 5), ("a", 2, 1, 2.0, 5), ("a", 3, 0, 1.0, 5), ("a", 3, 1, 2.0, 5), ("a", 4, 0, 1.0, 5), ("a", 4, 1, 2.0, 5),
        ("a", 5, 0, None, None), ("a", 6, 0, None, None), ("b", 1, None, None, None), ("b", 2, None, None, None), *[("b", d, 0, 7.0, None) for d in range(3, 7)]]


def test_a_poisoned_future_leaves_the_snapshots_of_the_past(spark, sf_dir, rows):
    """Prices after a cut are multiplied by noise; what a session before it knew must not move."""
    dense = materialize(src.dense_panel(spark, sf_dir))
    cut = 1500
    noisy = dense.withColumn("px", F.when(F.col("pos") > cut, F.col("px") * (1 + F.pmod(F.xxhash64("entity", "d"), F.lit(1000)) / 100)).otherwise(F.col("px")))
    days = dense.select("d", "pos").distinct()

    def known(panel):
        labels = learning.labelled(spark, sf_dir, panel)
        snaps = learning.dated_snapshots(labels, learning.momentum_wide(panel), days)
        placed = asof.snapshot_on_calendar(days.where(f"pos <= {cut}").select("d"), materialize(snaps), ("family",))
        return rows(placed.select("family", "d", "valid_from", "ord", F.transform("coef", lambda x: F.round(x, 9)).alias("coef"), F.round("intercept", 9).alias("b")), "family", "d", "ord")

    before, after = known(dense), known(noisy)
    assert before == after and any(r["coef"] and any(r["coef"]) for r in before)


def plain_fit(g, b):
    k = len(b)
    best, gain = np.zeros(k), 0.0
    for size in range(1, k + 1):
        for pick in combinations(range(k), size):
            ix = list(pick)
            if np.linalg.matrix_rank(g[np.ix_(ix, ix)], tol=1e-9) < size:
                continue
            w = np.linalg.solve(g[np.ix_(ix, ix)], b[ix])
            if (w >= 0).all() and w @ b[ix] > gain + 1e-12:
                best, gain = np.zeros(k), w @ b[ix]
                best[ix] = w
    return best / best.sum() if best.sum() else best


def test_non_negative_fit_against_all_subsets(spark):
    """Random targets, some of whose free fits have negative shares; one has no feasible support at all."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4))
    x[:, 3] += 0.8 * x[:, 0]
    targets = {f"t{i}": x @ rng.normal(size=4) + 0.1 * rng.normal(size=120) for i in range(12)}
    targets["opposed"] = -(x @ np.linalg.inv(x.T @ x) @ np.ones(4))
    data = [(name, *map(float, r), float(v)) for name, y in targets.items() for r, v in zip(x, y)]
    frame = spark.createDataFrame(data, "target string, a0 double, a1 double, a2 double, a3 double, y double")
    got = {r["target"]: r["weights"] for r in studies.style_weights(studies.gram(frame, ["target"], ["a0", "a1", "a2", "a3"], "y"), ["target"], 4).collect()}
    assert len(got) == len(targets) and got["opposed"] == [0.0] * 4
    negative = 0
    for name, y in targets.items():
        negative += (np.linalg.solve(x.T @ x, x.T @ y) < 0).any()
        assert np.allclose(got[name], plain_fit(x.T @ x, x.T @ y), atol=1e-4), name
    assert negative > 5


def test_a_repeated_series_is_one_support(spark):
    frame = spark.createDataFrame([("t", 1.0, 1.0, 2.0), ("t", 2.0, 2.0, 4.0), ("t", 3.0, 3.0, 6.0)], "target string, a0 double, a1 double, y double")
    got = studies.style_weights(studies.gram(frame, ["target"], ["a0", "a1"], "y"), ["target"], 2).first()
    assert got["weights"] == [1.0, 0.0] and got["n"] == 3
