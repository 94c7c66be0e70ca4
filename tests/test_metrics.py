"""Hand-computed metric, mix, verdict and bootstrap values."""

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import verdict
from tidemark.operators import bootstrap as bs
from tidemark.operators import evaluation as ev
from tidemark.operators import metrics, portfolio as pf

TOY = [("2020-01-02", 100.0), ("2020-01-03", 110.0), ("2020-01-06", 105.0), ("2020-01-07", 115.0), ("2020-01-08", 90.0), ("2020-01-09", 99.0)]


def path(spark, wealth, dates=None, base=0.0):
    dates = dates or [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(len(wealth))]
    data, prev = [], None
    for i, (d, w) in enumerate(zip(dates, wealth)):
        data.append(("x", d, i, float(w), 0.0 if prev is None else w / prev - 1.0, base))
        prev = w
    return spark.createDataFrame(data, "strategy string, d date, pos int, w double, ret double, base_ret double")


def summary(df, periods):
    m = metrics.path_metrics("strategy", periods)
    return metrics.with_path_columns(df, "strategy", periods).groupBy("strategy").agg(*[c.alias(n) for n, c in m.items()]).first()


def test_toy_prices(spark):
    s = summary(path(spark, [p for _, p in TOY], [dt.date.fromisoformat(d) for d, _ in TOY]), 252)
    assert s["cagr"] == pytest.approx(-0.4080967977694844, abs=1e-12)
    assert s["max_drawdown"] == pytest.approx(-0.21739130434782605, abs=1e-12)
    assert (s["max_dd_peak"].isoformat(), s["max_dd_trough"].isoformat()) == ("2020-01-07", "2020-01-08")


@pytest.mark.parametrize("periods", [12, 252])
def test_annualization(spark, periods):
    rets = [0.0] + [0.02, -0.01] * 12
    wealth = [1.0]
    for r in rets[1:]:
        wealth.append(wealth[-1] * (1 + r))
    s = summary(path(spark, wealth), periods)
    sample = rets[1:]
    mean = sum(sample) / len(sample)
    sd = math.sqrt(sum((x - mean) ** 2 for x in sample) / (len(sample) - 1))
    assert s["vol"] == pytest.approx(sd * math.sqrt(periods), rel=1e-9)
    assert s["sharpe"] == pytest.approx(mean / sd * math.sqrt(periods), rel=1e-9)
    assert s["sortino"] == pytest.approx(mean / 0.01 * math.sqrt(periods), rel=1e-9)


def test_turnover_of_one_full_switch(spark):
    w = [[0.0, 1.0]] * 3 + [[1.0, 0.0]] * 3
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(w)], "strategy string, pos int, weights array<double>")
    assert metrics.one_way_turnover(df, "strategy").first()["turnover"] == 1.0


def test_static_mix_drifts(spark, rows):
    data = [(f"e{o}", o, dt.date(2024, 1, 2 + i), i, px) for i in range(3) for o, px in ((0, 100.0), (1, [100.0, 120.0, 144.0][i]))]
    out = rows(pf.static_mix(spark.createDataFrame(data, "entity string, ord int, d date, pos int, px double"), [0.5, 0.5]), "pos")
    assert out[2]["w"] == pytest.approx(1.22)
    assert [r["weights"][1] for r in out] == pytest.approx([0.5, 120 / 220, 144 / 244])


def test_verdicts(spark):
    data = [(0.02, 0.01, 0.03, None, "Inconclusive"), (0.02, 0.01, 0.03, False, "Inconclusive"), (0.02, 0.01, 0.03, True, "Beat"), (-0.02, -0.03, -0.01, None, "Underperformed")]
    df = spark.createDataFrame(data, "e double, lo double, hi double, ok boolean, want string")
    for r in df.select("want", verdict(F.col("e"), F.col("lo"), F.col("hi"), F.col("ok")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_bins_keep_every_row_and_empty_bins(spark, rows):
    df = spark.createDataFrame([(i / 50.0, float(i % 2)) for i in range(51)], "p double, y double")
    out = rows(ev.reliability_bins(df, "p", "y"), "bin")
    assert len(out) == 10 and sum(r["n"] for r in out) == 51 and out[9]["n"] == 6


def test_bootstrap_matches_direct_resampling(spark, rows):
    import numpy as np

    rng = np.random.default_rng(5)
    n, block, reps = 50, 7, 30
    rs, rb = rng.normal(0.001, 0.02, n), rng.normal(0.0, 0.01, n)
    rs[0] = rb[0] = 0.0
    d0 = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("k", i, d0 + dt.timedelta(days=i), float(rs[i]), float(rb[i])) for i in range(n)], "k string, pos bigint, d date, rs double, rb double")
    got = rows(bs.excess_growth(df, ["k"], block, reps))[0]
    e, blocks, draws = 365.25 / (n - 1), math.ceil(n / block), []
    for rep in range(reps):
        ix = []
        for b in range(blocks):
            start = int(hashlib.md5(f"0-{rep}-{b}".encode()).hexdigest()[:7], 16) % (n - block + 1)
            ix += list(range(start, start + block))
        ix = ix[:n]
        draws.append(np.prod(1 + rs[ix]) ** e - np.prod(1 + rb[ix]) ** e)
    assert [got["low"], got["high"]] == pytest.approx(list(np.quantile(draws, [0.05, 0.95])), rel=1e-9)
    assert got["excess_cagr"] == pytest.approx(np.prod(1 + rs) ** e - np.prod(1 + rb) ** e, rel=1e-9)


def test_normal_probability_and_quantile(spark):
    from statistics import NormalDist

    import duckdb

    from tidemark.functions import normal

    n = NormalDist()
    zs = [ev.Z95, 0.0, -3.2, 5.5, -8.0, 40.0, -40.0, 1e-9]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(normal.probability(F.col("z"))).collect()]
    assert max(abs(g - n.cdf(z)) for g, z in zip(got, zs)) < 4e-9
    assert spark.createDataFrame([(None,), (float("nan"),)], "z double").select(normal.probability(F.col("z")).alias("p")).where("p IS NOT NULL").count() == 0
    duck = [duckdb.sql(f"SELECT {normal.probability_sql(f'{z!r}::DOUBLE')}").fetchall()[0][0] for z in zs]
    assert got == pytest.approx(duck, abs=1e-12)
    ps = [0.5, 0.975, 0.02, 1 - 1 / 464, 1 - 1e-9, 1e-4]
    found = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal.quantile(F.col("p"))).collect()]
    assert max(abs(n.cdf(z) - p) for z, p in zip(found, ps)) < 5e-9
    text = duckdb.sql(f"WITH RECURSIVE src AS (SELECT 0.998::DOUBLE AS p0), {normal.quantile_sql('q', 'src', 'p0')} SELECT z FROM q").fetchall()[0][0]
    assert text == pytest.approx(n.inv_cdf(0.998), abs=1e-6)


def test_more_trials_raise_the_hurdle(spark):
    from tidemark.plans.experiments import expected_maximum

    rows = [expected_maximum(spark.range(n)).first() for n in (1, 2, 25, 464)]
    assert [r["n_trials"] for r in rows] == [1, 2, 25, 464] and rows[0]["maximum"] == 0
    assert [r["maximum"] for r in rows[1:]] == pytest.approx([ev.expected_maximum(n) for n in (2, 25, 464)], abs=1e-6)
    df = spark.createDataFrame([(float(i % 7) - 2.5,) for i in range(300)], "x double").withColumn("k", F.lit(1))
    z = [ev.deflated_sharpe(df, "x", ["k"], expected_maximum(spark.range(n)).select("maximum").scalar()).first()["dsr_z"] for n in (25, 26)]
    assert z[1] < z[0] == pytest.approx(ev.deflated_sharpe(df, "x", ["k"], 25).first()["dsr_z"], abs=1e-6)
