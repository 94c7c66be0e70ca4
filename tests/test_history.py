"""Gap policies: break to NULL, hold flat, wealth from prices."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import bands, history, windows as op


def monthly(spark, values):
    data = [("e", dt.date(2024 + i // 12, i % 12 + 1, 1), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "entity string, month date, pos int, ret_pct double")


@pytest.mark.parametrize("values,want", [
    ([None, 10.0, -5.0, None, 2.0], [None, 1.1, 1.045, None, None]),
    ([2.0, 3.0, 4.0], [1.02, 1.0506, 1.092624]),
])
def test_break_to_null(spark, rows, values, want):
    df = monthly(spark, values).withColumn("w", history.broken_wealth(F.col("ret_pct"), F.col("pos"), W.partitionBy("entity").orderBy("pos")))
    got = [r["w"] for r in rows(df, "pos")]
    assert [None if g is None else round(g, 10) for g in got] == want


def test_hold_flat(spark, rows):
    df = monthly(spark, [None, 10.0, None, 10.0]).withColumn("w", op.compound_hold(F.col("ret_pct") / 100, op.by_entity()))
    assert [None if r["w"] is None else round(r["w"], 10) for r in rows(df, "pos")] == [None, 1.1, 1.1, 1.21]


def test_wealth_from_prices_breaks_for_good(spark, rows):
    data = [("e", i, p) for i, p in enumerate([None, 100.0, 110.0, None, 120.0])]
    df = spark.createDataFrame(data, "entity string, pos int, px double").withColumn("w", op.wealth_from_prices(F.col("px"), F.col("pos"), op.by_entity()))
    assert [None if r["w"] is None else round(r["w"], 10) for r in rows(df, "pos")] == [None, 1.0, 1.1, None, None]


def test_absent_months_stay_visible(spark, rows):
    panel = spark.createDataFrame([("e", 0, dt.date(2024, 1, 31), 1.0), ("e", 0, dt.date(2024, 4, 30), 2.0)], "entity string, ord int, d date, px double")
    assert [r["month"].month for r in rows(history.calendar_months(panel, 3), "month")] == [1, 2, 3]


def test_run_length_resets_on_false_and_null(spark, rows):
    data = [("e", i, c) for i, c in enumerate([True, True, None, True, False, True, True, True])]
    df = spark.createDataFrame(data, "entity string, pos int, c boolean")
    assert [r["run"] for r in rows(op.run_length(df, F.col("c")), "pos")] == [1, 2, 0, 1, 0, 1, 2, 3]


def test_whipsaws_look_past_other_switches(spark, rows):
    names = ["a", "a", "b", "c", "b", "a", "b", "b"]
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(names)], "strategy string, pos int, name string")
    got = {(r["i"], r["back_i"]) for r in rows(bands.whipsaws(df, "name", 3))}
    assert got == {(2, 5), (3, 4), (5, 6)}


def test_expanding_rank_average_ties(spark, rows):
    df = spark.createDataFrame([("e", i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0])], "entity string, pos int, v double")
    got = [r["pct"] for r in rows(op.expanding_rank(df, "v", "pos", ["entity"], 2), "pos")]
    assert got == [None, 0.5, 2.5 / 3, None, 0.5]


@pytest.mark.parametrize("bucket_rows", [1 << 16, 40])
def test_expanding_rank_matches_a_sorted_list(spark, bucket_rows):
    rng = random.Random(4)
    data = []
    for k in ("a", "b", None):
        for i in sorted(rng.sample(range(-50, 900), 300)):
            data.append((k, i, rng.choice((None, float("nan"), 1.5, 1.5, 1.5, rng.random() * 3, 0.1 + 0.2, 0.3, -0.0, 0.0)), "x", i))
    df = spark.createDataFrame(data, "k string, pos int, v double, pct_of string, n int")
    out = op.expanding_rank(df.repartition(5), "v", "pos", ["k"], 20, bucket_rows=bucket_rows)
    assert out.columns == [*df.columns, "pct"] and out.count() == len(data)
    got = {(r["k"], r["pos"]): r["pct"] for r in out.collect()}
    history = {}
    for k, i, v, *_ in data:
        if v is None or v != v:
            assert got[k, i] is None
            continue
        mine = history.setdefault(k, [])
        mine.append(v)
        want = (sum(x < v for x in mine) + (sum(x == v for x in mine) + 1) / 2) / len(mine)
        assert got[k, i] == (pytest.approx(want) if len(mine) >= 20 else None)
    assert op.expanding_rank(df.where("1 = 0"), "v", "pos", ["k"], 2).count() == 0
    assert [r["pct"] for r in op.expanding_rank(df.limit(1).withColumn("v", F.lit(2.0)), "v", "pos", ["k"], 1).collect()] == [1.0]


def test_expanding_rank_runs_no_python(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("pos"), F.rand(1).alias("v"))
    plan = op.expanding_rank(df, "v", "pos", ["k"], 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
