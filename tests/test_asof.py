"""As-of joins: boundaries, duplicates, NULL payloads, publication lags, bucketed form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, calendars as cal


def day(text):
    return dt.date.fromisoformat(text)


def test_null_payload_is_a_match_and_last_duplicate_wins(spark, rows):
    left = spark.createDataFrame([(day("2024-01-05"),), (day("2024-01-02"),)], "d date")
    right = spark.createDataFrame([(day("2024-01-03"), 1, 1.0), (day("2024-01-03"), 2, None), (day("2024-01-01"), 0, 9.0)], "av date, seq int, v double")
    out = {r["d"]: r for r in rows(asof.asof_backward(left, right, left_ts="d", right_ts="av", payload=["v", "seq"], seq="seq"))}
    assert out[day("2024-01-05")]["v"] is None and out[day("2024-01-05")]["seq"] == 2
    assert out[day("2024-01-02")]["v"] == 9.0


@pytest.mark.parametrize("seed", [1, 2])
def test_bucketed_equals_brute_force_with_a_hot_key(spark, rows, seed):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    pick = lambda: 0 if rnd.random() < 0.5 else rnd.randrange(1, 6)
    left = [(i, pick(), start + dt.timedelta(minutes=rnd.randrange(20000))) for i in range(300)]
    right = [(pick(), start + dt.timedelta(minutes=rnd.randrange(20000)), i) for i in range(250)]
    l = spark.createDataFrame(left, "id int, k int, ts timestamp")
    r = spark.createDataFrame(right, "k int, rts timestamp, v int")
    back = {x["id"]: x["v"] for x in rows(asof.asof_backward(l, r, left_ts="ts", right_ts="rts", by=("k",), payload=["v"], seq="v", bucket=F.to_date))}
    ahead = {x["id"]: x["v"] for x in rows(asof.asof_forward(l, r, left_ts="ts", right_ts="rts", by=("k",), payload=["v"], bucket=F.to_date))}
    for i, k, ts in left:
        before = [(t, v) for kk, t, v in right if kk == k and t <= ts]
        after = [(t, v) for kk, t, v in right if kk == k and t >= ts]
        assert back[i] == (max(before)[1] if before else None)
        if after:
            assert ahead[i] in {v for t, v in after if t == min(after)[0]}
        else:
            assert ahead[i] is None


def test_publication_lag_boundary(spark, rows):
    releases = spark.createDataFrame([(day("2024-09-01"), 100.0), (day("2024-10-01"), 400.0)], "month date, v double").withColumn("av", cal.next_month_day(F.col("month"), 15))
    days = spark.createDataFrame([(day("2024-11-14"),), (day("2024-11-15"),)], "d date")
    out = rows(asof.asof_on_calendar(days, releases, available_on="av", payload=["v"], seq="month"), "d")
    assert [r["v"] for r in out] == [100.0, 400.0]


def test_forward_dated_shift(spark, rows):
    prob = spark.createDataFrame([(day("2024-06-30"), 0.42)], "fwd date, p double").withColumn("av", cal.year_back(F.col("fwd")))
    days = spark.createDataFrame([(day("2023-05-31"),), (day("2023-07-03"),)], "d date")
    out = rows(asof.asof_on_calendar(days, prob, available_on="av", payload=["p"]), "d")
    assert [r["p"] for r in out] == [None, 0.42]


def test_many_series_in_one_pass_equal_separate_joins(spark, rows):
    days = spark.createDataFrame([(day("2024-01-01") + dt.timedelta(days=i), i) for i in range(40)], "d date, pos int")
    a = spark.createDataFrame([(day("2024-01-03"), day("2024-01-01"), 1.0), (day("2024-01-03"), day("2024-01-02"), None), (day("2024-01-20"), day("2024-01-19"), 3.0)], "av date, s date, x double")
    b = spark.createDataFrame([(day("2024-01-02"), 5.0), (day("2024-01-30"), 6.0)], "av date, y double")
    one = asof.asof_many(days, [(a, "av", ["x"], "s"), (b, "av", ["y"], None)])
    two = asof.asof_on_calendar(asof.asof_on_calendar(days, a, available_on="av", payload=["x"], seq="s"), b, available_on="av", payload=["y"])
    assert rows(one, "d") == rows(two, "d")
