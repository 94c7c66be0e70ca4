"""Events by rule against a plain loop."""

import datetime as dt
import random
import statistics

from tidemark.operators.events import crossings, rested

DAY = dt.date(2020, 1, 1)


def brute(series, rows, least, threshold, rest):
    found, last, before = [], None, None
    for i, (d, v) in enumerate(series):
        earlier = [x for _, x in series[max(0, i - rows):i] if x is not None]
        z = None
        if v is not None and len(earlier) >= max(least, 2) and statistics.stdev(earlier) > 0:
            z = (v - statistics.mean(earlier)) / statistics.stdev(earlier)
        if z is not None and z >= threshold and (before is None or before < threshold) and (last is None or (d - last).days >= rest):
            found.append(d)
            last = d
        before = z
    return found


def test_events_match_a_plain_loop(spark):
    rng = random.Random(2)
    data = {}
    for key in ("a", "b", None):
        data[key] = [(DAY + dt.timedelta(days=i), None if rng.random() < 0.05 else rng.choice((rng.gauss(10, 1), rng.gauss(10, 1), rng.gauss(16, 2)))) for i in range(0, 400, rng.choice((1, 2)))]
    data["flat"] = [(DAY + dt.timedelta(days=i), 5.0) for i in range(100)]
    df = spark.createDataFrame([(k, d, v) for k, s in data.items() for d, v in s], "key string, day date, v double")
    got = {}
    for r in rested(crossings(df, "key", "day", "v", 30, 10, 1.5), "key", "day", 7).collect():
        got.setdefault(r["key"], []).append(r["day"])
    want = {k: brute(s, 30, 10, 1.5, 7) for k, s in data.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and len(want["a"]) > 10


def test_two_large_days_of_a_month_are_two_events(spark):
    values = [(DAY + dt.timedelta(days=i), 100 + i % 3) for i in range(60)] + [(DAY + dt.timedelta(days=60), 500), (DAY + dt.timedelta(days=61), 600)]
    values += [(DAY + dt.timedelta(days=i), 100 + i % 3) for i in range(62, 72)] + [(DAY + dt.timedelta(days=72), 900)]
    df = spark.createDataFrame([("k", d, v) for d, v in values], "key string, day date, v bigint")
    found = sorted(r["day"] for r in rested(crossings(df, "key", "day", "v", 63, 40, 2.0), "key", "day", 10).collect())
    assert found == [DAY + dt.timedelta(days=60), DAY + dt.timedelta(days=72)] and found[0].month == found[1].month
    assert rested(crossings(df.where("1 = 0"), "key", "day", "v", 63, 40, 2.0), "key", "day", 10).count() == 0


def test_rest_is_counted_from_the_last_event_kept(spark):
    df = spark.createDataFrame([("k", DAY + dt.timedelta(days=i)) for i in (0, 9, 10, 18, 20, 20)], "key string, day date")
    assert sorted((r["day"] - DAY).days for r in rested(df, "key", "day", 10).collect()) == [0, 10, 20]
