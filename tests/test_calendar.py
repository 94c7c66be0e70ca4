"""Holiday edges, Easter dates, posting dates and the month-end trap."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import calendars as cal


def test_easter_against_known_sundays(spark, rows):
    known = {2000: "2000-04-23", 2008: "2008-03-23", 2011: "2011-04-24", 2019: "2019-04-21", 2024: "2024-03-31", 2025: "2025-04-20", 2038: "2038-04-25"}
    years = spark.createDataFrame([(y,) for y in known], "y int")
    for r in rows(cal.easter(years)):
        assert r["easter"].isoformat() == known[r["y"]]


def test_year_end_edges(spark, rows):
    for lo, hi, want in (("2027-12-30", "2028-01-03", ["2027-12-30", "2028-01-03"]), ("2022-12-30", "2023-01-03", ["2022-12-30", "2023-01-03"])):
        bounds = spark.createDataFrame([(dt.date.fromisoformat(lo), dt.date.fromisoformat(hi))], "lo date, hi date")
        assert [r["d"].isoformat() for r in rows(cal.business_days(bounds, "lo", "hi"), "d")] == want


def posted(spark, when):
    bounds = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2026, 12, 31))], "lo date, hi date")
    reqs = spark.createDataFrame([(i, w) for i, w in enumerate(when)], "id int, t string").select("id", F.col("t").cast("timestamp").alias("ts"))
    return {r["id"]: r for r in cal.posting_dates(reqs, cal.business_days(bounds, "lo", "hi")).collect()}


def test_posting_dates(spark):
    out = posted(spark, ["2026-09-15 11:59:00", "2026-09-15 12:00:00", "2026-02-28 09:00:00", "2024-10-14 09:00:00", "2026-09-30 13:00:00", "2026-09-30 11:00:00"])
    assert [out[i]["post_d"].isoformat() for i in range(6)] == ["2026-09-15", "2026-09-16", "2026-03-02", "2024-10-15", "2026-10-01", "2026-09-30"]
    assert [out[i]["trap"] for i in range(6)] == [0, 0, 0, 0, 1, 0]


def test_zone_conversion_moves_the_cutoff(spark, rows):
    bounds = spark.createDataFrame([(dt.date(2026, 7, 1), dt.date(2026, 7, 31))], "lo date, hi date")
    reqs = spark.sql("SELECT timestamp'2026-07-15 15:59:00' AS ts UNION ALL SELECT timestamp'2026-07-15 16:00:00'")
    out = rows(cal.posting_dates(reqs, cal.business_days(bounds, "lo", "hi"), zone="America/New_York"), "ts")
    assert [r["post_d"].isoformat() for r in out] == ["2026-07-15", "2026-07-16"]
