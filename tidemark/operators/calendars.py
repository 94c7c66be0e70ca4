"""Trading-calendar dimension: holidays by rule, sessions, posting dates, availability dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.asof import asof_forward
from tidemark.session import materialize


def nth_weekday(year: Column, month: int, day_name: str, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), day_name), 7 * (n - 1))


def last_weekday(year: Column, month: int, day_name: str) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(end, 7), day_name)


def observed(d: Column) -> Column:
    """Saturday moves to Friday, Sunday to Monday."""
    return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def easter(df: DataFrame, year: str = "y") -> DataFrame:
    """Adds `easter` by Oudin's integer formula (the paschal moon's epact, then the next Sunday)."""
    g, c = f"({year} % 19)", f"({year} div 100)"
    steps = df.withColumn("__h", F.expr(f"({c} - {c} div 4 - (8 * {c} + 13) div 25 + 19 * {g} + 15) % 30"))
    steps = steps.withColumn("__i", F.expr(f"__h - (__h div 28) * (1 - (29 div (__h + 1)) * ((21 - {g}) div 11))"))
    steps = steps.withColumn("__l", F.expr(f"__i - ({year} + {year} div 4 + __i + 2 - {c} + {c} div 4) % 7"))
    steps = steps.withColumn("__m", F.expr("3 + (__l + 40) div 44"))
    return steps.withColumn("easter", F.expr(f"make_date(cast({year} AS int), cast(__m AS int), cast(__l + 28 - 31 * (__m div 4) AS int))")).drop(
        "__h", "__i", "__l", "__m")


def holidays(years: DataFrame) -> DataFrame:
    """(y, holiday, d) for each year in `years(y)`; one row per closing day."""
    y = F.col("y")
    fixed = {name: observed(F.make_date(y, F.lit(m), F.lit(day))) for name, (m, day) in {
        "new_year": (1, 1), "juneteenth": (6, 19), "independence": (7, 4), "veterans": (11, 11), "christmas": (12, 25)}.items()}
    moving = {
        "king": nth_weekday(y, 1, "MON", 3),
        "presidents": nth_weekday(y, 2, "MON", 3),
        "good_friday": F.date_sub("easter", 2),
        "memorial": last_weekday(y, 5, "MON"),
        "labor": nth_weekday(y, 9, "MON", 1),
        "columbus": nth_weekday(y, 10, "MON", 2),
        "thanksgiving": nth_weekday(y, 11, "THU", 4),
    }
    next_new_year = F.make_date(y + 1, F.lit(1), F.lit(1))
    early = F.when(F.weekday(next_new_year) == 5, F.make_date(y, F.lit(12), F.lit(31)))
    entries = [F.struct(F.lit(name).alias("holiday"), d.alias("d")) for name, d in {**fixed, **moving, "next_new_year": early}.items()]
    return (
        easter(years).select("y", F.explode(F.array(*entries)).alias("e")).select("y", "e.holiday", "e.d")
        .filter(F.col("d").isNotNull())
    )


def years_spanned(bounds: DataFrame, lo: str, hi: str, extra: int = 0) -> DataFrame:
    """One row per calendar year of a one-row frame of bounds."""
    return bounds.select(F.explode(F.sequence(F.year(lo), F.year(hi) + extra)).alias("y"))


def business_days(bounds: DataFrame, lo: str, hi: str) -> DataFrame:
    """Weekdays in [lo, hi] of a one-row frame that are not holidays."""
    days = bounds.select(F.explode(F.sequence(F.col(lo), F.col(hi))).alias("d")).filter(F.weekday("d") < 5)
    closed = holidays(years_spanned(bounds, lo, hi, 1)).select("d").distinct()
    return days.join(closed, "d", "left_anti")


def trading_calendar(observed_days: DataFrame, project_years: int = 2) -> DataFrame:
    """(d, is_projected, pos): observed sessions, then scheduled ones to the end of the projection."""
    bounds = observed_days.agg(F.max("d").alias("last_d")).select(
        F.date_add("last_d", 1).alias("lo"), F.make_date(F.year("last_d") + project_years, F.lit(12), F.lit(31)).alias("hi"))
    days = observed_days.select("d").distinct().withColumn("is_projected", F.lit(0)).unionByName(
        business_days(bounds, "lo", "hi").withColumn("is_projected", F.lit(1)))
    return days.withColumn("pos", F.row_number().over(W.orderBy("d")) - 1)


def neighbours(calendar: DataFrame) -> DataFrame:
    """Adds the previous and next session of each calendar day."""
    w = W.orderBy("d")
    return calendar.withColumn("prev_d", F.lag("d").over(w)).withColumn("next_d", F.lead("d").over(w))


def schedule_flags(days: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Adds next scheduled session, month-end and pre-holiday flags to arbitrary days."""
    out = asof_forward(days, scheduled.select(F.col("d").alias("next_sched")), left_ts="d", right_ts="next_sched", payload=["next_sched"], strict=True)
    gap = F.datediff("next_sched", "d")
    plain_weekend = (F.weekday("d") == 4) & (gap == 3)
    return out.select(
        "*",
        (F.trunc("next_sched", "MM") != F.trunc("d", "MM")).cast("int").alias("is_month_end"),
        ((gap > 1) & ~plain_weekend).cast("int").alias("is_pre_holiday"),
    )


def posting_dates(requests: DataFrame, calendar: DataFrame, *, ts: str = "ts", zone: str | None = None, span: DataFrame | None = None) -> DataFrame:
    """Adds request day, posting date and month-end-trap flag.

    Before noon on a session the request posts the same day, otherwise on the next session. `zone`
    converts UTC instants to local time first; without it times are already local. All date logic is
    settled once per calendar day. That day table is written, so its true size decides the join: a
    broadcast below the threshold, and never a shuffle of the requests on a few dozen day keys unless
    the calendar itself outgrew it. `span(lo, hi)` gives the request days where they are known.
    """
    local = F.from_utc_timestamp(ts, zone) if zone else F.col(ts)
    if span is None:
        span = requests.agg(F.to_date(F.min(local)).alias("lo"), F.to_date(F.max(local)).alias("hi"))
    days = materialize(posting_lookup(span.select(F.explode(F.sequence("lo", "hi")).alias("d")), calendar))
    stamped = requests.withColumn("req_d", F.to_date(local)).withColumn("before_noon", F.hour(local) < 12)
    out = stamped.join(days.withColumnRenamed("d", "req_d"), "req_d")
    post = F.when(F.col("is_session") & F.col("before_noon"), F.col("req_d")).otherwise(F.col("next_d"))
    return out.select(
        *requests.columns, "req_d", post.alias("post_d"),
        (F.col("is_session") & F.col("is_last") & (F.trunc(post, "MM") != F.trunc("req_d", "MM"))).cast("int").alias("trap"),
    )


def posting_lookup(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per calendar day: is it a session, is it the month's last session, which session follows."""
    cal = calendar.select(F.col("d").alias("session_d"))
    month_last = calendar.groupBy(F.trunc("d", "MM").alias("m")).agg(F.max("d").alias("month_last"))
    return (
        asof_forward(days, cal.withColumnRenamed("session_d", "next_d"), left_ts="d", right_ts="next_d", payload=["next_d"], strict=True)
        .join(cal.withColumn("hit", F.lit(True)), F.col("d") == F.col("session_d"), "left")
        .join(month_last, F.trunc("d", "MM") == F.col("m"), "left")
        .select("d", "next_d", F.coalesce("hit", F.lit(False)).alias("is_session"),
                F.coalesce(F.col("d") == F.col("month_last"), F.lit(False)).alias("is_last"))
    )


def next_weekday(d: Column) -> Column:
    """The following Monday-to-Friday day, strictly later."""
    step = F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1)
    return F.date_add(d, step)


def next_month_day(month: Column, day: int) -> Column:
    """A fixed day of the month after the observed month."""
    return F.date_add(F.add_months(F.trunc(month, "MM"), 1), day - 1)


def year_back(d: Column) -> Column:
    """Twelve calendar months earlier, day clamped to the month's length."""
    return F.add_months(d, -12)
