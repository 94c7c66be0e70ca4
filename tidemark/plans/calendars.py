"""Calendar-dimension queries; every calendar spans the days found in the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import calendars as cal
from tidemark.plans.base import duck, query
from tidemark.session import materialize
from tidemark.sources import tables as src


def holidays_sql(name: str, years: str) -> tuple[str, str, str]:
    """CTEs giving `name`(y, holiday, d) for the years of a sub-select."""
    def fixed(label, m, day):
        x = f"make_date(y, {m}, {day})"
        return f"SELECT y, '{label}' AS holiday, ({x} + CASE isodow({x}) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END::INTEGER)::DATE AS d FROM {name}_y"

    def nth(label, m, dow, n):
        x = f"make_date(y, {m}, 1)"
        return f"SELECT y, '{label}', ({x} + (({dow} - isodow({x}) + 7) % 7 + {7 * (n - 1)})::INTEGER)::DATE FROM {name}_y"

    parts = [
        fixed("new_year", 1, 1), fixed("juneteenth", 6, 19), fixed("independence", 7, 4), fixed("veterans", 11, 11), fixed("christmas", 12, 25),
        nth("king", 1, 1, 3), nth("presidents", 2, 1, 3), nth("labor", 9, 1, 1), nth("columbus", 10, 1, 2), nth("thanksgiving", 11, 4, 4),
        f"SELECT y, 'memorial', (make_date(y, 5, 31) - (isodow(make_date(y, 5, 31)) - 1)::INTEGER)::DATE FROM {name}_y",
        f"SELECT y, 'good_friday', (make_date(y, (3 + (l + 40) // 44)::INTEGER, (l + 28 - 31 * ((3 + (l + 40) // 44) // 4))::INTEGER) - 2)::DATE FROM {name}_e",
        f"SELECT y, 'next_new_year', make_date(y, 12, 31) FROM {name}_y WHERE isodow(make_date(y + 1, 1, 1)) = 6",
    ]
    return (
        f"{name}_y AS ({years})",
        f"""{name}_e AS (SELECT y, i - (y + y // 4 + i + 2 - c + c // 4) % 7 AS l FROM (
              SELECT y, c, h - (h // 28) * (1 - (29 // (h + 1)) * ((21 - g) // 11)) AS i FROM (
                SELECT y, y % 19 AS g, y // 100 AS c, (y // 100 - y // 400 - (8 * (y // 100) + 13) // 25 + 19 * (y % 19) + 15) % 30 AS h FROM {name}_y)))""",
        f"{name} AS (" + " UNION ALL ".join(parts) + ")",
    )


def years_sql(lo: str, hi: str, source: str, extra: int) -> str:
    return f"SELECT unnest(range(year({lo})::BIGINT, year({hi})::BIGINT + {extra} + 1)) AS y FROM (SELECT min(d) AS {lo}, max(d) AS {hi} FROM {source})"


HOL = holidays_sql("hol", years_sql("a", "b", "ses", 3))
SCHED = "sched AS (SELECT d FROM (SELECT unnest(generate_series(min(d), make_date((year(max(d)) + 2)::BIGINT, 12, 31), INTERVAL 1 DAY))::DATE AS d FROM ses) WHERE isodow(d) < 6 AND d NOT IN (SELECT d FROM hol))"
TCAL = """tcal AS (SELECT d, p AS is_projected, row_number() OVER (ORDER BY d) - 1 AS pos FROM (
  SELECT d, 0 AS p FROM ses UNION ALL SELECT d, 1 FROM sched WHERE d > (SELECT max(d) FROM ses)))"""


def observed(spark, sf_dir):
    """The days on which anything shipped: one scan of one column, written because calendars read it several times."""
    return materialize(src.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct())


def bounds_of(days, years: int = 2):
    """First day, last day and end of the projection of a set of observed days."""
    return days.agg(F.min("d").alias("lo"), F.max("d").alias("last_d")).select(
        "lo", "last_d", F.make_date(F.year("last_d") + years, F.lit(12), F.lit(31)).alias("hi"))


@query("holiday_calendar", duck("SELECT y::BIGINT AS y, holiday, d, (d IN (SELECT d FROM ses))::INTEGER::BIGINT AS traded FROM hol", *HOL))
def holiday_calendar(spark, sf_dir):
    days = observed(spark, sf_dir)
    hol = cal.holidays(cal.years_spanned(days.agg(F.min("d").alias("lo"), F.max("d").alias("hi")), "lo", "hi", 3))
    traded = days.withColumn("traded", F.lit(1))
    return hol.join(traded, "d", "left").select(F.col("y").cast("bigint").alias("y"), "holiday", "d", F.coalesce("traded", F.lit(0)).cast("bigint").alias("traded"))


@query("business_days", duck("SELECT d FROM sched", *HOL, SCHED))
def business_days(spark, sf_dir):
    return cal.business_days(bounds_of(observed(spark, sf_dir)), "lo", "hi")


@query("trading_calendar", duck("SELECT d, is_projected::BIGINT AS is_projected, pos::BIGINT AS pos FROM tcal", *HOL, SCHED, TCAL))
def trading_calendar(spark, sf_dir):
    return cal.trading_calendar(observed(spark, sf_dir)).select("d", F.col("is_projected").cast("bigint").alias("is_projected"), F.col("pos").cast("bigint").alias("pos"))


@query("next_prev_session", duck(
    """SELECT q.d, (SELECT min(t.d) FROM tcal t WHERE t.d > q.d) AS next_d, (SELECT max(t.d) FROM tcal t WHERE t.d < q.d) AS prev_d
       FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) q""", *HOL, SCHED, TCAL))
def next_prev_session(spark, sf_dir):
    from tidemark.operators.asof import asof_backward, asof_forward

    asked = src.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    sessions = cal.trading_calendar(observed(spark, sf_dir)).select("d")
    nxt = asof_forward(asked, sessions.select(F.col("d").alias("next_d")), left_ts="d", right_ts="next_d", payload=["next_d"], strict=True)
    before = sessions.select(F.col("d").alias("prev_d"), F.date_add("d", 1).alias("from_d"))
    return asof_backward(nxt, before, left_ts="d", right_ts="from_d", payload=["prev_d"])


@query("month_end_flags", duck(
    """SELECT d, next_sched, is_month_end::BIGINT AS is_month_end,
              (next_sched - d > 1 AND NOT (isodow(d) = 5 AND next_sched - d = 3))::INTEGER::BIGINT AS is_pre_holiday, month_last FROM (
         SELECT s.d, min(x.d) AS next_sched, (date_trunc('month', min(x.d)) <> date_trunc('month', s.d))::INTEGER AS is_month_end,
                max(s.d) OVER (PARTITION BY date_trunc('month', s.d)) AS month_last
         FROM ses s LEFT JOIN sched x ON x.d > s.d AND x.d <= s.d + 15 GROUP BY s.d)""", *HOL, SCHED))
def month_end_flags(spark, sf_dir):
    days = observed(spark, sf_dir)
    scheduled = cal.business_days(bounds_of(days), "lo", "hi")
    month_last = days.groupBy(F.trunc("d", "MM").alias("m")).agg(F.max("d").alias("month_last"))
    out = cal.schedule_flags(days, scheduled).join(month_last, F.trunc("d", "MM") == F.col("m"))
    return out.select("d", "next_sched", F.col("is_month_end").cast("bigint").alias("is_month_end"),
                      F.col("is_pre_holiday").cast("bigint").alias("is_pre_holiday"), "month_last")


REQ_HOL = holidays_sql("rhol", years_sql("a", "b", "(SELECT ts::DATE AS d FROM req)", 1))
REQ_CAL = """rcal AS (SELECT d FROM (SELECT unnest(generate_series(min(ts)::DATE - 10, max(ts)::DATE + 20, INTERVAL 1 DAY))::DATE AS d FROM req)
  WHERE isodow(d) < 6 AND d NOT IN (SELECT d FROM rhol))"""
REQ_POST = """posted AS (
  SELECT r.*, r.local_ts::DATE AS req_d, r.local_ts::DATE IN (SELECT d FROM rcal) AS is_session,
    CASE WHEN r.local_ts::DATE IN (SELECT d FROM rcal) AND hour(r.local_ts) < 12 THEN r.local_ts::DATE
         ELSE n.next_d END AS post_d
  FROM (SELECT *, ts - INTERVAL 5 HOUR AS local_ts FROM req) r
  JOIN (SELECT q.d, min(c.d) AS next_d FROM (SELECT DISTINCT (ts - INTERVAL 5 HOUR)::DATE AS d FROM req) q JOIN rcal c ON c.d > q.d GROUP BY q.d) n
    ON n.d = r.local_ts::DATE)"""
POSTED = (*REQ_HOL, REQ_CAL, REQ_POST)


def request_span(requests):
    """(lo, hi): days around the requests; one scan of one column, written."""
    return materialize(requests.agg(F.date_sub(F.to_date(F.min("ts")), 10).alias("lo"), F.date_add(F.to_date(F.max("ts")), 20).alias("hi")))


def request_calendar(span):
    """Scheduled sessions of the span."""
    return cal.business_days(span, "lo", "hi")


def posted_rows(requests):
    """Requests with local posting dates; the tables hold UTC instants."""
    span = request_span(requests)
    inner = span.select(F.date_add("lo", 8).alias("lo"), F.date_sub("hi", 18).alias("hi"))
    return cal.posting_dates(requests, request_calendar(span), zone="America/New_York", span=inner)


def posted_requests(spark, sf_dir):
    return posted_rows(src.requests(spark, sf_dir))


@query("posting_date", duck("SELECT req_id, req_d, post_d FROM posted", *POSTED))
def posting_date(spark, sf_dir):
    return posted_requests(spark, sf_dir).select("req_id", "req_d", "post_d")


@query("month_end_trap", duck(
    """SELECT account, count(*)::BIGINT AS n, sum((is_session AND req_d = month_last AND date_trunc('month', post_d) <> date_trunc('month', req_d))::INTEGER)::BIGINT AS trapped
       FROM posted JOIN (SELECT date_trunc('month', d) AS m, max(d) AS month_last FROM rcal GROUP BY 1) ON m = date_trunc('month', req_d) GROUP BY account""", *POSTED))
def month_end_trap(spark, sf_dir):
    return posted_requests(spark, sf_dir).groupBy("account").agg(F.count("*").alias("n"), F.sum("trap").alias("trapped"))


@query("turn_of_month", duck(
    """SELECT d, (nth <= 3 OR is_end)::INTEGER::BIGINT AS turn_of_month, (nth <= 3 OR coalesce(nm <> m, false))::INTEGER::BIGINT AS turn_historical FROM (
         SELECT s.d, s.pos, month(s.d) AS m, row_number() OVER (PARTITION BY date_trunc('month', s.d) ORDER BY s.d) AS nth, lead(month(s.d)) OVER (ORDER BY s.d) AS nm,
                date_trunc('month', x.next_sched) <> date_trunc('month', s.d) AS is_end
         FROM ses s JOIN (SELECT s.d, min(x.d) AS next_sched FROM ses s JOIN sched x ON x.d > s.d AND x.d <= s.d + 15 GROUP BY s.d) x ON x.d = s.d)""", *HOL, SCHED))
def turn_of_month(spark, sf_dir):
    return turn_flags(observed(spark, sf_dir)).select(
        "d", F.col("turn_of_month").cast("bigint").alias("turn_of_month"), F.col("turn_historical").cast("bigint").alias("turn_historical"))


def turn_flags(days):
    """First three sessions of a month or its scheduled last one; the historical form looks at the next session."""
    flagged = cal.schedule_flags(days.select("d"), cal.business_days(bounds_of(days), "lo", "hi"))
    nth = F.row_number().over(W.partitionBy(F.trunc("d", "MM")).orderBy("d"))
    nxt = F.lead(F.month("d")).over(W.orderBy("d"))
    return flagged.select(
        "d", "is_month_end", "is_pre_holiday", nth.alias("nth"),
        ((nth <= 3) | (F.col("is_month_end") == 1)).cast("int").alias("turn_of_month"),
        ((nth <= 3) | F.coalesce(nxt != F.month("d"), F.lit(False))).cast("int").alias("turn_historical"))


@query("availability_dates", duck(
    """SELECT obs_d, (obs_d + CASE isodow(obs_d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END::INTEGER)::DATE AS next_weekday, (obs_d + 1)::DATE AS next_day,
         (date_trunc('month', obs_d) + INTERVAL 1 MONTH + INTERVAL 14 DAY)::DATE AS mid_next_month,
         (date_trunc('month', obs_d) + INTERVAL 1 MONTH + INTERVAL 7 DAY)::DATE AS eighth_next_month,
         (obs_d - INTERVAL 12 MONTH)::DATE AS year_back FROM (SELECT DISTINCT o_orderdate::DATE AS obs_d FROM orders)"""))
def availability_dates(spark, sf_dir):
    days = src.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("obs_d")).distinct()
    d = F.col("obs_d")
    return days.select("obs_d", cal.next_weekday(d).alias("next_weekday"), F.date_add(d, 1).alias("next_day"),
                       cal.next_month_day(d, 15).alias("mid_next_month"), cal.next_month_day(d, 8).alias("eighth_next_month"), cal.year_back(d).alias("year_back"))


@query("calendar_window", duck(
    """SELECT e.entity, m.month, round(r.ret_pct, 6) + 0.0 AS ret_pct FROM ent e CROSS JOIN (
         SELECT unnest(generate_series((date_trunc('month', max(d)) - INTERVAL 120 MONTH)::DATE, (date_trunc('month', max(d)) - INTERVAL 1 MONTH)::DATE, INTERVAL 1 MONTH))::DATE AS month FROM panel) m
       LEFT JOIN me r ON r.entity = e.entity AND r.month = m.month""",
    """me AS (SELECT entity, month, 100 * (last_px / lag(last_px) OVER (PARTITION BY entity ORDER BY month) - 1) AS ret_pct FROM (
         SELECT entity, date_trunc('month', d)::DATE AS month, arg_max(px, d) AS last_px FROM panel GROUP BY 1, 2))"""))
def calendar_window(spark, sf_dir):
    from tidemark.operators.history import calendar_months, month_end_returns

    panel = src.panel_table(spark, sf_dir)
    rets = month_end_returns(panel)
    return calendar_months(panel, 120).join(rets, ["entity", "month"], "left").select("entity", "month", F.round("ret_pct", 6).alias("ret_pct"))
