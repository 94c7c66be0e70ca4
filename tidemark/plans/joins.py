"""Join queries: as-of, forward as-of, interval, event-window, proximity and dimension lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.columns import big, change, r6
from tidemark.operators import asof, bands, calendars as cal, windows as op
from tidemark.plans.base import duck, query, rd
from tidemark.plans.windows import ROWS, RUN, WIN, release_features
from tidemark.session import materialize
from tidemark.sources import tables as src

RATE_COLUMNS = ["effr", "ust_3m", "ust_2y", "ust_10y", "spread_10y_2y", "spread_10y_3m"]


def minute(ts):
    return F.date_trunc("minute", ts)


def sessions(spark, sf_dir):
    """(d, pos) from one scan of the ship dates, written because most plans read the calendar twice."""
    days = materialize(src.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct())
    return numbered(days)


def numbered(days):
    """Distinct days with their position in the calendar."""
    return days.select("d", (F.row_number().over(W.orderBy("d")) - 1).alias("pos"))


def rates_known(spark, sf_dir, days, cube=None):
    """Daily rates as known on each calendar day; holiday NULLs are passed on."""
    rates = src.daily_rates(spark, sf_dir, cube).withColumn("available_on", cal.next_weekday(F.col("obs_d")))
    return asof.asof_on_calendar(days, rates, available_on="available_on", payload=["obs_d", *RATE_COLUMNS], seq="obs_d")


@query("asof_backward", duck("SELECT p.entity, p.d, r.obs_d, r.effr FROM panel p ASOF LEFT JOIN rates_last r ON p.d >= r.available_on"))
def asof_backward(spark, sf_dir):
    panel = src.panel_table(spark, sf_dir)
    known = rates_known(spark, sf_dir, panel.select("d").distinct())
    return panel.select("entity", "d").join(known, "d").select("entity", "d", "obs_d", "effr")


@query("asof_backward_keyed", duck(
    """SELECT l.req_id, r.req_id AS view_id, r.ts::DATE AS view_d FROM (SELECT * FROM req WHERE target = 'purchase') l
       ASOF LEFT JOIN (SELECT * FROM req WHERE target = 'view') r ON l.account = r.account AND l.ts >= r.ts"""))
def asof_backward_keyed(spark, sf_dir):
    """Latest view before each purchase of the same account; accounts are split by minute, so no account is one task's work."""
    req = src.requests(spark, sf_dir)
    views = req.filter(F.col("target") == "view").select("account", "ts", F.col("req_id").alias("view_id"), F.to_date("ts").alias("view_d"))
    out = asof.asof_backward(req.filter(F.col("target") == "purchase"), views, left_ts="ts", right_ts="ts", by=("account",),
                             payload=["view_id", "view_d"], seq="view_id", bucket=minute)
    return out.select("req_id", "view_id", "view_d")


@query("asof_forward_keyed", duck(
    """SELECT l.req_id, r.req_id AS next_id FROM (SELECT * FROM req WHERE target = 'error') l
       ASOF LEFT JOIN (SELECT * FROM req WHERE target = 'signup') r ON l.account = r.account AND l.ts <= r.ts"""))
def asof_forward_keyed(spark, sf_dir):
    req = src.requests(spark, sf_dir)
    nxt = req.filter(F.col("target") == "signup").select("account", "ts", F.col("req_id").alias("next_id"))
    out = asof.asof_forward(req.filter(F.col("target") == "error"), nxt, left_ts="ts", right_ts="ts", by=("account",), payload=["next_id"], bucket=minute)
    return out.select("req_id", "next_id")


RELEASES = """tr AS (SELECT month, cpi / lag(cpi, 12) OVER (ORDER BY month) - 1 AS yoy, cpi / lag(cpi, 3) OVER (ORDER BY month) - 1 AS chg_3m,
      CASE WHEN count(unemp) OVER t >= 12 THEN unemp - min(unemp) OVER t END AS gap,
      (date_trunc('month', month) + INTERVAL 1 MONTH + INTERVAL 14 DAY)::DATE AS mid, (date_trunc('month', month) + INTERVAL 1 MONTH + INTERVAL 7 DAY)::DATE AS eighth
    FROM rel WINDOW t AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


@query("asof_monthly_release", duck(
    f"""SELECT s.d, {rd('y.yoy')} AS yoy, {rd('g.gap')} AS gap FROM ses s
        ASOF LEFT JOIN (SELECT * FROM tr WHERE yoy IS NOT NULL) y ON s.d >= y.mid
        ASOF LEFT JOIN (SELECT * FROM tr WHERE gap IS NOT NULL) g ON s.d >= g.eighth""", RELEASES))
def asof_monthly_release(spark, sf_dir):
    days = sessions(spark, sf_dir).select("d")
    feats = release_features(src.monthly_releases(spark, sf_dir))
    known = lambda c, day: (feats.filter(F.col(c).isNotNull()).select(c, "month", cal.next_month_day(F.col("month"), day).alias("av")), "av", [c], "month")
    out = asof.asof_many(days, [known("yoy", 15), known("gap", 8)])
    return out.select("d", r6(F.col("yoy")).alias("yoy"), r6(F.col("gap")).alias("gap"))


@query("asof_daily_lag", duck("SELECT s.d, " + ", ".join(f"r.{c}" for c in RATE_COLUMNS) + " FROM ses s ASOF LEFT JOIN rates_last r ON s.d >= r.available_on"))
def asof_daily_lag(spark, sf_dir):
    return rates_known(spark, sf_dir, sessions(spark, sf_dir).select("d")).select("d", *RATE_COLUMNS)


@query("spread_arithmetic", duck(
    f"""SELECT v.d, {rd('r.ust_3m - r.effr')} AS tbill_minus_effr, {rd('v.m21 * 12 * 100 - r.ust_3m')} AS safe_minus_tbill
        FROM (SELECT d, px / lag(px, 21) {WIN} - 1 AS m21, ord FROM dense) v ASOF LEFT JOIN rates_last r ON v.d >= r.available_on WHERE v.ord = 0"""))
def spread_arithmetic(spark, sf_dir):
    panel = src.panel_table(spark, sf_dir)
    dense = src.densify(panel).withColumn("m21", op.total_return(F.col("px"), 21, op.by_entity())).filter("ord = 0").select("d", "m21")
    out = dense.join(rates_known(spark, sf_dir, panel.select("d").distinct()), "d")
    return out.select("d", r6(F.col("ust_3m") - F.col("effr")).alias("tbill_minus_effr"), r6(F.col("m21") * 12 * 100 - F.col("ust_3m")).alias("safe_minus_tbill"))


RISKZ = """riskz AS (SELECT (obs_d + 1)::DATE AS available_on, acts - threats AS diff,
     CASE WHEN count(idx) OVER t >= 60 THEN (idx - avg(idx) OVER t) / stddev_samp(idx) OVER t END AS z
   FROM risk WINDOW t AS (ORDER BY obs_d ROWS BETWEEN 364 PRECEDING AND CURRENT ROW))"""


def risk_known(spark, sf_dir, days):
    w = W.orderBy("obs_d")
    risk = src.risk_index(spark, sf_dir).select(
        F.date_add("obs_d", 1).alias("available_on"), op.zscore(F.col("idx"), 365, 60, w).alias("gpr_z"), (F.col("acts") - F.col("threats")).alias("gpr_diff"))
    out = asof.asof_on_calendar(days, risk, available_on="available_on", payload=["gpr_z", "gpr_diff"])
    return out.withColumn("gpr_spike", F.when(F.col("gpr_z").isNotNull(), F.when(F.col("gpr_z") > 2, 1).otherwise(0)))


@query("asof_zscore_spike", duck(
    f"SELECT s.d, {rd('z')} AS z, {rd('diff')} AS act_minus_threat, CASE WHEN z IS NOT NULL THEN (z > 2)::INTEGER END::BIGINT AS spike FROM ses s ASOF LEFT JOIN riskz r ON s.d >= r.available_on", RISKZ))
def asof_zscore_spike(spark, sf_dir):
    return risk_known(spark, sf_dir, sessions(spark, sf_dir).select("d")).select(
        "d", r6(F.col("gpr_z")).alias("z"), r6(F.col("gpr_diff")).alias("act_minus_threat"), F.col("gpr_spike").cast("bigint").alias("spike"))


@query("asof_with_fallback", duck(
    f"""SELECT l.entity, l.d, {rd('l.level')} AS level, {rd(f'l.level - lag(l.level, 5) OVER (PARTITION BY l.entity ORDER BY l.pos)')} AS chg_5,
          {rd('l.level - 100 * l.rv63')} AS minus_rv, p.pct FROM lv l JOIN pct p USING (entity, d)""",
    f"""lv0 AS (SELECT entity, ord, d, pos, CASE WHEN count(ret) {ROWS(20)} >= 20 THEN stddev_samp(ret) {ROWS(20)} * sqrt(252.0::DOUBLE) END AS rv20,
          CASE WHEN count(ret) {ROWS(63)} >= 63 THEN stddev_samp(ret) {ROWS(63)} * sqrt(252.0::DOUBLE) END AS rv63 FROM rets)""",
    "lv AS (SELECT v.*, coalesce(q.quote, v.rv20) AS level FROM lv0 v ASOF LEFT JOIN quotes q ON v.d >= q.obs_d)",
    """pct AS (SELECT a.entity, a.d, CASE WHEN count(b.level) >= 252 THEN
         round((sum(CASE WHEN round(b.level, 12) < round(a.level, 12) THEN 1 ELSE 0 END) + (sum(CASE WHEN round(b.level, 12) = round(a.level, 12) THEN 1 ELSE 0 END) + 1) / 2.0::DOUBLE) / count(b.level), 6) + 0.0 END AS pct
       FROM lv a LEFT JOIN lv b ON b.entity = a.entity AND b.pos <= a.pos AND a.level IS NOT NULL GROUP BY a.entity, a.d)"""))
def asof_with_fallback(spark, sf_dir):
    w = op.by_entity()
    panel = src.panel_table(spark, sf_dir)
    rv = op.with_returns(src.densify(panel)).select(
        "entity", "d", "pos", op.realized_vol(F.col("ret"), 20, 252, w).alias("rv20"), op.realized_vol(F.col("ret"), 63, 252, w).alias("rv63"))
    known = asof.asof_on_calendar(panel.select("d").distinct(), src.volatility_quotes(spark, sf_dir), available_on="obs_d", payload=["quote"])
    level = rv.join(known, "d", "left").select("entity", "d", "pos", "rv63", F.coalesce("quote", "rv20").alias("level"))
    ranked = op.expanding_rank(level.withColumn("level", F.round("level", 12)), "level", "pos", ["entity"], 252)
    lv = F.col("level")
    return ranked.select("entity", "d", r6(lv).alias("level"), r6(op.row_diff(lv, 5, w)).alias("chg_5"), r6(lv - 100 * F.col("rv63")).alias("minus_rv"), r6(F.col("pct")).alias("pct"))


def shifted_known(spark, sf_dir, days):
    prob = src.forward_dated_probability(spark, sf_dir).select("prob", cal.year_back(F.col("fwd_d")).alias("available_on"))
    return asof.asof_on_calendar(days, prob, available_on="available_on", payload=["prob"])


@query("asof_shifted", duck("SELECT s.d, f.prob FROM ses s ASOF LEFT JOIN (SELECT (fwd_d - INTERVAL 12 MONTH)::DATE AS av, prob FROM fwdprob) f ON s.d >= f.av"))
def asof_shifted(spark, sf_dir):
    return shifted_known(spark, sf_dir, sessions(spark, sf_dir).select("d")).select("d", "prob")


@query("daily_tone_z", duck(
    f"""SELECT q.d, {rd('t.tz')} AS tone_z, {rd('t.vz')} AS volume_z FROM (SELECT DISTINCT ts::DATE AS d FROM events) q ASOF LEFT JOIN z t ON q.d >= t.available_on""",
    """tone AS (SELECT ts::DATE AS obs_d, avg((props::JSON->>'$.k')::DOUBLE) AS tone, count(*)::DOUBLE AS volume FROM events GROUP BY 1)""",
    """z AS (SELECT (obs_d + 1)::DATE AS available_on, CASE WHEN count(*) OVER w >= 5 THEN (tone - avg(tone) OVER w) / stddev_samp(tone) OVER w END AS tz,
         CASE WHEN count(*) OVER w >= 5 THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w END AS vz
       FROM tone WINDOW w AS (ORDER BY obs_d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""))
def daily_tone_z(spark, sf_dir):
    tone = src.tone_source(spark, sf_dir)
    return tone_known(tone, tone.select(F.col("obs_d").alias("d")).distinct(), 20, 5).select(
        "d", r6(F.col("tone_z")).alias("tone_z"), r6(F.col("volume_z")).alias("volume_z"))


def tone_known(tone, days, rows: int = 252, min_rows: int = 60):
    """Daily mean score and count, trailing z-scores, known one day later."""
    w = W.orderBy("obs_d")
    daily = tone.groupBy("obs_d").agg(F.avg("score").alias("tone"), F.count(F.lit(1)).cast("double").alias("volume"))
    z = daily.select(F.date_add("obs_d", 1).alias("available_on"), op.zscore(F.col("tone"), rows, min_rows, w).alias("tone_z"),
                     op.zscore(F.col("volume"), rows, min_rows, w).alias("volume_z"))
    return asof.asof_on_calendar(days, z, available_on="available_on", payload=["tone_z", "volume_z"])


@query("asof_forward", duck("SELECT event_id, category, event_d, loc::BIGINT AS loc FROM evloc"))
def asof_forward(spark, sf_dir):
    return bands.locate_events(sessions(spark, sf_dir), src.event_calendar(spark, sf_dir)).select("event_id", "category", "event_d", big(F.col("loc")).alias("loc"))


@query("align_pair", duck(
    f"""SELECT entity, d, {rd('px / first_value(px) OVER w')} AS a, {rd('bpx / first_value(bpx) OVER w')} AS b FROM (
          SELECT p.entity, p.d, p.px, q.px AS bpx, count(*) OVER (PARTITION BY p.entity) AS n FROM panel p JOIN panel q ON q.d = p.d AND q.ord = 0 WHERE p.ord > 0)
        WHERE n >= 5 WINDOW w AS (PARTITION BY entity ORDER BY d)"""))
def align_pair(spark, sf_dir):
    from tidemark.operators.metrics import aligned

    panel = src.panel_table(spark, sf_dir)
    paths = panel.select(F.col("entity").alias("strategy"), "ord", "d", F.col("px").alias("w"))
    base = paths.filter("ord = 0").select("d", F.col("w").alias("bw"))
    out = aligned(paths.filter("ord > 0").join(base, "d"), ["strategy"])
    return out.select(F.col("strategy").alias("entity"), "d", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))


@query("reconcile", duck(
    f"""SELECT entity, count(calc + off)::BIGINT AS months, {rd('max(abs(calc - off))')} AS max_abs, (coalesce(max(abs(calc - off)), 0) <= 0.01)::INTEGER::BIGINT AS ok,
          count(CASE WHEN off IS NULL THEN 1 END)::BIGINT AS calc_only, count(CASE WHEN calc IS NULL THEN 1 END)::BIGINT AS official_only
        FROM (SELECT coalesce(c.entity, o.entity) AS entity, coalesce(c.month, o.month) AS month, c.calc, o.off FROM calc c FULL JOIN offi o ON c.entity = o.entity AND c.month = o.month)
        WHERE month BETWEEN DATE '1995-06-01' AND DATE '2001-06-01' GROUP BY entity""",
    """me AS (SELECT entity, month, 100 * (last_px / lag(last_px) OVER (PARTITION BY entity ORDER BY month) - 1) AS calc FROM (
         SELECT entity, date_trunc('month', d)::DATE AS month, arg_max(px, d) AS last_px FROM panel GROUP BY 1, 2))""",
    "calc AS (SELECT * FROM me WHERE calc IS NOT NULL)",
    """offi AS (SELECT entity, month, round(100 * (lp / lag(lp) OVER (PARTITION BY entity ORDER BY month) - 1), 2) AS off FROM (
         SELECT entity, date_trunc('month', d)::DATE AS month, arg_max(coalesce(px, -1), d) AS lp FROM dense GROUP BY 1, 2) WHERE lp > 0 QUALIFY off IS NOT NULL)"""))
def reconcile(spark, sf_dir):
    """Returns computed from daily rows against the published monthly table (2 decimals, full month ends only)."""
    from tidemark.operators.history import month_end_returns

    panel = src.panel_table(spark, sf_dir)
    calc = month_end_returns(panel).filter("ret_pct IS NOT NULL").withColumnRenamed("ret_pct", "calc")
    ends = src.densify(panel).groupBy("entity", F.trunc("d", "MM").alias("month")).agg(F.max_by(F.coalesce("px", F.lit(-1.0)), "d").alias("px")).filter("px > 0")
    w = W.partitionBy("entity").orderBy("month")
    off = ends.select("entity", "month", F.round(100.0 * change(F.col("px"), F.lag("px").over(w)), 2).alias("off")).filter("off IS NOT NULL")
    both = calc.join(off, ["entity", "month"], "full").filter(F.col("month").between(F.lit("1995-06-01").cast("date"), F.lit("2001-06-01").cast("date")))
    gap = F.max(F.abs(F.col("calc") - F.col("off")))
    return both.groupBy("entity").agg(
        F.count(F.col("calc") + F.col("off")).alias("months"), r6(gap).alias("max_abs"), (F.coalesce(gap, F.lit(0.0)) <= 0.01).cast("int").cast("bigint").alias("ok"),
        F.count(F.when(F.col("off").isNull(), 1)).alias("calc_only"), F.count(F.when(F.col("calc").isNull(), 1)).alias("official_only"))


@query("reindex_lagged", duck(
    """SELECT m.month, lag(r.cpi) OVER (ORDER BY m.month) AS cpi_lag, lag(r.unemp) OVER (ORDER BY m.month) AS unemp_lag
       FROM (SELECT DISTINCT date_trunc('month', d)::DATE AS month FROM ses) m LEFT JOIN rel r USING (month)"""))
def reindex_lagged(spark, sf_dir):
    months = src.table(spark, sf_dir, "lineitem").select(F.trunc(F.to_date("l_shipdate"), "MM").alias("month")).distinct()
    w = W.orderBy("month")
    return months.join(src.monthly_releases(spark, sf_dir), "month", "left").select(
        "month", F.lag("cpi").over(w).alias("cpi_lag"), F.lag("unemp").over(w).alias("unemp_lag"))


# Cycle intervals; the first one has no start.
CYCLES = [(None, "1994-12-31"), ("1996-03-01", "1996-11-30"), ("1998-07-15", "1999-01-15"), ("2001-03-01", "2001-06-30")]


def cycles(spark):
    return spark.createDataFrame(CYCLES, "start string, stop string").select(F.col("start").cast("date").alias("start"), F.col("stop").cast("date").alias("stop"))


CYCLE_SQL = "cyc AS (SELECT a::DATE AS a, b::DATE AS b FROM (VALUES " + ", ".join(f"({'NULL' if a is None else repr(a)}, '{b}')" for a, b in CYCLES) + ") t(a, b))"


@query("interval_flag", duck("SELECT s.d, EXISTS (SELECT 1 FROM cyc WHERE a IS NOT NULL AND b IS NOT NULL AND s.d BETWEEN a AND b)::INTEGER::BIGINT AS inside FROM ses s", CYCLE_SQL))
def interval_flag(spark, sf_dir):
    return bands.in_intervals(sessions(spark, sf_dir), cycles(spark)).select("d", big(F.col("inside")).alias("inside"))


PRE, POST = 20, 120
EVENT_ROWS = f"""evrows AS (SELECT e.event_id, e.category, r.entity, r.ord, o.off, r.ret FROM evloc e
   CROSS JOIN (SELECT unnest(range(-{PRE}, {POST + 1})) AS off) o JOIN rets r ON r.pos = e.loc + o.off
   WHERE e.loc >= {PRE} AND e.loc + {POST} < (SELECT count(*) FROM ses))"""


def event_rows(spark, sf_dir, pre: int = PRE, post: int = POST):
    """Returns of every entity at each offset of each usable event: explode, then equi-join on position."""
    panel = src.panel_table(spark, sf_dir)
    rets = op.with_returns(src.densify(panel)).select("entity", "ord", "pos", "ret")
    ses = src.sessions(panel)
    n = ses.agg(F.count(F.lit(1)).alias("n")).scalar()
    located = bands.locate_events(ses, src.event_calendar(spark, sf_dir))
    return bands.event_offsets(located, pre, post, n).join(rets, "pos").select("event_id", "category", "entity", "ord", "off", "ret")


@query("event_window_join", duck(f"SELECT event_id, category, entity, off::BIGINT AS off, {rd('ret')} AS ret FROM evrows", EVENT_ROWS))
def event_window_join(spark, sf_dir):
    return event_rows(spark, sf_dir).select("event_id", "category", "entity", big(F.col("off")).alias("off"), r6(F.col("ret")).alias("ret"))


@query("active_window_flag", duck(
    """SELECT s.d, c.category, coalesce(max((s.pos BETWEEN e.loc AND e.loc + 20)::INTEGER), 0)::BIGINT AS active
       FROM ses s CROSS JOIN (SELECT DISTINCT category FROM evcal) c LEFT JOIN evloc e ON e.category = c.category GROUP BY ALL"""))
def active_window_flag(spark, sf_dir):
    out = bands.active_window(sessions(spark, sf_dir), src.event_calendar(spark, sf_dir), 21)
    return out.select("d", "category", big(F.col("active")).alias("active"))


@query("proximity_semi", duck(
    """SELECT b.entity, b.d FROM rk b WHERE b.rb <= 50 AND EXISTS (SELECT 1 FROM rk w WHERE w.entity = b.entity AND w.rw <= 50 AND abs(w.pos - b.pos) <= 10)""",
    """rk AS (SELECT entity, d, pos, row_number() OVER (PARTITION BY entity ORDER BY ret DESC, d) AS rb, row_number() OVER (PARTITION BY entity ORDER BY ret, d) AS rw
         FROM rets WHERE ret IS NOT NULL)"""))
def proximity_semi(spark, sf_dir):
    rets = op.with_returns(src.dense_panel(spark, sf_dir)).filter("ret IS NOT NULL").select("entity", "d", "pos", "ret")
    best = W.partitionBy("entity").orderBy(F.desc("ret"), "d")
    worst = W.partitionBy("entity").orderBy("ret", "d")
    ranked = rets.withColumn("rb", F.row_number().over(best)).withColumn("rw", F.row_number().over(worst))
    return bands.near_positions(ranked.filter("rb <= 50"), ranked.filter("rw <= 50"), 10).select("entity", "d")


BINS = """rbins AS (SELECT i AS bin, i / 10.0::DOUBLE AS low, (i + 1) / 10.0::DOUBLE AS high, count(s.p) AS n, avg(s.p) AS mean_predicted, avg(s.y) AS empirical_rate
  FROM range(10) t(i) LEFT JOIN scored s ON least(floor(s.p * 10), 9) = i GROUP BY i)"""


@query("bin_lookup", duck(
    """SELECT d.doc_id, (c.bin IS NOT NULL)::INTEGER::BIGINT AS exact, coalesce(c.bin, x.bin)::BIGINT AS bin FROM (SELECT doc_id, n_chars / (n_chars + 2000.0) AS p FROM documents) d
       LEFT JOIN LATERAL (SELECT bin FROM rbins WHERE n > 0 AND low <= d.p AND d.p <= high ORDER BY bin LIMIT 1) c ON true
       LEFT JOIN LATERAL (SELECT bin FROM rbins WHERE n > 0 ORDER BY abs(mean_predicted - d.p), bin LIMIT 1) x ON true""", BINS))
def bin_lookup(spark, sf_dir):
    from tidemark.operators.evaluation import reliability_bins

    bins = reliability_bins(src.scored_documents(spark, sf_dir), "p", "y")
    docs = src.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("p"))
    return bands.bin_lookup(docs, bins, "p").select("doc_id", big(F.col("exact")).alias("exact"), big(F.col("bin")).alias("bin"))


@query("dim_lookup", duck(
    f"""SELECT n_name AS nation, r_name AS label, count(*)::BIGINT AS n, {rd('sum(o_totalprice)', 2)} AS value FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""))
def dim_lookup(spark, sf_dir):
    """Fact rows are summed per customer before the customer join, so a hot customer is one row of it."""
    per_customer = src.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))
    homes = src.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    by_nation = per_customer.join(homes, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return (
        by_nation.join(src.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(src.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_name").alias("nation"), F.col("r_name").alias("label"), "n", F.round("v", 2).alias("value")))


# Experiment blocks (cadence, horizon, lag) in their order of precedence.
BLOCKS = [("daily", 21, 1), ("daily", 21, 2), ("daily", 63, 1), ("monthly", 1, 1), ("monthly", 1, 2)]
BLOCK_SQL = "blocks AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', {h}, {l})" for i, (c, h, l) in enumerate(BLOCKS)) + ") t(block, cadence, h, lag))"


def on_blocks(df):
    """Every row once per experiment block: a literal array is exploded, nothing is joined."""
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), F.lit(c).alias("cadence"), F.lit(h).alias("h"), F.lit(l).alias("lag")) for i, (c, h, l) in enumerate(BLOCKS)])
    return df.withColumn("b", F.explode(blocks)).select(*df.columns, "b.block", "b.cadence", "b.h", "b.lag")


@query("experiment_grid", duck(
    """SELECT b.block::BIGINT AS block, b.cadence, b.h::BIGINT AS h, b.lag::BIGINT AS lag, s.entity AS strategy, q.entity AS baseline, s.n::BIGINT AS n_rows
       FROM blocks b CROSS JOIN (SELECT entity, ord, count(*) AS n FROM panel GROUP BY 1, 2) s CROSS JOIN ent q WHERE q.ord IN (0, 2) AND s.ord <> q.ord""", BLOCK_SQL))
def experiment_grid(spark, sf_dir):
    counts = src.panel(spark, sf_dir).groupBy("entity", "ord").agg(F.count(F.lit(1)).alias("n"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("ord", "entity"))), lambda e: e)
    base = counts.agg(F.filter(names, lambda e: e["ord"].isin(0, 2)).alias("b")).scalar()
    pairs = counts.withColumn("q", F.explode(base)).filter(F.col("q.ord") != F.col("ord")).select(
        F.col("entity").alias("strategy"), F.col("q.entity").alias("baseline"), F.col("n").alias("n_rows"))
    return on_blocks(pairs).select(big(F.col("block")).alias("block"), "cadence", big(F.col("h")).alias("h"), big(F.col("lag")).alias("lag"), "strategy", "baseline", "n_rows")


LEADERS = """lead0 AS (SELECT k AS strategy, d, pos, entity, ord, px / lag(px, n) OVER (PARTITION BY k, entity ORDER BY pos) - 1 AS m
  FROM dense CROSS JOIN (VALUES ('leader_21', 21), ('leader_63', 63)) t(k, n)),
path AS (SELECT strategy, d, pos, min_by(entity, ord) AS name FROM (SELECT *, max(m) OVER (PARTITION BY strategy, d) AS mx FROM lead0) WHERE m = mx GROUP BY 1, 2, 3)"""


def leader_paths(spark, sf_dir):
    """(strategy, d, pos, name): the entity leading over 21 and over 63 sessions."""
    dense = src.dense_panel(spark, sf_dir)
    w = op.by_entity()
    scored = dense.select("entity", "ord", "d", "pos", *[op.total_return(F.col("px"), n, w).alias(f"leader_{n}") for n in (21, 63)])
    long = scored.unpivot(["entity", "ord", "d", "pos"], ["leader_21", "leader_63"], "strategy", "m").filter("m IS NOT NULL")
    return long.groupBy("strategy", "d", "pos").agg(F.max_by("entity", F.struct("m", -F.col("ord"))).alias("name"))


@query("whipsaws", duck(
    """SELECT p.strategy, coalesce(count(DISTINCT i), 0)::BIGINT AS whipsaws FROM (SELECT DISTINCT strategy FROM path) p LEFT JOIN (
         SELECT a.strategy, a.i FROM sw a JOIN sw b ON b.strategy = a.strategy AND b.frm = a.dst AND b.dst = a.frm AND b.i - a.i BETWEEN 1 AND 21) x ON x.strategy = p.strategy GROUP BY 1""",
    LEADERS,
    """sw AS (SELECT strategy, pos AS i, prev AS frm, name AS dst FROM (SELECT *, lag(name) OVER (PARTITION BY strategy ORDER BY pos) AS prev FROM path) WHERE prev <> name)"""))
def whipsaws(spark, sf_dir):
    path = leader_paths(spark, sf_dir)
    hits = bands.whipsaws(path, "name").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    return path.select("strategy").distinct().join(hits, "strategy", "left").select("strategy", F.coalesce("n", F.lit(0)).cast("bigint").alias("whipsaws"))


# Vintages on offer; horizons up to 2028 take the income option.
VINTAGES = list(range(2030, 2080, 5))


@query("nearest_option", duck(
    """SELECT c_custkey, y::BIGINT AS year, CASE WHEN y <= 2028 THEN 'INCOME' ELSE (SELECT v::VARCHAR FROM (SELECT unnest(range(2030, 2080, 5)) AS v) ORDER BY abs(v - y), v LIMIT 1) END AS option
       FROM (SELECT c_custkey, 2025 + floor(abs(c_acctbal))::BIGINT % 60 AS y FROM customer)"""))
def nearest_option(spark, sf_dir):
    y = F.lit(2025) + F.floor(F.abs("c_acctbal")) % 60
    best = F.array_min(F.transform(F.array(*[F.lit(v) for v in VINTAGES]), lambda v: F.struct(F.abs(v - F.col("year")).alias("gap"), v.alias("v"))))
    return src.table(spark, sf_dir, "customer").select("c_custkey", big(y).alias("year")).select(
        "c_custkey", "year", F.when(F.col("year") <= 2028, "INCOME").otherwise(best["v"].cast("string")).alias("option"))
