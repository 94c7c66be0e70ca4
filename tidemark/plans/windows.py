"""Row-window queries over the dense panel."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.columns import change, r6
from tidemark.operators import windows as op
from tidemark.plans.base import duck, query, rd
from tidemark.sources import tables as src

P = op.by_entity
WIN = "OVER (PARTITION BY entity ORDER BY pos)"


def ROWS(n: int) -> str:
    return f"OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RUN = "OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("momentum", duck("SELECT entity, d, " + ", ".join(
    f"{rd(f'px / lag(px, {n}) {WIN} - 1')} AS mom_{n}" for n in (21, 63, 126, 252)) + " FROM dense"))
def momentum(spark, sf_dir):
    dense = src.dense_panel(spark, sf_dir)
    return dense.select("entity", "d", *[r6(op.total_return(F.col("px"), n, P())).alias(f"mom_{n}") for n in (21, 63, 126, 252)])


@query("momentum_by_supplier", duck(
    f"""SELECT entity, d, {rd('px / lag(px, 5) OVER (PARTITION BY entity ORDER BY d) - 1')} AS mom_5, {rd('px / max(px) OVER (PARTITION BY entity ORDER BY d) - 1')} AS dd FROM (
          SELECT l_suppkey AS entity, l_shipdate::DATE AS d, round(100 + 10 * ln(sum(l_extendedprice) / sum(l_quantity)), 6) AS px FROM lineitem GROUP BY 1, 2)"""))
def momentum_by_supplier(spark, sf_dir):
    """The same windows on a panel whose entity count grows with the data: one shuffle on the entity."""
    w = op.by_entity(order="d")
    px = F.col("px")
    return src.wide_panel_by_supplier(spark, sf_dir).select("entity", "d", r6(op.total_return(px, 5, w)).alias("mom_5"), r6(op.drawdown(px, w)).alias("dd"))


@query("momentum_skip", duck(f"SELECT entity, d, {rd(f'lag(px, 21) {WIN} / lag(px, 252) {WIN} - 1')} AS mom_12_1 FROM dense"))
def momentum_skip(spark, sf_dir):
    dense = src.dense_panel(spark, sf_dir)
    return dense.select("entity", "d", r6(op.skip_return(F.col("px"), 21, 252, P())).alias("mom_12_1"))


@query("simple_returns", duck(f"SELECT entity, d, {rd('ret')} AS ret, {rd(f'px / lag(px) {WIN} - 1')} AS ret_unpadded FROM rets"))
def simple_returns(spark, sf_dir):
    return op.with_returns(src.dense_panel(spark, sf_dir)).select(
        "entity", "d", r6(F.col("ret")).alias("ret"), r6(op.total_return(F.col("px"), 1, P())).alias("ret_unpadded"))


@query("realized_vol", duck("SELECT entity, d, " + ", ".join(
    f"{rd(f'CASE WHEN count(ret) {ROWS(n)} >= {n} THEN stddev_samp(ret) {ROWS(n)} * sqrt(252.0::DOUBLE) END')} AS rv{n}" for n in (20, 63))
    + " FROM rets"))
def realized_vol(spark, sf_dir):
    rets = op.with_returns(src.dense_panel(spark, sf_dir))
    return rets.select("entity", "d", *[r6(op.realized_vol(F.col("ret"), n, 252, P())).alias(f"rv{n}") for n in (20, 63)])


@query("drawdown", duck(f"SELECT entity, d, {rd(f'px / max(px) {RUN} - 1')} AS dd FROM dense"))
def drawdown(spark, sf_dir):
    return src.dense_panel(spark, sf_dir).select("entity", "d", r6(op.drawdown(F.col("px"), P())).alias("dd"))


@query("rows_since_peak", duck(
    f"SELECT entity, d, (pos - CASE WHEN first_value(px) {RUN} IS NULL THEN 0 ELSE coalesce(max(CASE WHEN px >= pk THEN pos END) {RUN}, 0) END)::BIGINT AS since_peak FROM pk",
    f"pk AS (SELECT *, max(px) {RUN} AS pk FROM dense)"))
def rows_since_peak(spark, sf_dir):
    out = op.rows_since_peak(src.dense_panel(spark, sf_dir), "px", P())
    return out.select("entity", "d", F.col("since_peak").cast("bigint").alias("since_peak"))


SMA = (50, 100, 200, 210)


def _sma(n: int) -> str:
    return f"CASE WHEN count(px) {ROWS(n)} >= {n} THEN avg(px) {ROWS(n)} END"


@query("sma_flags", duck(
    "SELECT entity, d, " + ", ".join(f"CASE WHEN m{n} IS NOT NULL THEN CASE WHEN px > m{n} THEN 1 ELSE 0 END END::BIGINT AS above_{n}" for n in SMA)
    + f", {rd(f'm200 / lag(m200, 20) {WIN} - 1')} AS slope_200 FROM sma",
    "sma AS (SELECT entity, pos, d, px, " + ", ".join(f"{_sma(n)} AS m{n}" for n in SMA) + " FROM dense)"))
def sma_flags(spark, sf_dir):
    px = F.col("px")
    dense = src.dense_panel(spark, sf_dir).withColumn("m200", op.moving_average(px, 200, P()))
    return dense.select(
        "entity", "d", *[op.above_average(px, n, P()).cast("bigint").alias(f"above_{n}") for n in SMA],
        r6(change(F.col("m200"), F.lag("m200", 20).over(P()))).alias("slope_200"))


VOL63 = f"CASE WHEN count(ret) {ROWS(63)} >= 63 THEN stddev_samp(ret) {ROWS(63)} * sqrt(252.0::DOUBLE) END"


@query("expanding_pct_rank", duck(
    """SELECT a.entity, a.d, CASE WHEN count(b.v) >= 252 THEN
         round((sum(CASE WHEN b.v < a.v THEN 1 ELSE 0 END) + (sum(CASE WHEN b.v = a.v THEN 1 ELSE 0 END) + 1) / 2.0::DOUBLE) / count(b.v), 6) + 0.0 END AS pct
       FROM v a LEFT JOIN v b ON b.entity = a.entity AND b.pos <= a.pos AND a.v IS NOT NULL GROUP BY a.entity, a.d""",
    f"v AS (SELECT entity, d, pos, px AS v FROM dense)"))
def expanding_pct_rank(spark, sf_dir):
    dense = src.dense_panel(spark, sf_dir).select("entity", "d", "pos", "px")
    return op.expanding_rank(dense, "px", "pos", ["entity"], 252).select("entity", "d", r6(F.col("pct")).alias("pct"))


@query("rolling_zscore", duck("SELECT entity, d, " + ", ".join(
    rd(f"CASE WHEN count(px) {ROWS(n)} >= {m} THEN (px - avg(px) {ROWS(n)}) / stddev_samp(px) {ROWS(n)} END") + f" AS z_{n}"
    for n, m in ((365, 60), (252, 60))) + " FROM dense"))
def rolling_zscore(spark, sf_dir):
    px = F.col("px")
    return src.dense_panel(spark, sf_dir).select(
        "entity", "d", *[r6(op.zscore(px, n, m, P())).alias(f"z_{n}") for n, m in ((365, 60), (252, 60))])


@query("row_diff", duck("SELECT entity, d, " + ", ".join(f"{rd(f'px - lag(px, {k}) {WIN}')} AS diff_{k}" for k in (1, 3, 5, 63)) + " FROM dense"))
def row_diff(spark, sf_dir):
    return src.dense_panel(spark, sf_dir).select("entity", "d", *[r6(op.row_diff(F.col("px"), k, P())).alias(f"diff_{k}") for k in (1, 3, 5, 63)])


@query("rolling_risk", duck(f"""SELECT entity, d,
    {rd(f'CASE WHEN count(rv20) {ROWS(63)} >= 63 THEN stddev_samp(rv20) {ROWS(63)} END')} AS vvol,
    {rd(f'CASE WHEN count(ret) {ROWS(63)} >= 63 THEN sqrt(avg(least(ret, 0.0::DOUBLE) * least(ret, 0.0::DOUBLE)) {ROWS(63)}) END')} AS downside,
    {rd(f'CASE WHEN count(dd) {ROWS(63)} >= 63 THEN sqrt(avg(dd * dd) {ROWS(63)}) END')} AS ulcer,
    {rd(f'(px / m200 - 1) / nullif(rv63, 0)')} AS dist_vol FROM base""",
    f"""base AS (SELECT entity, pos, d, px, ret, px / max(px) {RUN} - 1 AS dd, {_sma(200)} AS m200, {VOL63} AS rv63,
        CASE WHEN count(ret) {ROWS(20)} >= 20 THEN stddev_samp(ret) {ROWS(20)} * sqrt(252.0::DOUBLE) END AS rv20 FROM rets)"""))
def rolling_risk(spark, sf_dir):
    px, ret = F.col("px"), F.col("ret")
    base = op.with_returns(src.dense_panel(spark, sf_dir)).select(
        "entity", "pos", "d", "px", "ret", op.drawdown(px, P()).alias("dd"), op.moving_average(px, 200, P()).alias("m200"),
        op.realized_vol(ret, 63, 252, P()).alias("rv63"), op.realized_vol(ret, 20, 252, P()).alias("rv20"))
    t = op.trailing(P(), 63)
    loss = F.when(ret.isNotNull(), F.least(ret, F.lit(0.0)))
    return base.select(
        "entity", "d",
        r6(F.when(F.count("rv20").over(t) >= 63, F.stddev_samp("rv20").over(t))).alias("vvol"),
        r6(F.when(F.count("ret").over(t) >= 63, F.sqrt(F.avg(loss * loss).over(t)))).alias("downside"),
        r6(F.when(F.count("dd").over(t) >= 63, F.sqrt(F.avg(F.col("dd") * F.col("dd")).over(t)))).alias("ulcer"),
        r6(F.try_divide(px / F.col("m200") - 1.0, F.col("rv63"))).alias("dist_vol"))


@query("cross_rank", duck(
    """SELECT entity, d, CASE WHEN m IS NOT NULL THEN rank() OVER (PARTITION BY d ORDER BY m NULLS LAST)
              + (count(*) OVER (PARTITION BY d, m) - 1) / 2.0::DOUBLE END AS xrank FROM v""",
    f"v AS (SELECT entity, d, px / lag(px, 252) {WIN} - 1 AS m, ord FROM dense)", "w AS (SELECT 1)").replace("FROM v", "FROM v WHERE ord >= 2"))
def cross_rank(spark, sf_dir):
    dense = src.dense_panel(spark, sf_dir).withColumn("m", op.total_return(F.col("px"), 252, P())).filter("ord >= 2")
    return op.cross_rank(dense, "m").select("entity", "d", "xrank")


@query("dual_momentum_flag", duck(
    """SELECT v.entity, v.d, CASE WHEN v.m IS NULL OR s.m IS NULL THEN NULL WHEN v.ord = b.best AND v.m > s.m THEN 1 ELSE 0 END::BIGINT AS dual_mom
       FROM v LEFT JOIN v s ON s.d = v.d AND s.ord = 0
       LEFT JOIN (SELECT d, arg_max(ord, m * 1e0 - ord * 0) AS x, min(CASE WHEN m = mx THEN ord END) AS best
                  FROM (SELECT d, ord, m, max(m) OVER (PARTITION BY d) AS mx FROM v WHERE ord >= 2) GROUP BY d) b ON b.d = v.d
       WHERE v.ord >= 2""",
    f"v AS (SELECT entity, ord, d, px / lag(px, 252) {WIN} - 1 AS m FROM dense)"))
def dual_momentum_flag(spark, sf_dir):
    dense = src.dense_panel(spark, sf_dir).withColumn("m", op.total_return(F.col("px"), 252, P()))
    return dual_flags(dense).select("entity", "d", F.col("dual_mom").cast("bigint").alias("dual_mom"))


def dual_flags(df):
    """Leader among the risky peers (ord >= 2) that also beats the safe entity; needs both momenta."""
    day = W.partitionBy("d")
    safe = F.max(F.when(F.col("ord") == 0, F.col("m"))).over(day)
    best = F.max_by("ord", F.when((F.col("ord") >= 2) & F.col("m").isNotNull(), F.struct("m", -F.col("ord")))).over(day)
    flagged = df.withColumn("safe_m", safe).withColumn("best", best).filter("ord >= 2")
    win = (F.col("best") == F.col("ord")) & (F.col("m") > F.col("safe_m"))
    return flagged.withColumn("dual_mom", F.when(F.col("m").isNotNull() & F.col("safe_m").isNotNull(), F.when(win, 1).otherwise(0)))


@query("run_length", duck(
    """SELECT entity, d, sum(CASE WHEN hold THEN 1 ELSE 0 END) OVER (PARTITION BY entity, island ORDER BY pos)::BIGINT AS run,
       round(sum(CASE WHEN hold THEN 1 ELSE 0 END) OVER (PARTITION BY entity, island ORDER BY pos) / 21.0::DOUBLE, 6) AS months FROM i""",
    f"c AS (SELECT entity, d, pos, coalesce(px < lag(px, 5) {WIN}, false) AS hold FROM dense)",
    f"i AS (SELECT *, sum(CASE WHEN hold THEN 0 ELSE 1 END) {RUN} AS island FROM c)"))
def run_length(spark, sf_dir):
    dense = src.dense_panel(spark, sf_dir)
    cond = F.col("px") < F.lag("px", 5).over(P())
    out = op.run_length(dense.withColumn("cond", cond), F.col("cond"))
    return out.select("entity", "d", F.col("run").cast("bigint").alias("run"), r6(F.col("run") / 21.0).alias("months"))


@query("rows_since_event", duck(
    "SELECT s.d, c.category, CASE WHEN max(e.loc) IS NOT NULL THEN least(s.pos - max(e.loc), 252) END::BIGINT AS since FROM ses s CROSS JOIN (SELECT DISTINCT category FROM evcal) c "
    "LEFT JOIN evloc e ON e.category = c.category AND e.loc <= s.pos GROUP BY s.d, s.pos, c.category"))
def rows_since_event(spark, sf_dir):
    from tidemark.operators.bands import since_events

    ses = src.sessions(src.panel_table(spark, sf_dir))
    return since_events(ses, src.event_calendar(spark, sf_dir), cap=252).select("d", "category", F.col("since").cast("bigint").alias("since"))


@query("compound_hold", duck(
    f"SELECT entity, d, CASE WHEN count(r) {RUN} > 0 THEN {rd(f'exp(sum(ln(coalesce(1 + r, 1.0::DOUBLE))) {RUN})')} END AS wealth FROM v",
    f"v AS (SELECT entity, d, pos, px / lag(px) {WIN} - 1 AS r FROM dense)"))
def compound_hold(spark, sf_dir):
    v = src.dense_panel(spark, sf_dir).withColumn("r", op.total_return(F.col("px"), 1, P()))
    return v.select("entity", "d", r6(op.compound_hold(F.col("r"), P())).alias("wealth"))


MONTHS = """mret AS (
  SELECT entity, m.month, (row_number() OVER (PARTITION BY entity ORDER BY m.month) - 1) AS mpos, last_px / lag(last_px) OVER (PARTITION BY entity ORDER BY m.month) - 1 AS r
  FROM (SELECT entity, date_trunc('month', d)::DATE AS month, CASE WHEN count(px) = count(*) THEN arg_max(px, d) END AS last_px
        FROM dense GROUP BY 1, 2) m)"""


def monthly_complete_returns(spark, sf_dir):
    """Monthly returns that are missing when the month, or the one before, misses a session."""
    months = src.dense_panel(spark, sf_dir).groupBy("entity", F.trunc("d", "MM").alias("month")).agg(
        F.when(F.count("px") == F.count(F.lit(1)), F.max_by("px", "d")).alias("last_px"))
    w = W.partitionBy("entity").orderBy("month")
    return months.select("entity", "month", (F.row_number().over(w) - 1).alias("pos"), change(F.col("last_px"), F.lag("last_px").over(w)).alias("r"))


@query("compound_break", duck(
    """SELECT entity, month, CASE WHEN r IS NOT NULL AND gaps = 0 THEN round(exp(sum(ln(1 + r)) OVER (PARTITION BY entity ORDER BY mpos)), 6) + 0.0 END AS wealth
       FROM (SELECT *, sum(CASE WHEN r IS NULL AND started THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY mpos) AS gaps FROM (
             SELECT *, count(r) OVER (PARTITION BY entity ORDER BY mpos) > 0 AS started FROM mret))""", MONTHS))
def compound_break(spark, sf_dir):
    v = monthly_complete_returns(spark, sf_dir)
    return v.select("entity", "month", r6(op.compound_break(F.col("r"), F.col("pos"), P())).alias("wealth"))


@query("wealth_from_prices", duck(
    f"""SELECT entity, d, CASE WHEN px > 0 AND gaps = 0 THEN {rd(f'px / first_value(px IGNORE NULLS) {RUN}')} END AS wealth FROM (
        SELECT *, sum(CASE WHEN px IS NULL AND started THEN 1 ELSE 0 END) {RUN} AS gaps FROM (SELECT *, count(px) {RUN} > 0 AS started FROM dense))"""))
def wealth_from_prices(spark, sf_dir):
    dense = src.dense_panel(spark, sf_dir)
    return dense.select("entity", "d", r6(op.wealth_from_prices(F.col("px"), F.col("pos"), P())).alias("wealth"))


@query("wealth_paths", duck(
    f"""SELECT entity, d, {rd('w')} AS from_prices, {rd('ret')} AS ret,
        {rd('exp(sum(ln(1 + ret)) OVER (PARTITION BY entity ORDER BY pos))')} AS from_returns FROM wealth"""))
def wealth_paths(spark, sf_dir):
    from tidemark.operators.portfolio import hold_paths, wealth_from_returns

    paths = hold_paths(src.dense_panel(spark, sf_dir))
    return paths.select("entity", "d", r6(F.col("w")).alias("from_prices"), r6(F.col("ret")).alias("ret"),
                        r6(wealth_from_returns(F.col("ret"), P())).alias("from_returns"))


H, LAG = 21, 1
LABELS = f"""lab0 AS (
  SELECT *, lead(px, {LAG + H}) {WIN} / lead(px, {LAG}) {WIN} - 1 AS fret, lead(pos, {LAG + H}) {WIN} IS NOT NULL AS inside FROM dense),
lab1 AS (
  SELECT *, max(CASE WHEN ord = 0 THEN fret END) OVER (PARTITION BY d) AS safe FROM lab0),
lab2 AS (
  SELECT entity, ord, d, pos, px, safe, CASE WHEN inside THEN CASE WHEN ord = 0 THEN 0.0::DOUBLE ELSE fret - safe END END AS excess FROM lab1),
labels_d AS (
  SELECT d, pos, CASE WHEN max(safe) IS NOT NULL THEN arg_min(entity, ord) FILTER (excess = mx) END AS label,
         CASE WHEN max(safe) IS NOT NULL THEN min(ord) FILTER (excess = mx) END AS label_ord FROM (
    SELECT *, max(excess) OVER (PARTITION BY d) AS mx FROM lab2) GROUP BY d, pos)"""


@query("forward_label", duck(f"SELECT l.entity, l.d, {rd('excess')} AS excess, label FROM lab2 l JOIN labels_d USING (d)", LABELS))
def forward_label(spark, sf_dir):
    out = op.forward_labels(src.dense_panel(spark, sf_dir), H, LAG)
    return out.select("entity", "d", r6(F.col("excess")).alias("excess"), "label")


@query("lagged_activation", duck(
    f"""SELECT d, last_value(t IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS held_ord FROM (
        SELECT d, pos, lag(label_ord, {LAG + 1}) OVER (ORDER BY pos) AS t FROM labels_d)""", LABELS))
def lagged_activation(spark, sf_dir):
    from tidemark.operators.portfolio import lagged_holding

    lab = op.forward_labels(src.dense_panel(spark, sf_dir), H, LAG)
    targets = lab.groupBy("d", "pos").agg(F.max(F.when(F.col("entity") == F.col("label"), F.col("ord"))).alias("target")).withColumn("strategy", F.lit("perfect"))
    return lagged_holding(targets, "target", LAG).select("d", F.col("held").cast("bigint").alias("held_ord"))


@query("spike_starts", duck(
    f"SELECT entity, d FROM (SELECT *, lag(spike) {WIN} AS prev FROM (SELECT *, CASE WHEN coalesce(z, 0) > 2 THEN 1 ELSE 0 END AS spike FROM (SELECT entity, d, pos, "
    f"CASE WHEN count(px) {ROWS(365)} >= 60 THEN (px - avg(px) {ROWS(365)}) / stddev_samp(px) {ROWS(365)} END AS z FROM dense))) WHERE spike = 1 AND prev = 0"))
def spike_starts(spark, sf_dir):
    dense = src.dense_panel(spark, sf_dir).withColumn("z", op.zscore(F.col("px"), 365, 60, P()))
    spiked = dense.withColumn("spike", F.when(F.coalesce("z", F.lit(0.0)) > 2, 1).otherwise(0))
    return spiked.withColumn("prev", F.lag("spike").over(P())).filter("spike = 1 AND prev = 0").select("entity", "d")


@query("segment_starts", duck(
    """SELECT d, (m <> coalesce(lag(m) OVER (ORDER BY pos), m - INTERVAL 1 DAY))::INTEGER::BIGINT AS new_month,
              (year(d) <> coalesce(lag(year(d)) OVER (ORDER BY pos), 0))::INTEGER::BIGINT AS new_year
       FROM (SELECT *, date_trunc('month', d) AS m FROM ses)"""))
def segment_starts(spark, sf_dir):
    w = W.orderBy("pos")
    ses = src.sessions(src.panel_table(spark, sf_dir)).select("d", "pos", F.trunc("d", "MM").alias("m"), F.year("d").alias("y"))
    changed = lambda c: F.when(F.lag(c).over(w).isNull() | (F.lag(c).over(w) != F.col(c)), 1).otherwise(0).cast("bigint")
    return ses.select("d", changed("m").alias("new_month"), changed("y").alias("new_year"))


@query("forward_reveal", duck("SELECT entity, d, " + ", ".join(
    f"{rd(f'CASE WHEN lead(px, {LAG}) {WIN} > 0 THEN lead(px, {LAG + n}) {WIN} / lead(px, {LAG}) {WIN} - 1 END')} AS h{n}" for n in (21, 63, 126, 252)) + " FROM dense"))
def forward_reveal(spark, sf_dir):
    dense = src.dense_panel(spark, sf_dir)
    return dense.select("entity", "d", *[
        r6(F.when(F.lead("px", LAG).over(P()) > 0, change(F.lead("px", LAG + n).over(P()), F.lead("px", LAG).over(P())))).alias(f"h{n}") for n in (21, 63, 126, 252)])


@query("release_transforms", duck(
    f"""SELECT month, {rd('cpi / lag(cpi, 12) OVER (ORDER BY month) - 1')} AS yoy, {rd('cpi / lag(cpi, 3) OVER (ORDER BY month) - 1')} AS chg_3m,
        CASE WHEN count(unemp) OVER t >= 12 THEN {rd('unemp - min(unemp) OVER t')} END AS gap
        FROM rel WINDOW t AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""))
def release_transforms(spark, sf_dir):
    return release_features(src.monthly_releases(spark, sf_dir)).select(
        "month", *[r6(F.col(c)).alias(c) for c in ("yoy", "chg_3m", "gap")])


def release_features(releases):
    """12- and 3-month change of the level; gap of the rate above its own trailing-year minimum."""
    w = W.orderBy("month")
    t = w.rowsBetween(-11, 0)
    return releases.select(
        "month", change(F.col("cpi"), F.lag("cpi", 12).over(w)).alias("yoy"), change(F.col("cpi"), F.lag("cpi", 3).over(w)).alias("chg_3m"),
        F.when(F.count("unemp").over(t) >= 12, F.col("unemp") - F.min("unemp").over(t)).alias("gap"))
