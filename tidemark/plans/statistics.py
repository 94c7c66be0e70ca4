"""Metric, study and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import normal, weights as fw
from tidemark.functions.columns import big, change, r6
from tidemark.operators import evaluation as ev, history, metrics, studies, windows as op
from tidemark.operators.portfolio import hold_paths
from tidemark.plans import experiments
from tidemark.plans.base import duck, query, rd
from tidemark.plans.joins import BINS, EVENT_ROWS, LEADERS, PRE, event_rows, leader_paths, risk_known
from tidemark.plans.portfolio import SIGNALS, regimes, signals
from tidemark.plans.windows import LABELS, ROWS, WIN
from tidemark.session import materialize
from tidemark.sources import tables as src

DAYS = "date_diff('day', min(d), max(d))"

# Per-strategy rows with everything the grouped metrics need; used by most statements below.
PATHS = """pw AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.entity ORDER BY w.pos) AS rn, coalesce(b.ret, 0.0::DOUBLE) AS base_ret, max(w.w) OVER (PARTITION BY w.entity ORDER BY w.pos) AS peak,
         w.w / lag(w.w, 252) OVER (PARTITION BY w.entity ORDER BY w.pos) - 1 AS roll
  FROM wealth w LEFT JOIN wealth b ON b.pos = w.pos AND b.ord = 0),
pd AS (SELECT *, w / peak - 1 AS dd, max(CASE WHEN w >= peak THEN d END) OVER (PARTITION BY entity ORDER BY pos) AS peak_d FROM pw)"""

SQL_METRIC = {
    "cagr": f"CASE WHEN {DAYS} > 0 THEN (arg_max(w, pos) / arg_min(w, pos)) ** (365.25::DOUBLE / {DAYS}) - 1 ELSE 0.0::DOUBLE END",
    "vol": "stddev_samp(ret) FILTER (rn > 1) * sqrt(252.0::DOUBLE)",
    "sharpe": "CASE WHEN stddev_samp(ret - base_ret) FILTER (rn > 1) > 0 THEN avg(ret - base_ret) FILTER (rn > 1) / stddev_samp(ret - base_ret) FILTER (rn > 1) * sqrt(252.0::DOUBLE) ELSE 0.0::DOUBLE END",
    "sortino": "CASE WHEN count(*) FILTER (rn > 1 AND ret < base_ret) > 0 THEN avg(ret - base_ret) FILTER (rn > 1) / sqrt(avg((ret - base_ret) * (ret - base_ret)) FILTER (rn > 1 AND ret < base_ret)) * sqrt(252.0::DOUBLE) ELSE 0.0::DOUBLE END",
    "max_drawdown": "least(min(dd), 0.0::DOUBLE)",
    "calmar": f"CASE WHEN min(dd) < 0 THEN (CASE WHEN {DAYS} > 0 THEN (arg_max(w, pos) / arg_min(w, pos)) ** (365.25::DOUBLE / {DAYS}) - 1 ELSE 0.0::DOUBLE END) / abs(min(dd)) END",
    "ulcer": "sqrt(avg(dd * dd))",
    "worst_rolling": "coalesce(min(roll), arg_max(w, pos) / arg_min(w, pos) - 1)",
    "hit_rate": "avg((ret > base_ret)::INTEGER::DOUBLE) FILTER (rn > 1)",
}
PEAK = "CASE WHEN min(dd) < 0 THEN arg_min(peak_d, (dd, pos)) ELSE min(d) END AS max_dd_peak, CASE WHEN min(dd) < 0 THEN arg_min(d, (dd, pos)) ELSE min(d) END AS max_dd_trough"


def hold_rows(spark, sf_dir, periods: int = 252):
    """Buy-and-hold rows of every entity with the baseline return of the same session."""
    paths = hold_paths(src.dense_panel(spark, sf_dir))
    base = F.coalesce(F.max(F.when(F.col("ord") == 0, F.col("ret"))).over(W.partitionBy("pos")), F.lit(0.0))
    return metrics.with_path_columns(paths.withColumn("base_ret", base).withColumnRenamed("entity", "strategy"), "strategy", periods)


def metric_query(name: str, columns: list[str], extra_sql: str = "", extra: list[str] | None = None):
    sql = duck("SELECT entity AS strategy, " + ", ".join(f"{rd(SQL_METRIC[c])} AS {c}" for c in columns) + (", " + extra_sql if extra_sql else "") + " FROM pd GROUP BY entity", PATHS)

    @query(name, sql)
    def run(spark, sf_dir):
        m = metrics.path_metrics("strategy")
        picked = [r6(m[c]).alias(c) for c in columns] + [m[c].alias(c) for c in extra or []]
        return hold_rows(spark, sf_dir).groupBy("strategy").agg(*picked)

    return run


metric_query("cagr", ["cagr"])
metric_query("max_drawdown", ["max_drawdown"], PEAK, ["max_dd_peak", "max_dd_trough"])
metric_query("ulcer_index", ["ulcer"])
metric_query("annualized_vol", ["vol"])
metric_query("sharpe_sortino", ["sharpe", "sortino"])
metric_query("worst_rolling", ["worst_rolling"])
metric_query("hit_rate_calmar", ["hit_rate", "calmar"])


# Drifting 60/40 mix per entity against the safe asset: weights move with prices, so it has turnover.
MIX2 = """mix2 AS (SELECT w.entity, w.pos, w.d, 0.6 * w.w / (0.6 * w.w + 0.4 * b.w) AS wr, 0.4 * b.w / (0.6 * w.w + 0.4 * b.w) AS ws
  FROM wealth w JOIN wealth b ON b.pos = w.pos AND b.ord = 0 WHERE w.ord > 0)"""


def drifting_mix(spark, sf_dir):
    paths = hold_paths(src.dense_panel(spark, sf_dir))
    safe = F.max(F.when(F.col("ord") == 0, F.col("w"))).over(W.partitionBy("pos"))
    rows = paths.withColumn("b", safe).filter("ord > 0 AND b IS NOT NULL")
    value = 0.6 * F.col("w") + 0.4 * F.col("b")
    return rows.select(F.col("entity").alias("strategy"), "pos", "d", F.array(0.4 * F.col("b") / value, 0.6 * F.col("w") / value).alias("weights"))


@query("turnover", duck(
    f"""SELECT entity AS strategy, {rd('0.5 * coalesce(sum(abs(wr - pr) + abs(ws - ps)), 0)')} AS turnover FROM (
          SELECT *, lag(wr) OVER (PARTITION BY entity ORDER BY pos) AS pr, lag(ws) OVER (PARTITION BY entity ORDER BY pos) AS ps FROM mix2) GROUP BY entity""", MIX2))
def turnover(spark, sf_dir):
    return metrics.one_way_turnover(drifting_mix(spark, sf_dir), "strategy").select("strategy", r6(F.col("turnover")).alias("turnover"))


@query("time_in_entity", duck(
    f"SELECT entity AS strategy, {rd('avg(ws)')} AS safe_share, {rd('avg(wr)')} AS risky_share, 0.0::DOUBLE AS leader_share FROM mix2 GROUP BY 1 UNION ALL SELECT strategy || ' ' || name, 0.0, 0.0, {rd('count(*) / any_value(n)')} FROM (SELECT *, count(*) OVER (PARTITION BY strategy) AS n FROM path) GROUP BY 1, strategy, name",
    MIX2, LEADERS))
def time_in_entity(spark, sf_dir):
    mixes = drifting_mix(spark, sf_dir).groupBy("strategy").agg(
        r6(F.avg(F.get("weights", F.lit(0)))).alias("safe_share"), r6(F.avg(F.get("weights", F.lit(1)))).alias("risky_share"), F.lit(0.0).alias("leader_share"))
    path = leader_paths(spark, sf_dir).groupBy("strategy", "name").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("strategy"))
    leaders = path.select(F.concat_ws(" ", "strategy", "name").alias("strategy"), F.lit(0.0).alias("safe_share"), F.lit(0.0).alias("risky_share"), r6(share).alias("leader_share"))
    return mixes.unionByName(leaders)


@query("transfers_per_month", duck(
    f"""SELECT strategy, {rd('avg(n)')} AS per_month, max(n)::BIGINT AS max_month FROM (
          SELECT strategy, date_trunc('month', d) AS m, count(*) AS n FROM (SELECT *, lag(name) OVER (PARTITION BY strategy ORDER BY pos) AS prev FROM path) WHERE prev <> name GROUP BY 1, 2) GROUP BY strategy""", LEADERS))
def transfers_per_month(spark, sf_dir):
    w = W.partitionBy("strategy").orderBy("pos")
    posts = leader_paths(spark, sf_dir).withColumn("prev", F.lag("name").over(w)).filter("prev <> name").select("strategy", F.col("d").alias("post_d"))
    return metrics.transfers_per_month(posts, "strategy").select("strategy", r6(F.col("per_month")).alias("per_month"), "max_month")


SUMMARY = ["cagr", "vol", "sharpe", "sortino", "max_drawdown", "calmar", "ulcer", "worst_rolling", "hit_rate"]


@query("metric_summary", duck(
    "SELECT entity AS strategy, " + ", ".join(f"{rd(SQL_METRIC[c])} AS {c}" for c in SUMMARY) + f", {PEAK}, count(*)::BIGINT AS n_rows FROM pd GROUP BY entity", PATHS))
def metric_summary(spark, sf_dir):
    m = metrics.path_metrics("strategy")
    return hold_rows(spark, sf_dir).groupBy("strategy").agg(
        *[r6(m[c]).alias(c) for c in SUMMARY], m["max_dd_peak"].alias("max_dd_peak"), m["max_dd_trough"].alias("max_dd_trough"), m["n_rows"].alias("n_rows"))


EXCESS = "ex AS (SELECT r.entity, r.ord, r.d, r.pos, r.ret, r.ret - b.ret AS x FROM rets r JOIN rets b ON b.d = r.d AND b.ord = 0)"


def excess_rows(spark, sf_dir):
    """(entity, ord, d, pos, ret, x): daily return and its excess over the safe entity."""
    rets = op.with_returns(src.dense_panel(spark, sf_dir)).select("entity", "ord", "d", "pos", "ret")
    safe = F.max(F.when(F.col("ord") == 0, F.col("ret"))).over(W.partitionBy("d"))
    return rets.withColumn("x", F.col("ret") - safe)


def _t(x: str) -> str:
    return (f"CASE WHEN count({x}) >= 3 THEN {rd(f'avg({x})')} END AS mean, CASE WHEN count({x}) >= 3 AND stddev_samp({x}) > 0 THEN "
            f"{rd(f'avg({x}) / (stddev_samp({x}) / sqrt(count({x})))')} END AS t, count({x})::BIGINT AS n")


def t_columns(x):
    parts = ev.t_statistic(x)
    return [r6(parts["mean"]).alias("mean"), r6(parts["t"]).alias("t"), parts["n"].alias("n")]


@query("t_stat", duck(f"SELECT entity, {_t('x')} FROM ex GROUP BY entity", EXCESS))
def t_stat(spark, sf_dir):
    return excess_rows(spark, sf_dir).groupBy("entity").agg(*t_columns(F.col("x")))


@query("seasonality_cells", duck(
    f"""SELECT entity, month(m)::BIGINT AS month, {_t('x')} FROM (SELECT entity, date_trunc('month', d) AS m, sum(x) AS x FROM ex WHERE ord > 0 GROUP BY 1, 2) GROUP BY 1, 2""", EXCESS))
def seasonality_cells(spark, sf_dir):
    monthly = excess_rows(spark, sf_dir).filter("ord > 0").groupBy("entity", F.trunc("d", "MM").alias("m")).agg(F.sum("x").alias("x"))
    return monthly.groupBy("entity", big(F.month("m")).alias("month")).agg(*t_columns(F.col("x")))


@query("seasonality_splits", duck(
    f"""SELECT entity, 'turn' AS split, turn::BIGINT AS side, {_t('x')} FROM ex JOIN tm USING (d) WHERE ord > 0 GROUP BY 1, 3
        UNION ALL SELECT entity, 'half', (month(d) IN (11, 12, 1, 2, 3, 4))::INTEGER::BIGINT, {_t('x')} FROM ex WHERE ord > 0 GROUP BY 1, 3""", EXCESS,
    """tm AS (SELECT d, (row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d) <= 3 OR coalesce(lead(month(d)) OVER (ORDER BY d) <> month(d), false))::INTEGER AS turn FROM ses)"""))
def seasonality_splits(spark, sf_dir):
    nth = F.row_number().over(W.partitionBy("entity", F.trunc("d", "MM")).orderBy("d"))
    nxt = F.lead(F.month("d")).over(W.partitionBy("entity").orderBy("d"))
    rows = excess_rows(spark, sf_dir).filter("ord > 0").select(
        "entity", "x", F.when((nth <= 3) | F.coalesce(nxt != F.month("d"), F.lit(False)), 1).otherwise(0).alias("turn"),
        F.when(F.month("d").isin(11, 12, 1, 2, 3, 4), 1).otherwise(0).alias("half"))
    sides = rows.unpivot(["entity", "x"], ["turn", "half"], "split", "side")
    return sides.groupBy("entity", "split", big(F.col("side")).alias("side")).agg(*t_columns(F.col("x")))


EVENT_PATHS = f"""ep AS (SELECT category, entity, event_id, off, exp(sum(ln(1 + CASE WHEN off = -{PRE} THEN 0 ELSE coalesce(ret, 0) END)) OVER (PARTITION BY event_id, entity ORDER BY off)) - 1 AS v,
    count(ret) OVER (PARTITION BY event_id, entity) AS k FROM evrows)"""
QUANTILES = f"{rd('median(v)')} AS median, {rd('quantile_cont(v, 0.25)')} AS q25, {rd('quantile_cont(v, 0.75)')} AS q75, count(*)::BIGINT AS n"


@query("event_study", duck(f"SELECT category, entity, off::BIGINT AS off, {QUANTILES} FROM ep WHERE k >= {PRE} GROUP BY 1, 2, 3", EVENT_ROWS, EVENT_PATHS))
def event_study(spark, sf_dir):
    paths = studies.event_paths(event_rows(spark, sf_dir), ["event_id", "entity"], pre=PRE).filter(F.col("k") >= PRE)
    return studies.path_quantiles(paths, ["category", "entity", "off"]).withColumn("off", big(F.col("off")))


@query("spike_study", duck(
    f"""SELECT entity, off::BIGINT AS off, {rd('median(v)')} AS median, count(*)::BIGINT AS n FROM (
          SELECT s.loc, r.entity, o.off, exp(sum(ln(1 + CASE WHEN o.off = -20 THEN 0 ELSE coalesce(r.ret, 0) END)) OVER (PARTITION BY s.loc, r.entity ORDER BY o.off)) - 1 AS v
          FROM starts s CROSS JOIN (SELECT unnest(range(-20, 61)) AS off) o JOIN rets r ON r.pos = s.loc + o.off WHERE s.loc >= 20 AND s.loc + 60 < (SELECT count(*) FROM ses) AND r.ord IN (0, 1, 2))
        GROUP BY 1, 2""",
    """riskz AS (SELECT (obs_d + 1)::DATE AS available_on, CASE WHEN count(idx) OVER t >= 60 THEN (idx - avg(idx) OVER t) / stddev_samp(idx) OVER t END AS z
       FROM risk WINDOW t AS (ORDER BY obs_d ROWS BETWEEN 364 PRECEDING AND CURRENT ROW))""",
    """starts AS (SELECT pos AS loc FROM (SELECT pos, sp, lag(sp) OVER (ORDER BY pos) AS prev FROM (
         SELECT s.pos, CASE WHEN coalesce(r.z, 0) > 2 THEN 1 ELSE 0 END AS sp FROM ses s ASOF LEFT JOIN riskz r ON s.d >= r.available_on)) WHERE sp = 1 AND prev = 0)"""))
def spike_study(spark, sf_dir):
    panel = src.panel_table(spark, sf_dir)
    ses = src.sessions(panel)
    known = risk_known(spark, sf_dir, ses)
    w = W.orderBy("pos")
    on = known.withColumn("sp", F.coalesce("gpr_spike", F.lit(0))).withColumn("prev", F.lag("sp").over(w))
    starts = on.filter("sp = 1 AND prev = 0").select(F.col("pos").alias("loc"))
    from tidemark.operators.bands import event_offsets

    offsets = event_offsets(starts, 20, 60, ses.agg(F.count(F.lit(1)).alias("n")).scalar())
    rets = op.with_returns(src.densify(panel)).filter(F.col("ord").isin(0, 1, 2)).select("entity", "pos", "ret")
    paths = studies.event_paths(offsets.join(rets, "pos"), ["loc", "entity"], pre=20)
    out = studies.path_quantiles(paths, ["entity", "off"])
    return out.select("entity", big(F.col("off")).alias("off"), "median", "n")


# Named windows; the last two are replayed on monthly data.
WINDOWS = [("first_year", "1995-03-01", "1996-02-29", "daily"), ("mid_slide", "1997-06-01", "1998-01-31", "daily"), ("late_cycle", "2000-01-03", "2000-12-29", "daily"),
           ("long_monthly", "1996-01-01", "1998-12-01", "monthly"), ("tail_monthly", "2000-06-01", "2001-06-01", "monthly")]
WINDOW_SQL = "win AS (SELECT name, a::DATE AS a, b::DATE AS b, cad FROM (VALUES " + ", ".join(f"('{n}', '{a}', '{b}', '{c}')" for n, a, b, c in WINDOWS) + ") t(name, a, b, cad))"
STRESS = """me AS (SELECT entity, month AS d, last_px / lag(last_px) OVER (PARTITION BY entity ORDER BY month) - 1 AS r FROM (
     SELECT entity, date_trunc('month', d)::DATE AS month, arg_max(px, d) AS last_px FROM panel GROUP BY 1, 2)),
sw AS (SELECT name, cad, entity, d, fpx AS v FROM win JOIN wealth ON d BETWEEN a AND b WHERE cad = 'daily'
   UNION ALL SELECT name, cad, entity, d, exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY name, entity ORDER BY d)) FROM win JOIN me ON d BETWEEN a AND b WHERE cad = 'monthly'),
s1 AS (SELECT *, v / first_value(v) OVER k AS w, row_number() OVER k AS rn, max(v) OVER k AS pk FROM sw WINDOW k AS (PARTITION BY name, entity ORDER BY d)),
s2 AS (SELECT *, v / pk - 1 AS dd, pk / first_value(v) OVER (PARTITION BY name, entity ORDER BY d) AS peak_w FROM s1),
s3 AS (SELECT *, arg_min(rn, (dd, rn)) OVER q AS trough_rn, arg_min(peak_w, (dd, rn)) OVER q AS trough_peak, min(dd) OVER q AS worst FROM s2 WINDOW q AS (PARTITION BY name, entity)),
stress AS (SELECT name, cad, entity, count(*)::BIGINT AS n, round(arg_max(w, rn) - 1, 6) + 0.0 AS total_return, round(least(min(dd), 0), 6) + 0.0 AS max_dd,
   min(CASE WHEN worst < 0 AND rn >= trough_rn AND w >= trough_peak - 1e-12 THEN rn - trough_rn END)::BIGINT AS recovery FROM s3 GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


def stress_rows(spark, sf_dir):
    """Every named window replayed on every entity; windows are a literal array exploded onto days."""
    panel = src.panel_table(spark, sf_dir)
    daily = hold_paths(src.densify(panel)).select("entity", "d", F.col("fpx").alias("v"))
    rets = history.month_end_returns(panel).select("entity", F.col("month").alias("d"), (F.col("ret_pct") / 100.0).alias("r"))
    slices = studies.on_windows(daily, [w for w in WINDOWS if w[3] == "daily"]).withColumn("cad", F.lit("daily"))
    months = studies.on_windows(rets, [w for w in WINDOWS if w[3] == "monthly"]).withColumn("cad", F.lit("monthly"))
    w = W.partitionBy("name", "entity").orderBy("d")
    compounded = months.withColumn("v", F.product(1.0 + F.coalesce("r", F.lit(0.0))).over(op.running(w))).drop("r")
    return studies.window_stats(slices.unionByName(compounded), ["name", "cad", "entity"])


@query("stress_windows", duck("SELECT name, cad, entity, n, total_return, max_dd, recovery FROM stress", WINDOW_SQL, STRESS))
def stress_windows(spark, sf_dir):
    return stress_rows(spark, sf_dir)


@query("stress_subset", duck("SELECT s.name, s.entity, s.total_return, s.max_dd FROM stress s JOIN ent e USING (entity) WHERE e.ord IN (0, 1) AND s.name IN ('mid_slide', 'late_cycle', 'tail_monthly')", WINDOW_SQL, STRESS))
def stress_subset(spark, sf_dir):
    """The safe entity beside the next one through the windows of interest."""
    two = src.table(spark, sf_dir, "region").filter("r_regionkey IN (0, 1)").select(F.col("r_name").alias("entity"))
    rows = stress_rows(spark, sf_dir).filter(F.col("name").isin("mid_slide", "late_cycle", "tail_monthly"))
    return rows.join(two, "entity").select("name", "entity", "total_return", "max_dd")


@query("cost_of_wrong", duck(
    f"""SELECT name AS entity, count(*)::BIGINT AS n_wrong, {rd('avg(excess)')} AS mean, {rd('median(excess)')} AS median, {rd('quantile_cont(excess, 0.1)')} AS q10, {rd('100000 * median(excess)', 2)} AS dollars
        FROM path p JOIN lab2 l ON l.d = p.d AND l.entity = p.name JOIN labels_d y ON y.d = p.d WHERE p.strategy = 'leader_63' AND y.label IS NOT NULL AND y.label <> p.name AND excess IS NOT NULL GROUP BY name""", LABELS, LEADERS))
def cost_of_wrong(spark, sf_dir):
    """Excess of the 63-session leader on the days another entity won the forward window."""
    lab = op.forward_labels(src.dense_panel(spark, sf_dir), 21, 1).select("d", "entity", "excess", "label")
    picks = leader_paths(spark, sf_dir).filter("strategy = 'leader_63'").select("d", F.col("name").alias("entity"))
    wrong = picks.join(lab, ["d", "entity"]).filter("label IS NOT NULL AND label <> entity AND excess IS NOT NULL")
    return wrong.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_wrong"), r6(F.avg("excess")).alias("mean"), r6(F.median("excess")).alias("median"), r6(F.percentile("excess", 0.1)).alias("q10"),
        F.round(100000 * F.median("excess"), 2).alias("dollars"))


@query("reliability", duck(f"SELECT bin::BIGINT AS bin, {rd('low')} AS low, {rd('high')} AS high, n::BIGINT AS n, {rd('mean_predicted')} AS mean_predicted, {rd('empirical_rate')} AS empirical_rate FROM rbins", BINS))
def reliability(spark, sf_dir):
    bins = ev.reliability_bins(src.scored_documents(spark, sf_dir), "p", "y")
    return bins.select("bin", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "n", r6(F.col("mean_predicted")).alias("mean_predicted"), r6(F.col("empirical_rate")).alias("empirical_rate"))


@query("brier_skill", duck(
    f"""SELECT {rd('avg((p - y) * (p - y))')} AS brier, {rd('-avg(y * ln(pp) + (1 - y) * ln(1 - pp))')} AS log_loss, {rd('any_value(rate)')} AS base_rate,
          {rd('1 - avg((p - y) * (p - y)) / avg((rate - y) * (rate - y))')} AS skill, count(*)::BIGINT AS n
        FROM (SELECT p, y, least(greatest(p, 1e-6), 1 - 1e-6) AS pp, (SELECT avg(y) FROM scored) AS rate FROM scored)"""))
def brier_skill(spark, sf_dir):
    row = ev.brier_row(src.scored_documents(spark, sf_dir), "p", "y")
    return row.select(*[r6(F.col(c)).alias(c) for c in ("brier", "log_loss", "base_rate", "skill")], "n")


@query("multiclass_brier", duck(
    f"""SELECT entity_label AS label, {rd('avg(b)')} AS brier, count(*)::BIGINT AS n FROM (
          SELECT m.d, y.label AS entity_label, """ + " + ".join(f"(coalesce(greatest({r}, 0) / tot, 0) - (y.label_ord = {i})::INTEGER) ** 2" for i, r in enumerate("gfcsi")) + """ AS b
          FROM (SELECT *, coalesce(g, 0) + coalesce(f, 0) + coalesce(c, 0) + coalesce(s, 0) + coalesce(i, 0) AS tot FROM moments) m JOIN labels_d y USING (d) WHERE y.label IS NOT NULL AND tot > 0) GROUP BY 1""", LABELS))
def multiclass_brier(spark, sf_dir):
    """Price shares as class probabilities, scored against the forward winner."""
    lab = op.forward_labels(src.dense_panel(spark, sf_dir), 21, 1)
    px = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("px", F.lit(0.0)).alias("px")))), lambda s: s["px"])
    rows = lab.groupBy("d").agg(px.alias("raw"), F.max("label").alias("label"), F.max(F.when(F.col("label") == F.col("entity"), F.col("ord"))).alias("pos")).filter("label IS NOT NULL")
    return rows.groupBy("label").agg(r6(F.avg(fw.squared_error(fw.renormalized(F.col("raw")), F.col("pos")))).alias("brier"), F.count(F.lit(1)).alias("n"))


DEFLATED = ("""ds AS (SELECT *, (sr - sqrt(factor / (t - 1)) * (SELECT maximum FROM hurdle)) * sqrt(t - 1) / sqrt(factor) AS z FROM (
            SELECT *, greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12) AS factor FROM (
              SELECT entity, count(x) AS t, avg(x) / stddev_samp(x) AS sr, skewness(x) AS skew, kurtosis(x) + 3 AS kurt FROM ex WHERE ord > 0 AND x IS NOT NULL GROUP BY 1)))""",)


def stamped(spark, sf_dir):
    """Deflated scores under the hurdle of as many trials as the log of this data holds."""
    maximum = experiments.expected_maximum(experiments.logged_trials(spark, sf_dir)).select("maximum").scalar()
    return ev.deflated_sharpe(excess_rows(spark, sf_dir).filter("ord > 0"), "x", ["entity"], maximum)


@query("deflated_sharpe", duck(
    f"""SELECT entity, t::BIGINT AS t, {rd('sr')} AS sharpe, {rd('skew')} AS skew, {rd('kurt')} AS kurt, {rd('z', 5)} AS dsr_z, (z >= 1.6448536269514722)::INTEGER::BIGINT AS passes FROM ds""", EXCESS, *experiments.TRIAL_CTES, *DEFLATED))
def deflated_sharpe(spark, sf_dir):
    out = stamped(spark, sf_dir)
    return out.select("entity", "t", r6(F.col("sharpe")).alias("sharpe"), r6(F.col("skew")).alias("skew"), r6(F.col("kurt")).alias("kurt"),
                      F.round("dsr_z", 5).alias("dsr_z"), (F.col("dsr_z") >= ev.Z95).cast("int").cast("bigint").alias("passes"))


@query("deflated_probability", duck(f"SELECT entity, {rd(normal.probability_sql('z'))} AS dsr FROM ds", EXCESS, *experiments.TRIAL_CTES, *DEFLATED))
def deflated_probability(spark, sf_dir):
    """The same score as a probability."""
    return stamped(spark, sf_dir).select("entity", r6(normal.probability(F.col("dsr_z"))).alias("dsr"))


# Blended target series; the free fit of `hedged` has a negative share, so one entity must leave it.
BLENDS = {"blend": (0.1, 0.3, 0.6, 0.0, 0.0), "hedged": (0.8, 0.5, -0.3, 0.0, 0.2)}
XS = [f"a{i}" for i in range(5)]
GRAM = f"""xr AS (SELECT d, {', '.join(f'max(CASE WHEN ord = {i} THEN ret END) AS a{i}' for i in range(5))} FROM rets GROUP BY d),
xy AS (SELECT xl.*, t.target, {' + '.join(f't.c{i} * xl.a{i}' for i in range(5))} AS y FROM (SELECT * FROM xr WHERE a0 + a1 + a2 + a3 + a4 IS NOT NULL ORDER BY d DESC LIMIT 252) xl
  CROSS JOIN (VALUES {', '.join(f"('{k}', " + ', '.join(f'{c}::DOUBLE' for c in v) + ')' for k, v in BLENDS.items())}) t(target, c0, c1, c2, c3, c4)),
gm AS (SELECT target, {', '.join(f'sum(a{i} * a{j}) AS g{i}{j}' for i in range(5) for j in range(i, 5))}, {', '.join(f'sum(a{i} * y) AS b{i}' for i in range(5))}, count(*)::BIGINT AS n FROM xy GROUP BY target)"""


def gram_rows(spark, sf_dir):
    """Last 252 complete sessions: five entity returns and the blended target series, one row per target and session."""
    rets = op.with_returns(src.dense_panel(spark, sf_dir))
    wide = rets.groupBy("d").agg(*[F.max(F.when(F.col("ord") == i, F.col("ret"))).alias(x) for i, x in enumerate(XS)])
    full = wide.dropna().withColumn("rn", F.row_number().over(W.orderBy(F.desc("d")))).filter("rn <= 252")
    mixed = lambda shares: sum((F.lit(c) * F.col(x) for c, x in zip(shares[1:], XS[1:])), F.lit(shares[0]) * F.col(XS[0]))
    targets = F.array(*[F.struct(F.lit(name).alias("target"), mixed(shares).alias("y")) for name, shares in BLENDS.items()])
    return full.select(*XS, F.inline(targets))


@query("style_gram", duck("SELECT target, " + ", ".join(rd(f"g{i}{j}", 9) + f" AS g{i}{j}" for i in range(5) for j in range(i, 5)) + ", " + ", ".join(rd(f"b{i}", 9) + f" AS b{i}" for i in range(5)) + ", n FROM gm", GRAM))
def style_gram(spark, sf_dir):
    g = studies.gram(gram_rows(spark, sf_dir), ["target"], XS, "y")
    cols = [f"g{i}{j}" for i in range(5) for j in range(i, 5)] + [f"b{i}" for i in range(5)]
    return g.select("target", *[F.round(c, 9).alias(c) for c in cols], "n")


_CELL = lambda i, j: f"g{min(i, j)}{max(i, j)}"
# Every support of the five series, solved one pivot a step; then the feasible one with the largest gain.
SUPPORTS = f"""el AS (SELECT target, n, s AS support, 0 AS p, [{', '.join('[' + ', '.join([_CELL(i, j) for j in range(5)] + [f'b{i}']) + ']' for i in range(5))}] AS m,
    [{', '.join(_CELL(i, i) for i in range(5))}] AS diag, [{', '.join(f'b{i}' for i in range(5))}] AS b FROM gm CROSS JOIN (SELECT unnest(range(1, 32)) AS s)
  UNION ALL SELECT target, n, support, p + 1, CASE WHEN (support >> p) & 1 = 0 THEN m WHEN m[p + 1][p + 1] > 1e-12 * diag[p + 1] THEN
    list_transform(range(1, 6), lambda i: list_transform(range(1, 7), lambda j: CASE WHEN i = p + 1 THEN m[i][j] / m[i][i] ELSE m[i][j] - m[i][p + 1] * m[p + 1][j] / m[p + 1][p + 1] END)) END, diag, b FROM el WHERE p < 5),
sv AS (SELECT target, n, support, b, {', '.join(f'CASE WHEN (support >> {i}) & 1 = 1 THEN m[{i + 1}][6] ELSE 0 END AS w{i}' for i in range(5))} FROM el WHERE p = 5),
fit AS (SELECT *, {' + '.join(f'w{i}' for i in range(5))} AS total FROM sv WHERE least({', '.join(f'w{i}' for i in range(5))}) >= 0 AND {' + '.join(f'w{i} * b[{i + 1}]' for i in range(5))} > 0
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY {' + '.join(f'w{i} * b[{i + 1}]' for i in range(5))} DESC, support) = 1)"""


@query("style_weights", duck("SELECT target, " + ", ".join(f"{rd(f'w{i} / total', 4)} AS w{i}" for i in range(5)) + ", n FROM fit", GRAM, SUPPORTS))
def style_weights(spark, sf_dir):
    g = studies.gram(gram_rows(spark, sf_dir), ["target"], XS, "y")
    return studies.style_weights(g, ["target"], 5).select("target", *[F.get("weights", F.lit(i)).alias(f"w{i}") for i in range(5)], "n")


REGIME_CTE = """rg AS (SELECT d, CASE WHEN a50 IS NULL OR spread IS NULL THEN 'Unavailable' ELSE CASE WHEN a50 = 1 THEN 'Uptrend' ELSE 'Downtrend' END || ' | ' || CASE WHEN coalesce(rv63, 0) >= 0.70 THEN 'High vol' ELSE 'Low vol' END
  || ' | ' || CASE WHEN spread < 0 THEN 'Inverted curve' ELSE 'Normal curve' END END AS regime FROM sig)"""


@query("regime_hit_rate", duck(
    f"""SELECT r.regime, p.strategy, count(*)::BIGINT AS n, {rd('avg((p.name = y.label)::INTEGER::DOUBLE)', 4)} AS rate FROM rg r JOIN path p ON p.d = r.d JOIN labels_d y ON y.d = r.d
        WHERE y.label IS NOT NULL GROUP BY 1, 2""", LABELS, LEADERS, SIGNALS, REGIME_CTE))
def regime_hit_rate(spark, sf_dir):
    """How often each leader's pick wins, by the regime of the day it was known in."""
    dense = materialize(src.dense_panel(spark, sf_dir))
    won = op.forward_labels(dense, 21, 1).groupBy("d").agg(F.max("label").alias("label")).filter("label IS NOT NULL")
    picks = leader_paths(spark, sf_dir).select("strategy", "d", "name")
    rows = regimes(signals(spark, sf_dir, dense)).select("d", "regime").join(picks, "d").join(won, "d")
    return rows.groupBy("regime", "strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("name") == F.col("label")).cast("double")), 4).alias("rate"))


@query("conditional_next", duck(
    f"SELECT i.entity, {rd('avg(i.nxt)')} AS mean_next, count(i.nxt)::BIGINT AS n FROM (SELECT entity, ord, d, lead(ret) {WIN} AS nxt FROM rets) i JOIN rets c ON c.d = i.d AND c.ord = 2 WHERE c.ret > 0.02 AND i.ord <> 2 GROUP BY 1"))
def conditional_next(spark, sf_dir):
    rets = op.with_returns(src.dense_panel(spark, sf_dir)).withColumn("nxt", F.lead("ret").over(op.by_entity()))
    moved = F.max(F.when(F.col("ord") == 2, F.col("ret"))).over(W.partitionBy("d"))
    return rets.withColumn("c", moved).filter("c > 0.02 AND ord <> 2").groupBy("entity").agg(r6(F.avg("nxt")).alias("mean_next"), F.count("nxt").alias("n"))


@query("scarcity_bound", duck(
    """SELECT entity, count(*)::BIGINT AS worst_sessions, count(CASE WHEN p.name = r.entity AND h.name IS DISTINCT FROM r.entity THEN 1 END)::BIGINT AS limited FROM (
         SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY entity) AS q FROM rets WHERE ret IS NOT NULL) r
       LEFT JOIN path p ON p.pos = r.pos AND p.strategy = 'leader_21' LEFT JOIN path h ON h.pos = r.pos AND h.strategy = 'leader_63' WHERE r.ret <= r.q GROUP BY entity""", LEADERS))
def scarcity_bound(spark, sf_dir):
    """Worst 5% sessions of each entity; on how many the free target wanted it while the slower book did not hold it."""
    rets = op.with_returns(src.dense_panel(spark, sf_dir)).filter("ret IS NOT NULL").select("entity", "pos", "ret")
    cut = rets.groupBy("entity").agg(F.percentile("ret", 0.05).alias("q"))
    path = leader_paths(spark, sf_dir).groupBy("pos").agg(
        F.max(F.when(F.col("strategy") == "leader_21", F.col("name"))).alias("want"), F.max(F.when(F.col("strategy") == "leader_63", F.col("name"))).alias("held"))
    bad = rets.join(cut, "entity").filter("ret <= q").join(path, "pos", "left")
    limited = (F.col("want") == F.col("entity")) & ~F.col("held").eqNullSafe(F.col("entity"))
    return bad.groupBy("entity").agg(F.count(F.lit(1)).alias("worst_sessions"), F.count(F.when(limited, 1)).alias("limited"))


ME = """me AS (SELECT entity, month, 100 * (last_px / lag(last_px) OVER (PARTITION BY entity ORDER BY month) - 1) AS ret_pct FROM (
     SELECT entity, date_trunc('month', d)::DATE AS month, arg_max(px, d) AS last_px FROM panel GROUP BY 1, 2))"""


@query("month_end_returns", duck(f"SELECT entity, month, {rd('ret_pct')} AS ret_pct FROM me WHERE ret_pct IS NOT NULL", ME))
def month_end_returns(spark, sf_dir):
    return history.month_end_returns(src.panel(spark, sf_dir)).filter("ret_pct IS NOT NULL").select("entity", "month", r6(F.col("ret_pct")).alias("ret_pct"))


HISTORY = """mc AS (SELECT entity, month, round(100 * r, 6) AS ret_pct FROM (SELECT entity, month, last_px / lag(last_px) OVER (PARTITION BY entity ORDER BY month) - 1 AS r FROM (
   SELECT entity, date_trunc('month', d)::DATE AS month, CASE WHEN max(d) FILTER (px IS NOT NULL) = max(d) THEN arg_max(px, d) END AS last_px FROM dense GROUP BY 1, 2)) WHERE r IS NOT NULL),
cw AS (SELECT e.entity, m.month, r.ret_pct, row_number() OVER (PARTITION BY e.entity ORDER BY m.month) AS rn FROM ent e CROSS JOIN (
     SELECT unnest(generate_series((date_trunc('month', max(d)) - INTERVAL 120 MONTH)::DATE, (date_trunc('month', max(d)) - INTERVAL 1 MONTH)::DATE, INTERVAL 1 MONTH))::DATE AS month FROM panel) m
   LEFT JOIN mc r ON r.entity = e.entity AND r.month = m.month)"""


@query("monthly_history", duck(
    f"""SELECT entity, count(ret_pct)::BIGINT AS n_months, min(CASE WHEN ret_pct IS NOT NULL THEN month END) AS first_in_window, any_value(first_ever) AS first_available,
         count(CASE WHEN ret_pct IS NULL THEN 1 END)::BIGINT AS missing, count(CASE WHEN ret_pct IS NULL AND month > first_m THEN 1 END)::BIGINT AS missing_after_start,
         {rd('(nullif(arg_max(coalesce(wealth, -1), rn), -1) - 1) * 100')} AS compounded_pct, string_agg(coalesce(round(ret_pct * 1000000)::BIGINT::VARCHAR, '~'), ',' ORDER BY rn) AS returns,
         string_agg(coalesce(round(wealth * 1000000)::BIGINT::VARCHAR, '~'), ',' ORDER BY rn) AS wealth, coalesce(string_agg(CASE WHEN ret_pct IS NULL THEN strftime(month, '%Y-%m') END, ',' ORDER BY rn), '') AS missing_months FROM (
         SELECT c.*, f.first_ever, min(CASE WHEN ret_pct IS NOT NULL THEN month END) OVER (PARTITION BY c.entity) AS first_m,
           CASE WHEN ret_pct IS NOT NULL AND sum(CASE WHEN ret_pct IS NULL AND month > (SELECT min(month) FROM cw z WHERE z.entity = c.entity AND z.ret_pct IS NOT NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY c.entity ORDER BY rn) = 0
                THEN exp(sum(ln(1 + coalesce(ret_pct, 0) / 100)) OVER (PARTITION BY c.entity ORDER BY rn)) END AS wealth
         FROM cw c JOIN (SELECT entity, min(month) AS first_ever FROM mc GROUP BY 1) f ON f.entity = c.entity) GROUP BY entity""", HISTORY))
def monthly_history(spark, sf_dir):
    return history_table(spark, sf_dir).select("entity", "n_months", "first_in_window", "first_available", "missing", "missing_after_start", r6(F.col("compounded_pct")).alias("compounded_pct"),
                                                _listed("return_pct").alias("returns"), _listed("cumulative_wealth").alias("wealth"), F.array_join(F.transform("missing_months", lambda m: F.date_format(m, "yyyy-MM")), ",").alias("missing_months"))


def _listed(column):
    """An array of numbers as text, in millionths; a gap is `~`."""
    return F.array_join(F.transform(column, lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",", "~")


def official_months(spark, sf_dir):
    """(entity, month, ret_pct): months whose last session, and the previous month's, were priced."""
    panel = src.panel_table(spark, sf_dir)
    ends = src.densify(panel).groupBy("entity", F.trunc("d", "MM").alias("month")).agg(F.max_by(F.struct("px"), "d")["px"].alias("px"))
    w = W.partitionBy("entity").orderBy("month")
    rets = ends.select("entity", "month", F.round(100.0 * change(F.col("px"), F.lag("px").over(w)), 6).alias("ret_pct")).filter("ret_pct IS NOT NULL")
    return panel, rets


def history_table(spark, sf_dir, months: int = 120):
    panel, rets = official_months(spark, sf_dir)
    return history.history_document(history.calendar_months(panel, months).join(rets, ["entity", "month"], "left"), rets)


@query("range_recompound", duck(
    f"""SELECT entity, month, CASE WHEN ret_pct IS NOT NULL AND gaps = 0 THEN round(exp(sum(ln(1 + coalesce(ret_pct, 0) / 100)) OVER (PARTITION BY entity ORDER BY rn)), 6) + 0.0 END AS wealth FROM (
          SELECT *, sum(CASE WHEN ret_pct IS NULL AND month > f THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY rn) AS gaps FROM (
            SELECT *, min(CASE WHEN ret_pct IS NOT NULL THEN month END) OVER (PARTITION BY entity) AS f FROM cw WHERE month BETWEEN DATE '1999-01-01' AND DATE '2000-06-01'))""", HISTORY))
def range_recompound(spark, sf_dir):
    panel, rets = official_months(spark, sf_dir)
    rows = history.calendar_months(panel, 120).join(rets, ["entity", "month"], "left").filter("month BETWEEN DATE'1999-01-01' AND DATE'2000-06-01'")
    w = W.partitionBy("entity").orderBy("month")
    return rows.withColumn("rn", F.row_number().over(w)).select("entity", "month", r6(history.broken_wealth(F.col("ret_pct"), F.col("rn"), w)).alias("wealth"))


@query("quality_report", duck(
    """SELECT 'panel' AS source, 'empty price' AS check_name, 'error' AS level, count(*)::BIGINT AS n FROM dense WHERE px IS NULL
       UNION ALL SELECT 'panel', 'non-positive price', 'error', count(*) FROM panel WHERE px <= 0
       UNION ALL SELECT 'panel', 'duplicate key', 'error', count(*) - count(DISTINCT (entity, d)) FROM panel
       UNION ALL SELECT 'panel', 'baseline decreased', 'error', count(*) FROM (SELECT px - lag(px) OVER (ORDER BY d) AS g FROM panel WHERE ord = 0) WHERE g < -1e-9
       UNION ALL SELECT 'panel', 'gap over 7 days', 'warning', count(*) FROM (SELECT d - lag(d) OVER (PARTITION BY entity ORDER BY d) AS g FROM panel) WHERE g > 7
       UNION ALL SELECT 'panel', 'stale days', 'stat', (SELECT max(o_orderdate)::DATE FROM orders) - max(d) FROM panel
       UNION ALL SELECT 'orders', 'duplicate id', 'error', count(*) - count(DISTINCT o_orderkey) FROM orders
       UNION ALL SELECT 'pages', 'not https', 'error', count(*) FROM pages WHERE url IS NULL OR NOT starts_with(url, 'https://')
       UNION ALL SELECT 'releases', 'missing months', 'note', date_diff('month', min(month), max(month)) + 1 - count(*) FROM rel
       UNION ALL SELECT 'panel', 'rows', 'stat', count(*) FROM panel"""))
def quality_report(spark, sf_dir):
    panel = src.panel_table(spark, sf_dir)
    cube = materialize(src.order_cube(spark, sf_dir))
    newest = cube.agg(F.max("obs_d").alias("m")).scalar()
    return studies.quality_report(panel, src.densify(panel), src.table(spark, sf_dir, "orders"), src.table(spark, sf_dir, "pages"), src.monthly_releases(spark, sf_dir, cube), newest)


@query("fold_mean_excess", duck(
    f"""SELECT f.fold_start, l.entity, CASE WHEN l.ord = 0 THEN 0.0::DOUBLE ELSE {rd('coalesce(avg(l.excess) FILTER (l.pos <= f.s_max), 0)')} END AS mu FROM folds f CROSS JOIN lab2 l GROUP BY f.fold_start, l.entity, l.ord""",
    LABELS, "folds AS (SELECT min(d) AS fold_start, min(pos) AS start_pos, min(pos) - 45 AS s_max FROM ses GROUP BY date_trunc('year', d) HAVING min(pos) - 45 >= 252)"))
def fold_mean_excess(spark, sf_dir):
    from tidemark.operators.learning import fold_dimension, fold_means

    dense = src.dense_panel(spark, sf_dir)
    lab = op.forward_labels(dense, 21, 1)
    folds = fold_dimension(dense.select("d", "pos").distinct(), 21, 1, "year", 252, 0)
    return fold_means(lab, folds).select("fold_start", "entity", r6(F.col("mu")).alias("mu"))


@query("resample_month_end", duck(
    """SELECT month, lag(a) OVER (ORDER BY month) AS spread_lag, lag(b) OVER (ORDER BY month) AS bill_lag FROM (
         SELECT date_trunc('month', obs_d)::DATE AS month, arg_max(spread_10y_3m, obs_d) AS a, arg_max(ust_3m, obs_d) AS b FROM rates GROUP BY 1)"""))
def resample_month_end(spark, sf_dir):
    return history.resample_lagged(src.daily_rates(spark, sf_dir), "obs_d", {"spread_lag": "spread_10y_3m", "bill_lag": "ust_3m"})
