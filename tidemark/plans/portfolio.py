"""Rule, holding and portfolio-path queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import weights as fw
from tidemark.functions.columns import big, r6
from tidemark.operators import metrics, portfolio as pf, windows as op
from tidemark.plans.base import duck, query, rd
from tidemark.plans.joins import rates_known
from tidemark.plans.windows import ROWS, WIN, dual_flags
from tidemark.session import materialize
from tidemark.sources import tables as src


def _above(n: int) -> str:
    return f"CASE WHEN count(px) {ROWS(n)} >= {n} THEN (px > avg(px) {ROWS(n)})::INTEGER END"


SIGNALS = f"""sg0 AS (SELECT entity, ord, d, pos, px, ret, {_above(50)} AS a50, {_above(200)} AS a200, {_above(210)} AS a210, px / lag(px, 252) {WIN} - 1 AS m,
    CASE WHEN count(ret) {ROWS(63)} >= 63 THEN stddev_samp(ret) {ROWS(63)} * sqrt(252.0::DOUBLE) END AS rv63 FROM rets),
lead3 AS (SELECT d, min(CASE WHEN m = mx THEN ord END) AS best, max(mx) AS mx FROM (SELECT *, max(m) OVER (PARTITION BY d) AS mx FROM sg0 WHERE ord >= 2) GROUP BY d),
sig AS (SELECT c.d, c.pos, c.a50, c.a200, c.a210, c.rv63, CASE WHEN g.m IS NOT NULL AND l.mx > g.m THEN l.best ELSE 0 END AS dual, r.spread_10y_3m AS spread
  FROM sg0 c JOIN sg0 g ON g.d = c.d AND g.ord = 0 JOIN lead3 l ON l.d = c.d ASOF LEFT JOIN rates_last r ON c.d >= r.available_on WHERE c.ord = 2)"""

TARGETS = """vraw AS (SELECT date_trunc('month', d) AS month, row_number() OVER (ORDER BY date_trunc('month', d)) AS k,
    arg_min(CASE WHEN rv63 > 1e-6 THEN least(0.15::DOUBLE / rv63, 1.0::DOUBLE) ELSE 0.0::DOUBLE END, pos) AS raw FROM sig GROUP BY 1),
vfold AS (SELECT k, month, raw AS posted FROM vraw WHERE k = 1 UNION ALL
  SELECT v.k, v.month, CASE WHEN abs(v.raw - f.posted) >= 0.10 THEN v.raw ELSE f.posted END FROM vfold f JOIN vraw v ON v.k = f.k + 1),
targets AS (
  SELECT 'sma_10m' AS strategy, d, pos, CASE WHEN coalesce(a210, 0) = 1 THEN 2 ELSE 0 END AS t, NULL::DOUBLE AS w FROM sig
  UNION ALL SELECT 'dual_momentum', d, pos, dual, NULL FROM sig
  UNION ALL SELECT 'curve_trend', d, pos, CASE WHEN spread >= 0 AND coalesce(a200, 0) = 1 THEN 2 ELSE 0 END, NULL FROM sig
  UNION ALL SELECT 'sell_in_may', d, pos, CASE WHEN month(d) IN (11, 12, 1, 2, 3, 4) THEN 2 ELSE 0 END, NULL FROM sig
  UNION ALL SELECT 'vol_target', d, pos, NULL, posted FROM sig JOIN vfold ON month = date_trunc('month', d)),
tw AS (SELECT strategy, d, pos, """ + ", ".join(
    f"CASE WHEN t IS NULL THEN {'1 - w' if i == 0 else 'w' if i == 2 else '0.0'} ELSE (t = {i})::INTEGER END::DOUBLE AS w{i}" for i in range(5)) + " FROM targets)"
RULES_SQL = (SIGNALS, TARGETS)


def signals(spark, sf_dir, dense=None):
    """One row per session with the inputs of every rule (role entity 2 is the risky core)."""
    w = op.by_entity()
    px = F.col("px")
    dense = dense if dense is not None else src.dense_panel(spark, sf_dir)
    rets = op.with_returns(dense).select(
        "entity", "ord", "d", "pos", "px", *[op.above_average(px, n, w).alias(f"a{n}") for n in (50, 200, 210)], op.total_return(px, 252, w).alias("m"),
        op.realized_vol(F.col("ret"), 63, 252, w).alias("rv63"))
    core = {c: F.max(F.when(F.col("ord") == 2, F.col(c))).alias(c) for c in ("a50", "a200", "a210", "rv63")}
    safe = F.max(F.when(F.col("ord") == 0, F.col("m")))
    risky = F.when((F.col("ord") >= 2) & F.col("m").isNotNull(), F.struct("m", -F.col("ord")))
    wins = F.coalesce(F.max(F.when(F.col("ord") >= 2, F.col("m"))) > safe, F.lit(False))
    per_day = rets.groupBy("d", "pos").agg(*core.values(), F.when(wins, F.max_by("ord", risky)).otherwise(0).alias("dual"))
    known = rates_known(spark, sf_dir, dense.select("d").distinct()).select("d", F.col("spread_10y_3m").alias("spread"))
    return per_day.join(known, "d")


def _core(on):
    return F.when(F.coalesce(on, F.lit(False)), 2).otherwise(0)


# One-hot rules: signal row -> entity number; a missing signal means the safe entity.
RULES = {
    "sma_10m": lambda: _core(F.col("a210") == 1),
    "dual_momentum": lambda: F.col("dual"),
    "curve_trend": lambda: _core((F.col("spread") >= 0) & (F.col("a200") == 1)),
    "sell_in_may": lambda: _core(F.month("d").isin(11, 12, 1, 2, 3, 4)),
}


def rule_targets(spark, sf_dir, dense=None):
    """(strategy, d, pos, weights) for all five rules."""
    sig = materialize(signals(spark, sf_dir, dense))
    picks = sig.select("d", "pos", *[fn().cast("int").alias(name) for name, fn in RULES.items()])
    hot = picks.unpivot(["d", "pos"], list(RULES), "strategy", "t").select("strategy", "d", "pos", fw.one_hot(F.col("t"), 5).alias("weights"))
    vt = pf.vol_target_weights(sig.select(F.lit("vol_target").alias("strategy"), "d", "pos", F.col("rv63").alias("rv")))
    zero = F.lit(0.0)
    return hot.unionByName(vt.select("strategy", "d", "pos", F.array(1.0 - F.col("w"), zero, F.col("w"), zero, zero).alias("weights")))


def rule_query(name: str, strategy: str):
    sql = duck("SELECT d, " + ", ".join(f"{rd(f'w{i}')} AS w{i}" for i in range(5)) + f" FROM tw WHERE strategy = '{strategy}'", *RULES_SQL)

    @query(name, sql)
    def run(spark, sf_dir):
        if strategy in RULES:
            picks = signals(spark, sf_dir).select("d", fw.one_hot(RULES[strategy]().cast("int"), 5).alias("weights"))
        else:
            picks = rule_targets(spark, sf_dir).filter(F.col("strategy") == strategy)
        return picks.select("d", *[r6(F.get("weights", F.lit(i))).alias(f"w{i}") for i in range(5)])

    return run


rule_query("rule_sma", "sma_10m")
rule_query("rule_dual_momentum", "dual_momentum")
rule_query("rule_curve_trend", "curve_trend")
rule_query("rule_seasonal", "sell_in_may")
rule_query("rule_vol_target", "vol_target")


@query("all_rules", duck("SELECT strategy, d, " + ", ".join(f"{rd(f'w{i}')} AS w{i}" for i in range(5)) + " FROM tw", *RULES_SQL))
def all_rules(spark, sf_dir):
    return rule_targets(spark, sf_dir).select("strategy", "d", *[r6(F.get("weights", F.lit(i))).alias(f"w{i}") for i in range(5)])


LAG = 1
EARNED = f"""dret AS (SELECT pos, """ + ", ".join(f"coalesce(max(CASE WHEN ord = {i} THEN r END), 0) AS r{i}" for i in range(5)) + f""" FROM (
   SELECT ord, pos, px / lag(px) {WIN} - 1 AS r FROM dense) GROUP BY pos),
pret AS (SELECT strategy, d, pos, w0, w1, w2, w3, w4, CASE WHEN pos = 0 THEN 0.0::DOUBLE ELSE """ + " + ".join(f"w{i} * r{i}" for i in range(5)) + """ END AS ret FROM held JOIN dret USING (pos)),
pwealth AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY pos)) AS w FROM pret)"""
HELD = """held AS (SELECT strategy, d, pos, """ + ", ".join(
    f"coalesce(lag(w{i}, {LAG + 1}) OVER k, first_value(w{i}) OVER k) AS w{i}" for i in range(5)) + f""" FROM tw WINDOW k AS (PARTITION BY strategy ORDER BY pos)),
{EARNED}"""


def rule_paths(spark, sf_dir, dense=None, limited=False):
    """(strategy, d, pos, weights, ret, w) of every rule after one session of execution lag; `limited`: also under the
    holding period and the monthly quota."""
    dense = dense if dense is not None else materialize(src.dense_panel(spark, sf_dir))
    k = W.partitionBy("strategy").orderBy("pos")
    if limited:
        held = quota_limited(spark, sf_dir, dense).filter(F.col("lag") == LAG).select("strategy", "d", "pos", "weights")
    else:
        held = rule_targets(spark, sf_dir, dense).withColumn("weights", F.coalesce(F.lag("weights", LAG + 1).over(k), F.first("weights").over(op.running(k))))
    simple = dense.select("ord", "pos", op.total_return(F.col("px"), 1, op.by_entity()).alias("r"))
    paths = pf.portfolio_returns(held, pf.day_vectors(simple, "r", ("pos",)))
    return paths.withColumn("w", F.product(1.0 + F.col("ret")).over(op.running(k)))


@query("portfolio_returns", duck(f"SELECT strategy, d, {rd('ret')} AS ret, {rd('w')} AS wealth FROM pwealth", *RULES_SQL, HELD))
def portfolio_returns(spark, sf_dir):
    return rule_paths(spark, sf_dir).select("strategy", "d", r6(F.col("ret")).alias("ret"), r6(F.col("w")).alias("wealth"))


VERSUS = """vs AS (SELECT strategy, d, pos, w, ret FROM pwealth UNION ALL SELECT 'hold ' || entity, d, pos, w, ret FROM wealth),
vb AS (SELECT v.*, row_number() OVER (PARTITION BY strategy ORDER BY v.pos) AS rn, coalesce(b.ret, 0.0::DOUBLE) AS base_ret, max(v.w) OVER (PARTITION BY strategy ORDER BY v.pos) AS peak
  FROM vs v LEFT JOIN (SELECT pos, ret FROM wealth WHERE ord = 0) b ON b.pos = v.pos)"""


@query("rule_versus_hold", duck(
    f"""SELECT strategy, {rd("CASE WHEN date_diff('day', min(d), max(d)) > 0 THEN (arg_max(w, pos) / arg_min(w, pos)) ** (365.25::DOUBLE / date_diff('day', min(d), max(d))) - 1 ELSE 0.0::DOUBLE END")} AS cagr,
          {rd('least(min(w / peak - 1), 0.0::DOUBLE)')} AS max_drawdown, {rd('stddev_samp(ret) FILTER (rn > 1) * sqrt(252.0::DOUBLE)')} AS vol,
          {rd('coalesce(avg(ret - base_ret) FILTER (rn > 1) / nullif(stddev_samp(ret - base_ret) FILTER (rn > 1), 0) * sqrt(252.0::DOUBLE), 0.0::DOUBLE)')} AS sharpe, count(*)::BIGINT AS n_rows FROM vb GROUP BY strategy""",
    *RULES_SQL, HELD, VERSUS))
def rule_versus_hold(spark, sf_dir):
    """Flagship: every rule beside buy-and-hold of every entity, one metric row per strategy."""
    m = metrics.path_metrics("strategy")
    return all_paths(spark, sf_dir).groupBy("strategy").agg(
        *[r6(m[c]).alias(c) for c in ("cagr", "max_drawdown", "vol", "sharpe")], m["n_rows"].alias("n_rows"))


def all_paths(spark, sf_dir, limited=False):
    """Rule and buy-and-hold paths with the safe entity's return alongside."""
    dense = materialize(src.dense_panel(spark, sf_dir))
    holds = pf.hold_paths(dense)
    base = holds.filter("ord = 0").select("pos", F.col("ret").alias("base_ret"))
    paths = rule_paths(spark, sf_dir, dense, limited).select("strategy", "d", "pos", "w", "ret").unionByName(
        holds.select(F.concat(F.lit("hold "), "entity").alias("strategy"), "d", "pos", "w", "ret"))
    joined = paths.join(base, "pos", "left").withColumn("base_ret", F.coalesce("base_ret", F.lit(0.0)))
    return metrics.with_path_columns(joined, "strategy", 252)


@query("buy_and_hold", duck(
    f"SELECT entity, d, {rd(f'px / first_value(px) {WIN}')} AS wealth, {rd('CASE WHEN pos = 0 THEN 0.0 ELSE coalesce(r, 0.0::DOUBLE) END')} AS ret FROM (SELECT *, px / lag(px) {WIN} - 1 AS r FROM dense)"))
def buy_and_hold(spark, sf_dir):
    w = op.by_entity()
    dense = src.dense_panel(spark, sf_dir)
    return dense.select("entity", "d", r6(F.try_divide(F.col("px"), F.first("px").over(op.running(w)))).alias("wealth"),
                        r6(F.coalesce(op.total_return(F.col("px"), 1, w), F.lit(0.0))).alias("ret"))


@query("static_mix", duck(
    f"""SELECT d, {rd('total / first_value(total) OVER (ORDER BY pos)')} AS wealth, {rd('CASE WHEN total <> 0 THEN vg / total END')} AS w_safe, {rd('CASE WHEN total <> 0 THEN vc / total END')} AS w_core FROM (
          SELECT d, pos, coalesce(0.4 / g0 * coalesce(g, 0), 0) AS vg, coalesce(0.6 / c0 * coalesce(c, 0), 0) AS vc, coalesce(0.4 / g0 * coalesce(g, 0), 0) + coalesce(0.6 / c0 * coalesce(c, 0), 0) AS total
          FROM (SELECT *, first_value(g) OVER (ORDER BY pos) AS g0, first_value(c) OVER (ORDER BY pos) AS c0 FROM moments))"""))
def static_mix(spark, sf_dir):
    out = pf.static_mix(src.dense_panel(spark, sf_dir), [0.4, 0.0, 0.6, 0.0, 0.0])
    return out.select("d", r6(F.col("w")).alias("wealth"), r6(F.get("weights", F.lit(0))).alias("w_safe"), r6(F.get("weights", F.lit(2))).alias("w_core"))


# Risky shares of the rebalanced mixes.
MIXES = {"mix_20": 0.2, "mix_60": 0.6, "mix_80": 0.8}
REBALANCED = """px2 AS (SELECT pos, d, coalesce(fg, 0) AS g, coalesce(fc, 0) AS c, date_trunc('month', d) AS m FROM (
   SELECT d, pos, max(CASE WHEN ord = 0 THEN fpx END) AS fg, max(CASE WHEN ord = 2 THEN fpx END) AS fc FROM filled GROUP BY 1, 2)),
due AS (SELECT a.pos + 2 AS pos FROM px2 a JOIN px2 b ON b.pos = a.pos - 1 WHERE a.m <> b.m),
stp AS (SELECT x.pos, x.d, x.g, x.c, y.g AS pg, y.c AS pc, z.pos IS NOT NULL AS is_due FROM px2 x JOIN px2 y ON y.pos = x.pos - 1 LEFT JOIN due z ON z.pos = x.pos),
reb AS (
  SELECT k AS strategy, t, pos, d, CASE WHEN g > 0 THEN (1 - t) / g ELSE 0.0::DOUBLE END AS sg, CASE WHEN c > 0 THEN t / c ELSE 0.0::DOUBLE END AS sc, 1.0::DOUBLE AS w, 1 - t AS wg
    FROM px2 CROSS JOIN (VALUES ('mix_20', 0.2::DOUBLE), ('mix_60', 0.6::DOUBLE), ('mix_80', 0.8::DOUBLE)) m(k, t) WHERE pos = 0
  UNION ALL
  SELECT strategy, t, pos, d, nsg, nsc, CASE WHEN worth > 0 THEN w * (g * nsg + c * nsc) / worth ELSE 1.0::DOUBLE END, CASE WHEN worth > 0 THEN pg * nsg / (pg * nsg + pc * nsc) ELSE 1 - t END FROM (
    SELECT *, CASE WHEN reset THEN CASE WHEN pg > 0 THEN (1 - t) * worth / pg ELSE 0 END ELSE sg END AS nsg, CASE WHEN reset THEN CASE WHEN pc > 0 THEN t * worth / pc ELSE 0 END ELSE sc END AS nsc FROM (
      SELECT r.strategy, r.t, s.pos, s.d, s.g, s.c, s.pg, s.pc, r.sg, r.sc, r.w, s.pg * r.sg + s.pc * r.sc AS worth,
        s.is_due AND s.pg * r.sg + s.pc * r.sc > 0 AND abs(s.pg * r.sg / (s.pg * r.sg + s.pc * r.sc) - (1 - r.t)) + abs(s.pc * r.sc / (s.pg * r.sg + s.pc * r.sc) - r.t) > 0.02 AS reset
      FROM reb r JOIN stp s ON s.pos = r.pos + 1)))"""


@query("rebalanced_mix", duck(f"SELECT strategy, d, {rd('w')} AS wealth, {rd('wg')} AS w_safe FROM reb", REBALANCED))
def rebalanced_mix(spark, sf_dir):
    dense = op.with_returns(src.dense_panel(spark, sf_dir)).drop("px").withColumnRenamed("fpx", "px")
    days = pf.day_vectors(dense, "px")
    mixes = F.array(*[F.struct(F.lit(k).alias("strategy"), F.array(*[F.lit(x) for x in (1 - t, 0.0, t, 0.0, 0.0)]).alias("target")) for k, t in MIXES.items()])
    rows = days.withColumn("m", F.explode(mixes)).select("m.strategy", "pos", "d", "px", "m.target")
    return pf.rebalanced_mixes(rows, lag=1).select("strategy", "d", r6(F.col("w")).alias("wealth"), r6(F.get("weights", F.lit(0))).alias("w_safe"))


@query("regime_labels", duck(
    f"""SELECT d, CASE WHEN a50 IS NULL OR spread IS NULL THEN 'Unavailable' ELSE CASE WHEN a50 = 1 THEN 'Uptrend' ELSE 'Downtrend' END || ' | ' || CASE WHEN coalesce(rv63, 0) >= 0.70 THEN 'High vol' ELSE 'Low vol' END
          || ' | ' || CASE WHEN spread < 0 THEN 'Inverted curve' ELSE 'Normal curve' END END AS regime FROM sig""", SIGNALS))
def regime_labels(spark, sf_dir):
    return regimes(signals(spark, sf_dir)).select("d", "regime")


def regimes(sig):
    """Trend, volatility and curve flags joined into one label; unknown trend or curve has none."""
    trend = F.when(F.col("a50") == 1, "Uptrend").otherwise("Downtrend")
    vol = F.when(F.coalesce("rv63", F.lit(0.0)) >= 0.70, "High vol").otherwise("Low vol")
    curve = F.when(F.col("spread") < 0, "Inverted curve").otherwise("Normal curve")
    known = F.col("a50").isNotNull() & F.col("spread").isNotNull()
    return sig.withColumn("regime", F.when(known, F.concat_ws(" | ", trend, vol, curve)).otherwise("Unavailable"))


@query("regime_streak", duck(
    """SELECT regime, max(d) AS last_d, count(*)::BIGINT AS sessions FROM (SELECT *, sum(CASE WHEN regime = prev THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS island FROM (
         SELECT *, lag(regime) OVER (ORDER BY pos) AS prev FROM rgl)) WHERE island = (SELECT count(*) FROM (SELECT regime, lag(regime) OVER (ORDER BY pos) AS prev FROM rgl) WHERE regime IS DISTINCT FROM prev) GROUP BY regime""", SIGNALS,
    """rgl AS (SELECT d, pos, CASE WHEN a50 IS NULL OR spread IS NULL THEN 'Unavailable' ELSE CASE WHEN a50 = 1 THEN 'Uptrend' ELSE 'Downtrend' END || ' | ' || CASE WHEN coalesce(rv63, 0) >= 0.70 THEN 'High vol' ELSE 'Low vol' END
          || ' | ' || CASE WHEN spread < 0 THEN 'Inverted curve' ELSE 'Normal curve' END END AS regime FROM sig)"""))
def regime_streak(spark, sf_dir):
    rows = regimes(signals(spark, sf_dir)).withColumn("series", F.lit("core"))
    w = W.partitionBy("series").orderBy("pos")
    run = op.run_length(rows.withColumn("prev", F.lag("regime").over(w)), F.col("regime") == F.col("prev"), ("series",))
    last = run.groupBy("series").agg(F.max_by(F.struct("regime", "d", "run"), "pos").alias("x"))
    return last.select("x.regime", F.col("x.d").alias("last_d"), (F.col("x.run") + 1).cast("bigint").alias("sessions"))


N = range(5)
DIFFERS = " OR ".join(f"abs(l.w{i} - s.e{i}) > 1e-6 + 1e-5 * abs(s.e{i})" for i in N)
ALL_SAFE = "l.w0 >= 0.999 AND " + " AND ".join(f"abs(l.w{i}) <= 1e-8" for i in N[1:])
SAFER = "l.w0 >= s.e0 - 1e-8 AND " + " AND ".join(f"l.w{i} <= s.e{i} + 1e-8" for i in N[1:])
PATH_SQL = f"""tl AS MATERIALIZED (
   SELECT x.*, l.lag_n, count(*) OVER (PARTITION BY x.strategy, l.lag_n) AS n,
     CASE WHEN l.lag_n = 1 THEN lead(date_trunc('month', x.d), 1) OVER k ELSE lead(date_trunc('month', x.d), 2) OVER k END AS post_month
   FROM tw x CROSS JOIN (VALUES (1), (2)) l(lag_n) WINDOW k AS (PARTITION BY x.strategy, l.lag_n ORDER BY x.pos)),
sim AS (
  SELECT strategy, lag_n, pos, {", ".join(f"w{i} AS e{i}" for i in N)}, -1000000::BIGINT AS last_sw, NULL::TIMESTAMP AS um, 0 AS uc, 0 AS acc, 0 AS used FROM tl WHERE pos = 0
  UNION ALL
  SELECT strategy, lag_n, pos, {", ".join(f"CASE WHEN ok THEN w{i} ELSE e{i} END" for i in N)}, CASE WHEN ok THEN pos ELSE last_sw END, CASE WHEN ok THEN post_month ELSE um END,
    CASE WHEN ok THEN least(u + 1, 2) ELSE uc END, ok::INTEGER, CASE WHEN ok THEN least(u + 1, 2) ELSE 0 END FROM (
    SELECT *, differs AND (pos - last_sw >= 21 OR all_safe) AND pos + lag_n < n AND (u < 2 OR safer) AS ok FROM (
      SELECT l.*, {", ".join(f"s.e{i}" for i in N)}, s.last_sw, s.um, s.uc, CASE WHEN s.um = l.post_month THEN s.uc ELSE 0 END AS u, {DIFFERS} AS differs, {ALL_SAFE} AS all_safe, {SAFER} AS safer
      FROM sim s JOIN tl l ON l.strategy = s.strategy AND l.lag_n = s.lag_n AND l.pos = s.pos + 1)))"""
HELD_LIMITED = f"""held AS (SELECT strategy, d, pos, {", ".join(f"coalesce(lag(e{i}, {LAG + 1}) OVER k, first_value(e{i}) OVER k) AS w{i}" for i in N)}
   FROM (SELECT * FROM sim WHERE lag_n = {LAG}) JOIN ses USING (pos) WINDOW k AS (PARTITION BY strategy ORDER BY pos)),
{EARNED}"""


@query("target_path", duck(
    f"""SELECT strategy, lag_n::BIGINT AS lag, d, {', '.join(rd(f'coalesce(CASE WHEN lag_n = 1 THEN lag(e{i}, 2) OVER k ELSE lag(e{i}, 3) OVER k END, first_value(e{i}) OVER k)') + f' AS w{i}' for i in N)},
          coalesce(CASE WHEN lag_n = 1 THEN lag(acc, 1) OVER k ELSE lag(acc, 2) OVER k END, 0)::BIGINT AS post, coalesce(CASE WHEN lag_n = 1 THEN lag(used, 1) OVER k ELSE lag(used, 2) OVER k END, 0)::BIGINT AS used
        FROM sim JOIN ses USING (pos) WINDOW k AS (PARTITION BY strategy, lag_n ORDER BY pos)""", *RULES_SQL, PATH_SQL))
def target_path(spark, sf_dir):
    out = quota_limited(spark, sf_dir)
    return out.select("strategy", big(F.col("lag")).alias("lag"), "d", *[r6(F.get("weights", F.lit(i))).alias(f"w{i}") for i in N], big(F.col("post")).alias("post"), big(F.col("used")).alias("used"))


def quota_limited(spark, sf_dir, dense=None):
    rows = rule_targets(spark, sf_dir, dense).withColumn("lag", F.explode(F.array(F.lit(1), F.lit(2))))
    return pf.limited_paths(materialize(rows.select("strategy", "lag", "pos", "d", "weights")), min_hold=21, size=5)
