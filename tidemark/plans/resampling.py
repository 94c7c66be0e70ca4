"""Bootstrap intervals, fan charts and the scoreboard built from them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import columns as fc
from tidemark.functions.columns import big, r6
from tidemark.operators import bootstrap as bs
from tidemark.operators import evaluation as ev
from tidemark.operators import metrics
from tidemark.operators import windows as op
from tidemark.plans import experiments
from tidemark.plans.base import duck, query, rd
from tidemark.plans.portfolio import HELD_LIMITED, PATH_SQL, RULES_SQL, VERSUS, all_paths
from tidemark.session import materialize
from tidemark.sources import tables as src

BLOCK, REPS = 21, 400
HASH = "('0x' || substr(md5(concat_ws('-', {parts})), 1, 7))::BIGINT"


def boot_sql(pairs: str) -> tuple[str, ...]:
    """Replica CTEs over a CTE `pairs`(k, pos, d, rs, rb); ends in `boot`(k, excess_cagr, low, high, n_boot)."""
    return (
        f"""bn AS (SELECT k, count(*) AS n, ceil(count(*) / {BLOCK}.0)::BIGINT AS blocks, greatest(date_diff('day', min(d), max(d)), 1) AS days,
              exp(sum(CASE WHEN pos = 0 THEN 0 ELSE ln(1 + rs) END) * 365.25 / greatest(date_diff('day', min(d), max(d)), 1))
              - exp(sum(CASE WHEN pos = 0 THEN 0 ELSE ln(1 + rb) END) * 365.25 / greatest(date_diff('day', min(d), max(d)), 1)) AS point FROM {pairs} GROUP BY k)""",
        f"bcum AS (SELECT k, pos, sum(ln(1 + rs)) OVER (PARTITION BY k ORDER BY pos) AS cs, sum(ln(1 + rb)) OVER (PARTITION BY k ORDER BY pos) AS cb FROM {pairs})",
        f"""draws AS (SELECT k, rep, days, start, CASE WHEN blk = blocks - 1 THEN n - {BLOCK} * (blocks - 1) ELSE {BLOCK} END AS len FROM (
              SELECT *, {HASH.format(parts="'0', rep::VARCHAR, blk::VARCHAR")} % (n - {BLOCK} + 1) AS start FROM (
                SELECT k, n, blocks, days, rep, unnest(range(blocks)) AS blk FROM bn CROSS JOIN (SELECT unnest(range({REPS})) AS rep) WHERE n >= {BLOCK} + 2)))""",
        """reps AS (SELECT d.k, rep, exp(sum(e.cs - coalesce(s.cs, 0)) * 365.25 / any_value(days)) - exp(sum(e.cb - coalesce(s.cb, 0)) * 365.25 / any_value(days)) AS x
             FROM draws d JOIN bcum e ON e.k = d.k AND e.pos = d.start + d.len - 1 LEFT JOIN bcum s ON s.k = d.k AND s.pos = d.start - 1 GROUP BY d.k, rep)""",
        """boot AS (SELECT b.k, any_value(b.n) AS n, any_value(b.point) AS excess_cagr, coalesce(quantile_cont(r.x, 0.05), any_value(b.point)) AS low,
             coalesce(quantile_cont(r.x, 0.95), any_value(b.point)) AS high, count(r.x) AS n_boot FROM bn b LEFT JOIN reps r ON r.k = b.k GROUP BY b.k)""",
    )


def pair_returns(joined, keys):
    """Aligned pair paths with positions from 0 and returns whose first is zero."""
    out = metrics.aligned(joined, keys)
    w = W.partitionBy(*keys).orderBy("d")
    step = lambda c: F.coalesce(fc.change(F.col(c), F.lag(c).over(w)), F.lit(0.0))
    return out.select(*keys, "d", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), step("a").alias("rs"), step("b").alias("rb"))


PAIRS = """pairs AS (SELECT k, d, row_number() OVER w - 1 AS pos, coalesce(a / lag(a) OVER w - 1, 0) AS rs, coalesce(b / lag(b) OVER w - 1, 0) AS rb
  FROM (SELECT p.entity AS k, p.d, p.px AS a, q.px AS b FROM panel p JOIN panel q ON q.d = p.d AND q.ord = 0 WHERE p.ord > 0) WINDOW w AS (PARTITION BY k ORDER BY d))"""


@query("block_bootstrap", duck(f"SELECT k AS entity, {rd('excess_cagr')} AS excess_cagr, {rd('low')} AS low, {rd('high')} AS high, n_boot::BIGINT AS n_boot FROM boot", PAIRS, *boot_sql("pairs")))
def block_bootstrap(spark, sf_dir):
    panel = src.panel_table(spark, sf_dir)
    base = panel.filter("ord = 0").select("d", F.col("px").alias("bw"))
    joined = panel.filter("ord > 0").select("entity", "d", F.col("px").alias("w")).join(base, "d")
    out = bs.excess_growth(pair_returns(joined, ["entity"]), ["entity"], BLOCK, REPS)
    return out.select("entity", *[r6(F.col(c)).alias(c) for c in ("excess_cagr", "low", "high")], big(F.col("n_boot")).alias("n_boot"))


HORIZONS = (252, 756, 1260)


@query("fan_chart", duck(
    "SELECT entity, h::BIGINT AS horizon, " + ", ".join(f"{rd(f'quantile_cont(v, {q})', 4)} AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + f""" FROM (
       SELECT d.entity, h, rep, exp(sum(e.c - coalesce(s.c, 0))) AS v FROM (
         SELECT entity, h, rep, {HASH.format(parts="'fan', h::VARCHAR, rep::VARCHAR, blk::VARCHAR")} % (n - 21 + 1) AS start FROM (
           SELECT entity, n, h, rep, unnest(range(h // 21)) AS blk FROM (SELECT entity, count(*) AS n FROM fr GROUP BY 1) CROSS JOIN (SELECT unnest([252, 756, 1260]) AS h) CROSS JOIN (SELECT unnest(range(300)) AS rep))) d
       JOIN fr e ON e.entity = d.entity AND e.pos = d.start + 20 LEFT JOIN fr s ON s.entity = d.entity AND s.pos = d.start - 1 GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    """fr AS (SELECT entity, row_number() OVER w - 1 AS pos, sum(ln(1 + ret)) OVER w AS c FROM rets WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY d))"""))
def fan_chart(spark, sf_dir):
    rets = op.with_returns(src.dense_panel(spark, sf_dir)).filter("ret IS NOT NULL")
    w = W.partitionBy("entity").orderBy("d")
    paths = rets.select("entity", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.col("ret").alias("r"))
    out = bs.terminal_wealth(paths, ["entity"], HORIZONS, BLOCK, 300, "fan")
    return out.select("entity", big(F.col("horizon")).alias("horizon"), *[F.round(c, 4).alias(c) for c in ("p10", "p25", "p50", "p75", "p90")])


# Every rule under holding period and quota, and every entity, against two baselines, the safe entity and the core one.
COMPARE = ("""vp AS (SELECT v.strategy || ' / ' || b.strategy AS k, v.strategy, b.strategy AS baseline, v.d, v.w AS a, b.w AS b FROM vs v JOIN vs b ON b.d = v.d
     WHERE b.strategy IN (SELECT 'hold ' || entity FROM ent WHERE ord IN (0, 2)) AND b.strategy <> v.strategy)""",
    """cpairs AS (SELECT k, strategy, baseline, d, row_number() OVER w - 1 AS pos, coalesce(a / lag(a) OVER w - 1, 0) AS rs, coalesce(b / lag(b) OVER w - 1, 0) AS rb FROM vp WINDOW w AS (PARTITION BY k ORDER BY d))""")
DSR_SQL = """dsr AS (SELECT k, CASE WHEN t >= 10 THEN (sr - sqrt(factor / (t - 1)) * (SELECT maximum FROM hurdle)) * sqrt(t - 1) / sqrt(factor) END AS z FROM (
   SELECT *, greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12) AS factor FROM (
     SELECT k, count(*) AS t, avg(x) / stddev_samp(x) AS sr, skewness(x) AS skew, kurtosis(x) + 3 AS kurt FROM (SELECT k, rs - rb AS x FROM cpairs WHERE pos > 0) GROUP BY 1)))"""
POINTS = lambda c: f"round({c} * 100, 2)::DECIMAL(18, 2)::VARCHAR"
BOARD = f"""board AS (SELECT *, strategy || ' against ' || baseline || ': excess growth ' || {POINTS('raw')} || ' points a year, 90% interval ' || {POINTS('raw_low')} || ' to ' || {POINTS('raw_high')} || ', verdict ' || verdict || '.'
    || CASE WHEN raw < 0 THEN ' The point estimate is below this baseline.' ELSE '' END AS sentence FROM (
   SELECT p.strategy, p.baseline, b.excess_cagr AS raw, b.low AS raw_low, b.high AS raw_high, round(b.excess_cagr, 6) + 0.0 AS excess_cagr, round(b.low, 6) + 0.0 AS low, round(b.high, 6) + 0.0 AS high, round(z.z, 5) + 0.0 AS dsr_z,
   CASE WHEN b.excess_cagr > 0 AND b.low > 0 AND coalesce(z.z >= {ev.Z95}, false) THEN 'Beat' WHEN b.excess_cagr < 0 AND b.high < 0 THEN 'Underperformed' ELSE 'Inconclusive' END AS verdict,
   (b.excess_cagr < 0)::INTEGER::BIGINT AS below FROM (SELECT DISTINCT k, strategy, baseline FROM cpairs) p JOIN boot b ON b.k = p.k JOIN dsr z ON z.k = p.k))"""
BOARD_SQL = (*RULES_SQL, PATH_SQL, HELD_LIMITED, VERSUS, *COMPARE, *boot_sql("cpairs"), *experiments.TRIAL_CTES, DSR_SQL, BOARD)


def comparisons(spark, sf_dir, paths=None):
    """(strategy, baseline, excess_cagr, low, high, dsr_z, verdict, below, sentence) for every pair."""
    paths = (paths if paths is not None else materialize(all_paths(spark, sf_dir, limited=True))).select("strategy", "d", "pos", "w")
    bases = src.table(spark, sf_dir, "region").filter("r_regionkey IN (0, 2)").select(F.concat(F.lit("hold "), "r_name").alias("baseline"))
    base = paths.withColumnRenamed("strategy", "baseline").withColumnRenamed("w", "bw").drop("pos").join(bases, "baseline")
    joined = paths.join(base, "d").filter("baseline <> strategy")
    keys = ["strategy", "baseline"]
    pairs = materialize(pair_returns(joined, keys))
    boot = bs.excess_growth(pairs, keys, BLOCK, REPS)
    maximum = experiments.expected_maximum(experiments.logged_trials(spark, sf_dir)).select("maximum").scalar()
    dsr = ev.deflated_sharpe(pairs.filter("pos > 0").withColumn("x", F.col("rs") - F.col("rb")), "x", keys, maximum).select(*keys, "dsr_z")
    out = boot.join(dsr, keys)
    label = fc.verdict(F.col("excess_cagr"), F.col("low"), F.col("high"), F.col("dsr_z") >= ev.Z95)
    out = out.withColumn("verdict", label).withColumn("below", F.when(F.col("excess_cagr") < 0, 1).otherwise(0).cast("bigint"))
    return out.withColumn("sentence", fc.comparison_sentence(F.col("strategy"), F.col("baseline"), F.col("excess_cagr"), F.col("low"), F.col("high"), F.col("verdict")))


@query("scoreboard_compare", duck("SELECT strategy, baseline, excess_cagr, low, high, dsr_z, verdict, below, sentence FROM board", *BOARD_SQL))
def scoreboard_compare(spark, sf_dir):
    out = comparisons(spark, sf_dir)
    return out.select("strategy", "baseline", *[r6(F.col(c)).alias(c) for c in ("excess_cagr", "low", "high")], F.round("dsr_z", 5).alias("dsr_z"), "verdict", "below", "sentence")


def board_rows(spark, sf_dir):
    """One row per strategy: metrics plus a map of comparisons by baseline."""
    paths = materialize(all_paths(spark, sf_dir, limited=True))
    m = metrics.path_metrics("strategy")
    rows = paths.groupBy("strategy").agg(*[r6(m[c]).alias(c) for c in ("cagr", "vol", "sharpe", "max_drawdown", "ulcer", "hit_rate")])
    versus = comparisons(spark, sf_dir, paths).groupBy("strategy").agg(
        F.map_from_entries(F.collect_list(F.struct("baseline", F.struct("excess_cagr", "low", "high", "dsr_z", "verdict", "sentence")))).alias("versus"),
        F.count(F.lit(1)).alias("n_compared"), F.sum("below").alias("n_below"), F.count(F.when(F.col("verdict") == "Beat", 1)).alias("n_beat"))
    kind = F.when(F.startswith("strategy", F.lit("hold ")), "baseline").otherwise("rule")
    return rows.join(versus, "strategy").withColumn("kind", kind)


@query("scoreboard", duck(
    f"""SELECT v.strategy, CASE WHEN starts_with(v.strategy, 'hold ') THEN 'baseline' ELSE 'rule' END AS kind, v.cagr, v.max_drawdown, v.vol, b.n_compared, b.n_below, b.n_beat FROM (
          SELECT strategy, {rd("(arg_max(w, pos) / arg_min(w, pos)) ** (365.25::DOUBLE / date_diff('day', min(d), max(d))) - 1")} AS cagr, {rd('least(min(w / peak - 1), 0.0::DOUBLE)')} AS max_drawdown,
            {rd('stddev_samp(ret) FILTER (rn > 1) * sqrt(252.0::DOUBLE)')} AS vol FROM vb GROUP BY 1) v
        JOIN (SELECT strategy, count(*)::BIGINT AS n_compared, sum(below)::BIGINT AS n_below, count(CASE WHEN verdict = 'Beat' THEN 1 END)::BIGINT AS n_beat FROM board GROUP BY 1) b ON b.strategy = v.strategy""", *BOARD_SQL))
def scoreboard(spark, sf_dir):
    return board_rows(spark, sf_dir).select("strategy", "kind", "cagr", "max_drawdown", "vol", "n_compared", "n_below", "n_beat")


@query("scoreboard_view", duck("SELECT strategy, baseline, verdict, excess_cagr FROM board WHERE starts_with(strategy, 'hold ') = false AND baseline = (SELECT 'hold ' || entity FROM ent WHERE ord = 2)", *BOARD_SQL))
def scoreboard_view(spark, sf_dir):
    """The slice of the comparison table one view shows: rules against the core entity."""
    core = src.table(spark, sf_dir, "region").filter("r_regionkey = 2").select(F.concat(F.lit("hold "), "r_name").alias("baseline"))
    rows = comparisons(spark, sf_dir).filter(~F.startswith("strategy", F.lit("hold ")))
    return rows.join(core, "baseline").select("strategy", "baseline", "verdict", r6(F.col("excess_cagr")).alias("excess_cagr"))
