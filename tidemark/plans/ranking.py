"""Top-k, sampling, de-duplication and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.columns import big, r6
from tidemark.operators import bands, windows as op
from tidemark.operators.history import calendar_months, month_end
from tidemark.operators.portfolio import hold_paths
from tidemark.plans.base import duck, query, rd
from tidemark.plans.joins import BLOCK_SQL, LEADERS, leader_paths, on_blocks
from tidemark.sources import tables as src


@query("month_end_sample", duck(f"SELECT entity, max(d) AS d, {rd('arg_max(w, d)')} AS wealth FROM wealth GROUP BY entity, date_trunc('month', d)"))
def month_end_sample(spark, sf_dir):
    paths = hold_paths(src.dense_panel(spark, sf_dir))
    return month_end(paths, "w").select("entity", F.col("last_d").alias("d"), r6(F.col("w")).alias("wealth"))


@query("missed_best_days", duck(
    f"""SELECT entity, k::BIGINT AS k, count(CASE WHEN missed THEN 1 END)::BIGINT AS missed, {rd('coalesce(sum(CASE WHEN missed THEN ret END), 0)')} AS missed_sum, max(near)::BIGINT AS near
        FROM (SELECT r.*, k, coalesce(p.name, '') <> r.entity AS missed FROM rk r CROSS JOIN (VALUES (10), (20), (50)) t(k) LEFT JOIN path p ON p.strategy = 'leader_63' AND p.pos = r.pos - 2 WHERE rb <= k)
        JOIN (SELECT b.entity AS e2, count(*) AS near FROM rk b WHERE b.rb <= 50 AND EXISTS (SELECT 1 FROM rk w WHERE w.entity = b.entity AND w.rw <= 50 AND abs(w.pos - b.pos) <= 10) GROUP BY 1) ON e2 = entity
        GROUP BY entity, k""", LEADERS,
    """rk AS (SELECT entity, d, pos, ret, row_number() OVER (PARTITION BY entity ORDER BY ret DESC, d) AS rb, row_number() OVER (PARTITION BY entity ORDER BY ret, d) AS rw FROM rets WHERE ret IS NOT NULL)"""))
def missed_best_days(spark, sf_dir):
    """Best sessions of each entity on which the 63-session leader strategy, two sessions behind, held something else."""
    rets = op.with_returns(src.dense_panel(spark, sf_dir)).filter("ret IS NOT NULL").select("entity", "d", "pos", "ret")
    held = leader_paths(spark, sf_dir).filter("strategy = 'leader_63'").select((F.col("pos") + 2).alias("pos"), "name")
    by_best = W.partitionBy("entity").orderBy(F.desc("ret"), "d")
    by_worst = W.partitionBy("entity").orderBy("ret", "d")
    best = rets.withColumn("rb", F.row_number().over(by_best)).filter("rb <= 50")
    worst = rets.withColumn("rw", F.row_number().over(by_worst)).filter("rw <= 50")
    near = bands.near_positions(best, worst, 10).groupBy("entity").agg(F.count(F.lit(1)).alias("near"))
    scored = best.join(held, "pos", "left").withColumn("missed", F.coalesce("name", F.lit("")) != F.col("entity"))
    by_k = scored.withColumn("k", F.explode(F.array(F.lit(10), F.lit(20), F.lit(50)))).filter("rb <= k")
    return by_k.join(near, "entity").groupBy("entity", "k").agg(
        F.count(F.when(F.col("missed"), 1)).alias("missed"), r6(F.coalesce(F.sum(F.when(F.col("missed"), F.col("ret"))), F.lit(0.0))).alias("missed_sum"),
        F.max("near").alias("near")).withColumn("k", big(F.col("k")))


@query("trailing_rows", duck("SELECT entity, d, px FROM panel QUALIFY row_number() OVER (PARTITION BY entity ORDER BY d DESC) <= 252"))
def trailing_rows(spark, sf_dir):
    last = W.partitionBy("entity").orderBy(F.desc("d"))
    return src.panel(spark, sf_dir).withColumn("rn", F.row_number().over(last)).filter("rn <= 252").select("entity", "d", "px")


@query("finite_span", duck(
    """SELECT entity, min(CASE WHEN px IS NOT NULL THEN d END) AS first_d, max(CASE WHEN px IS NOT NULL THEN d END) AS last_d, min(CASE WHEN px IS NOT NULL THEN pos END)::BIGINT AS first_pos,
        count(px)::BIGINT AS n, count(*)::BIGINT AS n_sessions FROM dense GROUP BY entity"""))
def finite_span(spark, sf_dir):
    ok = F.col("px").isNotNull()
    return src.dense_panel(spark, sf_dir).groupBy("entity").agg(
        F.min(F.when(ok, F.col("d"))).alias("first_d"), F.max(F.when(ok, F.col("d"))).alias("last_d"), big(F.min(F.when(ok, F.col("pos")))).alias("first_pos"),
        F.count("px").alias("n"), F.count(F.lit(1)).alias("n_sessions"))


@query("dedupe_keep", duck(
    """SELECT account, day, arg_min(req_id, (ts, req_id)) AS first_id, arg_min(target, (ts, req_id)) AS first_target, arg_max(req_id, (ts, req_id)) AS last_id, arg_max(target, (ts, req_id)) AS last_target
       FROM (SELECT *, ts::DATE AS day FROM req) GROUP BY account, day"""))
def dedupe_keep(spark, sf_dir):
    """Keep-first and keep-last per account and day as mergeable minima: no group is ever sorted or collected."""
    return keep_first_last(src.requests(spark, sf_dir).withColumn("day", F.to_date("ts")), ["account", "day"], ["ts", "req_id"], ["req_id", "target"]).select(
        "account", "day", F.col("first.req_id").alias("first_id"), F.col("first.target").alias("first_target"),
        F.col("last.req_id").alias("last_id"), F.col("last.target").alias("last_target"))


def keep_first_last(df, keys, order, payload):
    row, at = F.struct(*payload), F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"))


@query("curve_views", duck(
    f"""SELECT cadence, lag::BIGINT AS lag, block::BIGINT AS block, h::BIGINT AS h, entity, month, {rd('wealth')} AS wealth FROM (
          SELECT *, dense_rank() OVER (PARTITION BY cadence, lag ORDER BY block) AS rk FROM blocks) CROSS JOIN (
          SELECT entity, date_trunc('month', d)::DATE AS month, arg_max(w, d) AS wealth FROM wealth GROUP BY 1, 2) WHERE rk = 1""", BLOCK_SQL))
def curve_views(spark, sf_dir):
    """One curve per (cadence, lag) view and entity; the first block of a view wins."""
    curve = month_end(hold_paths(src.dense_panel(spark, sf_dir)), "w")
    first = W.partitionBy("cadence", "lag", "entity", "month").orderBy("block")
    out = on_blocks(curve).withColumn("rk", F.row_number().over(first)).filter("rk = 1")
    return out.select("cadence", big(F.col("lag")).alias("lag"), big(F.col("block")).alias("block"), big(F.col("h")).alias("h"), "entity", "month", r6(F.col("w")).alias("wealth"))


@query("union_blocks", duck(
    f"""SELECT 'yearly' AS block, entity, y::BIGINT AS y, NULL::BIGINT AS m, n::BIGINT AS n, {rd('hi')} AS hi FROM (SELECT entity, year(d) AS y, count(*) AS n, max(px) AS hi FROM panel GROUP BY 1, 2)
        UNION ALL SELECT 'monthly', entity, y, m, n, {rd('hi')} FROM (SELECT entity, year(d) AS y, month(d) AS m, count(*) AS n, max(px) AS hi FROM panel GROUP BY 1, 2, 3)"""))
def union_blocks(spark, sf_dir):
    """Result rows of two blocks; columns a block lacks become NULL. The coarse block is built from the fine one."""
    monthly = src.panel(spark, sf_dir).groupBy("entity", big(F.year("d")).alias("y"), big(F.month("d")).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.max("px").alias("hi"))
    yearly = monthly.groupBy("entity", "y").agg(F.sum("n").alias("n"), F.max("hi").alias("hi")).withColumn("block", F.lit("yearly"))
    return yearly.unionByName(monthly.withColumn("block", F.lit("monthly")), allowMissingColumns=True).withColumn("hi", r6(F.col("hi")))


@query("missing_months", duck(
    """SELECT e.entity, m.month, (m.month > f.first_m)::INTEGER::BIGINT AS after_start FROM ent e CROSS JOIN (
         SELECT unnest(generate_series((date_trunc('month', max(d)) - INTERVAL 120 MONTH)::DATE, (date_trunc('month', max(d)) - INTERVAL 1 MONTH)::DATE, INTERVAL 1 MONTH))::DATE AS month FROM panel) m
       JOIN (SELECT entity, date_trunc('month', min(d))::DATE AS first_m FROM panel GROUP BY 1) f ON f.entity = e.entity
       WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.entity = e.entity AND date_trunc('month', p.d) = m.month)"""))
def missing_months(spark, sf_dir):
    panel = src.panel_table(spark, sf_dir)
    have = panel.select("entity", F.trunc("d", "MM").alias("month")).distinct()
    first = have.groupBy("entity").agg(F.min("month").alias("first_m"))
    gone = calendar_months(panel, 120).join(have, ["entity", "month"], "left_anti")
    return gone.join(first, "entity").select("entity", "month", (F.col("month") > F.col("first_m")).cast("int").cast("bigint").alias("after_start"))
