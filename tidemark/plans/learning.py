"""Walk-forward, policy and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import weights as fw
from tidemark.functions.columns import big, change, r6
from tidemark.operators import asof, frames, learning as lr, walkforward, windows as op
from tidemark.plans import experiments
from tidemark.plans.base import duck, query, rd
from tidemark.plans.features import FRAME_CTES, FRAME_SQL, daily_features
from tidemark.plans.joins import sessions
from tidemark.plans.portfolio import RULES_SQL, SIGNALS, regimes, rule_targets, signals
from tidemark.plans.windows import LABELS, WIN
from tidemark.session import materialize
from tidemark.sources import tables as src

H, LAG = 21, 1
GAP = H + LAG + 1
SPAN = 5 * 365
RULE_ORDER = ["sma_10m", "dual_momentum", "curve_trend", "vol_target", "sell_in_may"]


def folds_sql(unit: str, min_rows: int, span: int, h: int = H, lag: int = LAG) -> str:
    return f"""folds AS (SELECT *, coalesce(lead(start_pos) OVER (ORDER BY start_pos), (SELECT count(*) FROM ses)) AS stop_pos FROM (
      SELECT f.*, s.d AS train_last_d FROM (SELECT min(d) AS fold_start, min(pos) AS start_pos, min(pos) - 2 * ({h} + {lag}) - 1 AS s_max FROM ses GROUP BY date_trunc('{unit}', d)) f JOIN ses s ON s.pos = f.s_max
      WHERE f.s_max >= {min_rows} AND s.d - (SELECT min(d) FROM ses) >= {span}))"""


@query("fold_bounds", duck(
    f"SELECT fold_start, start_pos::BIGINT AS start_pos, s_max::BIGINT AS s_max, (s_max + {H + LAG})::BIGINT AS label_end, (s_max + {H + LAG} < start_pos)::INTEGER::BIGINT AS purged FROM folds",
    folds_sql("month", 0, 0)))
def fold_bounds(spark, sf_dir):
    folds = lr.fold_dimension(sessions(spark, sf_dir), H, LAG, "month", 0, 0)
    end = lr.label_end(F.col("s_max"), H, LAG)
    return folds.select("fold_start", big(F.col("start_pos")).alias("start_pos"), big(F.col("s_max")).alias("s_max"), big(end).alias("label_end"),
                        F.when(end < F.col("start_pos"), 1).otherwise(0).cast("bigint").alias("purged"))


USABLE = """usable AS (SELECT m.d, m.pos, ((m.g IS NOT NULL)::INTEGER + (m.f IS NOT NULL)::INTEGER + (m.c IS NOT NULL)::INTEGER + (m.s IS NOT NULL)::INTEGER + (m.i IS NOT NULL)::INTEGER) / 5.0 > 0.6
    AND l.label IS NOT NULL AS ok FROM moments m JOIN labels_d l USING (d, pos))"""
PLAN = """plan AS (SELECT f.*, u.n_train, u.n_train >= 504 AND u.n_train > 292 AS good FROM folds f JOIN (SELECT pos, sum(ok::INTEGER) OVER (ORDER BY pos) AS n_train FROM usable) u ON u.pos = f.s_max)"""


def labelled(spark, sf_dir, dense=None):
    """(entity, ord, d, pos, px, excess, label) with the label's entity number."""
    lab = op.forward_labels(dense if dense is not None else src.dense_panel(spark, sf_dir), H, LAG)
    return lab.withColumn("label_no", F.max(F.when(F.col("entity") == F.col("label"), F.col("ord"))).over(W.partitionBy("d")))


def usable_rows(lab):
    """(d, pos, ok, label_no): enough prices known and a label available."""
    per_day = lab.groupBy("d", "pos").agg(F.count("px").alias("n_ok"), F.count(F.lit(1)).alias("k"), F.max("label_no").alias("label_no"))
    return per_day.select("d", "pos", ((F.col("n_ok") / F.col("k") > 0.6) & F.col("label_no").isNotNull()).alias("ok"), "label_no")


@query("fold_plan", duck(
    "SELECT fold_start, s_max::BIGINT AS s_max, stop_pos::BIGINT AS stop_pos, n_train::BIGINT AS n_train, CASE WHEN good THEN n_train - 252 ELSE 0 END::BIGINT AS n_dev, CASE WHEN good THEN 252 ELSE 0 END::BIGINT AS n_cal, good::INTEGER::BIGINT AS usable FROM plan",
    LABELS, USABLE, folds_sql("month", 504, SPAN), PLAN))
def fold_plan(spark, sf_dir):
    dense = src.dense_panel(spark, sf_dir)
    lab = labelled(spark, sf_dir, dense)
    folds = lr.fold_dimension(dense.select("d", "pos").distinct(), H, LAG, "month", 504, SPAN)
    out = lr.train_counts(usable_rows(lab), folds, 252, 504)
    return out.select("fold_start", *[big(F.col(c)).alias(c) for c in ("s_max", "stop_pos", "n_train", "n_dev", "n_cal", "usable")])


XWIDE = "xw AS (SELECT d, pos, " + ", ".join(f"max(CASE WHEN ord = {i} THEN m END) AS x{i}" for i in range(5)) + f" FROM (SELECT d, pos, ord, px / lag(px, 21) {WIN} - 1 AS m FROM dense) GROUP BY d, pos)"


def momentum_wide(dense):
    m = dense.withColumn("m", op.total_return(F.col("px"), 21, op.by_entity()))
    return m.groupBy("d", "pos").agg(*[F.max(F.when(F.col("ord") == i, F.col("m"))).alias(f"x{i}") for i in range(5)])


XS = [f"x{i}" for i in range(5)]


@query("fold_scaler", duck(
    f"""SELECT fold_start, feature, {rd('any_value(med)')} AS median, {rd('avg(coalesce(x, med))')} AS mean, {rd('stddev_pop(coalesce(x, med))')} AS scale, count(*)::BIGINT AS n FROM (
          SELECT *, coalesce(median(x) OVER (PARTITION BY fold_start, feature), 0) AS med FROM (
            SELECT p.fold_start, 'x' || k AS feature, [r.x0, r.x1, r.x2, r.x3, r.x4][k + 1] AS x FROM plan p JOIN ranked r ON r.pos <= p.s_max AND r.rk <= p.n_train - 252 CROSS JOIN (SELECT unnest(range(5)) AS k) WHERE p.good))
        GROUP BY fold_start, feature""",
    LABELS, USABLE, folds_sql("year", 504, 0), PLAN, XWIDE, "ranked AS (SELECT w.*, row_number() OVER (ORDER BY w.pos) AS rk FROM xw w JOIN usable u USING (d, pos) WHERE u.ok)"))
def fold_scaler(spark, sf_dir):
    dense = materialize(src.dense_panel(spark, sf_dir))
    use = usable_rows(labelled(spark, sf_dir, dense))
    folds = lr.train_counts(use, lr.fold_dimension(dense.select("d", "pos").distinct(), H, LAG, "year", 504, 0), 252, 504).filter("usable = 1")
    rows = momentum_wide(dense).join(use.filter("ok").select("pos"), "pos").withColumn("rank", F.row_number().over(W.orderBy("pos")))
    out = lr.fold_scaler(rows, folds, XS)
    return out.select("fold_start", "feature", r6(F.col("median")).alias("median"), r6(F.col("mean")).alias("mean"), r6(F.col("scale")).alias("scale"), "n")


PICKS = f"""picks AS (SELECT t.strategy, t.d, t.pos, CASE WHEN t.t IS NOT NULL THEN t.t WHEN t.w > 0.5 - 1e-9 AND t.w >= 1 - t.w THEN CASE WHEN t.w > 1 - t.w THEN 2 ELSE 0 END ELSE 0 END AS chosen, l.label_ord FROM targets t JOIN labels_d l USING (d, pos)),
hr AS (SELECT *, CASE WHEN pos - {GAP} >= 50 AND cnt >= 50 THEN hits / cnt END AS rate FROM (
   SELECT *, coalesce(sum((chosen = label_ord AND label_ord IS NOT NULL)::INTEGER) OVER w, 0)::DOUBLE AS hits, coalesce(sum((label_ord IS NOT NULL)::INTEGER) OVER w, 0)::DOUBLE AS cnt FROM picks
   WINDOW w AS (PARTITION BY strategy ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND {GAP} PRECEDING)))"""


def rule_picks(spark, sf_dir, dense):
    """(strategy, d, pos, chosen, label_no): each rule's single call beside the realized winner."""
    lab = labelled(spark, sf_dir, dense).groupBy("d", "pos").agg(F.max("label_no").alias("label_no"))
    targets = rule_targets(spark, sf_dir, dense).select("strategy", "pos", fw.chosen_position(F.col("weights")).alias("chosen"))
    return targets.join(lab, "pos").select("strategy", "d", "pos", "chosen", "label_no")


@query("purged_hit_rate", duck(f"SELECT strategy, d, cnt::BIGINT AS cnt, {rd('rate')} AS rate FROM hr", LABELS, *RULES_SQL, PICKS))
def purged_hit_rate(spark, sf_dir):
    dense = materialize(src.dense_panel(spark, sf_dir))
    return lr.purged_hit_rates(rule_picks(spark, sf_dir, dense), H, LAG).select("strategy", "d", big(F.col("cnt")).alias("cnt"), r6(F.col("rate")).alias("rate"))


BEST = f"""best AS (SELECT d, pos, strategy AS which, chosen, least(greatest(rate, 0.05::DOUBLE), 0.95::DOUBLE) AS rate FROM hr WHERE rate IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY d ORDER BY rate DESC, list_position(['sma_10m', 'dual_momentum', 'curve_trend', 'vol_target', 'sell_in_may'], strategy)) = 1),
brp AS (SELECT d, pos, which, """ + ", ".join(f"CASE WHEN chosen = {i} THEN rate ELSE (1 - rate) / 4 END AS p{i}" for i in range(5)) + """ FROM best),
freq AS (SELECT d, pos, """ + ", ".join(f"sum((label_ord = {i})::INTEGER::DOUBLE) OVER w / count(label_ord) OVER w AS p{i}" for i in range(5)) + f""", count(label_ord) OVER w AS n FROM labels_d
   WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND {GAP} PRECEDING)),
avgp AS (SELECT d, pos, """ + ", ".join(f"avg(p{i}) AS p{i}" for i in range(5)) + """ FROM (SELECT d, pos, p0, p1, p2, p3, p4 FROM brp UNION ALL SELECT d, pos, p0, p1, p2, p3, p4 FROM freq WHERE n >= 50) GROUP BY d, pos)"""
PROBA_SQL = (LABELS, *RULES_SQL, PICKS, BEST)


def p_columns(col="p"):
    return [r6(F.get(col, F.lit(i))).alias(f"p{i}") for i in range(5)]


@query("best_rule_proba", duck("SELECT d, which, " + ", ".join(f"{rd(f'p{i}')} AS p{i}" for i in range(5)) + " FROM brp", *PROBA_SQL))
def best_rule_proba(spark, sf_dir):
    dense = materialize(src.dense_panel(spark, sf_dir))
    rates = lr.purged_hit_rates(rule_picks(spark, sf_dir, dense), H, LAG)
    return lr.best_rule_probabilities(rates, RULE_ORDER, 5).select("d", "which", *p_columns())


def ensemble(spark, sf_dir, dense):
    """Average of the best-rule probabilities and the purged label shares."""
    picks = materialize(rule_picks(spark, sf_dir, dense))
    labels = picks.filter(F.col("strategy") == RULE_ORDER[0]).select("d", "pos", "label_no")
    rule = lr.best_rule_probabilities(lr.purged_hit_rates(picks, H, LAG), RULE_ORDER, 5)
    return lr.average_probabilities(rule, lr.label_frequencies(labels, H, LAG, 5))


@query("avg_proba", duck("SELECT d, " + ", ".join(f"{rd(f'p{i}')} AS p{i}" for i in range(5)) + " FROM avgp", *PROBA_SQL))
def avg_proba(spark, sf_dir):
    return ensemble(spark, sf_dir, materialize(src.dense_panel(spark, sf_dir))).select("d", *p_columns())


POLICY = f"""mus AS (SELECT f.fold_start, f.start_pos, {', '.join(f'coalesce(avg(CASE WHEN l.ord = {i} THEN l.excess END) FILTER (l.pos <= f.s_max), 0) AS m{i}' for i in range(1, 5))} FROM folds f CROSS JOIN lab2 l GROUP BY 1, 2),
sc AS (SELECT a.d, a.pos, a.p0, a.p1, a.p2, a.p3, a.p4, [a.p0, a.p1, a.p2, a.p3, a.p4] AS p, [0, m1, m2, m3, m4] AS mu, [0, a.p1 * m1, a.p2 * m2, a.p3 * m3, a.p4 * m4] AS s FROM avgp a ASOF JOIN mus m ON a.pos >= m.start_pos),
pol AS (SELECT *, CASE WHEN b > 1 AND p[b] >= 0.34 AND mu[b] > 0 AND s[b] > 0 THEN b - 1 ELSE 0 END AS pick FROM (SELECT *, list_position(s, list_max(s)) AS b FROM sc)),
fin AS (SELECT *, CASE WHEN alive THEN pick WHEN safe_alive THEN 0 END AS final FROM (
  SELECT p.*, coalesce(lx.px, 0) > 0 AS alive, coalesce(l0.px, 0) > 0 AS safe_alive FROM pol p LEFT JOIN dense lx ON lx.ord = p.pick AND lx.pos = least(p.pos + {LAG}, (SELECT max(pos) FROM ses))
  LEFT JOIN dense l0 ON l0.ord = 0 AND l0.pos = least(p.pos + {LAG}, (SELECT max(pos) FROM ses))))"""
YEAR_FOLDS = folds_sql("year", 252, 0)
POLICY_SQL = (*PROBA_SQL, YEAR_FOLDS, POLICY)


def policy_rows(spark, sf_dir, dense):
    """(d, pos, p, mu, pick): the fold's mean excess known at each row, and the policy's choice."""
    lab = labelled(spark, sf_dir, dense)
    folds = lr.fold_dimension(dense.select("d", "pos").distinct(), H, LAG, "year", 252, 0)
    mu = lr.fold_vectors(lr.fold_means(lab, folds))
    rows = asof.asof_backward(ensemble(spark, sf_dir, dense), mu, left_ts="pos", right_ts="start_pos", payload=["fold_start", "mu"]).filter("mu IS NOT NULL")
    return rows.withColumn("pick", fw.policy_position(F.col("p"), F.col("mu")))


@query("policy", duck("SELECT d, pick::BIGINT AS pick FROM pol", *POLICY_SQL))
def policy(spark, sf_dir):
    return policy_rows(spark, sf_dir, materialize(src.dense_panel(spark, sf_dir))).select("d", big(F.col("pick")).alias("pick"))


def listed_policy(spark, sf_dir, dense):
    """Adds `final`: a pick without a price on its posting session falls back to the safe entity, or to nothing."""
    w = op.by_entity()
    at_post = dense.select("ord", "pos", F.coalesce(F.lead("px", LAG).over(w), F.last("px").over(w.rowsBetween(0, W.unboundedFollowing))).alias("post_px"), F.lead("pos", LAG).over(w).alias("nxt"), "px", F.lead("px", LAG).over(w).alias("lpx"))
    alive = at_post.select("pos", "ord", (F.coalesce(F.when(F.col("nxt").isNull(), F.col("px")).otherwise(F.col("lpx")), F.lit(0.0)) > 0).alias("ok"))
    per_day = alive.groupBy("pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "ok"))), lambda s: s["ok"]).alias("alive"))
    rows = policy_rows(spark, sf_dir, dense).join(per_day, "pos")
    return rows.withColumn("final", F.when(F.get("alive", F.col("pick")), F.col("pick")).when(F.get("alive", F.lit(0)), F.lit(0)))


@query("policy_over_folds", duck("SELECT d, pick::BIGINT AS pick, final::BIGINT AS final FROM fin", *POLICY_SQL))
def policy_over_folds(spark, sf_dir):
    out = listed_policy(spark, sf_dir, materialize(src.dense_panel(spark, sf_dir)))
    return out.select("d", big(F.col("pick")).alias("pick"), big(F.col("final")).alias("final"))


# One linear model a fold, fitted by moments of the rows up to its s_max; the policy's risky candidate, picked or not,
# is explained by the snapshot of the row's fold.
MODEL_SQL = ("xl AS (SELECT d, pos, k, [x0, x1, x2, x3, x4][k + 1] AS x FROM xw CROSS JOIN (SELECT unnest(range(5)) AS k))",
    "cf AS (SELECT f.fold_start, l.ord, x.k, CASE WHEN l.ord <> 0 AND isfinite(corr(l.excess, x.x)) THEN corr(l.excess, x.x) ELSE 0 END AS coef, CASE WHEN l.ord <> 0 THEN coalesce(avg(l.excess), 0) ELSE 0 END AS icept FROM folds f JOIN lab2 l ON l.pos <= f.s_max JOIN xl x ON x.pos = l.pos GROUP BY f.fold_start, l.ord, x.k)",
    "sx AS (SELECT f.fold_start, k, coalesce(avg(x), 0) AS mean, coalesce(stddev_pop(x), 0) AS scale, coalesce(median(x), 0) AS med FROM folds f JOIN xl ON xl.pos <= f.s_max GROUP BY f.fold_start, k)",
    "pk AS (SELECT p.d, p.pos, list_position(p.s[2:], list_max(p.s[2:])) AS cand, p.pick, m.fold_start FROM pol p ASOF JOIN folds m ON p.pos >= m.start_pos)",
    """zz AS (SELECT p.d, p.cand AS winner, (p.pick = p.cand)::INTEGER::BIGINT AS picked, s.fold_start, x.k, (coalesce(x.x, s.med) - s.mean) / CASE WHEN s.scale < 1e-8 THEN 1 ELSE s.scale END AS z, CASE WHEN s.scale < 1e-8 THEN 1 ELSE s.scale END AS scale, w.coef - b.coef AS dc, w.icept - b.icept AS di
         FROM pk p JOIN xl x ON x.pos = p.pos JOIN sx s ON s.fold_start = p.fold_start AND s.k = x.k JOIN cf w ON w.fold_start = p.fold_start AND w.k = x.k AND w.ord = p.cand JOIN cf b ON b.fold_start = p.fold_start AND b.k = x.k AND b.ord = 0)""",
    """contrib AS (SELECT d, winner, picked, 'x' || k AS feature, dc * z AS contribution, CASE WHEN abs(dc) >= 1e-8 THEN -(di + gap) / dc * scale END AS flip
         FROM (SELECT *, sum(dc * z) OVER (PARTITION BY d) AS gap FROM zz) QUALIFY row_number() OVER (PARTITION BY d ORDER BY abs(dc * z) DESC, k) <= 3)""")


def explained(spark, sf_dir, dense, top: int = 3):
    """(d, winner, picked, feature, contribution, flip): what speaks for the risky entity with the largest probability
    times mean excess, by the model its fold knew, and whether the policy picked it."""
    wide = materialize(momentum_wide(dense))
    folds = lr.fold_dimension(dense.select("d", "pos").distinct(), H, LAG, "year", 252, 0)
    snapshots = materialize(lr.moment_snapshots(labelled(spark, sf_dir, dense), wide, folds, XS))
    score = F.slice(F.zip_with("p", "mu", lambda p, m: p * m), 2, 4)
    rows = policy_rows(spark, sf_dir, dense).withColumn("winner", F.array_position(score, F.array_max(score)).cast("int"))
    picks = rows.select("d", "pos", "fold_start", "winner", (F.col("pick") == F.col("winner")).cast("bigint").alias("picked"))
    return lr.explain_rows(picks.join(wide.drop("d"), "pos").join(snapshots, "fold_start"), XS, top)


@query("model_snapshots", duck(
    f"SELECT fold_start, ord::BIGINT AS ord, 'x' || k AS feature, {rd('coef')} AS coef, {rd('icept')} AS intercept, {rd('mean')} AS mean, {rd('scale')} AS scale, {rd('med')} AS median FROM cf JOIN sx USING (fold_start, k)",
    LABELS, XWIDE, YEAR_FOLDS, *MODEL_SQL[:3]))
def model_snapshots(spark, sf_dir):
    """The models as a table: one row a fold, class and feature."""
    dense = materialize(src.dense_panel(spark, sf_dir))
    folds = lr.fold_dimension(dense.select("d", "pos").distinct(), H, LAG, "year", 252, 0)
    snaps = lr.moment_snapshots(labelled(spark, sf_dir, dense), momentum_wide(dense), folds, XS)
    rows = snaps.select("fold_start", "mean", "scale", "median", F.posexplode(F.arrays_zip("coef", "intercept")).alias("ord", "m"))
    rows = rows.select("fold_start", "ord", F.col("m.intercept").alias("intercept"), F.posexplode(F.arrays_zip(F.col("m.coef").alias("coef"), "mean", "scale", "median")).alias("k", "v"))
    return rows.select("fold_start", big(F.col("ord")).alias("ord"), F.concat(F.lit("x"), "k").alias("feature"), r6(F.col("v.coef")).alias("coef"), r6(F.col("intercept")).alias("intercept"),
                       *[r6(F.coalesce(F.col(f"v.{c}"), F.lit(0.0))).alias(c) for c in ("mean", "scale", "median")])


def fold_family(name: str, unit: str, rows: int, span: int) -> tuple[str, ...]:
    """The coefficients of one cadence of refits as CTEs, named after the family."""
    return (folds_sql(unit, rows, span).replace("folds AS (", f"folds_{name} AS (", 1),
            f"""snap_{name} AS (SELECT '{name}' AS family, f.fold_start, l.ord, {', '.join(f"CASE WHEN l.ord <> 0 AND isfinite(corr(l.excess, x.x{k})) THEN corr(l.excess, x.x{k}) ELSE 0 END AS c{k}" for k in range(5))},
              CASE WHEN l.ord <> 0 THEN coalesce(avg(l.excess), 0) ELSE 0 END AS icept FROM folds_{name} f JOIN lab2 l ON l.pos <= f.s_max JOIN xw x ON x.pos = l.pos GROUP BY f.fold_start, l.ord)""")


# Families of refits, (unit, least training rows, least span of the calendar in days).
REFITS = {"yearly": ("year", 252, 0), "monthly": ("month", 504, SPAN)}


def dated_snapshots(labels, wide, days):
    """(family, valid_from, valid_to, ord, coef, intercept): the models of all refits with the days on which they were the latest."""
    families = []
    for name, (unit, rows, span) in REFITS.items():
        folds = lr.fold_dimension(days, H, LAG, unit, rows, span)
        families.append(lr.moment_snapshots(labels, wide, folds, XS).withColumn("family", F.lit(name)))
    snaps = families[0].unionByName(families[1])
    by_class = snaps.select("family", "fold_start", F.posexplode(F.arrays_zip("coef", "intercept")).alias("ord", "m"))
    return asof.validity(by_class.select("family", "fold_start", "ord", "m.coef", "m.intercept"), ("family",), "fold_start")


@query("asof_snapshot", duck(
    f"""SELECT k.family, s.d, v.fold_start AS valid_from, v.valid_to, n.ord::BIGINT AS ord, {', '.join(f"{rd(f'n.c{k}')} AS c{k}" for k in range(5))}, {rd('n.icept')} AS intercept
        FROM ses s CROSS JOIN (SELECT DISTINCT family FROM snaps) k ASOF LEFT JOIN valid v ON v.family = k.family AND s.d >= v.fold_start LEFT JOIN snaps n ON n.family = v.family AND n.fold_start = v.fold_start""",
    LABELS, XWIDE, *[cte for name, spec in REFITS.items() for cte in fold_family(name, *spec)],
    "snaps AS (" + " UNION ALL ".join(f"SELECT * FROM snap_{name}" for name in REFITS) + ")",
    "valid AS (SELECT *, lead(fold_start) OVER (PARTITION BY family ORDER BY fold_start) AS valid_to FROM (SELECT DISTINCT family, fold_start FROM snaps))"))
def asof_snapshot(spark, sf_dir):
    """The model that each session knew, by family of refits: its coefficients, its date and how long it was the latest."""
    dense = materialize(src.dense_panel(spark, sf_dir))
    days = materialize(dense.select("d", "pos").distinct())
    snaps = materialize(dated_snapshots(labelled(spark, sf_dir, dense), momentum_wide(dense), days))
    out = asof.snapshot_on_calendar(days.select("d"), snaps, ("family",))
    return out.select("family", "d", "valid_from", "valid_to", big(F.col("ord")).alias("ord"), *[r6(F.get("coef", F.lit(k))).alias(f"c{k}") for k in range(5)], r6(F.col("intercept")).alias("intercept"))


@query("explain_contrib", duck(f"SELECT d, winner::BIGINT AS winner, picked, feature, {rd('contribution')} AS contribution, {rd('flip')} AS flip FROM contrib", *POLICY_SQL, XWIDE, *MODEL_SQL))
def explain_contrib(spark, sf_dir):
    out = explained(spark, sf_dir, materialize(src.dense_panel(spark, sf_dir)))
    return out.select("d", big(F.col("winner")).alias("winner"), "picked", "feature", r6(F.col("contribution")).alias("contribution"), r6(F.col("flip")).alias("flip"))


@query("relabel_by_vol", duck(
    f"SELECT raw::BIGINT AS raw, {rd('mean_vol')} AS mean_vol, (row_number() OVER (ORDER BY mean_vol, raw) - 1)::BIGINT AS ordered FROM (SELECT month(d) % 3 AS raw, avg(rv63) AS mean_vol FROM sig GROUP BY 1)", SIGNALS))
def relabel_by_vol(spark, sf_dir):
    states = signals(spark, sf_dir).select((F.month("d") % 3).alias("raw"), "rv63")
    return lr.relabel_by_volatility(states, "raw", "rv63").select(big(F.col("raw")).alias("raw"), r6(F.col("mean_vol")).alias("mean_vol"), big(F.col("ordered")).alias("ordered"))


@query("trial_count", duck("SELECT block::BIGINT AS block, family, trials::BIGINT AS trials FROM btrial", *experiments.TRIAL_CTES))
def trial_count(spark, sf_dir):
    """What the trial log holds, by block and family."""
    logged = experiments.logged_trials(spark, sf_dir).groupBy("block", "family").agg(F.count(F.lit(1)).alias("trials"))
    asked = experiments.specs(spark).select("block", F.explode(F.array(F.lit("logistic"), F.lit("boosting"), F.lit("rule"))).alias("family"))
    return asked.join(logged, ["block", "family"], "left").select(big(F.col("block")).alias("block"), "family", F.coalesce("trials", F.lit(0)).cast("bigint").alias("trials"))


REVEAL = ", ".join(f"CASE WHEN lead(px, {LAG}) {WIN} > 0 THEN lead(px, {LAG + n}) {WIN} / lead(px, {LAG}) {WIN} - 1 END AS h{n}" for n in (21, 63, 126, 252))


@query("replay_table", duck(
    f"""SELECT f.d, f.final::BIGINT AS pick, {rd('f.p[f.final + 1]', 4)} AS probability, c.feature AS driver, {rd('c.contribution', 4)} AS contribution, """ + ", ".join(f"{rd(f'r.h{n}')} AS h{n}" for n in (21, 63, 126, 252))
    + """ FROM fin f LEFT JOIN contrib c ON c.d = f.d AND c.winner = f.final AND c.picked = 1 JOIN rv r ON r.d = f.d AND r.ord = f.final WHERE f.final IS NOT NULL""", *POLICY_SQL, XWIDE, *MODEL_SQL, f"rv AS (SELECT d, ord, {REVEAL} FROM dense)"))
def replay_table(spark, sf_dir):
    """Every decided session with its choice, probability, top drivers and what followed."""
    return replay(spark, sf_dir, materialize(src.dense_panel(spark, sf_dir)))


def replay(spark, sf_dir, dense):
    w = op.by_entity()
    ahead = dense.select("d", F.col("ord").alias("final"), *[F.when(F.lead("px", LAG).over(w) > 0, change(F.lead("px", LAG + n).over(w), F.lead("px", LAG).over(w))).alias(f"h{n}") for n in (21, 63, 126, 252)])
    drivers = explained(spark, sf_dir, dense).filter("picked = 1").select("d", F.col("winner").alias("final"), F.col("feature").alias("driver"), "contribution")
    rows = listed_policy(spark, sf_dir, dense).filter("final IS NOT NULL").select("d", "final", F.get("p", F.col("final")).alias("probability"))
    out = rows.join(ahead, ["d", "final"]).join(drivers, ["d", "final"], "left")
    return out.select("d", big(F.col("final")).alias("pick"), F.round("probability", 4).alias("probability"), "driver", F.round("contribution", 4).alias("contribution"), *[r6(F.col(f"h{n}")).alias(f"h{n}") for n in (21, 63, 126, 252)])


@query("latest_signal", duck(
    f"""SELECT f.d, coalesce(f.final, 0)::BIGINT AS pick, {rd('f.p[coalesce(f.final, 0) + 1]', 4)} AS probability, CASE coalesce(f.final, 0) WHEN 0 THEN 'Shelter' WHEN 1 THEN 'Neutral' ELSE 'Risk On' END AS stance,
          g.regime, (SELECT count(*) FROM contrib c WHERE c.d = f.d AND c.winner = f.final AND c.picked = 1)::BIGINT AS n_drivers FROM fin f JOIN (SELECT d, CASE WHEN a50 IS NULL OR spread IS NULL THEN 'Unavailable' ELSE CASE WHEN a50 = 1 THEN 'Uptrend' ELSE 'Downtrend' END || ' | '
          || CASE WHEN coalesce(rv63, 0) >= 0.70 THEN 'High vol' ELSE 'Low vol' END || ' | ' || CASE WHEN spread < 0 THEN 'Inverted curve' ELSE 'Normal curve' END END AS regime FROM sig) g ON g.d = f.d
        WHERE f.pos = (SELECT max(pos) FROM fin)""", *POLICY_SQL, XWIDE, *MODEL_SQL))
def latest_signal(spark, sf_dir):
    """The last decided row: choice, probability, stance, regime and how many drivers explain it."""
    from tidemark.functions.columns import stance

    dense = materialize(src.dense_panel(spark, sf_dir))
    last = listed_policy(spark, sf_dir, dense).agg(F.max_by(F.struct("d", F.coalesce("final", F.lit(0)).alias("pick"), "p"), "pos").alias("x")).select("x.*")
    regime = regimes(signals(spark, sf_dir, dense)).select("d", "regime")
    drivers = explained(spark, sf_dir, dense).filter("picked = 1").groupBy("d", F.col("winner").alias("pick")).agg(F.count(F.lit(1)).alias("n_drivers"))
    return last.join(regime, "d").join(drivers, ["d", "pick"], "left").select(
        "d", big(F.col("pick")).alias("pick"), F.round(F.get("p", F.col("pick")), 4).alias("probability"), stance(F.col("pick")).alias("stance"), "regime", F.coalesce("n_drivers", F.lit(0)).cast("bigint").alias("n_drivers"))


# What holds of any fitted model: which sessions a fold scores, on how many purged rows it was trained, and that
# its probabilities are probabilities.
KNOWN = " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in frames.MODEL_FEATURES)
WF_SQL = duck(
    """SELECT s.d, g.fold_start, g.n_train::BIGINT AS n_train, 1.0::DOUBLE AS p_sum, 1::BIGINT AS in_range FROM good g JOIN ses s ON s.pos >= g.start_pos AND s.pos < g.stop_pos""",
    *FRAME_CTES, f"fm AS ({FRAME_SQL})", LABELS, folds_sql("month", 504, SPAN),
    f"mok AS (SELECT s.pos, ({KNOWN}) / {len(frames.MODEL_FEATURES)}.0 > 0.6 AND l.label IS NOT NULL AS ok FROM fm JOIN ses s ON s.d = fm.d JOIN labels_d l ON l.d = fm.d)",
    "good AS (SELECT f.*, u.n_train FROM folds f JOIN (SELECT pos, sum(ok::INTEGER) OVER (ORDER BY pos) AS n_train FROM mok) u ON u.pos = f.s_max WHERE u.n_train >= 504 AND u.n_train > 292)")


def wf_out(probabilities):
    whole = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x)
    inside = F.forall("p", lambda x: x.isNotNull() & (x >= 0) & (x <= 1))
    return probabilities.select("d", "fold_start", "n_train", r6(whole).alias("p_sum"), inside.cast("bigint").alias("in_range"))


def wf_rows(spark, sf_dir, family, calibrate):
    return wf_out(walkforward.probabilities(experiments.models(spark, sf_dir, calibrate, blocks=[0], families=[family])))


@query("wf_logistic", WF_SQL)
def wf_logistic(spark, sf_dir):
    return wf_rows(spark, sf_dir, "logistic", False)


@query("wf_calibrated", WF_SQL)
def wf_calibrated(spark, sf_dir):
    return wf_rows(spark, sf_dir, "logistic", True)


@query("wf_gbt", WF_SQL)
def wf_gbt(spark, sf_dir):
    return wf_rows(spark, sf_dir, "boosting", True)


def trained_ensemble(spark, sf_dir, dense, fits):
    """Average of the logistic, the boosted and the best-rule probabilities of each session; what is absent does not dilute."""
    trained = walkforward.probabilities(fits)
    picks = materialize(rule_picks(spark, sf_dir, dense))
    rule = lr.best_rule_probabilities(lr.purged_hit_rates(picks, H, LAG), RULE_ORDER, 5)
    return lr.average_probabilities(*[trained.where(F.col("family") == f).select("d", "pos", "p") for f in ("logistic", "boosting")], rule)


@query("model_ensemble")
def model_ensemble(spark, sf_dir):
    fits = experiments.models(spark, sf_dir, blocks=[0])
    return trained_ensemble(spark, sf_dir, materialize(src.dense_panel(spark, sf_dir)), fits).select("d", *p_columns())


def trained_drivers(rows, names, fits, top: int = 5):
    """(d, pos, fold_start, winner, feature, contribution, flip): what speaks for the entity that the fitted logistic model
    of a session's own fold finds likeliest."""
    scored = walkforward.probabilities(fits.where("family = 'logistic'")).select("block", "d", "pos", "fold_start", fw.top_position(F.col("p")).alias("winner"))
    at = rows.select("block", "pos", *[F.nanvl(F.get("x", F.lit(i)), F.lit(None).cast("double")).alias(n) for i, n in enumerate(names)])
    models = walkforward.snapshots(fits).drop("c")
    return lr.explain_rows(scored.join(at, ["block", "pos"]).join(models, ["block", "fold_start"]), names, top)


@query("model_drivers")
def model_drivers(spark, sf_dir):
    rows, names, fits = experiments.learned(spark, sf_dir, calibrate=False, blocks=[0], families=["logistic"])
    out = trained_drivers(rows, names, fits)
    return out.select("d", big(F.col("winner")).alias("winner"), "feature", r6(F.col("contribution")).alias("contribution"), r6(F.col("flip")).alias("flip"))


@query("wf_gmm")
def wf_gmm(spark, sf_dir):
    frame = daily_features(spark, sf_dir).select("d", "pos", "c_rv63", "c_dd", "spread_10y_3m", "vol_level")
    out = lr.walk_forward_mixture(frame, ["c_rv63", "c_dd", "spread_10y_3m", "vol_level"], "c_rv63")
    return out.select("d", big(F.col("state")).alias("state"))
