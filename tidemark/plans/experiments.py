"""Experiment blocks as a key: positions, labels, folds, models and trials of all cadences, horizons and lags in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.columns import change
from tidemark.functions import normal
from tidemark.operators import frames, walkforward as wf
from tidemark.plans.features import FRAME_CTES, FRAME_SQL, daily_features, release_features
from tidemark.plans.joins import BLOCKS
from tidemark.session import materialize
from tidemark.sources import tables as src
from tidemark.sources.triallog import TrialLog, data_version

SPAN = 5 * 365
CLASSES = 5
RULES = ("sma_10m", "dual_momentum", "curve_trend", "vol_target", "sell_in_may")
# Least rows and calibration rows by cadence; the block that tries no boosted trees.
SIZES = {"daily": (504, 252), "monthly": (36, 12)}
WITHOUT_BOOSTING = ("daily", 63, 1)
TABLES = ("region", "nation", "supplier", "lineitem", "orders", "events")


def specs(spark) -> DataFrame:
    """(block, cadence, h, lag, unit, min_rows, cal_len, search_all, families): one row a block."""
    rows = [(i, c, h, lag, "month" if c == "daily" else "year", *SIZES[c], c == "monthly", ["logistic"] if (c, h, lag) == WITHOUT_BOOSTING else ["logistic", "boosting"]) for i, (c, h, lag) in enumerate(BLOCKS)]
    return spark.createDataFrame(rows, "block int, cadence string, h int, lag int, unit string, min_rows int, cal_len int, search_all boolean, families array<string>")


def positions(dense: DataFrame) -> DataFrame:
    """(cadence, entity, ord, d, pos, px): every session, and every month with its last session's price."""
    daily = dense.select(F.lit("daily").alias("cadence"), "entity", "ord", "d", F.col("pos").cast("int").alias("pos"), "px")
    ends = dense.groupBy("entity", "ord", F.trunc("d", "MM").alias("d")).agg(F.max_by(F.struct("px"), "d")["px"].alias("px"))
    months = ends.select("d").distinct().select("d", (F.row_number().over(W.orderBy("d")) - 1).alias("pos"))
    return daily.unionByName(ends.join(months, "d").select(F.lit("monthly").alias("cadence"), "entity", "ord", "d", "pos", "px"))


def block_labels(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, d, pos, label_no): the entity that wins from pos + lag to pos + lag + h, for all blocks at once.

    Start and end prices are equi-joins on the position table, so horizon and lag are columns. Missing entities are
    ignored, ties go to the earlier entity, and the label is NULL while the safe entity's window is incomplete.
    """
    keyed = placed.join(F.broadcast(blocks.select("block", "cadence", "h", "lag")), "cadence")
    price = lambda name: placed.select("cadence", "entity", F.col("pos").alias(f"{name}_pos"), F.col("px").alias(name))
    ahead = keyed.withColumn("start_pos", F.col("pos") + F.col("lag")).withColumn("end_pos", F.col("pos") + F.col("lag") + F.col("h"))
    ahead = ahead.join(price("start"), ["cadence", "entity", "start_pos"], "left").join(price("end"), ["cadence", "entity", "end_pos"], "left")
    ahead = ahead.withColumn("gain", change(F.col("end"), F.col("start")))
    best = F.max_by("ord", F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("ord"))))
    safe = F.max(F.when(F.col("ord") == 0, F.col("gain")))
    days = ahead.groupBy("block", "d", "pos").agg(best.alias("best"), safe.alias("safe"))
    return days.select("block", "d", "pos", F.when(F.col("safe").isNotNull(), F.col("best")).cast("int").alias("label_no"))


def block_rows(spark, sf_dir, blocks: list[int] | None = None) -> tuple[DataFrame, list[str]]:
    """Feature vectors beside the labels of the blocks (all of them): (block, d, pos, usable, label_no, x, ok, rank)."""
    names = list(frames.MODEL_FEATURES)
    panel = src.panel_table(spark, sf_dir)
    dense = materialize(src.densify(panel))
    wanted = specs(spark) if blocks is None else specs(spark).where(F.col("block").isin(blocks))
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names]).alias("x")
    known = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0)) / len(names) > 0.6
    daily = daily_features(spark, sf_dir, panel).select(F.lit("daily").alias("cadence"), "d", known.alias("usable"), vector)
    frame = daily
    if any(c == "monthly" for i, (c, *_) in enumerate(BLOCKS) if blocks is None or i in blocks):
        frame = daily.unionByName(month_rows(spark, sf_dir, dense, known, vector))
    labels = block_labels(positions(dense), wanted).join(F.broadcast(wanted.select("block", "cadence")), "block")
    rows = frame.join(labels, ["cadence", "d"]).select("block", "d", "pos", "usable", "label_no", "x")
    return materialize(wf.ranked(rows)), names


def month_rows(spark, sf_dir, dense, known, vector) -> DataFrame:
    cube = materialize(src.order_cube(spark, sf_dir))
    monthly = frames.monthly(dense, src.daily_rates(spark, sf_dir, cube), release_features(src.monthly_releases(spark, sf_dir, cube)), src.risk_index(spark, sf_dir, cube))
    return monthly.select(F.lit("monthly").alias("cadence"), F.col("month").alias("d"), known.alias("usable"), vector)


def block_plan(spark, rows: DataFrame) -> DataFrame:
    """The eligible folds of every block."""
    blocks = specs(spark)
    calendar = rows.select("block", "d", "pos").join(F.broadcast(blocks.select("block", "h", "lag", "unit", "min_rows")), "block")
    return materialize(wf.eligible(rows, wf.block_folds(calendar, SPAN), blocks))


def logged_trials(spark, sf_dir, grids: dict | None = None) -> DataFrame:
    """The trial log of this data and these configurations; what is not in the log yet is fitted and appended."""
    grids = grids or wf.GRIDS
    run = f"{data_version(spark, [f'{sf_dir}/{t}.parquet' for t in TABLES])} {BLOCKS} {sorted(grids.items())}"
    log = TrialLog(spark)
    found = log.read(run)
    if found is None:
        rows, _ = block_rows(spark, sf_dir)
        log.append(run, searched(spark, rows, grids)[1])
        found = log.read(run)
    return found


def searched(spark, rows: DataFrame, grids: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(folds, trials, losses): the grid scored by every searching fold; the rules of each block count as trials too."""
    grids = grids or wf.GRIDS
    folds = block_plan(spark, rows)
    losses = materialize(wf.search(rows, folds, specs(spark), CLASSES, grids))
    rules = rows.select("block").distinct().select("block", F.lit("rule").alias("family"), F.lit(None).cast("date").alias("fold_start"), F.explode(F.array(*[F.lit(r) for r in RULES])).alias("configuration"), F.lit(None).cast("double").alias("loss"))
    return folds, wf.trial_rows(losses, grids).unionByName(rules), losses


def learned(spark, sf_dir, calibrate: bool = True, blocks: list[int] | None = None, families: list[str] | None = None) -> tuple[DataFrame, list[str], DataFrame]:
    """(rows, feature names, fits): the fits of all folds of the blocks and families asked for, as a written table."""
    rows, names = block_rows(spark, sf_dir, blocks)
    folds, _, losses = searched(spark, rows)
    known = specs(spark)
    if families:
        known = known.withColumn("families", F.array_intersect("families", F.array(*[F.lit(f) for f in families])))
    return rows, names, materialize(wf.fit(rows, wf.choices(folds, losses, known), CLASSES, calibrate))


def models(spark, sf_dir, calibrate: bool = True, blocks: list[int] | None = None, families: list[str] | None = None) -> DataFrame:
    return learned(spark, sf_dir, calibrate, blocks, families)[2]


def expected_maximum(trials: DataFrame) -> DataFrame:
    """One row (n_trials, maximum): the expected largest of as many standard normal scores as the log has trials."""
    n = trials.agg(F.count(F.lit(1)).alias("n_trials"))
    e = 2.718281828459045
    top = (1 - 0.5772156649015329) * normal.quantile(1 - 1 / F.col("n_trials")) + 0.5772156649015329 * normal.quantile(1 - 1 / (F.col("n_trials") * e))
    return n.withColumn("maximum", F.when(F.col("n_trials") > 1, top).otherwise(0.0))


KNOWN = " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in frames.MODEL_FEATURES)
_DAYS = "SELECT b.block, b.h, b.lag, s.d, s.pos, 504 AS least, 252 AS cal, date_trunc('month', s.d) AS seg FROM blk b, ses s WHERE b.cadence = 'daily'"
_MONTHS = "SELECT b.block, b.h, b.lag, m.d, m.pos, 36 AS least, 12 AS cal, date_trunc('year', m.d) AS seg FROM blk b, msx m WHERE b.cadence = 'monthly'"
# What the log must hold: the configurations of every searching fold, and five rules a block. A month counts as usable if
# its label is known; the calendars here are too short for any monthly fold to search.
TRIAL_CTES = (*FRAME_CTES, f"fmx AS ({FRAME_SQL})",
    "blk AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', {h}, {lag}, {0 if (c, h, lag) == WITHOUT_BOOSTING else len(wf.GRIDS['boosting'])})" for i, (c, h, lag) in enumerate(BLOCKS)) + ") t(block, cadence, h, lag, boosted))",
    "msx AS (SELECT date_trunc('month', d)::DATE AS d, row_number() OVER (ORDER BY date_trunc('month', d)) - 1 AS pos FROM (SELECT DISTINCT date_trunc('month', d) AS d FROM ses))",
    "safe_d AS (SELECT pos, px FROM dense WHERE ord = 0)",
    "safe_m AS (SELECT m.pos, CASE WHEN max(x.d) FILTER (x.px IS NOT NULL) = max(x.d) THEN arg_max(x.px, x.d) END AS px FROM dense x JOIN msx m ON m.d = date_trunc('month', x.d) WHERE x.ord = 0 GROUP BY m.pos)",
    f"bcal AS ({_DAYS} UNION ALL {_MONTHS})",
    f"""bok AS (SELECT c.block, c.pos, ({KNOWN}) / {len(frames.MODEL_FEATURES)}.0 > 0.6 AND a.px IS NOT NULL AND z.px IS NOT NULL AND a.px <> 0 AS ok FROM bcal c JOIN blk b ON b.block = c.block AND b.cadence = 'daily' JOIN fmx ON fmx.d = c.d
      LEFT JOIN safe_d a ON a.pos = c.pos + c.lag LEFT JOIN safe_d z ON z.pos = c.pos + c.lag + c.h
      UNION ALL SELECT c.block, c.pos, a.px IS NOT NULL AND z.px IS NOT NULL FROM bcal c JOIN blk b ON b.block = c.block AND b.cadence = 'monthly' LEFT JOIN safe_m a ON a.pos = c.pos + c.lag LEFT JOIN safe_m z ON z.pos = c.pos + c.lag + c.h)""",
    "bcount AS (SELECT block, pos, sum(ok::INTEGER) OVER (PARTITION BY block ORDER BY pos) AS n_train FROM bok)",
    "bstart AS (SELECT block, least, cal, seg, min(d) AS fold_start, min(pos) AS start_pos, min(pos) - 2 * (h + lag) - 1 AS s_max FROM bcal GROUP BY block, h, lag, least, cal, seg)",
    f"""bfold AS (SELECT f.*, n.n_train, f.start_pos = min(f.start_pos) OVER (PARTITION BY f.block) AS leads FROM bstart f JOIN bcal c ON c.block = f.block AND c.pos = f.s_max JOIN bcount n ON n.block = f.block AND n.pos = f.s_max
      WHERE f.s_max >= f.least AND c.d - (SELECT min(d) FROM bcal x WHERE x.block = f.block) >= {SPAN} AND n.n_train >= f.least AND n.n_train > f.cal + 40)""",
    "bsearch AS (SELECT b.block, b.boosted, count(f.block) AS n FROM blk b LEFT JOIN bfold f ON f.block = b.block AND (f.leads OR b.cadence = 'monthly' OR month(f.fold_start) = 1) AND f.n_train - f.cal > 200 GROUP BY b.block, b.boosted)",
    f"btrial AS (SELECT block, 'logistic' AS family, {len(wf.GRIDS['logistic'])} * n AS trials FROM bsearch UNION ALL SELECT block, 'boosting', boosted * n FROM bsearch UNION ALL SELECT block, 'rule', {len(RULES)} FROM bsearch)",
    "ntrial AS (SELECT sum(trials)::DOUBLE AS n FROM btrial)",
    normal.quantile_sql("qa", "ntrial", "1 - 1 / n"), normal.quantile_sql("qb", "ntrial", "1 - 1 / (n * 2.718281828459045::DOUBLE)"),
    "hurdle AS (SELECT CASE WHEN n > 1 THEN (1 - 0.5772156649015329::DOUBLE) * qa.z + 0.5772156649015329::DOUBLE * qb.z ELSE 0 END AS maximum FROM ntrial, qa, qb)")
