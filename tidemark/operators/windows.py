"""Row-window operators over a panel.

A panel holds one row per entity and session, so a partition is bounded by the length of the
calendar and not by the size of the fact tables behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.columns import change, full_window
from tidemark.session import materialize


def by_entity(*keys: str, order: str = "pos"):
    return W.partitionBy(*(keys or ("entity",))).orderBy(order)


def trailing(w, rows: int):
    return w.rowsBetween(-(rows - 1), 0)


def running(w):
    return w.rowsBetween(W.unboundedPreceding, 0)


def total_return(px: Column, n: int, w) -> Column:
    """px / px[-n] - 1; gaps are not filled."""
    return change(px, F.lag(px, n).over(w))


def skip_return(px: Column, near: int, far: int, w) -> Column:
    return change(F.lag(px, near).over(w), F.lag(px, far).over(w))


def with_returns(dense: DataFrame, w=None) -> DataFrame:
    """Adds `fpx` (price padded over gaps) and `ret` (simple return of the padded price)."""
    w = w or by_entity()
    padded = dense.withColumn("fpx", F.last("px", ignorenulls=True).over(running(w)))
    return padded.withColumn("ret", change(F.col("fpx"), F.lag("fpx").over(w)))


def realized_vol(ret: Column, rows: int, periods: int, w) -> Column:
    win = trailing(w, rows)
    return full_window(F.stddev_samp(ret).over(win) * F.sqrt(F.lit(float(periods))), ret, win, rows)


def moving_average(x: Column, rows: int, w) -> Column:
    win = trailing(w, rows)
    return full_window(F.avg(x).over(win), x, win, rows)


def above_average(px: Column, rows: int, w) -> Column:
    """1 when strictly above the full-window average; 0 otherwise; NULL until the window is full."""
    avg = moving_average(px, rows, w)
    return F.when(avg.isNotNull(), F.when(px > avg, 1).otherwise(0))


def drawdown(px: Column, w) -> Column:
    return change(px, F.max(px).over(running(w)))


def rows_since_peak(df: DataFrame, px: str, w, out: str = "since_peak", pos: str = "pos") -> DataFrame:
    """Rows since the running peak; an equal value restarts the count.

    A series that opens with a gap has no peak to compare with and counts from its first row.
    """
    run = running(w)
    peak_pos = F.max(F.when(F.col(px) >= F.col("__peak"), F.col(pos))).over(run)
    start = F.first(pos).over(run)
    opened = F.first(F.col(px).isNotNull()).over(run)
    return (
        df.withColumn("__peak", F.max(px).over(run))
        .withColumn(out, F.col(pos) - F.when(opened, F.coalesce(peak_pos, start)).otherwise(start))
        .drop("__peak")
    )


def zscore(x: Column, rows: int, min_rows: int, w) -> Column:
    win = trailing(w, rows)
    sd = F.stddev_samp(x).over(win)
    return F.when(F.count(x).over(win) >= min_rows, F.try_divide(x - F.avg(x).over(win), sd))


def row_diff(x: Column, k: int, w) -> Column:
    return x - F.lag(x, k).over(w)


def run_length(df: DataFrame, cond: Column, keys: tuple[str, ...] = ("entity",), order: str = "pos", out: str = "run") -> DataFrame:
    """Consecutive rows on which `cond` has held; false or NULL resets to 0."""
    marked = df.withColumn("__hold", F.coalesce(cond, F.lit(False))).withColumn(
        "__island", F.sum(F.when(F.col("__hold"), 0).otherwise(1)).over(running(W.partitionBy(*keys).orderBy(order))))
    inner = running(W.partitionBy(*keys, "__island").orderBy(order))
    return marked.withColumn(out, F.sum(F.when(F.col("__hold"), 1).otherwise(0)).over(inner)).drop("__hold", "__island")


def rows_since_event(pos: Column, event_pos: Column, cap: int, w) -> Column:
    """Rows since the latest event at or before the row, capped; NULL before the first."""
    since = pos - F.last(event_pos, ignorenulls=True).over(running(w))
    return F.when(since.isNotNull(), F.least(since, F.lit(cap)))


def compound_hold(ret: Column, w) -> Column:
    """Running wealth that stays flat across a missing return once it has started."""
    run = running(w)
    return F.when(F.count(ret).over(run) > 0, F.product(F.coalesce(1.0 + ret, F.lit(1.0))).over(run))


def compound_break(ret: Column, row_no: Column, w) -> Column:
    """Running wealth that is unknown from the first interior gap on.

    `row_no` numbers the rows of the window; the path is intact while every row since the first
    return has one.
    """
    run = running(w)
    first = F.min(F.when(ret.isNotNull(), row_no)).over(run)
    intact = F.count(ret).over(run) == row_no - first + 1
    return F.when(ret.isNotNull() & intact, F.product(F.coalesce(1.0 + ret, F.lit(1.0))).over(run))


def wealth_from_prices(px: Column, pos: Column, w) -> Column:
    """Price over first valid price; NULL for good after an interior gap."""
    ok = px > 0
    run = running(w)
    first_pos = F.min(F.when(ok, pos)).over(run)
    intact = F.count(F.when(ok, 1)).over(run) == pos - first_pos + 1
    return F.when(ok & intact, F.try_divide(px, F.first(F.when(ok, px), ignorenulls=True).over(run)))


def cross_rank(df: DataFrame, value: str, day: str = "d", out: str = "xrank") -> DataFrame:
    """Ascending average-tie rank among a day's non-null values."""
    peers = W.partitionBy(day, value)
    ranked = F.rank().over(W.partitionBy(day).orderBy(F.col(value).asc_nulls_last()))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), ranked + (F.count(F.lit(1)).over(peers) - 1) / 2.0))


def expanding_rank(df: DataFrame, value: str, order: str, keys: list[str], min_rows: int, out: str = "pct", bucket_rows: int = 1 << 16) -> DataFrame:
    """Percentile of each value within its own history (self included, average ties), for series of any length.

    The rows before a position are, by the ones of its binary form, at most one left half-block of each size. On every
    level a block's left half is counted by distinct value, the counts are summed in the order of values, and the
    rows of the right half look up how many lie below and beside them. Distinct values are cut into buckets of about
    `bucket_rows` rows by quantiles, sums over whole buckets are added from a small table; so no task sees a
    whole series, and a value that a third of all rows share is one row of its block. Work is rows times levels; the
    given rows are written once.

    `order` is a whole number or a date, unique in a series; NULL and NaN values have no rank and count nowhere.
    """
    at = F.unix_date(order) if dict(df.dtypes)[order] == "date" else F.col(order)
    x = F.col(value).cast("double")
    rows = materialize(df.withColumn("__k", F.struct(*keys)).withColumn("__at", at.cast("bigint")))
    known = rows.select("__k", "__at", F.when(~F.isnan(x), x).alias("__v")).where("__v IS NOT NULL AND __at IS NOT NULL")
    low, high, n = known.agg(F.min("__at"), F.max("__at"), F.count(F.lit(1))).first()
    levels, buckets = ((high or 0) - (low or 0)).bit_length(), -(-n // bucket_rows)
    if buckets > 1:
        edges = known.groupBy("__k").agg(F.percentile_approx("__v", [i / buckets for i in range(1, buckets)]).alias("__edges"))
        known = known.join(edges, "__k").withColumn("__b", F.size(F.filter("__edges", lambda e: e < F.col("__v")))).drop("__edges")
    else:
        known = known.withColumn("__b", F.lit(0))
    placed = known.withColumn("__i", F.col("__at") - F.lit(low or 0)).withColumn("__l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))) if levels else F.lit(0))
    placed = placed.withColumn("__p", F.expr("shiftright(__i, __l + 1)")).withColumn("__right", F.expr("shiftright(__i, __l) & 1"))
    block = ["__k", "__l", "__p"]
    left = placed.groupBy(*block, "__b", "__v").agg(F.sum(1 - F.col("__right")).alias("__same"))
    before = F.coalesce(F.sum("__same").over(W.partitionBy(*block, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = left.groupBy(*block, "__b").agg(F.sum("__same").alias("__n"))
    under = F.coalesce(F.sum("__n").over(W.partitionBy(*block).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = whole.withColumn("__under", under).withColumn("__all", F.sum("__n").over(W.partitionBy(*block))).drop("__n")
    counts = left.withColumn("__before", before).join(whole, [*block, "__b"])
    hits = placed.where("__right = 1").select(*block, "__b", "__v", "__at").join(counts, [*block, "__b", "__v"])
    sums = hits.groupBy("__k", "__at").agg(F.sum(F.col("__before") + F.col("__under")).alias("__below"), F.sum("__same").alias("__same"), F.sum("__all").alias("__all"))
    size = F.coalesce("__all", F.lit(0)) + 1
    pct = (F.coalesce("__below", F.lit(0)) + (F.coalesce("__same", F.lit(0)) + 2) / 2.0) / size
    ranked = rows.join(sums, ["__k", "__at"], "left").withColumn(out, F.when(x.isNotNull() & ~F.isnan(x) & (size >= min_rows), pct))
    return ranked.select(*df.columns, out)


def forward_labels(dense: DataFrame, h: int, lag: int, w=None) -> DataFrame:
    """Adds `excess` over the safe asset from t+lag to t+lag+h, and per day the winning entity.

    Missing entities are ignored, ties go to the earlier entity, and the label is NULL while the
    safe asset's window is incomplete.
    """
    w = w or by_entity()
    ahead = dense.withColumn("fret", change(F.lead("px", lag + h).over(w), F.lead("px", lag).over(w)))
    day = W.partitionBy("d")
    safe = F.max(F.when(F.col("ord") == 0, F.col("fret"))).over(day)
    inside = F.lead("pos", lag + h).over(w).isNotNull()
    ahead = ahead.withColumn("__safe", safe).withColumn(
        "excess", F.when(inside, F.when(F.col("ord") == 0, 0.0).otherwise(F.col("fret") - F.col("__safe"))))
    best = F.max_by("entity", F.when(F.col("excess").isNotNull(), F.struct("excess", -F.col("ord")))).over(day)
    return ahead.withColumn("label", F.when(F.col("__safe").isNotNull(), best)).drop("fret", "__safe")
