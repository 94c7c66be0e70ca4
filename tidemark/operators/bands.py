"""Range, interval and proximity joins written as equi-joins on exploded positions or small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.asof import asof_forward


def locate_events(sessions: DataFrame, events: DataFrame, event_d: str = "event_d") -> DataFrame:
    """Adds `loc`: position of the first session at or after the event; NULL past the end."""
    return asof_forward(events, sessions.select("d", F.col("pos").alias("loc")), left_ts=event_d, right_ts="d", payload=["loc"])


def event_offsets(events: DataFrame, pre: int, post: int, n_sessions: Column) -> DataFrame:
    """One row per event and offset in [-pre, post]; events without the full window are dropped."""
    inside = (F.col("loc") >= pre) & (F.col("loc") + post < n_sessions)
    return (
        events.filter(inside)
        .withColumn("off", F.explode(F.sequence(F.lit(-pre), F.lit(post))))
        .withColumn("pos", F.col("loc") + F.col("off"))
    )


def since_events(sessions: DataFrame, events: DataFrame, cap: int) -> DataFrame:
    """(d, pos, category, since): sessions since the latest event of each category, capped."""
    located = locate_events(sessions, events).filter(F.col("loc").isNotNull())
    marks = located.groupBy("category", F.col("loc").alias("pos")).agg(F.lit(1).alias("hit"))
    cats = F.sort_array(F.collect_set("category"))
    grid = sessions.select("d", "pos", F.explode(events.agg(cats.alias("c")).scalar()).alias("category"))
    w = W.partitionBy("category").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    since = F.col("pos") - F.last(F.when(F.col("hit") == 1, F.col("pos")), ignorenulls=True).over(w)
    joined = grid.join(marks, ["category", "pos"], "left")
    return joined.withColumn("since", F.when(since.isNotNull(), F.least(since, F.lit(cap)))).select("d", "pos", "category", "since")


def active_window(sessions: DataFrame, events: DataFrame, length: int) -> DataFrame:
    """(d, category, active): 1 during the `length` sessions that start at an event."""
    located = locate_events(sessions, events).filter(F.col("loc").isNotNull())
    on = located.select("category", F.explode(F.sequence(F.col("loc"), F.col("loc") + (length - 1))).alias("pos")).distinct()
    cats = F.sort_array(F.collect_set("category"))
    grid = sessions.select("d", "pos", F.explode(events.agg(cats.alias("c")).scalar()).alias("category"))
    return grid.join(on.withColumn("hit", F.lit(1)), ["category", "pos"], "left").select(
        "d", "pos", "category", F.coalesce("hit", F.lit(0)).alias("active"))


def in_intervals(rows: DataFrame, intervals: DataFrame, d: str = "d") -> DataFrame:
    """Adds `inside`: 1 when d falls in any closed [start, stop]; open-ended intervals are skipped.

    Intervals become the days they cover, so the join is an equi-join on the day.
    """
    days = intervals.filter("start IS NOT NULL AND stop IS NOT NULL").select(
        F.explode(F.sequence("start", "stop")).alias(d)).distinct().withColumn("__in", F.lit(1))
    return rows.join(days, d, "left").withColumn("inside", F.coalesce("__in", F.lit(0))).drop("__in")


def near_positions(left: DataFrame, right: DataFrame, reach: int, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Left rows having a right row of the same key within `reach` positions."""
    near = right.select(*by, F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)).alias("pos")).distinct()
    return left.join(near, [*by, "pos"], "left_semi")


def whipsaws(path: DataFrame, name: str, window: int = 21, key: str = "strategy") -> DataFrame:
    """Switches that a later switch reverses within `window` positions: (key, i, frm, to).

    A reversal of (frm -> to) is a switch (to -> frm), so switches are grouped by their unordered
    pair and only the next opposite one has to be looked at.
    """
    w = W.partitionBy(key).orderBy("pos")
    switches = (
        path.withColumn("frm", F.lag(name).over(w)).withColumn("to", F.col(name))
        .filter(F.col("frm").isNotNull() & (F.col("frm") != F.col("to"))).select(key, F.col("pos").alias("i"), "frm", "to")
    )
    later = W.partitionBy(key, F.least("frm", "to"), F.greatest("frm", "to")).orderBy("i").rowsBetween(1, W.unboundedFollowing)
    upward = F.col("frm") < F.col("to")
    back = F.when(upward, F.min(F.when(~upward, F.col("i"))).over(later)).otherwise(F.min(F.when(upward, F.col("i"))).over(later))
    return switches.withColumn("back_i", back).filter(F.col("back_i") - F.col("i") <= window).select(key, "i", "frm", "to", "back_i")


def bin_lookup(values: DataFrame, bins: DataFrame, value: str) -> DataFrame:
    """Adds the populated bin of each value; without one, the populated bin with the closest mean.

    `bins(bin, low, high, n, mean_predicted, empirical_rate)` is a fixed-size table: it is folded
    into one array that travels with the plan, and each value is resolved row by row.
    """
    table = bins.filter("n > 0").agg(F.sort_array(F.collect_list(F.struct("bin", "low", "high", "n", "mean_predicted", "empirical_rate"))).alias("b")).scalar()
    v = F.col(value)
    with_bins = values.withColumn("__bins", table)
    covering = F.filter("__bins", lambda b: (b["low"] <= v) & (v <= b["high"]))
    nearest = F.array_min(F.transform("__bins", lambda b: F.struct(F.abs(b["mean_predicted"] - v).alias("gap"), b["bin"].alias("bin"), b.alias("b"))))
    found = F.when(F.size(covering) > 0, F.get(covering, F.lit(0))).otherwise(nearest["b"])
    return with_bins.withColumn("__hit", found).withColumn("exact", F.when(F.size(covering) > 0, 1).otherwise(0)).select(
        *values.columns, "exact", *[F.col(f"__hit.{c}").alias(c) for c in ("bin", "n", "mean_predicted", "empirical_rate")])
