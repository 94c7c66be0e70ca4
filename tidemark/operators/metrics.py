"""Path metrics as grouped aggregates over (strategy, d, pos, w, ret)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.columns import change
from tidemark.operators.windows import running


def aligned(joined: DataFrame, keys: list[str], a: str = "w", b: str = "bw", order: str = "d", min_rows: int = 5) -> DataFrame:
    """Two joined paths with NULL rows dropped, both rebased to their first common row.

    Groups shorter than `min_rows`, or starting at or below zero, give no result.
    """
    w = W.partitionBy(*keys).orderBy(order)
    both = joined.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    first = lambda c: F.first(c).over(running(w))
    out = both.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys))).withColumn("__a0", first(a)).withColumn("__b0", first(b))
    out = out.filter((F.col("__n") >= min_rows) & (F.col("__a0") > 0) & (F.col("__b0") > 0))
    return out.withColumn("a", F.col(a) / F.col("__a0")).withColumn("b", F.col(b) / F.col("__b0")).drop("__n", "__a0", "__b0")


def cagr(first_w: Column, last_w: Column, days: Column) -> Column:
    grown = F.pow(last_w / first_w, 365.25 / days) - 1.0
    return F.when((first_w > 0) & (last_w > 0) & (days > 0), grown).otherwise(0.0)


def with_path_columns(paths: DataFrame, key: str, periods: int) -> DataFrame:
    """One ordered pass per strategy adding everything the grouped metrics need."""
    w = W.partitionBy(key).orderBy("pos")
    run = running(w)
    out = paths.withColumn("rn", F.row_number().over(w)).withColumn("peak", F.max("w").over(run))
    return out.select(
        "*",
        F.when(F.col("peak") > 0, F.col("w") / F.col("peak") - 1.0).otherwise(0.0).alias("dd"),
        F.max(F.when(F.col("w") >= F.col("peak"), F.col("d"))).over(run).alias("peak_d"),
        change(F.col("w"), F.lag("w", periods).over(w)).alias("roll"),
    )


def path_metrics(key: str, periods: int = 252) -> dict[str, Column]:
    """Aggregates over `with_path_columns` rows that also carry the baseline return `base_ret`.

    The first return of a path is not part of its return sample.
    """
    scale = F.sqrt(F.lit(float(periods)))
    live = F.col("rn") > 1
    ret = F.when(live, F.col("ret"))
    excess = F.when(live, F.col("ret") - F.col("base_ret"))
    loss = F.when(excess < 0, excess)
    first_w, last_w = F.min_by("w", "pos"), F.max_by("w", "pos")
    growth = cagr(first_w, last_w, F.datediff(F.max("d"), F.min("d")))
    worst = F.min("dd")
    fell = worst < 0
    return {
        "cagr": growth,
        "vol": F.when(F.count(ret) >= 2, F.stddev_samp(ret) * scale).otherwise(0.0),
        "sharpe": F.when((F.count(excess) >= 2) & (F.stddev_samp(excess) > 0), F.avg(excess) / F.stddev_samp(excess) * scale).otherwise(0.0),
        "sortino": F.when((F.count(excess) >= 2) & (F.count(loss) > 0), F.avg(excess) / F.sqrt(F.avg(loss * loss)) * scale).otherwise(0.0),
        "max_drawdown": F.least(worst, F.lit(0.0)),
        "max_dd_peak": F.when(fell, F.min_by("peak_d", F.struct("dd", "pos"))).otherwise(F.min("d")),
        "max_dd_trough": F.when(fell, F.min_by("d", F.struct("dd", "pos"))).otherwise(F.min("d")),
        "calmar": F.when(fell, growth / F.abs(worst)),
        "ulcer": F.sqrt(F.avg(F.col("dd") * F.col("dd"))),
        "worst_rolling": F.coalesce(F.min("roll"), last_w / first_w - 1.0),
        "hit_rate": F.avg(F.when(live, F.when(F.col("ret") > F.col("base_ret"), 1.0).otherwise(0.0))),
        "n_rows": F.count(F.lit(1)),
    }


def one_way_turnover(weights: DataFrame, key: str, w_col: str = "weights") -> DataFrame:
    """Half the sum of absolute component changes between consecutive rows."""
    w = W.partitionBy(key).orderBy("pos")
    prev = F.lag(w_col).over(w)
    step = F.aggregate(F.zip_with(F.col(w_col), F.col("__prev"), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)
    return weights.withColumn("__prev", prev).groupBy(key).agg((0.5 * F.coalesce(F.sum(step), F.lit(0.0))).alias("turnover"))


def transfers_per_month(posts: DataFrame, key: str, d: str = "post_d") -> DataFrame:
    """Mean and largest number of postings over the months that have any."""
    months = posts.groupBy(key, F.trunc(d, "MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return months.groupBy(key).agg(F.avg("n").alias("per_month"), F.max("n").alias("max_month"))


def rebase_slice(paths: DataFrame, key: str, start: Column, stop: Column, min_rows: int = 5) -> DataFrame:
    """Closed date slice rebased to 1; too-short slices or a non-positive start give no rows."""
    part = paths.filter((F.col("d") >= start) & (F.col("d") <= stop) & F.col("w").isNotNull())
    first = F.first("w").over(running(W.partitionBy(key).orderBy("d")))
    out = part.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(key))).withColumn("__w0", first)
    return out.filter((F.col("__n") >= min_rows) & (F.col("__w0") > 0)).withColumn("rebased", F.col("w") / F.col("__w0")).drop("__n", "__w0")
