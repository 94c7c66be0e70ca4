"""Monthly histories: month-end returns, gap-complete calendar windows, re-compounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.columns import change


def month_end(panel: DataFrame, value: str = "px", keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Last non-null value per key and month; pre-aggregates map-side."""
    return panel.filter(F.col(value).isNotNull()).groupBy(*keys, F.trunc("d", "MM").alias("month")).agg(
        F.max_by(value, "d").alias(value), F.max("d").alias("last_d"))


def month_end_returns(panel: DataFrame) -> DataFrame:
    """(entity, month, ret_pct): percent change between month ends; the first month has none."""
    w = W.partitionBy("entity").orderBy("month")
    return month_end(panel).select("entity", "month", (100.0 * change(F.col("px"), F.lag("px").over(w))).alias("ret_pct"))


def calendar_months(panel: DataFrame, months: int) -> DataFrame:
    """(entity, month) for the `months` calendar months before the panel's last month, absent ones included."""
    last = F.trunc(F.max("d"), "MM")
    window = panel.agg(F.sequence(F.add_months(last, -months), F.add_months(last, -1), F.expr("interval 1 month")).alias("m")).scalar()
    return panel.select("entity").distinct().select("entity", F.explode(window).alias("month"))


def broken_wealth(ret_pct: Column, row_no: Column, w) -> Column:
    """Compounded percent returns, unknown from the first interior gap on."""
    from tidemark.operators.windows import compound_break

    return compound_break(ret_pct / 100.0, row_no, w)


def history_document(window_rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Per entity: returns, wealth, first months, missing months and the compounded total of a calendar window.

    Every entity has exactly one row per month of the window, so its arrays have a fixed length.
    """
    w = W.partitionBy("entity").orderBy("month")
    rows = window_rows.withColumn("rn", F.row_number().over(w))
    rows = rows.withColumn("wealth", broken_wealth(F.col("ret_pct"), F.col("rn"), w))
    known = F.when(F.col("ret_pct").isNotNull(), F.col("month"))
    first = F.min(known).over(W.partitionBy("entity"))
    rows = rows.withColumn("first_m", first)
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("rn", c))), lambda s: s[c])
    gone = F.col("ret_pct").isNull()
    doc = rows.groupBy("entity").agg(
        ordered("ret_pct").alias("return_pct"), ordered("wealth").alias("cumulative_wealth"), F.count("ret_pct").alias("n_months"),
        F.min(known).alias("first_in_window"), F.count(F.when(gone, 1)).alias("missing"), F.count(F.when(gone & (F.col("month") > F.col("first_m")), 1)).alias("missing_after_start"),
        F.sort_array(F.collect_list(F.when(gone, F.col("month")))).alias("missing_months"), F.max_by(F.struct("wealth"), "rn")["wealth"].alias("last_wealth"))
    ever = all_rows.groupBy("entity").agg(F.min("month").alias("first_available"))
    return doc.join(ever, "entity").withColumn("compounded_pct", (F.col("last_wealth") - 1.0) * 100.0).drop("last_wealth")


def resample_lagged(daily: DataFrame, day: str, columns: dict[str, str]) -> DataFrame:
    """Last non-null value of each column per month, shifted one month later."""
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col(day))).alias(k) for k, v in columns.items()]
    months = daily.groupBy(F.trunc(day, "MM").alias("month")).agg(*last)
    w = W.orderBy("month")
    return months.select("month", *[F.lag(k).over(w).alias(k) for k in columns])
