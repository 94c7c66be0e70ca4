"""Events found by rule: threshold crossings of a trailing z-score, with a rest after each event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def crossings(days: DataFrame, key: str, day: str, value: str, rows: int, least: int, threshold: float) -> DataFrame:
    """(key, day) where the z-score against the `rows` earlier days reaches the threshold and the day before did not.

    `days` has one row for each key and day, so a window partition is as long as the calendar. Fewer than `least` earlier days,
    or earlier days without spread, have no score.
    """
    by = W.partitionBy(key).orderBy(day)
    earlier = by.rowsBetween(-rows, -1)
    spread = F.stddev_samp(value).over(earlier)
    score = F.when((F.count(value).over(earlier) >= least) & (spread > 0), (F.col(value) - F.avg(value).over(earlier)) / spread)
    scored = days.withColumn("__z", score).withColumn("__before", F.lag("__z").over(by))
    return scored.where((F.col("__z") >= threshold) & F.coalesce(F.col("__before") < threshold, F.lit(True))).select(key, day)


def rested(found: DataFrame, key: str, day: str, rest: int) -> DataFrame:
    """Of the sorted days of a key the first, and then each that comes at least `rest` days after the last one kept.

    The choice depends on all earlier ones, so it is an ordered fold; a key's days are as many as the calendar's at most.
    """
    def step(kept, d):
        free = F.coalesce(F.datediff(d, F.element_at(kept, -1)) >= rest, F.lit(True))
        return F.when(F.size(kept) == 0, F.array(d)).when(free, F.concat(kept, F.array(d))).otherwise(kept)

    days = F.sort_array(F.collect_set(day))
    none = F.slice(F.array(F.lit(None).cast("date")), 1, 0)
    return found.groupBy(key).agg(days.alias("__days")).select(key, F.explode(F.aggregate("__days", none, step)).alias(day))
