"""As-of joins: union both sides, order by time, carry the last (or next) payload.

One shuffle on the key and one ordered pass; no pair of rows is ever enumerated. With `bucket` the
key is split into time buckets, so a key holding a large share of all rows is spread over many tasks
and only one summary row per bucket is carried across bucket borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_T, _SIDE, _SEQ, _PAY, _ROW, _B = "__t", "__side", "__seq", "__pay", "__row", "__b"


def _stack(left, right, left_ts, right_ts, by, payload, seq, left_side, bucket: Column | None):
    pay = F.struct(*[F.col(p) for p in payload])
    seq_col = F.col(seq) if seq else F.lit(None)
    seq_type = right.schema[seq].dataType if seq else "bigint"
    shared = [F.col(b) for b in by]
    l = left.select(*shared, F.col(left_ts).alias(_T), F.lit(left_side).alias(_SIDE), F.lit(None).cast(seq_type).alias(_SEQ),
                    F.struct(*[F.col(c) for c in left.columns]).alias(_ROW))
    r = right.select(*shared, F.col(right_ts).alias(_T), F.lit(1 - left_side).alias(_SIDE), seq_col.cast(seq_type).alias(_SEQ),
                     pay.alias(_PAY))
    both = r.unionByName(l, allowMissingColumns=True)
    return both.withColumn(_B, bucket(F.col(_T))) if bucket is not None else both


def _finish(df, payload, hit):
    return df.filter(F.col(_ROW).isNotNull()).select(f"{_ROW}.*", *[hit[p].alias(p) for p in payload])


def asof_backward(left: DataFrame, right: DataFrame, *, left_ts: str, right_ts: str, payload: list[str],
                  by: tuple[str, ...] = (), seq: str | None = None, bucket=None) -> DataFrame:
    """Left rows with the payload of the last right row whose time is <= theirs.

    Equal right times keep the last by `seq`. The payload may itself be NULL: a matched row with a
    NULL value is a match, and is not skipped. `bucket` maps a time column to a coarser bucket.
    """
    both = _stack(left, right, left_ts, right_ts, by, payload, seq, 1, bucket)
    order = [F.col(_T), F.col(_SIDE), F.col(_SEQ)]
    if bucket is None:
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return _finish(both.withColumn("__hit", F.last(_PAY, ignorenulls=True).over(w)), payload, F.col("__hit"))
    keys = [*by, _B]
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = both.withColumn("__hit", F.last(_PAY, ignorenulls=True).over(w)).filter(F.col(_ROW).isNotNull())
    borders = both.groupBy(*keys).agg(F.max_by(_PAY, F.when(F.col(_PAY).isNotNull(), F.struct(_T, _SEQ))).alias("__lastpay"))
    prior = W.partitionBy(*by).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    carried = borders.select(*keys, F.last("__lastpay", ignorenulls=True).over(prior).alias("__carry"))
    return _finish(inside.join(carried, keys), payload, F.coalesce("__hit", "__carry"))


def asof_forward(left: DataFrame, right: DataFrame, *, left_ts: str, right_ts: str, payload: list[str],
                 by: tuple[str, ...] = (), strict: bool = False, bucket=None) -> DataFrame:
    """Left rows with the payload of the first right row at or after (strictly after) their time."""
    both = _stack(left, right, left_ts, right_ts, by, payload, None, 1 if strict else 0, bucket)
    w_rows = W.partitionBy(*by).orderBy(F.col(_T), F.col(_SIDE)).rowsBetween(0, W.unboundedFollowing)
    if bucket is None:
        return _finish(both.withColumn("__hit", F.first(_PAY, ignorenulls=True).over(w_rows)), payload, F.col("__hit"))
    keys = [*by, _B]
    w = W.partitionBy(*keys).orderBy(F.col(_T), F.col(_SIDE)).rowsBetween(0, W.unboundedFollowing)
    inside = both.withColumn("__hit", F.first(_PAY, ignorenulls=True).over(w)).filter(F.col(_ROW).isNotNull())
    borders = both.groupBy(*keys).agg(F.min_by(_PAY, F.when(F.col(_PAY).isNotNull(), F.col(_T))).alias("__firstpay"))
    later = W.partitionBy(*by).orderBy(_B).rowsBetween(1, W.unboundedFollowing)
    carried = borders.select(*keys, F.first("__firstpay", ignorenulls=True).over(later).alias("__carry"))
    return _finish(inside.join(carried, keys), payload, F.coalesce("__hit", "__carry"))


def asof_on_calendar(calendar: DataFrame, right: DataFrame, *, available_on: str, payload: list[str], seq: str | None = None) -> DataFrame:
    """Calendar days with the values known on each day.

    Both sides hold at most one row per day and series, so this runs on the date dimension; callers
    then equi-join the result to any number of panel rows by day.
    """
    return asof_backward(calendar, right, left_ts="d", right_ts=available_on, payload=payload, seq=seq)


def asof_many(calendar: DataFrame, series: list[tuple[DataFrame, str, list[str], str | None]]) -> DataFrame:
    """Calendar days with several series as known on each day, in one ordered pass.

    Each series is (rows, availability column, payload columns, optional date column breaking ties).
    All series share one union and one sort; a series' payload is NULL on the rows of the others, so
    carrying the last non-null payload per series gives the same result as separate as-of joins.
    """
    stacked = calendar.select(F.col("d").alias(_T), F.lit(1).alias(_SIDE), F.lit(None).cast("date").alias(_SEQ),
                              F.struct(*[F.col(c) for c in calendar.columns]).alias(_ROW))
    for i, (rows, available_on, payload, seq) in enumerate(series):
        order = (F.col(seq) if seq else F.lit(None)).cast("date")
        part = rows.select(F.col(available_on).alias(_T), F.lit(0).alias(_SIDE), order.alias(_SEQ), F.struct(*[F.col(p) for p in payload]).alias(f"__p{i}"))
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    w = W.orderBy(_T, _SIDE, _SEQ).rowsBetween(W.unboundedPreceding, 0)
    hits = stacked.select(_ROW, *[F.last(f"__p{i}", ignorenulls=True).over(w).alias(f"__h{i}") for i in range(len(series))]).filter(F.col(_ROW).isNotNull())
    return hits.select(f"{_ROW}.*", *[F.col(f"__h{i}")[p].alias(p) for i, (_, _, payload, _) in enumerate(series) for p in payload])


def validity(snapshots: DataFrame, keys: tuple[str, ...], start: str) -> DataFrame:
    """Snapshots with the interval in which each is the latest of its family: [valid_from, valid_to), open at the end.

    One row per family and snapshot time is ordered, whatever the number of payload rows of a snapshot.
    """
    times = snapshots.select(*keys, F.col(start).alias("valid_from")).distinct()
    times = times.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy(*keys).orderBy("valid_from")))
    return snapshots.withColumn("valid_from", F.col(start)).join(times, [*keys, "valid_from"])


def snapshot_on_calendar(calendar: DataFrame, snapshots: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Calendar days once per family with the snapshot valid on them; days before a family's first have none.

    Only the interval starts take part in the ordered pass over days; the payload is equi-joined by segment.
    """
    starts = snapshots.select(*keys, "valid_from").distinct()
    families = starts.select(*keys).distinct()
    names = families.agg(F.collect_set(F.struct(*keys)).alias("k")).scalar()
    days = calendar.withColumn("__k", F.explode(names)).select(*calendar.columns, *[F.col(f"__k.{k}").alias(k) for k in keys])
    placed = asof_backward(days, starts, left_ts="d", right_ts="valid_from", payload=["valid_from"], by=keys)
    return placed.join(snapshots, [*keys, "valid_from"], "left")
