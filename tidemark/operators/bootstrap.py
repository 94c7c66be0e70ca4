"""Moving-block bootstrap as joins: replicas pick hashed block starts, blocks are looked up by start.

Work grows with replicas x blocks and not with replicas x rows, because the growth of the block that
begins at each row is computed once per path. Starts come from a hash of (seed, replica, block), so
any retry of a task draws the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.windows import running
from tidemark.session import spread


def hashed_start(seed: str, rep: Column, blk: Column, span: Column) -> Column:
    digest = F.md5(F.concat_ws("-", F.lit(seed), rep.cast("string"), blk.cast("string")))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % span


def replicas(groups: DataFrame, keys: list[str], reps: int) -> DataFrame:
    """One row per group and replica, spread over the cluster before blocks are unfolded."""
    return spread(groups.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))), *keys, "rep")


def block_growth(paths: DataFrame, keys: list[str], values: list[str], block: int, tail: Column) -> DataFrame:
    """Per possible start: log growth of a full block and of the shorter last one, for every value column.

    `paths` has positions 0..n-1 per group; a group is one path, bounded by the calendar.
    """
    w = W.partitionBy(*keys).orderBy("pos")
    logs = {v: F.ln(1.0 + F.col(v)) for v in values}
    cum = paths.select(*keys, "pos", tail.alias("__tail"), *[F.sum(x).over(running(w)).alias(f"__c_{v}") for v, x in logs.items()],
                       *[x.alias(f"__l_{v}") for v, x in logs.items()])
    full = cum.select(*keys, F.col("pos").alias("start"), "__tail",
                      *[F.sum(f"__l_{v}").over(w.rowsBetween(0, block - 1)).alias(f"full_{v}") for v in values],
                      *[(F.col(f"__c_{v}") - F.col(f"__l_{v}")).alias(f"__b_{v}") for v in values])
    ends = cum.select(*keys, (F.col("pos") - F.col("__tail") + 1).alias("start"), *[F.col(f"__c_{v}").alias(f"__e_{v}") for v in values])
    return full.join(ends, [*keys, "start"]).select(
        *keys, "start", *[F.col(f"full_{v}") for v in values], *[(F.col(f"__e_{v}") - F.col(f"__b_{v}")).alias(f"tail_{v}") for v in values])


def excess_growth(paths: DataFrame, keys: list[str], block: int, reps: int, seed: str = "0") -> DataFrame:
    """Per group: point excess CAGR of rs over rb, its 5% and 95% bootstrap quantiles, replicas used.

    `paths(keys, pos, d, rs, rb)`; paths shorter than block + 2 return the point estimate thrice.
    """
    by = W.partitionBy(*keys)
    n = F.count(F.lit(1)).over(by)
    rows = paths.withColumn("n", n).withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("tail", F.col("n") - block * (F.col("blocks") - 1))
    days = F.greatest(F.datediff(F.max("d"), F.min("d")), F.lit(1))
    first = lambda c: F.when(F.col("pos") == 0, 0.0).otherwise(F.ln(1.0 + F.col(c)))
    groups = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("blocks").alias("blocks"), days.alias("days"), F.sum(first("rs")).alias("ls"), F.sum(first("rb")).alias("lb"))
    e = 365.25 / F.col("days")
    groups = groups.withColumn("point", F.exp(F.col("ls") * e) - F.exp(F.col("lb") * e))
    growth = block_growth(rows, keys, ["rs", "rb"], block, F.col("tail"))
    long_enough = groups.filter(F.col("n") >= block + 2).select(*keys, "n", "blocks", "days")
    draws = (
        replicas(long_enough, keys, reps).withColumn("blk", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        .withColumn("start", hashed_start(seed, F.col("rep"), F.col("blk"), F.col("n") - block + 1))
    )
    last = F.col("blk") == F.col("blocks") - 1
    hit = draws.join(growth, [*keys, "start"])
    sums = hit.groupBy(*keys, "rep").agg(
        F.max("days").alias("days"), *[F.sum(F.when(last, F.col(f"tail_{v}")).otherwise(F.col(f"full_{v}"))).alias(v) for v in ("rs", "rb")])
    excess = sums.withColumn("x", F.exp(F.col("rs") * e) - F.exp(F.col("rb") * e))
    bands = excess.groupBy(*keys).agg(F.percentile("x", 0.05).alias("low"), F.percentile("x", 0.95).alias("high"), F.count(F.lit(1)).alias("n_boot"))
    out = groups.join(bands, keys, "left")
    return out.select(*keys, "n", "days", F.col("point").alias("excess_cagr"), F.coalesce("low", "point").alias("low"), F.coalesce("high", "point").alias("high"),
                      F.coalesce("n_boot", F.lit(0)).alias("n_boot"))


def terminal_wealth(paths: DataFrame, keys: list[str], horizons: tuple[int, ...], block: int, reps: int, seed: str) -> DataFrame:
    """Bootstrap quantiles of wealth after each horizon; horizons are whole numbers of blocks."""
    w = W.partitionBy(*keys).orderBy("pos")
    logs = paths.withColumn("__l", F.ln(1.0 + F.col("r")))
    starts = logs.select(*keys, F.col("pos").alias("start"), F.sum("__l").over(w.rowsBetween(0, block - 1)).alias("g"))
    groups = paths.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= block + 5)
    plan = replicas(groups, keys, reps).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    draws = plan.withColumn("blk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("horizon") / block).cast("int") - 1)))
    label = F.concat_ws("-", F.lit(seed), F.col("horizon").cast("string"), F.col("rep").cast("string"))
    draws = draws.withColumn("start", F.conv(F.substring(F.md5(F.concat_ws("-", label, F.col("blk").cast("string"))), 1, 7), 16, 10).cast("bigint") % (F.col("n") - block + 1))
    ends = draws.join(starts, [*keys, "start"]).groupBy(*keys, "horizon", "rep").agg(F.exp(F.sum("g")).alias("wealth"))
    return ends.groupBy(*keys, "horizon").agg(*[F.percentile("wealth", q).alias(f"p{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)])
