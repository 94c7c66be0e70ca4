"""Descriptive studies: event paths, window replays, style weights, data-quality rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.columns import r6
from tidemark.operators.windows import running


def event_paths(rows: DataFrame, keys: list[str], pre: int) -> DataFrame:
    """Cumulative return of each (event, entity) from -pre, and `k`, its number of known returns.

    The first offset counts as zero and a missing return leaves the path flat. A group is one event
    window, so its length is pre + post + 1.
    """
    w = W.partitionBy(*keys).orderBy("off")
    step = F.when(F.col("off") == -pre, 0.0).otherwise(F.coalesce("ret", F.lit(0.0)))
    return rows.withColumn("v", F.product(1.0 + step).over(running(w)) - 1.0).withColumn("k", F.count("ret").over(W.partitionBy(*keys)))


def path_quantiles(paths: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    return paths.groupBy(*keys).agg(
        r6(F.median(value)).alias("median"), r6(F.percentile(value, 0.25)).alias("q25"), r6(F.percentile(value, 0.75)).alias("q75"), F.count(F.lit(1)).alias("n"))


def on_windows(rows: DataFrame, windows: list[tuple]) -> DataFrame:
    """Rows once per named window covering their day; windows are literals of the plan."""
    dims = F.array(*[F.struct(F.lit(w[0]).alias("name"), F.lit(w[1]).cast("date").alias("a"), F.lit(w[2]).cast("date").alias("b")) for w in windows])
    hit = F.filter(dims, lambda x: (x["a"] <= F.col("d")) & (F.col("d") <= x["b"]))
    return rows.withColumn("__w", F.explode(hit)).select(F.col("__w.name").alias("name"), *rows.columns)


def window_stats(rows: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """n, total return, max drawdown and rows from trough to regained peak, per window and entity."""
    w = W.partitionBy(*keys).orderBy("d")
    run, whole = running(w), W.partitionBy(*keys)
    first = F.first(value).over(run)
    step = rows.withColumn("w", F.col(value) / first).withColumn("rn", F.row_number().over(w)).withColumn("peak", F.max(value).over(run))
    step = step.withColumn("dd", F.col(value) / F.col("peak") - 1.0).withColumn("peak_w", F.col("peak") / first)
    at = F.struct("dd", "rn")
    step = step.withColumn("worst", F.min("dd").over(whole)).withColumn("trough", F.min_by(F.struct("rn", "peak_w"), at).over(whole))
    back = F.when((F.col("worst") < 0) & (F.col("rn") >= F.col("trough.rn")) & (F.col("w") >= F.col("trough.peak_w") - 1e-12), F.col("rn") - F.col("trough.rn"))
    out = step.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), r6(F.max_by("w", "rn") - 1.0).alias("total_return"), r6(F.least(F.min("dd"), F.lit(0.0))).alias("max_dd"), F.min(back).cast("bigint").alias("recovery"))
    return out.filter("n >= 2")


def gram(rows: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    """Cross products of k series with each other and with a target: the only pass over the rows."""
    k = len(xs)
    products = [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"g{i}{j}") for i in range(k) for j in range(i, k)]
    targets = [F.sum(F.col(xs[i]) * F.col(y)).alias(f"b{i}") for i in range(k)]
    return rows.groupBy(*keys).agg(*products, *targets, F.count(F.lit(1)).alias("n"))


def style_weights(gram_df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, weights, n): non-negative least-squares weights per Gram row, rescaled to sum 1.

    The optimum is the feasible solution with the largest gain among the supports. A row is exploded over its 2^k - 1
    supports (k is small), each eliminates the pivots of its support in one fold over the augmented matrix, and the
    largest gain is a mergeable maximum. A support with a vanishing pivot has no solution, equal gains go to the smaller
    support number, and a row without a feasible support has zeros.
    """
    g = lambda i, j: F.col(f"g{min(i, j)}{max(i, j)}")
    augmented = F.array(*[F.array(*[g(i, j) for j in range(k)], F.col(f"b{i}")) for i in range(k)])
    supports = F.explode(F.sequence(F.lit(1), F.lit(2**k - 1))).alias("support")
    rows = gram_df.select(*keys, "n", augmented.alias("m"), supports)
    pivots = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda p: F.getbit("support", p) == 1)

    def eliminate(m: Column, p: Column) -> Column:
        """NULL cells where the pivot has vanished: no comparison with them holds."""
        pivot = F.get(F.get(m, p), p)
        usable = pivot > 1e-12 * F.get(F.get(F.col("m"), p), p)
        scaled = F.transform(F.get(m, p), lambda x: F.when(usable, x / pivot))
        return F.transform(m, lambda row, i: F.when(i == p, scaled).otherwise(F.zip_with(row, scaled, lambda x, y: x - F.get(row, p) * y)))

    solved = rows.withColumn("solved", F.aggregate(pivots, F.col("m"), eliminate))
    share = F.transform("solved", lambda row, i: F.when(F.getbit("support", i) == 1, F.get(row, F.lit(k))).otherwise(0.0))
    solved = solved.select(*keys, "n", "m", "support", share.alias("w"))
    gain = F.aggregate(F.zip_with("w", "m", lambda w, row: w * F.get(row, F.lit(k))), F.lit(0.0), lambda acc, x: acc + x)
    feasible = F.coalesce(F.forall("w", lambda x: x >= 0), F.lit(False)) & (gain > 0)
    best = solved.groupBy(*keys).agg(F.max_by("w", F.when(feasible, F.struct(gain, -F.col("support")))).alias("w"), F.max("n").alias("n"))
    total = F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x)
    weights = F.when(F.col("w").isNotNull(), F.transform("w", lambda x: F.round(x / total, 4))).otherwise(F.array_repeat(F.lit(0.0), k))
    return best.select(*keys, weights.alias("weights"), "n")


def quality_report(panel: DataFrame, dense: DataFrame, orders: DataFrame, pages: DataFrame, releases: DataFrame, newest: Column) -> DataFrame:
    """One row per check: (source, check_name, level, n)."""
    def row(df, source, name, level, expr):
        return df.agg(expr.cast("bigint").alias("n")).select(F.lit(source).alias("source"), F.lit(name).alias("check_name"), F.lit(level).alias("level"), "n")

    w = W.partitionBy("entity").orderBy("d")
    steps = panel.withColumn("dpx", F.col("px") - F.lag("px").over(w)).withColumn("gap", F.datediff("d", F.lag("d").over(w)))
    count_if = lambda c: F.count(F.when(c, 1))
    dup_panel = panel.groupBy("entity", "d").agg((F.count(F.lit(1)) - 1).alias("extra"))
    dup_orders = orders.groupBy("o_orderkey").agg((F.count(F.lit(1)) - 1).alias("extra"))
    span = F.months_between(F.max("month"), F.min("month")) + 1 - F.count(F.lit(1))
    parts = [
        row(dense, "panel", "empty price", "error", count_if(F.col("px").isNull())),
        row(panel, "panel", "non-positive price", "error", count_if(F.col("px") <= 0)),
        row(dup_panel, "panel", "duplicate key", "error", F.sum("extra")),
        row(steps, "panel", "baseline decreased", "error", count_if((F.col("ord") == 0) & (F.col("dpx") < -1e-9))),
        row(steps, "panel", "gap over 7 days", "warning", count_if(F.col("gap") > 7)),
        row(panel.withColumn("newest", newest), "panel", "stale days", "stat", F.datediff(F.max("newest"), F.max("d"))),
        row(dup_orders, "orders", "duplicate id", "error", F.sum("extra")),
        row(pages, "pages", "not https", "error", count_if(F.col("url").isNull() | ~F.startswith("url", F.lit("https://")))),
        row(releases, "releases", "missing months", "note", span),
        row(panel, "panel", "rows", "stat", F.count(F.lit(1))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
