"""Probability evaluation: reliability tables, Brier scores, deflated Sharpe, verdict inputs."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: Euler-Mascheroni constant of the expected-maximum approximation.
EULER = 0.5772156649015329


def reliability_bins(scored: DataFrame, p: str, y: str, n_bins: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed; empty bins stay in the table.

    Rows are reduced to one partial sum per bin before anything is shuffled; the bin dimension is a
    literal sequence of fixed length.
    """
    spark = scored.sparkSession
    bin_no = F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1))
    sums = scored.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("empirical_rate"))
    dim = spark.range(n_bins).select(F.col("id").alias("bin"), (F.col("id") / n_bins).alias("low"), ((F.col("id") + 1) / n_bins).alias("high"))
    return dim.join(sums, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted", "empirical_rate")


def brier_row(scored: DataFrame, p: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Brier score, clipped log loss, skill against the base rate: all from one pass of sums."""
    clipped = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    safe = F.least(F.greatest(clipped, F.lit(1e-6)), F.lit(1 - 1e-6))
    yy = F.col(y)
    sums = scored.filter(F.col(p).isNotNull() & yy.isNotNull()).groupBy(*keys).agg(
        F.avg(F.pow(clipped - yy, F.lit(2.0))).alias("brier"),
        (-F.avg(yy * F.ln(safe) + (1 - yy) * F.ln(1 - safe))).alias("log_loss"),
        F.avg(yy).alias("base_rate"), F.avg(yy * yy).alias("__y2"), F.count(F.lit(1)).alias("n"))
    reference = F.col("__y2") - F.col("base_rate") * F.col("base_rate")
    return sums.withColumn("skill", F.when(reference > 0, 1.0 - F.col("brier") / reference).otherwise(0.0)).drop("__y2")


def deflated_sharpe(df: DataFrame, excess: str, keys: list[str], n_trials: int | Column) -> DataFrame:
    """Per group: t, period Sharpe, corrected skewness and kurtosis, and the deflated z-score.

    Moments are mergeable sums, so groups of any size aggregate map-side first. `n_trials` is a number, or the
    expected maximum of as many scores as a trial log holds, as a column.
    """
    x = F.col(excess)
    m = df.filter(x.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("t"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.col("t").cast("double")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6.0) + 3.0
    m = m.withColumn("sharpe", F.when((n >= 3) & (F.col("sd") > 0), F.col("mean") / F.col("sd")).otherwise(0.0))
    m = m.withColumn("skew", F.coalesce(F.when(n >= 3, skew), F.lit(0.0))).withColumn("kurt", F.coalesce(F.when(n >= 4, kurt), F.lit(3.0)))
    sr = F.col("sharpe")
    factor = F.greatest(1.0 - F.col("skew") * sr + (F.col("kurt") - 1.0) / 4.0 * sr * sr, F.lit(1e-12))
    hurdle = F.sqrt(factor / (n - 1)) * (n_trials if isinstance(n_trials, Column) else F.lit(expected_maximum(n_trials)))
    z = (sr - hurdle) * F.sqrt(n - 1) / F.sqrt(factor)
    return m.withColumn("dsr_z", F.when(n >= 10, z)).drop("g1", "g2", "mean", "sd")


def expected_maximum(n_trials: int) -> float:
    """Expected largest of n standard normal scores; 0 for a single trial."""
    n = max(int(n_trials), 1)
    if n == 1:
        return 0.0
    normal = NormalDist()
    return (1 - EULER) * normal.inv_cdf(1 - 1 / n) + EULER * normal.inv_cdf(1 - 1 / (n * 2.718281828459045))


# Fixed value: the z-score whose normal probability is 0.95.
Z95 = 1.6448536269514722


def t_statistic(x: Column) -> dict[str, Column]:
    """Mean, t and n of a sample as aggregates; NULL below three rows, t NULL for zero spread."""
    n = F.count(x)
    sd = F.stddev_samp(x)
    return {
        "mean": F.when(n >= 3, F.avg(x)),
        "t": F.when((n >= 3) & (sd > 0), F.avg(x) / (sd / F.sqrt(n.cast("double")))),
        "n": n,
    }
