"""Cleaning of raw tabular exports: blank rows, duplicate keys, mixed row types, optional sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key by `order`, as a mergeable minimum: no key is sorted or collected."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def clean_daily(raw: DataFrame, date_text: str, order: list[str]) -> DataFrame:
    """Drop all-blank rows and rows whose date does not parse; keep the first row per date and entity."""
    values = [c for c in raw.columns if c not in order]
    parsed = raw.dropna(how="all", subset=values).withColumn("d", F.expr(f"try_to_date({date_text}, 'yyyy-MM-dd')")).filter(F.col("d").isNotNull())
    return first_per_key(parsed.drop(date_text), ["entity", "d"], order)


def period_text(raw: Column) -> Column:
    """Numeric-looking periods lose their trailing `.0` and blanks."""
    return F.regexp_replace(F.trim(raw), r"\.0$", "")


def split_periods(raw: DataFrame, kind: str, period: str) -> tuple[DataFrame, DataFrame]:
    """Monthly rows (`m`) and annual rows (`y`) of one mixed export, each with its own keys."""
    rows = raw.withColumn("__p", period_text(F.col(period)))
    monthly = rows.filter(F.col(kind) == "m").withColumn("month", F.concat_ws("-", F.substring("__p", 1, 4), F.substring("__p", 5, 2)))
    annual = rows.filter(F.col(kind) == "y").withColumn("year", F.expr("try_cast(substring(__p, 1, 4) AS INT)")).withColumn("period_end", F.col("__p")).withColumn(
        "is_partial", F.when(F.col("__p").endswith("12"), 0).otherwise(1))
    return monthly.drop("__p"), annual.drop("__p")


def sniff(columns: list[str], fragments: list[str]) -> str | None:
    """First column whose lower-cased name contains one of the fragments, in column order."""
    return next((c for c in columns if any(f in c.lower() for f in fragments)), None)


def read_optional(spark, path: str | None, schema: str, reader: str = "csv") -> DataFrame:
    """The table at `path`, or an empty frame of the same schema where nothing is there."""
    from pyspark.errors import AnalysisException

    if path is not None:
        try:
            options = {"header": "true"} if reader == "csv" else {}
            return spark.read.format(reader).options(**options).schema(schema).load(path)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
    return spark.createDataFrame([], schema)
