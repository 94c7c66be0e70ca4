"""Session defaults and the two ways this package touches physical execution."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the queries rely on; cluster-supplied values win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; where none is named, a folder in the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidemark"


def materialize(df: DataFrame) -> DataFrame:
    """A derived table that a plan reads more than once, written to the shared folder and read back.

    The written files survive a lost executor, cut the lineage, and give Catalyst real sizes, so joins
    against small derived tables are planned as broadcasts within the automatic threshold.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def written(df: DataFrame) -> str:
    """The path of a table written to the shared folder, for those who read it more than once under their own column ids."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys into the session's full partition count.

    For few small rows with costly work per row or group: adaptive coalescing would put all groups
    into one task, an explicit count keeps them apart. A following groupBy on these keys reuses it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, *keys)
