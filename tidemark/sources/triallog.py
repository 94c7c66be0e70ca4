"""An append-only log of model trials in the shared folder.

A run is named by what determines its trials: the version of the data and the configurations. Its rows are written to
a folder of their own and become visible by one commit file of the run, so a failed or repeated write never shows
half a run or counts one twice. Nothing is changed or removed; `history` shows all runs.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir
from tidemark.sources.publish import Files

TRIALS = "block int, family string, fold_start date, configuration string, loss double"
COMMITS = "run string, folder string, trials bigint"


def data_version(spark: SparkSession, paths: list[str]) -> str:
    """A digest of names, lengths and times of the files below the paths; their content is not read."""
    files = [spark.read.format("binaryFile").load(p).select("path", "length", "modificationTime") for p in paths]
    lines = reduce(DataFrame.unionByName, files).select(F.concat_ws(" ", "path", "length", F.unix_micros("modificationTime")).alias("line"))
    return lines.agg(F.md5(F.concat_ws("\n", F.sort_array(F.collect_list("line")))).alias("version")).first()["version"]


class TrialLog:
    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{checkpoint_dir(spark).rstrip('/')}/trial-log"

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).json(f"{self.path}/runs")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], COMMITS)

    def append(self, run: str, trials: DataFrame) -> None:
        """Writes the rows, then the run's commit, a file that can be created once: of jobs that fit the same run at a
        time the first counts, and the others' rows are removed."""
        folder = f"rows-{uuid.uuid4().hex}"
        trials.select(*[c.split()[0] for c in TRIALS.split(", ")]).write.parquet(f"{self.path}/{folder}")
        commit = json.dumps({"run": run, "folder": folder, "trials": self._rows(folder).count()})
        files = Files(self.spark, self.path)
        if not files.create(f"{self.path}/runs", f"{hashlib.sha256(run.encode()).hexdigest()}.json", commit):
            files.remove(f"{self.path}/{folder}")

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.schema(TRIALS).parquet(f"{self.path}/{folder}")

    def read(self, run: str) -> DataFrame | None:
        """The run's trials as first committed, or None."""
        found = self.commits().where(F.col("run") == run).agg(F.min("folder").alias("folder")).first()["folder"]
        return self._rows(found) if found else None

    def history(self) -> DataFrame:
        """All trials ever committed, with their run; a run committed twice shows once."""
        first = self.commits().groupBy("run").agg(F.min("folder").alias("folder")).collect()
        parts = [self._rows(r["folder"]).withColumn("run", F.lit(r["run"])) for r in first]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], TRIALS + ", run string"))
