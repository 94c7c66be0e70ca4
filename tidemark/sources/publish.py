"""Result sinks and the staged publish: write aside, validate, then move the pointer.

A publication is a folder of versions and a folder of pointer files. A version is written under a name of its own and is
never changed. It is served once a pointer file with the next number names it; that file is renamed into place only if
no file has the name, so of two publishers that read the same pointer one wins. The rename is exclusive where the file
system's is (HDFS; a local disk checks first). Readers take the largest number, in any session. A publisher that dies
leaves a version nobody names, which `remove_unserved` takes away later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "number bigint, folder string, rows bigint"


def write_documents(df: DataFrame, path: str, fields: list[str]) -> DataFrame:
    """Each row as one JSON document; written in parallel and read back with the same schema."""
    df.select(F.to_json(F.struct(*fields)).alias("value")).write.mode("overwrite").text(path)
    schema = df.select(*fields).schema
    return df.sparkSession.read.schema(schema).json(path)


class Files:
    """The few operations on names that the DataFrame API lacks, through the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.api = spark._jvm.org.apache.hadoop.fs
        self.gateway = spark.sparkContext._gateway
        self.system = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.api.FileContext.getFileContext(self.system.getUri(), spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.api.Path(name)

    def create(self, folder: str, name: str, text: str) -> bool:
        """Writes a whole file under a name that must be free; False if it is taken."""
        aside, target = self.path(f"{folder}/.{name}-{uuid.uuid4().hex}"), self.path(f"{folder}/{name}")
        stream = self.system.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.gateway.new_array(self.api.Options.Rename, 0)
        try:
            self.context.rename(self.system.makeQualified(aside), self.system.makeQualified(target), options)
            return True
        except Py4JJavaError as taken:
            self.system.delete(aside, False)
            if "FileAlreadyExistsException" not in taken.java_exception.getClass().getName():
                raise
            return False

    def folders(self, root: str) -> dict[str, int]:
        """Names of the folders below `root` with their time in milliseconds."""
        return {s.getPath().getName(): s.getModificationTime() for s in self.system.listStatus(self.path(root)) if s.isDirectory()}

    def remove(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """All pointers ever set below `root`; none where nothing was published."""
    try:
        return spark.read.schema(POINTER).json(f"{root.rstrip('/')}/pointer")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], POINTER)


def served(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(number, path) of the version to read, (0, None) before the first."""
    last = pointers(spark, root).agg(F.max("number").alias("number"), F.max_by("folder", "number").alias("folder")).first()
    return (last["number"], f"{root.rstrip('/')}/{last['folder']}") if last["number"] else (0, None)


def publish(df: DataFrame, root: str, checks: dict[str, Column], after: int | None = None,
            partition_by: tuple[str, ...] = (), validate: Callable[[DataFrame], list[str]] | None = None) -> tuple[str | None, list[str]]:
    """Write to a new folder below `root`, count failing rows per check, and move the pointer if there are none.

    Returns the path that is served afterwards and what failed: names of checks, what `validate` names, `empty`, or
    `superseded` if another publisher moved the pointer past `after` (by default the number read before the write) in
    the meantime. After a failure the pointer stays and the staged folder is removed. Only one count per check reaches
    the driver.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    files = Files(spark, root)
    seen = served(spark, root)[0] if after is None else after
    folder = f"v-{uuid.uuid4().hex}"
    staged = f"{root}/{folder}"
    df.write.partitionBy(*partition_by).parquet(staged)
    written = read_version(spark, staged, df.schema)
    row = written.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(name) for name, c in checks.items()]).first()
    failed = [name for name in checks if row[name] > 0] + (validate(written) if validate else [])
    if row["__rows"] == 0:
        failed.append("empty")
    if not failed and not files.create(f"{root}/pointer", f"{seen + 1:012d}.json", json.dumps({"number": seen + 1, "folder": folder, "rows": row["__rows"]})):
        failed.append("superseded")
    if failed:
        files.remove(staged)
    return served(spark, root)[1], failed


def remove_unserved(spark: SparkSession, root: str, keep: int = 2, idle_seconds: float = 7 * 86400.0) -> list[str]:
    """Removes version folders that are not among the last `keep` pointers and were last written `idle_seconds` ago or
    earlier, and returns their names. The wait spares running publishers and readers of a version just superseded."""
    root = root.rstrip("/")
    files = Files(spark, root)
    spared = {r["folder"] for r in pointers(spark, root).orderBy(F.desc("number")).limit(keep).collect()}
    now = spark.range(1).select(F.unix_millis(F.current_timestamp()).alias("t")).first()["t"]
    gone = sorted(name for name, at in files.folders(root).items() if name.startswith("v-") and name not in spared and now - at >= idle_seconds * 1000)
    for name in gone:
        files.remove(f"{root}/{name}")
    return gone


def read_version(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
