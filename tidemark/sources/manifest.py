"""Manifest audit and restat over a folder of files, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, digest): the first 16 hex digits of each file's SHA-256, computed where the file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    relative = F.regexp_replace("path", ".*" + folder.rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(relative.alias("path"), F.substring(F.sha2("content", 256), 1, 16).alias("digest"))


def tree_digests(spark: SparkSession, folder: str, pattern: str = "*", leaf: int = 8 << 20, leaves: int = 16) -> DataFrame:
    """(path, bytes, ranges, digest) of files of any size, hashed in parallel ranges.

    A file is cut into ranges of `leaves` leaves of `leaf` bytes. A range's digest is the SHA-256 of its leaves' SHA-256
    digests, and the file's that of its length and its ranges' digests in order, 32 bytes each. Ranges are spread over
    tasks, a task holds one leaf, and how they are dealt does not matter; the two sizes do and belong to the manifest.
    Spark's file scan leaves out empty files, so an empty file counts as missing. The folder must be of a kind that pyarrow's file systems open.
    """
    size = leaf * leaves
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))
    ranges = files.select("path", "length", F.explode(starts).alias("start"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def hashed(batches):
        import hashlib
        import re

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            digests = []
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                system, name = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
                whole = hashlib.sha256()
                with system.open_input_file(name) as source:
                    source.seek(start)
                    for _ in range(leaves):
                        whole.update(hashlib.sha256(source.read(leaf)).digest())
                        if source.tell() >= source.size():
                            break
                digests.append(whole.digest())
            yield pa.RecordBatch.from_arrays([batch["path"], batch["length"], batch["start"], pa.array(digests, pa.binary())], names=["path", "length", "start", "part"])

    parts = ranges.repartition(tasks, "path", "start").mapInArrow(hashed, "path string, length bigint, start bigint, part binary")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("start", F.hex("part").alias("h")))), lambda x: x["h"])
    root = F.sha2(F.concat_ws(" ", F.col("length"), F.array_join(ordered, "")), 256)
    relative = F.regexp_replace("path", ".*" + folder.rstrip("/").replace(".", r"\.") + "/", "")
    return parts.groupBy("path", "length").agg(F.count(F.lit(1)).alias("ranges"), root.alias("digest")).select(relative.alias("path"), F.col("length").alias("bytes"), "ranges", "digest")


def audit(manifest: DataFrame, found: DataFrame, required: DataFrame) -> DataFrame:
    """(path, status): present, mismatched, optional missing or required missing.

    Required paths are checked against what was found and not against the manifest, so a manifest
    that forgot one cannot hide it.
    """
    listed = manifest.select("path", F.col("digest").alias("expected"), F.lit(1).alias("listed"))
    need = required.select("path", F.lit(1).alias("required"))
    all_rows = listed.join(found.select("path", "digest"), "path", "full").join(need, "path", "full")
    gone = F.col("digest").isNull()
    status = (
        F.when(gone & (F.col("required") == 1), "required missing").when(gone & (F.col("listed") == 1), "optional missing")
        .when(F.col("listed").isNull(), "unlisted").when(F.col("digest") != F.col("expected"), "mismatched").otherwise("present"))
    return all_rows.select("path", status.alias("status"))


def passes(audit_rows: DataFrame) -> DataFrame:
    """One row: may the data be used?"""
    bad = F.count(F.when(F.col("status").isin("required missing", "mismatched"), 1))
    return audit_rows.agg((bad == 0).alias("ok"))


def restat(df: DataFrame, name: str, key: Column, content: Column) -> DataFrame:
    """(path, n_rows, n_cols, first_key, last_key, digest): an order-free digest of the rows.

    The digest adds per-row hashes as decimals, so partitions are summed independently, row order is free and no
    number of rows overflows it.
    """
    row_hash = F.conv(F.substring(F.md5(content), 1, 8), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).cast("string").alias("first_key"), F.max(key).cast("string").alias("last_key"), F.sum(row_hash).cast("string").alias("digest")).select(
        F.lit(name).alias("path"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"), "first_key", "last_key", "digest")
