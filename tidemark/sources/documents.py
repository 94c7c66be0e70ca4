"""Result documents: every product as JSON lines, all of them written and made visible together.

A document has named parts; a part is a table whose fields and types are declared. Rows of all parts are one table
(document, part, body) partitioned by document and published as one version, so a reader never sees the board of one
run beside the signal of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import publish as pb

ROWS = "part string, body string, document string"
Parts = dict[tuple[str, str], str]


def fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.strip().split(" ", 1)) for f in schema.split(",")]


def part_rows(df: DataFrame, document: str, part: str, schema: str) -> DataFrame:
    """One JSON body a row; NULL fields are written, so that a body always shows the whole schema."""
    columns = [F.col(name).cast(kind).alias(name) for name, kind in fields(schema)]
    return df.select(F.lit(part).alias("part"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("body"), F.lit(document).alias("document"))


def incomplete(parts: Parts, optional: set[tuple[str, str]] = frozenset()):
    """A validation that names what is missing: a part without rows, and a part with a body that does not show its fields."""
    def validate(written: DataFrame) -> list[str]:
        whole = F.lit(False)
        for (document, part), schema in parts.items():
            shown = F.json_object_keys("body") == F.array(*[F.lit(name) for name, _ in fields(schema)])
            whole = F.when((F.col("document") == document) & (F.col("part") == part), F.coalesce(shown, F.lit(False))).otherwise(whole)
        found = {(r["document"], r["part"]): r["bad"] for r in written.groupBy("document", "part").agg(F.count(F.when(~whole, 1)).alias("bad")).collect()}
        missing = [f"missing {d}/{p}" for d, p in parts if (d, p) not in found and (d, p) not in optional]
        return missing + [f"unreadable {d}/{p}" for (d, p), bad in sorted(found.items()) if bad]
    return validate


def publish_documents(rows: DataFrame, root: str, parts: Parts, optional: set[tuple[str, str]] = frozenset()) -> tuple[str | None, list[str]]:
    """All documents as one version below `root`; a missing or unreadable part keeps the version before."""
    ordered = rows.select(*[name for name, _ in fields(ROWS)])
    return pb.publish(ordered, root, {"body": F.col("body").isNotNull()}, partition_by=("document",), validate=incomplete(parts, optional))


def read_part(spark: SparkSession, path: str, document: str, part: str, schema: str) -> DataFrame:
    """A part of a published document as a table: only the document's folder is read."""
    rows = pb.read_version(spark, path, ROWS).where((F.col("document") == document) & (F.col("part") == part))
    return rows.select(F.from_json("body", schema).alias("x")).select("x.*")
