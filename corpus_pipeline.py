"""A training-data pipeline over `documents`: language, exact copies, near copies, mixture, packing.

Every stage reads what the one before it wrote, decides over all of it, and returns the rows that stay with the
columns of `documents`; the last returns the pieces of the packed sequences. Stages write light decisions and join
them back; rows without id pass the stages that compare documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exact import exact_groups
from tidemark.llm.jaccard import similar_groups
from tidemark.llm.language import UNKNOWN, identify
from tidemark.llm.mixing import mixed
from tidemark.llm.packing import packed_sequences
from tidemark.llm.queries import tokenizer_path
from tidemark.session import materialize

LEAST_SHARE = 0.5
USED = ("doc_id", "text", "lang", "source")


def whole_rows(stage):
    """A stage that returns rows of `docs`: foreign columns pass under numbered names, whatever their own are."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        numbered = docs.toDF(*[name if name in USED else f"_{i}_" for i, name in enumerate(docs.columns)])
        return stage(spark, numbered, sf_dir).toDF(*docs.columns)
    return run


@whole_rows
def in_one_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go, and those of which no language makes up half."""
    found = identify(docs, carry=True)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("row.*")


@whole_rows
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    gone = exact_groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("probe").alias("gone_probe")).distinct()
    keyed = docs.withColumn("own_probe", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return keyed.join(gone, F.expr("doc_id <=> gone_id AND own_probe = gone_probe"), "left_anti").select(*docs.columns)


@whole_rows
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    gone = similar_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@whole_rows
def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays as many times as the mix takes it."""
    copies = mixed(docs).where("copies > 0").select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), "copies").distinct()
    taken = docs.alias("d").join(copies.alias("m"), F.expr("d.doc_id <=> m.mix_id AND d.source <=> m.mix_source"))
    return taken.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("m.copies").cast("int")))).select(*[F.col(f"d.`{c}`") for c in docs.columns])


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_sequences(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("language", in_one_language),
    ("exact", without_copies),
    ("near", without_near_copies),
    ("mixture", to_weights),
    ("packing", into_sequences),
]

# SQL has no form for language ID, the curve and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
