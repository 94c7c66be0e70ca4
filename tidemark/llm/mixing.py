"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket. A source's target is met by taking all its documents as many whole
times as fit, and once more those whose hash lies below a threshold. The threshold is found on histograms: the
bucket in which the running sum passes what is left to take is refined by the next bits of the hash, the others
are settled. Nothing is sorted but histograms of at most 4096 buckets a source, and thresholds are nested: a larger
budget only adds documents.

Defined cases: NULL text has size 0; documents without source form the last source; rows of one id are taken
together; a source without words has target 0 and takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.text import text_batches, text_buffer, words
from tidemark.session import materialize

LEVELS, BITS = 5, 12
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2


def place(doc_id: str) -> Column:
    """60 bits of the id's MD5: the document's place on the threshold line."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def word_counts(docs: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    """All columns but the text, and the number of its words."""
    names = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text) + f", `{out}` bigint"

    def count(stream):
        for batch in stream:
            data, offsets = text_buffer(batch.column(text))
            n = np.bincount(words(data, offsets, hashed=False).row, minlength=batch.num_rows)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(n, pa.int64())], names=[*names, out])

    return text_batches(docs).mapInArrow(count, schema)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares by weight, capped at `most` times the source, the excess reshared.

    Taken in order of cap by weight, a source is capped while its cap is below its share of what is left; this is
    where repeated resharing ends. One row a source; the windows run over sources only.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most
    before = W.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    steps = ranked.select("source", "source_size", "w", cap.alias("cap"), (F.sum("source_size").over(whole) * share).alias("total"), F.sum("w").over(whole).alias("all_w"),
                          F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"))
    steps = steps.withColumn("capped", F.col("cap") * (F.col("all_w") - F.col("w_before")) < F.col("w") * (F.col("total") - F.col("cap_before")))
    level = steps.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0))).withColumn("left_w", F.sum(F.when(~F.col("capped"), F.col("w"))).over(whole))
    free = F.col("left") * F.col("w") / F.col("left_w")
    return level.select("source", "source_size", F.when(F.col("capped") | (free > F.col("cap")), F.col("cap").cast("double")).otherwise(free).alias("target"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of `docs`."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    rows = materialize(word_counts(rows).withColumn("place", place("doc_id")))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = goal.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    goal = materialize(goal.withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")))
    sized = goal.select("source", F.col("budget").alias("rest"), F.lit(0).cast("bigint").alias("threshold"))
    inside = rows.select("source", "place", "size")
    for level in range(LEVELS):
        low = (LEVELS - 1 - level) * BITS
        bucket = F.shiftright("place", low)
        bars = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        run = bars.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("bucket")))
        run = run.alias("b").join(sized.alias("s"), F.expr("b.source <=> s.source")).select("b.source", "bucket", "n", "upto", "rest")
        found = run.where("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", "upto", "n", "rest")).alias("x"))
        sized = materialize(found.select("source", F.col("x.bucket").alias("threshold"), (F.col("x.rest") - F.col("x.upto") + F.col("x.n")).alias("rest"), F.col("x.n").alias("at")))
        if level < LEVELS - 1:
            inside = materialize(inside.alias("r").join(sized.alias("s"), F.expr("r.source <=> s.source") & (F.shiftright("r.place", low) == F.col("s.threshold"))).select("r.source", "r.place", "r.size"))
    edge = goal.alias("g").join(sized.alias("s"), F.expr("g.source <=> s.source"), "left").select(
        "g.source", "source_size", "target", "times", F.coalesce("threshold", F.lit(1 << 60)).alias("threshold"), F.expr("at - rest <= rest").alias("with_edge"))
    extra = F.when((F.col("place") < F.col("threshold")) | ((F.col("place") == F.col("threshold")) & F.col("with_edge")), 1).otherwise(0)
    out = rows.alias("r").join(edge.alias("e"), F.expr("r.source <=> e.source")).withColumn("copies", F.when(F.col("source_size") > 0, F.col("times") + F.when(F.col("times") < most, extra).otherwise(0)).otherwise(0).cast("bigint"))
    return out.select("doc_id", "r.source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
