"""Registration, and the stages one after the other on messy rows."""

import __spark_entry__ as entry_module
import corpus_pipeline as pipeline
from tools.check_oracle import compare

import pytest
from pyspark.sql import functions as F

NAMES = ["op1_curve_packing", "op2_ngram_jaccard", "op3_substring_dedup", "op4_exact_dedup", "op5_quality_classifier", "op6_perplexity_rules", "op7_language_id", "op8_toxicity", "op9_mixing", "op10_warc", "op11_chat_format", "op12_hard_negatives", "op13_fill_in_middle", "pipeline"]


def test_all_are_registered():
    assert set(NAMES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry_module.oracle_sql()])
def test_matches_duckdb(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql()[name], sf_dir)
    assert ok, note


def test_stages_decide_over_what_is_left(spark, messy, nothing, sf_dir):
    from tidemark.session import materialize

    docs = messy.select("doc_id", "text", "lang", "source", "n_chars", "size", "row")
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir))
        assert after.columns == docs.columns
        seen[name] = docs.collect(), after.collect()
        docs = after
    before, after = seen["language"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} >= {1, 2, 3, 9}
    before, after = seen["exact"]
    largest = {}
    for r in before:
        largest[r["text"]] = max(largest.get(r["text"], -10**9), -10**8 if r["doc_id"] is None else r["doc_id"])
    assert {(r["text"]) for r in after} == set(largest) and all((-10**8 if r["doc_id"] is None else r["doc_id"]) == largest[r["text"]] for r in after)
    before, after = seen["near"]
    ids = [r["doc_id"] for r in after if r["doc_id"] is not None]
    assert 30 <= min(i for i in ids if 30 <= i < 42) and len([i for i in ids if 30 <= i < 42]) < 12
    before, after = seen["mixture"]
    assert len(after) >= len({r["doc_id"] for r in after})
    pieces = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sum(r["start"] == 0 for r in pieces) == docs.count()
    empty = nothing.select(*docs.columns)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run_gives_pieces(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0


def test_stages_keep_foreign_columns_of_any_name(spark, messy, sf_dir):
    """Names that stages use inside, with dots, and quoted ones come back with their values."""
    names = ["gone_id", "gone_probe", "own_probe", "time", "mix_id", "mix_source", "copies", "row", "lang_pred", "score", "a.b", "x `y`", "held_out", "component_id", "_0_"]
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars", *[(F.xxhash64("doc_id", "text") + i).alias(f"c{i}") for i in range(len(names))]).toDF("doc_id", "text", "lang", "source", "n_chars", *names)
    docs = docs.select("*", F.struct(F.col("doc_id").alias("in.side"), F.lit(1).alias("x y")).alias("nested"))
    given = {(r[0], r[1]): tuple(r)[4:] for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(tuple(r)[4:] == given[r[0], r[1]] for r in rows), name
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
