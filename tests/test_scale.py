"""Plans: the large-dimension branch, map-side top-k, pruned scans, no collected or paired hot groups."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import tables as src


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_without_broadcast_is_the_same(spark, sf_dir):
    small = {(r["entity"], r["d"]): r["px"] for r in src.panel(spark, sf_dir).collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = src.panel(spark, sf_dir)
        text = plan(big)
        assert "BroadcastExchange" not in text
        # the fact table is summed by (key, day) before it meets the dimension
        assert text.count("partial_sum") >= 2
        assert {(r["entity"], r["d"]): r["px"] for r in big.collect()} == pytest.approx(small)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_panel_scan_reads_only_its_columns(spark, sf_dir):
    scans = [line for line in plan(src.panel(spark, sf_dir)).splitlines() if "lineitem" in line]
    assert scans and all("l_discount" not in line and "l_comment" not in line for line in scans)


def test_event_calendar_sums_days_before_the_shuffle(spark, sf_dir):
    text = plan(src.event_calendar(spark, sf_dir))
    assert "partial_sum" in text and text.rindex("Window") < text.index("partial_sum"), "windows see daily rows only"


def test_no_cartesian_products(spark, sf_dir):
    import __spark_entry__ as entry_module

    for name in ("experiment_grid", "bin_lookup", "nearest_option", "interval_flag", "event_window_join", "proximity_semi", "rule_versus_hold", "block_bootstrap"):
        text = plan(entry_module.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_materialized_tables_use_the_named_folder(spark, sf_dir):
    from tidemark.session import materialize

    df = materialize(src.table(spark, sf_dir, "nation").filter(F.col("n_nationkey") < 5))
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]


def test_queries_of_a_document_set_share_one_panel(spark, sf_dir, monkeypatch):
    from tidemark.plans import load_all
    from tidemark.plans.base import QUERIES
    from tidemark.sources import tables as src

    load_all()
    names = ["returns_export", "scan_panel", "missed_best_days"]
    apart = [sorted(map(str, QUERIES[n](spark, sf_dir).collect())) for n in names]
    priced, calls = src.priced, []
    monkeypatch.setattr(src, "priced", lambda *a: calls.append(a) or priced(*a))
    with src.shared(spark, sf_dir):
        together = [sorted(map(str, QUERIES[n](spark, sf_dir).collect())) for n in names]
    assert together == apart and len(calls) == 1
    QUERIES["scan_panel"](spark, sf_dir)
    assert len(calls) == 2
