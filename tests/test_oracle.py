"""Registered queries against their DuckDB statements; TIDEMARK_FULL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry_module
from tools.check_oracle import compare

DEFAULT = """scan_panel clean_raw_daily manifest_audit staged_publish sink_roundtrip coerce_numeric validate_weights safe_only_move slice_rebase signal_change
holiday_calendar trading_calendar next_prev_session posting_date calendar_window asof_backward asof_backward_keyed asof_forward_keyed asof_with_fallback reconcile
event_window_join active_window_flag proximity_semi bin_lookup whipsaws nearest_option momentum rows_since_peak sma_flags expanding_pct_rank run_length compound_break
forward_label lagged_activation missed_best_days dedupe_keep missing_months metric_summary seasonality_splits event_study stress_windows reliability brier_skill
deflated_sharpe style_gram monthly_history quality_report block_bootstrap fan_chart portfolio_returns rule_versus_hold rebalanced_mix target_path
feature_frame_daily feature_frame_monthly quota_gate quota_gate_stream signal_change_stream quota_usage fold_plan fold_scaler policy_over_folds explain_contrib trial_count""".split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("TIDEMARK_FULL") else DEFAULT


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
