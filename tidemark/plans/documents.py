"""The products of a run as one published set of documents."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.base import ORACLES, QUERIES, query
from tidemark.plans.experiments import logged_trials
from tidemark.session import checkpoint_dir
from tidemark.sources import documents as dc
from tidemark.sources import tables as src

# Fixed values: (document, part): the query that fills it and its fields.
SOURCES = {
    ("meta", "tables"): ("manifest_restat", "path string, n_rows bigint, n_cols bigint, first_key string, last_key string, digest string"),
    ("today", "signal"): ("latest_signal", "d date, pick bigint, probability double, stance string, regime string, n_drivers bigint"),
    ("today", "cost"): ("cost_of_wrong", "entity string, n_wrong bigint, mean double, median double, q10 double, dollars double"),
    ("today", "missed"): ("missed_best_days", "entity string, k bigint, missed bigint, missed_sum double, near bigint"),
    ("today", "fan"): ("fan_chart", "entity string, horizon bigint, p10 double, p25 double, p50 double, p75 double, p90 double"),
    ("today", "scarcity"): ("scarcity_bound", "entity string, worst_sessions bigint, limited bigint"),
    ("scoreboard", "rows"): ("scoreboard", "strategy string, kind string, cagr double, max_drawdown double, vol double, n_compared bigint, n_below bigint, n_beat bigint"),
    ("scoreboard", "versus"): ("scoreboard_compare", "strategy string, baseline string, excess_cagr double, low double, high double, dsr_z double, verdict string, below bigint, sentence string"),
    ("calibration", "reliability"): ("reliability", "bin bigint, low double, high double, n bigint, mean_predicted double, empirical_rate double"),
    ("calibration", "brier"): ("multiclass_brier", "label string, brier double, n bigint"),
    ("history", "replay"): ("replay_table", "d date, pick bigint, probability double, driver string, contribution double, h21 double, h63 double, h126 double, h252 double"),
    ("history", "regime"): ("regime_streak", "regime string, last_d date, sessions bigint"),
    ("history", "regimes"): ("regime_hit_rate", "regime string, strategy string, n bigint, rate double"),
    ("history", "events"): ("event_study", "category string, entity string, off bigint, median double, q25 double, q75 double, n bigint"),
    ("history", "spikes"): ("spike_study", "entity string, off bigint, median double, n bigint"),
    ("history", "seasonality"): ("seasonality_cells", "entity string, month bigint, mean double, t double, n bigint"),
    ("stress", "windows"): ("stress_windows", "name string, cad string, entity string, n bigint, total_return double, max_dd double, recovery bigint"),
    ("stress", "style"): ("style_weights", "target string, w0 double, w1 double, w2 double, w3 double, w4 double, n bigint"),
    ("trials", "counts"): ("trial_count", "block bigint, family string, trials bigint"),
    ("features", "registry"): ("feature_registry", "name string, in_model bigint, n_known bigint"),
    ("curves", "views"): ("curve_views", "cadence string, lag bigint, block bigint, h bigint, entity string, month date, wealth double"),
    ("monthly-history", "entities"): ("monthly_history", "entity string, n_months bigint, first_in_window date, first_available date, missing bigint, compounded_pct double, returns string, wealth string, missing_months string"),
    ("returns", "days"): ("returns_export", "d date, r0 double, r1 double, r2 double, r3 double, r4 double"),
    ("calendar", "sessions"): ("trading_calendar", "d date, is_projected bigint, pos bigint"),
    ("alert", "changes"): ("signal_change", "account bigint, previous string, current string, message string"),
}
PARTS = {key: schema for key, (_, schema) in SOURCES.items()}
# What short or quiet data need not have.
OPTIONAL = {("history", "events"), ("history", "spikes"), ("history", "replay"), ("today", "signal"), ("alert", "changes"), ("stress", "style"), ("history", "regimes")}


def content(name: str, kind: str, engine: str) -> tuple[str, str] | None:
    """(what it adds to, expression): numbers as exact decimals, dates as days, texts by their length."""
    if kind in ("bigint", "double"):
        return "numbers", f"coalesce(CAST({name} AS decimal(28, 6)), 0)"
    if kind == "date":
        return "days", f"coalesce({f'datediff({name}, DATE {chr(39)}1970-01-01{chr(39)})' if engine == 'spark' else f'date_diff({chr(39)}day{chr(39)}, DATE {chr(39)}1970-01-01{chr(39)}, {name})'}, 0)"
    return "letters", f"coalesce(length({name}), 0)"


def totals(schema: str, engine: str) -> dict[str, str]:
    """Aggregates over a part: rows, known fields, and the sums of its numbers, days and letters."""
    sums: dict[str, list[str]] = {"numbers": ["0"], "days": ["0"], "letters": ["0"]}
    for name, kind in dc.fields(schema):
        where, expression = content(name, kind, engine)
        sums[where].append(expression)
    known = " + ".join(f"CAST({name} IS NOT NULL AS int)" for name, _ in dc.fields(schema))
    out = {"n_rows": "count(*)", "n_known": f"coalesce(sum({known}), 0)", **{k: f"coalesce(sum({' + '.join(v)}), 0)" for k, v in sums.items()}}
    return {k: f"CAST({v} AS {'double' if k == 'numbers' else 'bigint'})" for k, v in out.items()}


def _part_sql(document: str, part: str) -> str:
    name, schema = SOURCES[document, part]
    return f"SELECT '{document}' AS document, '{part}' AS part, {', '.join(f'{e} AS {k}' for k, e in totals(schema, 'duck').items())} FROM ({ORACLES[name]}) HAVING count(*) > 0"


def all_rows(spark, sf_dir, sources=SOURCES) -> DataFrame:
    """The rows of every part; the plans are built side by side, as some of them write tables on the way.

    The panel and the order cube, which most parts read, are written once for all. The trial log is filled first, so
    that the parts that read it find it.
    """
    with src.shared(spark, sf_dir), ThreadPoolExecutor(4) as pool:
        logged_trials(spark, sf_dir)
        built = [pool.submit(copy_context().run, QUERIES[name], spark, sf_dir) for name, _ in sources.values()]
        tables = dict(zip(sources, (b.result() for b in built)))
    return reduce(DataFrame.unionByName, [dc.part_rows(tables[key], *key, schema) for key, (_, schema) in sources.items()])


@query("document_set", " UNION ALL ".join(f"({_part_sql(*key)})" for key in SOURCES))
def document_set(spark, sf_dir):
    """All documents published as one version and read back by part: rows, known fields, and sums over their content."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    path, failed = dc.publish_documents(all_rows(spark, sf_dir), root, PARTS, OPTIONAL)
    if failed:
        raise RuntimeError(f"documents not published: {failed}")
    read = [dc.read_part(spark, path, *key, schema).agg(*[F.expr(e).alias(k) for k, e in totals(schema, "spark").items()]).select(F.lit(key[0]).alias("document"), F.lit(key[1]).alias("part"), "*")
            for key, schema in PARTS.items()]
    return reduce(DataFrame.unionByName, read).where("n_rows > 0")
