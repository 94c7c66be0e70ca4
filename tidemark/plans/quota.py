"""Quota queries over the request table, batch and stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.columns import big
from tidemark.operators import quota as qt
from tidemark.plans.base import duck, query
from tidemark.plans.calendars import POSTED, posted_rows
from tidemark.session import checkpoint_dir
from tidemark.sources import tables as src

# Targets in component order, the safe one first.
TARGETS = ["view", "click", "error", "purchase", "signup"]
MIXES = qt.one_hot_mixes(len(TARGETS))
# Bytes of files a micro-batch takes.
BATCH_BYTES = 64 << 20


def target_number(target):
    return (F.array_position(F.array(*[F.lit(t) for t in TARGETS]), target) - 1).cast("int")


def stamped(spark, sf_dir):
    """Requests with posting month and target number."""
    return numbered(src.requests(spark, sf_dir))


def numbered(requests):
    rows = posted_rows(requests)
    return rows.select("account", F.trunc("post_d", "MM").alias("month"), "ts", "req_id", "target", target_number(F.col("target")).alias("target_no"))


GATE_SQL = """rq AS (SELECT account, req_id, ts, coalesce(list_position(['view', 'click', 'error', 'purchase', 'signup'], target), 0) - 1 AS x, date_trunc('month', post_d)::DATE AS month,
   row_number() OVER (PARTITION BY account ORDER BY ts, req_id) AS rn FROM posted),
gate AS (
  SELECT account, 0::BIGINT AS rn, NULL::BIGINT AS req_id, NULL::DATE AS month, 0 AS held, 0 AS used, 0 AS x, 0 AS accepted, '' AS reason FROM (SELECT DISTINCT account FROM rq)
  UNION ALL
  SELECT account, rn, req_id, month, CASE WHEN ok THEN x ELSE held END, CASE WHEN ok THEN least(u + 1, 2) ELSE u END, x, ok::INTEGER,
     CASE WHEN ok THEN CASE WHEN u < 2 THEN 'posted' ELSE 'posted safe-only' END WHEN x < 0 THEN 'invalid target' WHEN x = held THEN 'no change' ELSE 'monthly limit' END FROM (
    SELECT r.account, r.rn, r.req_id, r.month, r.x, g.held, CASE WHEN g.month = r.month THEN g.used ELSE 0 END AS u,
      r.x >= 0 AND r.x <> g.held AND (CASE WHEN g.month = r.month THEN g.used ELSE 0 END < 2 OR r.x = 0) AS ok
    FROM gate g JOIN rq r ON r.account = g.account AND r.rn = g.rn + 1))"""
DECISIONS = duck("SELECT account, req_id, month, nullif(x, -1)::BIGINT AS target_no, accepted::BIGINT AS accepted, reason, used::BIGINT AS used, held::BIGINT AS held_no FROM gate WHERE rn > 0", *POSTED, GATE_SQL)


def shown(decisions):
    return decisions.select("account", "req_id", "month", *[big(F.col(c)).alias(c) for c in ("target_no", "accepted", "used", "held_no")], "reason")


@query("quota_gate", DECISIONS)
def quota_gate(spark, sf_dir):
    return shown(qt.gate(stamped(spark, sf_dir), MIXES, F.to_date("ts"), F.date_trunc("minute", "ts")))


@query("quota_gate_stream", DECISIONS)
def quota_gate_stream(spark, sf_dir):
    """The same gate fed by a file stream, one micro-batch after the other, with the calendar of each batch's own days."""
    from tidemark.streaming.quota_stream import gate_batches

    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return shown(gate_batches(streamed_requests(spark, sf_dir), numbered, MIXES, root))


def streamed_requests(spark, sf_dir):
    """Requests as a file stream over the event table, one file or a folder of part files.

    The byte limit bounds a micro-batch, and with it the rows one account can bring to a task at once.
    """
    raw = spark.readStream.schema(src.SCHEMAS["events"]).option("maxBytesPerTrigger", str(BATCH_BYTES)).parquet(f"{sf_dir}/events.parquet*")
    return raw.select(F.col("user_id").alias("account"), F.col("event_id").alias("req_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("target"))


@query("signal_change_stream", duck(
    """SELECT account, req_id, lag(target) OVER w AS previous, target AS current,
         CASE WHEN lag(target) OVER w IS NULL THEN 'first signal' WHEN lag(target) OVER w = target THEN 'unchanged' ELSE 'flipped' END AS kind FROM req WINDOW w AS (PARTITION BY account ORDER BY ts, req_id)"""))
def signal_change_stream(spark, sf_dir):
    from tidemark.streaming.quota_stream import STATE_PROVIDER, change_stream, drain

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    drain(change_stream(streamed_requests(spark, sf_dir)), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("account", "req_id", "previous", "current", "kind")


@query("quota_usage", duck("SELECT account, date_trunc('month', post_d)::DATE AS month, count(*)::BIGINT AS requests, count(DISTINCT target)::BIGINT AS targets FROM posted GROUP BY 1, 2", *POSTED))
def quota_usage(spark, sf_dir):
    """Requests per account and posting month; targets are counted in two steps, so a hot account stays map-side."""
    per_target = stamped(spark, sf_dir).groupBy("account", "month", "target").agg(F.count(F.lit(1)).alias("n"))
    return per_target.groupBy("account", "month").agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("targets"))


@query("quota_meter", duck(
    """SELECT account, max(month) AS month, arg_max(used, rn)::BIGINT AS used, (2 - arg_max(used, rn))::BIGINT AS remaining, sum(accepted) FILTER (month = (SELECT max(month) FROM gate m WHERE m.account = g.account))::BIGINT AS accepted
       FROM gate g WHERE rn > 0 GROUP BY account""", *POSTED, GATE_SQL))
def quota_meter(spark, sf_dir):
    """Changes used and left in each account's last posting month, from the chunk maps; nothing is replayed."""
    last = qt.meter(stamped(spark, sf_dir), MIXES, F.to_date("ts"), F.date_trunc("minute", "ts"))
    return last.select("account", "month", big(F.col("used")).alias("used"), big(2 - F.col("used")).alias("remaining"), big(F.col("accepted")).alias("accepted"))
