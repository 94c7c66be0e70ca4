"""Scan, cleaning, audit and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.columns import big, keep_existing, normalize_headers, r6
from tidemark.operators import windows as op
from tidemark.plans.base import duck, query, rd
from tidemark.session import checkpoint_dir, materialize
from tidemark.sources import cleaning as cl
from tidemark.sources import manifest as mf
from tidemark.sources import publish as pb
from tidemark.sources import tables as src


@query("scan_panel", duck("SELECT entity, d, px FROM panel"))
def scan_panel(spark, sf_dir):
    return src.panel(spark, sf_dir).select("entity", "d", "px")


@query("clean_raw_daily", duck(
    """SELECT entity, d, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(v, (ts, event_id)) AS v FROM (
         SELECT event_type AS entity, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS DATE) AS d, event_id, ts, value AS v FROM events) WHERE d IS NOT NULL GROUP BY 1, 2"""))
def clean_raw_daily(spark, sf_dir):
    """A raw export with unreadable dates: parse, drop, keep the first row per entity and day."""
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    raw = src.table(spark, sf_dir, "events").select(F.col("event_type").alias("entity"), text.alias("date_text"), "ts", "event_id", F.col("value").alias("v"))
    return cl.clean_daily(raw, "date_text", ["ts", "event_id"]).select("entity", "d", "event_id", "v")


@query("split_period_rows", duck(
    """SELECT 'm' AS kind, substr(p, 1, 4) || '-' || substr(p, 5, 2) AS period, NULL::BIGINT AS is_partial, count(*)::BIGINT AS n FROM ex WHERE type = 'm' GROUP BY ALL
       UNION ALL SELECT 'y', TRY_CAST(substr(p, 1, 4) AS INTEGER)::VARCHAR, (NOT ends_with(p, '12'))::INTEGER::BIGINT, count(*)::BIGINT FROM ex WHERE type = 'y' GROUP BY ALL""",
    """ex AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'y' WHEN o_orderkey % 3 = 1 THEN 'm' ELSE 'x' END AS type, regexp_replace(trim(' ' || strftime(o_orderdate, '%Y%m') || '.0 '), '\\.0$', '') AS p FROM orders)"""))
def split_period_rows(spark, sf_dir):
    """One mixed export split into monthly and annual rows; other row types are ignored."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "y").when(F.col("o_orderkey") % 3 == 1, "m").otherwise("x")
    raw = src.table(spark, sf_dir, "orders").select(kind.alias("type"), F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyyMM"), F.lit(".0 ")).alias("Year"))
    monthly, annual = cl.split_periods(raw, "type", "Year")
    m = monthly.groupBy(F.lit("m").alias("kind"), F.col("month").alias("period")).agg(F.count(F.lit(1)).alias("n")).withColumn("is_partial", F.lit(None).cast("bigint"))
    y = annual.groupBy(F.lit("y").alias("kind"), F.col("year").cast("string").alias("period"), big(F.col("is_partial")).alias("is_partial")).agg(F.count(F.lit(1)).alias("n"))
    return m.unionByName(y)


@query("normalize_headers", duck('SELECT c_custkey AS "key id", c_mktsegment AS "mkt segment", c_acctbal AS balance FROM customer'))
def normalize_headers_query(spark, sf_dir):
    """Headers with stray blanks cleaned; columns the file lacks are skipped."""
    raw = src.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("  key   id"), F.col("c_mktsegment").alias("mkt  segment "), F.col("c_acctbal").alias(" balance "))
    return keep_existing(normalize_headers(raw), ["key id", "mkt segment", "balance", "region name"])


@query("optional_source_fallback", duck("SELECT s.d, coalesce(q.quote, r.effr) AS level, (q.quote IS NOT NULL)::INTEGER::BIGINT AS from_quote, NULL::DOUBLE AS absent FROM ses s ASOF LEFT JOIN quotes q ON s.d >= q.obs_d ASOF LEFT JOIN rates_last r ON s.d >= r.available_on"))
def optional_source_fallback(spark, sf_dir):
    """A source with holes falls back to another series; a source that is not there yields NULL, not a failure."""
    from tidemark.operators.asof import asof_on_calendar
    from tidemark.plans.joins import rates_known, sessions

    days = sessions(spark, sf_dir).select("d")
    cube = materialize(src.order_cube(spark, sf_dir))
    quotes = src.volatility_quotes(spark, sf_dir, cube).toDF("Obs Date", "Recession Prob")
    value = cl.sniff(quotes.columns, ["prob", "rec"])
    known = asof_on_calendar(days, quotes.select(F.col("Obs Date").alias("obs_d"), F.col(value).alias("quote")), available_on="obs_d", payload=["quote"])
    missing = cl.read_optional(spark, f"{sf_dir}/not_supplied.csv", "obs_d date, absent double")
    known = asof_on_calendar(known, missing, available_on="obs_d", payload=["absent"])
    rates = rates_known(spark, sf_dir, days, cube).select("d", "effr")
    return known.join(rates, "d").select("d", F.coalesce("quote", "effr").alias("level"), F.when(F.col("quote").isNotNull(), 1).otherwise(0).cast("bigint").alias("from_quote"), "absent")


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ", 1)) for part in schema.split(",")]


def _content(schema: str, engine: str) -> str:
    """All columns of a row as one text, written alike by both engines; NULL is `~`."""
    forms = {
        "spark": {"double": "cast(cast(round({c} * 10000) AS bigint) AS string)", "timestamp_ntz": "date_format({c}, 'yyyyMMddHHmmssSSSSSS')",
                  "array<float>": "array_join(transform({c}, x -> cast(cast(round(cast(x AS double) * 1000000) AS bigint) AS string)), ',')", "": "cast({c} AS string)"},
        "duck": {"double": "round({c} * 10000)::BIGINT::VARCHAR", "timestamp_ntz": "strftime({c}, '%Y%m%d%H%M%S%f')",
                 "array<float>": "array_to_string(list_transform({c}, lambda x: round(x::DOUBLE * 1000000)::BIGINT), ',')", "": "{c}::VARCHAR"}}[engine]
    return "concat_ws('|', " + ", ".join(f"coalesce({forms.get(kind, forms['']).format(c=name)}, '~')" for name, kind in _fields(schema)) + ")"


def _restat_sql(name: str) -> str:
    fields = _fields(src.SCHEMAS[name])
    key = fields[0][0]
    return (f"SELECT '{name}' AS path, count(*)::BIGINT AS n_rows, {len(fields)}::BIGINT AS n_cols, min({key})::VARCHAR AS first_key, max({key})::VARCHAR AS last_key, "
            f"sum(('0x' || substr(md5({_content(src.SCHEMAS[name], 'duck')}), 1, 8))::BIGINT)::VARCHAR AS digest FROM {name}")


RESTAT = " UNION ALL ".join(_restat_sql(n) for n in src.SCHEMAS)


@query("manifest_restat", duck(RESTAT))
def manifest_restat(spark, sf_dir):
    return table_stats(spark, sf_dir)


def table_stats(spark, sf_dir):
    parts = [mf.restat(src.table(spark, sf_dir, name), name, F.col(_fields(schema)[0][0]), F.expr(_content(schema, "spark"))) for name, schema in src.SCHEMAS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("manifest_audit", duck(
    """SELECT coalesce(m.path, f.path, r.path) AS path, CASE WHEN f.path IS NULL AND r.path IS NOT NULL THEN 'required missing' WHEN f.path IS NULL THEN 'optional missing' WHEN m.path IS NULL THEN 'unlisted'
         WHEN m.digest <> f.digest THEN 'mismatched' ELSE 'present' END AS status
       FROM (SELECT path, digest || CASE WHEN path = 'pages' THEN 'x' ELSE '' END AS digest FROM st WHERE path <> 'supplier' UNION ALL SELECT 'archive', '0') m
       FULL JOIN st f ON f.path = m.path FULL JOIN (SELECT unnest(['orders', 'customer', 'rates']) AS path) r ON r.path = coalesce(m.path, f.path)""", f"st AS ({RESTAT})"))
def manifest_audit(spark, sf_dir):
    """Table digests against a manifest with one wrong digest, one unlisted table, one absent optional and one absent required."""
    found = table_stats(spark, sf_dir).select("path", "digest")
    listed = found.filter("path <> 'supplier'").select("path", F.concat("digest", F.when(F.col("path") == "pages", "x").otherwise("")).alias("digest"))
    extra = spark.createDataFrame([("archive", "0")], "path string, digest string")
    required = spark.createDataFrame([("orders",), ("customer",), ("rates",)], "path string")
    return mf.audit(listed.unionByName(extra), found, required)


@query("returns_export", duck("SELECT d, " + ", ".join(f"{rd(f'max(CASE WHEN ord = {i} THEN r END)')} AS r{i}" for i in range(5)) + " FROM (SELECT ord, d, CASE WHEN pos = 0 THEN 0.0::DOUBLE ELSE px / lag(px) OVER (PARTITION BY entity ORDER BY pos) - 1 END AS r FROM dense) GROUP BY d"))
def returns_export(spark, sf_dir):
    """Simple returns of every entity per day, first row 0, gaps kept as NULL."""
    dense = src.dense_panel(spark, sf_dir)
    r = F.when(F.col("pos") == 0, 0.0).otherwise(op.total_return(F.col("px"), 1, op.by_entity()))
    return dense.select("d", "ord", r6(r).alias("r")).groupBy("d").pivot("ord", [0, 1, 2, 3, 4]).agg(F.first("r")).toDF("d", "r0", "r1", "r2", "r3", "r4")


@query("panel_pivot", duck("SELECT d, k AS entity, v AS px FROM (SELECT d, unnest(['g', 'f', 'c', 's', 'i']) AS k, unnest([g, f, c, s, i]) AS v FROM moments) WHERE v IS NOT NULL"))
def panel_pivot(spark, sf_dir):
    """Long to wide and back: roles as columns, then rows again."""
    wide = src.panel(spark, sf_dir).withColumn("role", src.role_of(F.col("ord"))).groupBy("d").pivot("role", list(src.ROLES)).agg(F.first("px"))
    return wide.unpivot(["d"], list(src.ROLES), "entity", "px").filter("px IS NOT NULL")


@query("staged_publish", duck("SELECT entity, d, px FROM panel"))
def staged_publish(spark, sf_dir):
    """A good version is published; a bad one fails its checks, a late one finds the pointer moved, and the good one stays served."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/publish-{uuid.uuid4().hex}"
    panel = materialize(src.panel(spark, sf_dir).select("entity", "d", "px"))
    checks = {"positive": F.col("px") > 0, "dated": F.col("d").isNotNull()}
    outcomes = [pb.publish(panel, root, checks)[1], pb.publish(panel.withColumn("px", -F.col("px")), root, checks)[1], pb.publish(panel.limit(1), root, checks, after=0)[1]]
    if outcomes != [[], ["positive"], ["superseded"]]:
        raise RuntimeError(f"unexpected outcomes: {outcomes}")
    return pb.read_version(spark, pb.served(spark, root)[1], panel.schema)


@query("file_audit")
def file_audit(spark, sf_dir):
    """The given files hashed by ranges against a manifest with one wrong digest, one unlisted file, one absent optional and one absent required."""
    found = materialize(mf.tree_digests(spark, sf_dir, "*.parquet"))
    listed = found.where("path <> 'supplier.parquet'").select("path", F.concat("digest", F.when(F.col("path") == "pages.parquet", "x").otherwise("")).alias("digest"))
    extra = spark.createDataFrame([("archive.parquet", "0")], "path string, digest string")
    required = spark.createDataFrame([("orders.parquet",), ("rates.parquet",)], "path string")
    return mf.audit(listed.unionByName(extra), found, required).join(found, "path", "left").select("path", "status", "bytes", "ranges", "digest")


@query("sink_roundtrip", duck(f"SELECT entity, month, {rd('wealth')} AS wealth FROM (SELECT entity, date_trunc('month', d)::DATE AS month, arg_max(w, d) AS wealth FROM wealth GROUP BY 1, 2)"))
def sink_roundtrip(spark, sf_dir):
    """Month-end curves written as JSON documents, one per entity, and read back."""
    from tidemark.operators.history import month_end
    from tidemark.operators.portfolio import hold_paths

    curve = month_end(hold_paths(src.dense_panel(spark, sf_dir)), "w").select("entity", F.struct("month", r6(F.col("w")).alias("wealth")).alias("point"))
    docs = curve.groupBy("entity").agg(F.sort_array(F.collect_list("point")).alias("curve"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    back = pb.write_documents(docs, path, ["entity", "curve"])
    return back.select("entity", F.explode("curve").alias("p")).select("entity", "p.month", "p.wealth")
