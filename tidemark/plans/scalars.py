"""Projection, predicate and scalar-function queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import columns as fc
from tidemark.functions import weights as fw
from tidemark.functions.columns import big, r6
from tidemark.operators import metrics, windows as op
from tidemark.operators.portfolio import hold_paths
from tidemark.plans.base import duck, query, rd
from tidemark.sources import tables as src


@query("coerce_numeric", duck(
    """SELECT page_id, TRY_CAST(regexp_extract(url, '/([^/?]+)\\?', 1) AS DOUBLE) AS path_no, TRY_CAST(regexp_extract(url, 'page=([^&]*)', 1) AS DOUBLE) AS page_no,
         CASE WHEN isfinite(TRY_CAST(regexp_extract(url, 'ref=([^&]*)', 1) AS DOUBLE)) THEN TRY_CAST(regexp_extract(url, 'ref=([^&]*)', 1) AS DOUBLE) END AS ref_no FROM pages"""))
def coerce_numeric(spark, sf_dir):
    """Numeric reading of text fields: anything that is not a number becomes NULL."""
    pages = src.table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"/([^/?]+)\?", 1).alias("a"), F.regexp_extract("url", "page=([^&]*)", 1).alias("b"), F.regexp_extract("url", "ref=([^&]*)", 1).alias("c"))
    return pages.select("page_id", fc.coerce_number("a").alias("path_no"), fc.coerce_number("b").alias("page_no"), fc.finite(fc.coerce_number("c")).alias("ref_no"))


@query("month_key", duck(
    """SELECT strftime(o_orderdate, '%Y-%m') AS month_key, date_trunc('month', o_orderdate)::DATE AS month, last_day(o_orderdate::DATE) AS month_end, count(*)::BIGINT AS n FROM orders GROUP BY ALL"""))
def month_key(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return src.table(spark, sf_dir, "orders").groupBy(
        F.date_format(d, "yyyy-MM").alias("month_key"), F.trunc(d, "MM").alias("month"), F.last_day(d).alias("month_end")).agg(F.count(F.lit(1)).alias("n"))


@query("slice_rebase", duck(
    f"""SELECT entity, d, {rd('w / first_value(w) OVER (PARTITION BY entity ORDER BY d)')} AS rebased FROM (
          SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM wealth WHERE d BETWEEN DATE '1997-01-01' AND DATE '1999-12-31') WHERE n >= 5"""))
def slice_rebase(spark, sf_dir):
    paths = hold_paths(src.dense_panel(spark, sf_dir))
    day = lambda text: F.lit(text).cast("date")
    return metrics.rebase_slice(paths, "entity", day("1997-01-01"), day("1999-12-31")).select("entity", "d", r6(F.col("rebased")).alias("rebased"))


@query("completeness_filter", duck(
    """SELECT d, n_ok::BIGINT AS n_ok FROM (SELECT m.d, (m.g IS NOT NULL)::INTEGER + (m.f IS NOT NULL)::INTEGER + (m.c IS NOT NULL)::INTEGER + (m.s IS NOT NULL)::INTEGER + (m.i IS NOT NULL)::INTEGER AS n_ok, l.label
         FROM moments m JOIN labels_d l USING (d)) WHERE n_ok / 5.0 > 0.6 AND label IS NOT NULL""",
    f"""lab0 AS (SELECT *, lead(px, 22) OVER (PARTITION BY entity ORDER BY pos) / lead(px, 1) OVER (PARTITION BY entity ORDER BY pos) - 1 AS fret FROM dense)""",
    "labels_d AS (SELECT d, max(CASE WHEN ord = 0 AND fret IS NOT NULL THEN 1 END) AS label FROM lab0 GROUP BY d)"))
def completeness_filter(spark, sf_dir):
    labelled = op.forward_labels(src.dense_panel(spark, sf_dir), 21, 1)
    rows = labelled.groupBy("d").agg(F.count("px").alias("n_ok"), F.count(F.lit(1)).alias("k"), F.max("label").alias("label"))
    return rows.filter((F.col("n_ok") / F.col("k") > 0.6) & F.col("label").isNotNull()).select("d", "n_ok")


BREAK = "1998-07-01"


@query("structural_break_split", duck(
    f"""SELECT entity, after_break::BIGINT AS after_break, count(*)::BIGINT AS n, {rd('CASE WHEN date_diff(' + "'day'" + ', min(d), max(d)) > 0 THEN (arg_max(px, d) / arg_min(px, d)) ** (365.25::DOUBLE / date_diff(' + "'day'" + ', min(d), max(d))) - 1 ELSE 0 END')} AS cagr,
         {rd('stddev_samp(r) * sqrt(252.0::DOUBLE)')} AS vol FROM (
         SELECT *, px / lag(px) OVER (PARTITION BY entity, after_break ORDER BY d) - 1 AS r FROM (SELECT *, (d >= DATE '{BREAK}')::INTEGER AS after_break FROM panel)) GROUP BY 1, 2"""))
def structural_break_split(spark, sf_dir):
    """The same metrics on each side of a break date: the side is just one more group key."""
    split = src.panel(spark, sf_dir).withColumn("after_break", F.when(F.col("d") >= F.lit(BREAK).cast("date"), 1).otherwise(0).cast("bigint"))
    w = W.partitionBy("entity", "after_break").orderBy("d")
    rows = split.withColumn("r", fc.change(F.col("px"), F.lag("px").over(w)))
    growth = metrics.cagr(F.min_by("px", "d"), F.max_by("px", "d"), F.datediff(F.max("d"), F.min("d")))
    return rows.groupBy("entity", "after_break").agg(F.count(F.lit(1)).alias("n"), r6(growth).alias("cagr"), r6(F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol"))


@query("calendar_encodings", duck(
    f"""SELECT d, month(d)::BIGINT AS month, {rd('sin(2 * pi() * month(d) / 12)')} AS month_sin, {rd('cos(2 * pi() * month(d) / 12)')} AS month_cos,
         (month(d) IN (11, 12, 1, 2, 3, 4))::INTEGER::BIGINT AS nov_apr, (year(d) % 4)::BIGINT AS pres_cycle, n::BIGINT AS n FROM (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1)"""))
def calendar_encodings(spark, sf_dir):
    days = src.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    enc = fc.calendar_encodings(F.col("d"))
    return days.select("d", big(enc["month"]).alias("month"), r6(enc["month_sin"]).alias("month_sin"), r6(enc["month_cos"]).alias("month_cos"),
                       big(enc["nov_apr"]).alias("nov_apr"), big(enc["pres_cycle"]).alias("pres_cycle"), "n")


# Requested mixes come from customers' orders: one component per order priority, the safe one first.
MIX_ORDER = ["5-LOW", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


def raw_mixes(spark, sf_dir):
    """(k, w): spend by priority as an allocation request; some lack a component, some are negative."""
    orders = src.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    sums = orders.groupBy("o_custkey").agg(*[F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")).otherwise(0.0)).alias(f"w{i}") for i, p in enumerate(MIX_ORDER)])
    charged = F.col("w4") - F.when(F.col("o_custkey") % 7 == 0, 50000.0).otherwise(0.0)
    return sums.select(F.col("o_custkey").alias("k"), F.array("w0", "w1", "w2", "w3", charged).alias("w"))


MIXES = """mix AS (SELECT o_custkey AS k,
   sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice ELSE 0 END) AS w0, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) AS w1,
   sum(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice ELSE 0 END) AS w2, sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice ELSE 0 END) AS w3,
   sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_totalprice ELSE 0 END) - CASE WHEN o_custkey % 7 = 0 THEN 50000.0 ELSE 0 END AS w4 FROM orders GROUP BY 1),
valid AS (SELECT k, least(w0, w1, w2, w3, w4) < 0 AS neg, w0 + w1 + w2 + w3 + w4 AS s, w0, w1, w2, w3, w4 FROM mix)"""


@query("validate_weights", duck(
    "SELECT k, CASE WHEN neg THEN 'negative' WHEN s <= 0 THEN 'zero sum' ELSE 'ok' END AS status, "
    + ", ".join(f"CASE WHEN NOT neg AND s > 0 THEN {rd(f'w{i} / s')} END AS w{i}" for i in range(5)) + " FROM valid", MIXES))
def validate_weights(spark, sf_dir):
    mixes = raw_mixes(spark, sf_dir).withColumn("status", fw.weight_status(F.col("w"), 5)).withColumn("n", fw.normalized(F.col("w"), 5))
    return mixes.select("k", "status", *[r6(F.get("n", F.lit(i))).alias(f"w{i}") for i in range(5)])


SEGMENT_MIX = """segmix AS (SELECT c_mktsegment AS seg, sum(w0) / sum(s) AS m0, sum(w1) / sum(s) AS m1, sum(w2) / sum(s) AS m2, sum(w3) / sum(s) AS m3, sum(w4) / sum(s) AS m4
  FROM valid JOIN customer ON c_custkey = k WHERE NOT neg AND s > 0 GROUP BY 1)"""


@query("safe_only_move", duck(
    "SELECT v.k, (v.w0 / v.s >= m0 - 1e-8 AND " + " AND ".join(f"v.w{i} / v.s <= m{i} + 1e-8" for i in range(1, 5)) + " AND NOT ("
    + " AND ".join(f"abs(m{i} - v.w{i} / v.s) <= 1e-8 + 1e-5 * abs(v.w{i} / v.s)" for i in range(5)) + "))::INTEGER::BIGINT AS safe_only "
    "FROM valid v JOIN customer ON c_custkey = v.k JOIN segmix ON seg = c_mktsegment WHERE NOT neg AND s > 0", MIXES, SEGMENT_MIX))
def safe_only_move(spark, sf_dir):
    """Would moving from the segment's mix to the customer's mix only add to the safe component?"""
    mixes = raw_mixes(spark, sf_dir).filter(fw.weight_status(F.col("w"), 5) == "ok").withColumn("target", fw.normalized(F.col("w"), 5))
    tagged = mixes.join(src.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("k"))
    spent = [F.sum(F.get("w", F.lit(i))) for i in range(5)]
    whole = F.sum(fw.total(F.col("w")))
    segments = tagged.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.array(*[s / whole for s in spent]).alias("current"))
    by_segment = F.map_from_entries(F.collect_list(F.struct("seg", "current")))
    lookup = segments.agg(by_segment.alias("m")).scalar()  # a handful of market segments
    moved = tagged.withColumn("__m", lookup).withColumn("current", F.element_at("__m", F.col("c_mktsegment")))
    return moved.select("k", fc.flag(fw.safe_only_move(F.col("current"), F.col("target"))).alias("safe_only"))


# Trigger texts that key off a same-day move.
SUSPECT_TOKENS = ["c_up", "c fund up", "us up", "spx up", "big c"]


@query("suspect_rule_flag", duck(
    """SELECT conv_id, turn, (role = 'user' AND turn <= 1 AND (lower(text) LIKE '%c!_up%' ESCAPE '!' OR contains(lower(text), 'c fund up') OR contains(lower(text), 'us up') OR contains(lower(text), 'spx up')
         OR contains(lower(text), 'big c') OR contains(lower(text), 'tion')))::INTEGER::BIGINT AS suspect, length(text)::BIGINT AS n FROM conversations"""))
def suspect_rule_flag(spark, sf_dir):
    """Rule rows: role stands for the asset, turn for the holding length, text for the trigger; `tion` makes the sample's prose hit."""
    conv = src.table(spark, sf_dir, "conversations")
    hit = fc.suspect_rule(F.col("role"), "USER", F.col("turn"), F.col("text"), [*SUSPECT_TOKENS, "tion"])
    return conv.select("conv_id", "turn", fc.flag(hit).alias("suspect"), big(F.length("text")).alias("n"))


NAMES = "['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST']"


@query("dominant_entity", duck(
    f"""SELECT k, CASE WHEN top + 1e-9 >= 0.5 THEN {NAMES}[p + 1] ELSE 'MIX' END AS dominant, {NAMES}[p + 1] AS pick, CASE WHEN top + 1e-9 >= 0.5 THEN p ELSE 0 END::BIGINT AS chosen FROM (
          SELECT k, greatest(w0, w1, w2, w3, w4) / s AS top, list_position([w0, w1, w2, w3, w4], greatest(w0, w1, w2, w3, w4)) - 1 AS p FROM valid WHERE NOT neg AND s > 0)""", MIXES))
def dominant_entity(spark, sf_dir):
    names = src.table(spark, sf_dir, "region").agg(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r")).select(F.col("r.r_name").alias("n")).scalar()
    mixes = raw_mixes(spark, sf_dir).withColumn("n", fw.normalized(F.col("w"), 5)).filter("n IS NOT NULL").withColumn("names", names)
    w = F.col("n")
    return mixes.select("k", fw.dominant(w, F.col("names")).alias("dominant"), F.get("names", fw.top_position(w)).alias("pick"), big(fw.chosen_position(w)).alias("chosen"))


@query("verdict", duck(
    f"""SELECT entity, y::BIGINT AS y, {rd('ex')} AS excess, {rd('lo')} AS low, {rd('hi')} AS high,
          CASE WHEN ex > 0 AND lo > 0 AND coalesce(ok, false) THEN 'Beat' WHEN ex < 0 AND hi < 0 THEN 'Underperformed' ELSE 'Inconclusive' END AS verdict FROM (
          SELECT entity, y, ex, ex - 1.645 * se AS lo, ex + 1.645 * se AS hi, CASE WHEN n > 100 THEN ex / se > 1 END AS ok FROM (
            SELECT r.entity, year(r.d) AS y, avg(r.ret - b.ret) AS ex, stddev_samp(r.ret - b.ret) / sqrt(count(*)) AS se, count(*) AS n
            FROM rets r JOIN rets b ON b.d = r.d AND b.ord = 0 WHERE r.ord > 0 AND r.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2))"""))
def verdict(spark, sf_dir):
    """Verdict per entity and year from a normal interval of the mean daily excess."""
    rets = op.with_returns(src.dense_panel(spark, sf_dir)).select("entity", "ord", "d", "ret")
    base = F.max(F.when(F.col("ord") == 0, F.col("ret"))).over(W.partitionBy("d"))
    ex = rets.withColumn("x", F.col("ret") - base).filter("ord > 0 AND x IS NOT NULL")
    g = ex.groupBy("entity", big(F.year("d")).alias("y")).agg(F.avg("x").alias("ex"), (F.stddev_samp("x") / F.sqrt(F.count("x").cast("double"))).alias("se"), F.count("x").alias("n"))
    lo, hi = F.col("ex") - 1.645 * F.col("se"), F.col("ex") + 1.645 * F.col("se")
    ok = F.when(F.col("n") > 100, F.col("ex") / F.col("se") > 1)
    return g.select("entity", "y", r6(F.col("ex")).alias("excess"), r6(lo).alias("low"), r6(hi).alias("high"), fc.verdict(F.col("ex"), lo, hi, ok).alias("verdict"))


@query("signal_change", duck(
    """SELECT n.account, p.target AS previous, n.target AS current, CASE WHEN p.target IS NULL THEN 'first signal: ' || n.target WHEN p.target = n.target THEN 'unchanged: ' || n.target
         ELSE 'flipped: ' || p.target || ' to ' || n.target END AS message FROM (SELECT account, arg_max(target, (ts, req_id)) AS target FROM req GROUP BY 1) n
       LEFT JOIN (SELECT account, arg_max(target, (ts, req_id)) AS target FROM req WHERE ts < (SELECT max(ts)::DATE FROM req) - 7 GROUP BY 1) p USING (account)"""))
def signal_change(spark, sf_dir):
    """Latest published signal per account against the one of a week earlier; both are mergeable maxima."""
    req = src.requests(spark, sf_dir)
    cutoff = req.agg(F.date_sub(F.to_date(F.max("ts")), 7).cast("timestamp").alias("c")).scalar()
    at = F.struct("ts", "req_id")
    rows = req.withColumn("old", F.col("ts") < cutoff)
    both = rows.groupBy("account").agg(F.max_by("target", F.when(F.col("old"), at)).alias("previous"), F.max_by("target", at).alias("current"))
    prev, cur = F.col("previous"), F.col("current")
    message = F.when(prev.isNull(), F.format_string("first signal: %s", cur)).when(prev.eqNullSafe(cur), F.format_string("unchanged: %s", cur)).otherwise(
        F.format_string("flipped: %s to %s", prev, cur))
    return both.select("account", "previous", "current", message.alias("message"))
