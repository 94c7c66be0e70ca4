"""Query registry and the DuckDB fragments that mirror the shared source roles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


SHARED = """
panel AS (
  SELECT r_name AS entity, r_regionkey::INTEGER AS ord, l_shipdate::DATE AS d,
         round(100 + 10 * ln(sum(l_extendedprice) / sum(l_quantity)), 6) AS px
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3),
ses AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos FROM (SELECT DISTINCT d FROM panel)),
ent AS (SELECT DISTINCT entity, ord FROM panel),
dense AS (
  SELECT e.entity, e.ord, s.d, s.pos, p.px
  FROM ent e CROSS JOIN ses s LEFT JOIN panel p ON p.entity = e.entity AND p.d = s.d),
filled AS (
  SELECT *, last_value(px IGNORE NULLS) OVER (PARTITION BY entity ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fpx FROM dense),
rets AS (SELECT *, fpx / lag(fpx) OVER (PARTITION BY entity ORDER BY pos) - 1 AS ret FROM filled),
rates AS (
  SELECT *, round(ust_10y - ust_2y, 4) AS spread_10y_2y, round(ust_10y - ust_3m, 4) AS spread_10y_3m FROM (
    SELECT o_orderdate::DATE AS obs_d,
      round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) / 50021.1373, 4) AS effr,
      round(avg(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) / 50021.1373, 4) AS ust_3m,
      round(avg(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END) / 50021.1373, 4) AS ust_2y,
      round(avg(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_totalprice END) / 50021.1373, 4) AS ust_10y
    FROM orders GROUP BY 1)),
rates_av AS (
  SELECT *, (obs_d + CASE isodow(obs_d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END::INTEGER)::DATE AS available_on FROM rates),
rates_last AS (
  SELECT * FROM rates_av QUALIFY row_number() OVER (PARTITION BY available_on ORDER BY obs_d DESC) = 1),
rel AS (
  SELECT date_trunc('month', o_orderdate)::DATE AS month, round(avg(o_totalprice) / 997.1357, 4) AS cpi,
         round(100.0 * avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END), 4) AS unemp
  FROM orders GROUP BY 1),
risk AS (
  SELECT o_orderdate::DATE AS obs_d, round(avg(o_totalprice) / 977.3391, 4) AS idx,
         round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 977.3391, 4) AS acts,
         round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) / 977.3391, 4) AS threats
  FROM orders GROUP BY 1),
quotes AS (
  SELECT o_orderdate::DATE AS obs_d, round(avg(o_totalprice) / 10007.3911, 4) AS quote FROM orders
  WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' GROUP BY 1),
fwdprob AS (
  SELECT last_day((month + INTERVAL 12 MONTH)::DATE) AS fwd_d, prob FROM (
    SELECT date_trunc('month', o_orderdate)::DATE AS month,
           round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0 END), 6) AS prob FROM orders GROUP BY 1)),
evday AS (SELECT o_orderpriority AS pr, o_orderdate::DATE AS d, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS v FROM orders GROUP BY 1, 2),
evz AS (
  SELECT pr, d, CASE WHEN count(v) OVER k >= 40 AND stddev_samp(v) OVER k > 0 THEN (v - avg(v) OVER k) / stddev_samp(v) OVER k END AS z
  FROM evday WINDOW k AS (PARTITION BY pr ORDER BY d ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
evcross AS (SELECT pr, d FROM (SELECT *, lag(z) OVER (PARTITION BY pr ORDER BY d) AS earlier FROM evz) WHERE z >= 2 AND coalesce(earlier < 2, true)),
evnext AS (SELECT a.pr, a.d, min(b.d) AS nxt FROM evcross a LEFT JOIN evcross b ON b.pr = a.pr AND b.d >= a.d + 10 GROUP BY 1, 2),
evpick AS (SELECT pr, min(d) AS d FROM evcross GROUP BY pr UNION ALL SELECT n.pr, n.nxt FROM evpick p JOIN evnext n ON n.pr = p.pr AND n.d = p.d WHERE n.nxt IS NOT NULL),
evcal AS (
  SELECT date_diff('day', DATE '1970-01-01', d)::BIGINT * 5 + list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], pr) AS event_id,
         CASE pr WHEN '1-URGENT' THEN 'war' WHEN '2-HIGH' THEN 'financial_crisis' WHEN '3-MEDIUM' THEN 'rate_shock' WHEN '4-NOT SPECIFIED' THEN 'pandemic' ELSE 'other' END AS category, d AS event_d FROM evpick),
evloc AS (
  SELECT e.event_id, e.category, e.event_d, min(s.pos) AS loc FROM evcal e LEFT JOIN ses s ON s.d >= e.event_d GROUP BY ALL),
req AS (SELECT user_id AS account, event_id AS req_id, ts, event_type AS target FROM events),
scored AS (
  SELECT doc_id, n_chars / (n_chars + 2000.0) AS p, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)),
wealth AS (
  SELECT entity, ord, d, pos, fpx, fpx / first_value(fpx) OVER (PARTITION BY entity ORDER BY pos) AS w,
         CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY pos) = 1 THEN 0.0::DOUBLE ELSE ret END AS ret
  FROM rets WHERE fpx IS NOT NULL),
moments AS (
  SELECT d, pos,
    max(CASE WHEN ord = 0 THEN px END) AS g, max(CASE WHEN ord = 1 THEN px END) AS f, max(CASE WHEN ord = 2 THEN px END) AS c,
    max(CASE WHEN ord = 3 THEN px END) AS s, max(CASE WHEN ord = 4 THEN px END) AS i
  FROM dense GROUP BY d, pos)
"""


def duck(select: str, *ctes: str) -> str:
    """One statement: the shared fragments, then the query's own CTEs, then its SELECT."""
    own = "".join(",\n" + c.strip().rstrip(",") for c in ctes)
    return "WITH RECURSIVE " + SHARED.strip() + own + "\n" + select.strip()


def rd(expr: str, digits: int = 6) -> str:
    """Rounding that never yields a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"
