"""Point-in-time feature frames, daily and monthly, and their registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import big, r6
from tidemark.operators import calendars as cal, frames
from tidemark.plans.base import duck, query, rd
from tidemark.plans.calendars import HOL, SCHED, bounds_of
from tidemark.plans.joins import RELEASES, RISKZ
from tidemark.plans.windows import ROWS, RUN, WIN, release_features
from tidemark.session import materialize
from tidemark.sources import tables as src

BREAK = "1999-06-01"


def daily_features(spark, sf_dir, panel=None):
    """The daily frame: one row per session, one column per registered feature.

    Price windows run per entity, macro series are joined as known on each day, and everything meets
    on the day. Rows up to t do not change when later data is cut off.
    """
    panel = panel if panel is not None else src.panel_table(spark, sf_dir)
    cube = materialize(src.order_cube(spark, sf_dir))
    sources = frames.Sources(
        rates=src.daily_rates(spark, sf_dir, cube), releases=src.monthly_releases(spark, sf_dir, cube), risk=src.risk_index(spark, sf_dir, cube),
        events=src.event_calendar(spark, sf_dir), quotes=src.volatility_quotes(spark, sf_dir, cube), forward_prob=src.forward_dated_probability(spark, sf_dir, cube))
    return frames.daily(panel, sources, cal.business_days(bounds_of(panel), "lo", "hi"), BREAK)


def _mom(n: int) -> str:
    return f"px / lag(px, {n}) {WIN} - 1"


def _sma(n: int) -> str:
    return f"CASE WHEN count(px) {ROWS(n)} >= {n} THEN avg(px) {ROWS(n)} END"


def _rv(n: int) -> str:
    return f"CASE WHEN count(ret) {ROWS(n)} >= {n} THEN stddev_samp(ret) {ROWS(n)} * sqrt(252.0::DOUBLE) END"


PRICE_SQL = f"""pf0 AS (SELECT entity, ord, d, pos, px, ret, {_mom(21)} AS mom_21, {_mom(63)} AS mom_63, {_mom(126)} AS mom_126, {_mom(252)} AS mom_252,
   lag(px, 21) {WIN} / lag(px, 252) {WIN} - 1 AS mom_12_1, px / max(px) {RUN} - 1 AS dd, max(px) {RUN} AS pk, {_sma(50)} AS m50, {_sma(100)} AS m100, {_sma(200)} AS m200, {_sma(210)} AS m210,
   {_rv(20)} AS rv20, {_rv(63)} AS rv63 FROM rets),
pf AS (SELECT *, CASE WHEN m50 IS NOT NULL THEN (px > m50)::INTEGER END AS a50, CASE WHEN m100 IS NOT NULL THEN (px > m100)::INTEGER END AS a100,
   CASE WHEN m200 IS NOT NULL THEN (px > m200)::INTEGER END AS a200, CASE WHEN m210 IS NOT NULL THEN (px > m210)::INTEGER END AS a10m,
   m200 / lag(m200, 20) {WIN} - 1 AS slope, (px / m200 - 1) / nullif(rv63, 0) AS dist_vol,
   CASE WHEN count(rv20) {ROWS(63)} >= 63 THEN stddev_samp(rv20) {ROWS(63)} END AS vvol,
   CASE WHEN count(ret) {ROWS(63)} >= 63 THEN sqrt(avg(least(ret, 0.0::DOUBLE) ** 2) {ROWS(63)}) END AS downside,
   CASE WHEN count(dd) {ROWS(63)} >= 63 THEN sqrt(avg(dd * dd) {ROWS(63)}) END AS ulcer,
   pos - CASE WHEN first_value(px) {RUN} IS NULL THEN 0 ELSE coalesce(max(CASE WHEN px >= pk THEN pos END) {RUN}, 0) END AS since_peak FROM pf0),
xr AS (SELECT d, ord, CASE WHEN mom_252 IS NOT NULL THEN rank() OVER (PARTITION BY d ORDER BY mom_252 NULLS LAST) + (count(*) OVER (PARTITION BY d, mom_252) - 1) / 2.0::DOUBLE END AS rk,
   max(mom_252) OVER (PARTITION BY d) AS mx FROM pf WHERE ord >= 2),
vlev AS (SELECT p.d, p.pos, coalesce(q.quote, p.rv20) AS level, p.rv63, p.rv63 AS v2 FROM (SELECT * FROM pf WHERE ord = 2) p ASOF LEFT JOIN quotes q ON p.d >= q.obs_d),
vpct AS (SELECT a.d, CASE WHEN count(b.level) FILTER (a.level IS NOT NULL) >= 252 THEN (count(CASE WHEN round(b.level, 12) < round(a.level, 12) THEN 1 END) + (count(CASE WHEN round(b.level, 12) = round(a.level, 12) THEN 1 END) + 1) / 2.0::DOUBLE) / count(b.level) END AS vol_pct,
   CASE WHEN count(b.v2) FILTER (a.v2 IS NOT NULL) >= 252 THEN (count(CASE WHEN round(b.v2, 12) < round(a.v2, 12) THEN 1 END) + (count(CASE WHEN round(b.v2, 12) = round(a.v2, 12) THEN 1 END) + 1) / 2.0::DOUBLE) / count(b.v2) END AS c_vol_pct
   FROM vlev a JOIN vlev b ON b.pos <= a.pos GROUP BY a.d)"""
ROLE = {"c": 2, "s": 3, "i": 4, "f": 1, "g": 0}


def _pick(role: str, column: str, name: str) -> str:
    return f"max(CASE WHEN ord = {ROLE[role]} THEN {column} END) AS {name}"


WIDE_COLUMNS = (
    [(r, f"mom_{n}", f"{r}_mom_{n}") for r in "csif" for n in (21, 63, 126, 252)] + [("g", f"mom_{n}", f"g_mom_{n}") for n in (21, 63, 252)]
    + [(r, c, f"{r}_{c}") for r in "csif" for c in ("mom_12_1", "dd")]
    + [("c", c, n) for c, n in (("a50", "c_above_sma50"), ("a100", "c_above_sma100"), ("a200", "c_above_sma200"), ("a10m", "c_above_sma10m"), ("slope", "c_sma200_slope"), ("dist_vol", "c_dist_vol"),
                               ("rv20", "c_rv20"), ("rv63", "c_rv63"), ("vvol", "c_vvol"), ("downside", "c_downside"), ("ulcer", "c_ulcer"), ("since_peak", "c_days_since_peak"))]
    + [(r, "a200", f"{r}_above_sma200") for r in "sif"])
WIDE_SQL = "pw AS (SELECT d, pos, " + ", ".join(_pick(*c) for c in WIDE_COLUMNS) + " FROM pf GROUP BY d, pos)"
CROSS_SQL = """xw AS (SELECT x.d, """ + ", ".join(f"max(CASE WHEN ord = {o} THEN rk END) AS {r}_rs_rank" for r, o in (("c", 2), ("s", 3), ("i", 4))) + """, any_value(x.mx) AS mx FROM xr x GROUP BY x.d)"""
SINCE_SQL = """evw AS (SELECT s.d, """ + ", ".join(
    f"CASE WHEN max(CASE WHEN e.category = '{c}' THEN e.loc END) IS NOT NULL THEN least(s.pos - max(CASE WHEN e.category = '{c}' THEN e.loc END), 252) END AS {n}"
    for c, n in (("war", "days_since_war"), ("financial_crisis", "days_since_crisis"), ("rate_shock", "days_since_rate"), ("pandemic", "days_since_pandemic"))) + """,
   coalesce(max((e.category = 'war' AND s.pos <= e.loc + 20)::INTEGER), 0) AS in_war_window, coalesce(max((e.category = 'financial_crisis' AND s.pos <= e.loc + 20)::INTEGER), 0) AS in_crisis_window
   FROM ses s LEFT JOIN evloc e ON e.loc <= s.pos GROUP BY s.d, s.pos)"""
MACRO_SQL = """mac0 AS (SELECT s.d, s.pos, r.spread_10y_3m, r.spread_10y_2y, r.ust_3m, r.effr, y.yoy, c.chg_3m, g.gap, k.z, k.diff, f.prob
   FROM ses s ASOF LEFT JOIN rates_last r ON s.d >= r.available_on ASOF LEFT JOIN (SELECT * FROM tr WHERE yoy IS NOT NULL) y ON s.d >= y.mid
   ASOF LEFT JOIN (SELECT * FROM tr WHERE chg_3m IS NOT NULL) c ON s.d >= c.mid ASOF LEFT JOIN (SELECT * FROM tr WHERE gap IS NOT NULL) g ON s.d >= g.eighth
   ASOF LEFT JOIN riskz k ON s.d >= k.available_on ASOF LEFT JOIN (SELECT (fwd_d - INTERVAL 12 MONTH)::DATE AS av, prob FROM fwdprob) f ON s.d >= f.av),
mac AS (SELECT *, spread_10y_3m - lag(spread_10y_3m, 63) OVER (ORDER BY pos) AS chg3, spread_10y_2y - lag(spread_10y_2y, 63) OVER (ORDER BY pos) AS chg2,
   sum(CASE WHEN coalesce(spread_10y_3m < 0, false) THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS island FROM mac0),
cald AS (SELECT d, (nth <= 3 OR is_end)::INTEGER AS turn_of_month, (next_sched - d > 1 AND NOT (isodow(d) = 5 AND next_sched - d = 3))::INTEGER AS pre_holiday FROM (
   SELECT s.d, row_number() OVER (PARTITION BY date_trunc('month', s.d) ORDER BY s.d) AS nth, x.next_sched, date_trunc('month', x.next_sched) <> date_trunc('month', s.d) AS is_end
   FROM ses s JOIN (SELECT s.d, min(x.d) AS next_sched FROM ses s JOIN sched x ON x.d > s.d AND x.d <= s.d + 15 GROUP BY s.d) x ON x.d = s.d))"""
FLOAT_OUT = [c[2] for c in WIDE_COLUMNS if not (c[1].startswith("a") or c[1] == "since_peak")]
INT_OUT = [c[2] for c in WIDE_COLUMNS if c[1].startswith("a") or c[1] == "since_peak"]
FRAME_SQL = ("SELECT w.d, " + ", ".join(f"{rd('w.' + c)} AS {c}" for c in FLOAT_OUT) + ", " + ", ".join(f"w.{c}::BIGINT AS {c}" for c in INT_OUT)
    + ", " + ", ".join(f"x.{r}_rs_rank AS {r}_rs_rank, CASE WHEN w.{r}_mom_252 IS NULL OR w.g_mom_252 IS NULL THEN NULL WHEN w.{r}_mom_252 = x.mx AND w.{r}_mom_252 > w.g_mom_252 THEN 1 ELSE 0 END::BIGINT AS {r}_dual_mom" for r in "csi")
    + f""", month(w.d)::BIGINT AS month, {rd('sin(2 * pi() * month(w.d) / 12)')} AS month_sin, {rd('cos(2 * pi() * month(w.d) / 12)')} AS month_cos, c.turn_of_month::BIGINT AS turn_of_month, c.pre_holiday::BIGINT AS pre_holiday,
      (month(w.d) IN (11, 12, 1, 2, 3, 4))::INTEGER::BIGINT AS nov_apr, (year(w.d) % 4)::BIGINT AS pres_cycle, {rd('m.spread_10y_3m')} AS spread_10y_3m, {rd('m.spread_10y_2y')} AS spread_10y_2y,
      {rd('m.chg3')} AS spread_10y_3m_chg_63, {rd('m.chg2')} AS spread_10y_2y_chg_63, CASE WHEN m.spread_10y_3m IS NOT NULL THEN (m.spread_10y_3m < 0)::INTEGER END::BIGINT AS curve_inverted,
      CASE WHEN m.spread_10y_3m IS NOT NULL THEN {rd('(count(*) OVER (PARTITION BY m.island ORDER BY m.pos) - CASE WHEN m.island > 0 THEN 1 ELSE 0 END) / 21.0::DOUBLE')} END AS months_inverted,
      {rd('m.ust_3m - m.effr')} AS tbill_minus_effr, {rd('m.yoy')} AS cpi_yoy, {rd('m.chg_3m')} AS cpi_chg_3m, {rd('m.gap')} AS unemp_gap, {rd('w.g_mom_21 * 12 * 100 - m.ust_3m')} AS g_minus_tbill,
      {rd('v.level')} AS vol_level, {rd('p.vol_pct')} AS vol_pct, {rd('v.level - lag(v.level, 5) OVER (ORDER BY w.pos)')} AS vol_chg_5, {rd('v.level - 100 * v.rv63')} AS vol_minus_rv, {rd('p.c_vol_pct')} AS c_vol_pct,
      {rd('m.z')} AS gpr_z, {rd('m.diff')} AS gpr_act_minus_threat, CASE WHEN m.z IS NOT NULL THEN (m.z > 2)::INTEGER END::BIGINT AS gpr_spike,
      e.days_since_war::BIGINT AS days_since_war, e.days_since_crisis::BIGINT AS days_since_crisis, e.days_since_rate::BIGINT AS days_since_rate, e.days_since_pandemic::BIGINT AS days_since_pandemic,
      e.in_war_window::BIGINT AS in_war_window, e.in_crisis_window::BIGINT AS in_crisis_window, (w.d >= DATE '{BREAK}')::INTEGER::BIGINT AS i_structural_break, {rd('m.prob')} AS nyfed_rec_prob
    FROM pw w JOIN xw x ON x.d = w.d JOIN cald c ON c.d = w.d JOIN mac m ON m.d = w.d JOIN vlev v ON v.d = w.d JOIN vpct p ON p.d = w.d JOIN evw e ON e.d = w.d""")
FRAME_CTES = (PRICE_SQL, WIDE_SQL, CROSS_SQL, SINCE_SQL, RELEASES, RISKZ, *HOL, SCHED, MACRO_SQL)


@query("feature_frame_daily", duck(FRAME_SQL, *FRAME_CTES))
def feature_frame_daily(spark, sf_dir):
    return frames.published(daily_features(spark, sf_dir))


@query("feature_registry", duck(
    "SELECT name, in_model::BIGINT AS in_model, n_known::BIGINT AS n_known FROM (" + " UNION ALL ".join(
        f"SELECT '{s.name}' AS name, {int(s.model)} AS in_model, count({s.name}) AS n_known FROM ff" for s in frames.REGISTRY if s.name not in frames.OPTIONAL) + ")",
    *FRAME_CTES, f"ff AS ({FRAME_SQL})"))
def feature_registry(spark, sf_dir):
    """The registry beside the data: how many sessions know each feature, and which ones models use."""
    frame = frames.published(daily_features(spark, sf_dir))
    frames.guard(frame)
    names = [s.name for s in frames.REGISTRY if s.name in frame.columns and s.name not in frames.OPTIONAL]
    counts = frame.agg(*[F.count(n).alias(n) for n in names])
    long = counts.unpivot([], names, "name", "n_known")
    meta = F.create_map(*[F.lit(x) for s in frames.REGISTRY for x in (s.name, int(s.model))])
    return long.select("name", big(meta[F.col("name")]).alias("in_model"), "n_known")


MONTH_W = "OVER (PARTITION BY entity ORDER BY month)"


def _mrows(n: int) -> str:
    return f"OVER (PARTITION BY entity ORDER BY month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


MONTHLY_SQL = f"""mr AS (SELECT entity, ord, month, last_px / lag(last_px) {MONTH_W} - 1 AS r FROM (
     SELECT entity, ord, date_trunc('month', d)::DATE AS month, CASE WHEN max(d) FILTER (px IS NOT NULL) = max(d) THEN arg_max(px, d) END AS last_px FROM dense GROUP BY 1, 2, 3)),
lv AS (SELECT *, CASE WHEN count(r) OVER k > 0 THEN exp(sum(ln(1 + coalesce(r, 0))) OVER k) END AS px FROM mr WINDOW k AS (PARTITION BY entity ORDER BY month)),
mx0 AS (SELECT *, px / lag(px) {MONTH_W} - 1 AS ret, px / max(px) OVER (PARTITION BY entity ORDER BY month) - 1 AS dd, CASE WHEN count(px) {_mrows(10)} >= 10 THEN avg(px) {_mrows(10)} END AS m10 FROM lv),
mx1 AS (SELECT *, px / lag(px, 1) {MONTH_W} - 1 AS mom_21, px / lag(px, 3) {MONTH_W} - 1 AS mom_63, px / lag(px, 6) {MONTH_W} - 1 AS mom_126, px / lag(px, 12) {MONTH_W} - 1 AS mom_252,
   lag(px, 1) {MONTH_W} / lag(px, 12) {MONTH_W} - 1 AS mom_12_1, CASE WHEN m10 IS NOT NULL THEN (px > m10)::INTEGER END AS above, m10 / lag(m10) {MONTH_W} - 1 AS slope,
   CASE WHEN count(ret) {_mrows(12)} >= 12 THEN stddev_samp(ret) {_mrows(12)} * sqrt(12.0::DOUBLE) END AS rv,
   CASE WHEN count(ret) {_mrows(12)} >= 12 THEN sqrt(avg(least(ret, 0.0::DOUBLE) ** 2) {_mrows(12)}) END AS downside, CASE WHEN count(dd) {_mrows(12)} >= 12 THEN sqrt(avg(dd * dd) {_mrows(12)}) END AS ulcer FROM mx0),
mw AS (SELECT month, {', '.join(f'max(CASE WHEN ord = {o} THEN {c} END) AS {r}_{c}' for r, o in ROLE.items() for c in ('mom_21', 'mom_63', 'mom_126', 'mom_252', 'mom_12_1', 'dd', 'above'))},
   {', '.join(f'max(CASE WHEN ord = 2 THEN {c} END) AS c_{c}' for c in ('slope', 'rv', 'downside', 'ulcer'))}, max(CASE WHEN ord = 2 THEN (px / m10 - 1) / nullif(rv, 0) END) AS c_dist_vol FROM mx1 GROUP BY month),
mp AS (SELECT a.month, CASE WHEN count(b.c_rv) FILTER (a.c_rv IS NOT NULL) >= 36 THEN (count(CASE WHEN round(b.c_rv, 12) < round(a.c_rv, 12) THEN 1 END) + (count(CASE WHEN round(b.c_rv, 12) = round(a.c_rv, 12) THEN 1 END) + 1) / 2.0::DOUBLE) / count(b.c_rv) END AS c_vol_pct
   FROM mw a JOIN mw b ON b.month <= a.month GROUP BY a.month),
mm AS (SELECT month, lag(a) OVER (ORDER BY month) AS spread, lag(a2) OVER (ORDER BY month) AS spread2, lag(b) OVER (ORDER BY month) AS bill, lag(e) OVER (ORDER BY month) AS effr FROM (
   SELECT date_trunc('month', obs_d)::DATE AS month, arg_max(spread_10y_3m, obs_d) AS a, arg_max(spread_10y_2y, obs_d) AS a2, arg_max(ust_3m, obs_d) AS b, arg_max(effr, obs_d) AS e FROM rates GROUP BY 1)),
mc AS (SELECT month, lag(yoy) OVER (ORDER BY month) AS yoy, lag(chg_3m) OVER (ORDER BY month) AS chg_3m, lag(gap) OVER (ORDER BY month) AS gap FROM tr),
mg AS (SELECT month, lag(z) OVER (ORDER BY month) AS z, lag(diff) OVER (ORDER BY month) AS diff FROM (SELECT month, diff, CASE WHEN count(v) OVER t >= 12 THEN (v - avg(v) OVER t) / stddev_samp(v) OVER t END AS z FROM (
   SELECT date_trunc('month', obs_d)::DATE AS month, round(avg(idx), 6) AS v, avg(acts) - avg(threats) AS diff FROM risk GROUP BY 1) WINDOW t AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))),
mi AS (SELECT month, sum(CASE WHEN coalesce(spread < 0, false) THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY month) AS run FROM (
   SELECT w.month, spread, sum(CASE WHEN coalesce(spread < 0, false) THEN 0 ELSE 1 END) OVER (ORDER BY w.month) AS island FROM mw w LEFT JOIN mm USING (month)))"""


def _peers(r: str) -> tuple[str, str]:
    """Rank and dual-momentum flag of one entity among c, s, i."""
    mine, others = f"w.{r}_mom_252", [f"w.{x}_mom_252" for x in "csi" if x != r]
    rank = f"CASE WHEN {mine} IS NOT NULL THEN 1 + " + " + ".join(f"CASE WHEN {o} < {mine} THEN 1.0::DOUBLE WHEN {o} = {mine} THEN 0.5::DOUBLE ELSE 0 END" for o in others) + f" END AS {r}_rs_rank"
    first = "".join(f" AND NOT coalesce(w.{x}_mom_252 = {mine}, false)" for x in "csi"[:"csi".index(r)])
    flag = f"CASE WHEN {mine} IS NULL THEN NULL WHEN {mine} = greatest(w.c_mom_252, w.s_mom_252, w.i_mom_252){first} AND {mine} > w.g_mom_252 THEN 1 ELSE 0 END::BIGINT AS {r}_dual_mom"
    return rank, flag


M_FLOAT = [f"{r}_{c}" for r in ROLE for c in ("mom_21", "mom_63", "mom_126", "mom_252")] + [f"{r}_{c}" for r in "csif" for c in ("mom_12_1", "dd")]


ZEROS = ("days_since_war", "days_since_crisis", "days_since_rate", "days_since_pandemic", "in_war_window", "in_crisis_window", "c_days_since_peak")


@query("feature_frame_monthly", duck(
    "SELECT w.month, " + ", ".join(f"{rd('w.' + c)} AS {c}" for c in M_FLOAT) + ", " + ", ".join(f"w.{r}_above::BIGINT AS {r}_above_sma200" for r in "csif") + ", "
    + ", ".join(f"w.c_above::BIGINT AS c_above_{n}" for n in ("sma10m", "sma50", "sma100")) + ", " + ", ".join(x for r in "csi" for x in _peers(r)) + ", " + ", ".join(f"0::BIGINT AS {z}" for z in ZEROS)
    + f""", {rd('w.c_slope')} AS c_sma200_slope, {rd('w.c_rv')} AS c_rv63, {rd('w.c_rv')} AS c_rv20, {rd('w.c_rv')} AS vol_level, {rd('w.c_dist_vol')} AS c_dist_vol, {rd('w.c_downside')} AS c_downside, {rd('w.c_ulcer')} AS c_ulcer,
       {rd('p.c_vol_pct')} AS c_vol_pct, {rd('p.c_vol_pct')} AS vol_pct, 0.0::DOUBLE AS vol_minus_rv, {rd('CASE WHEN count(w.c_rv) OVER y >= 12 THEN stddev_samp(w.c_rv) OVER y END')} AS c_vvol,
       {rd('m.spread')} AS spread_10y_3m, {rd('m.spread2')} AS spread_10y_2y, {rd('m.spread - lag(m.spread, 3) OVER k')} AS spread_10y_3m_chg_63, {rd('m.spread2 - lag(m.spread2, 3) OVER k')} AS spread_10y_2y_chg_63,
       CASE WHEN m.spread IS NOT NULL THEN (m.spread < 0)::INTEGER END::BIGINT AS curve_inverted, CASE WHEN m.spread IS NOT NULL THEN i.run::DOUBLE END AS months_inverted,
       {rd('m.bill - m.effr')} AS tbill_minus_effr, {rd('c.yoy')} AS cpi_yoy, {rd('c.chg_3m')} AS cpi_chg_3m, {rd('c.gap')} AS unemp_gap, {rd('w.g_mom_21 * 12 * 100 - m.bill')} AS g_minus_tbill,
       {rd('w.c_rv - lag(w.c_rv) OVER k')} AS vol_chg_5, {rd('g.z')} AS gpr_z, {rd('g.diff + 1e-9')} AS gpr_act_minus_threat, CASE WHEN g.z IS NOT NULL THEN (g.z > 2)::INTEGER END::BIGINT AS gpr_spike,
       1::BIGINT AS turn_of_month, month(w.month)::BIGINT AS month_no, {rd('sin(2 * pi() * month(w.month) / 12)')} AS month_sin, {rd('cos(2 * pi() * month(w.month) / 12)')} AS month_cos,
       (month(w.month) IN (11, 12, 1, 2, 3, 4))::INTEGER::BIGINT AS nov_apr, (year(w.month) % 4)::BIGINT AS pres_cycle, (last_day(w.month) >= DATE '{BREAK}')::INTEGER::BIGINT AS i_structural_break
       FROM mw w JOIN mp p USING (month) LEFT JOIN mm m USING (month) LEFT JOIN mc c USING (month) LEFT JOIN mg g USING (month) JOIN mi i USING (month)
       WINDOW k AS (ORDER BY w.month), y AS (ORDER BY w.month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    RELEASES, MONTHLY_SQL))
def feature_frame_monthly(spark, sf_dir):
    """The whole month-end frame."""
    panel = src.panel_table(spark, sf_dir)
    cube = materialize(src.order_cube(spark, sf_dir))
    frame = frames.monthly(src.densify(panel), src.daily_rates(spark, sf_dir, cube), release_features(src.monthly_releases(spark, sf_dir, cube)), src.risk_index(spark, sf_dir, cube))
    # averages of four-digit values end on halves of the last published digit; a billionth sends those up on any engine
    frame = frame.withColumn("gpr_act_minus_threat", F.col("gpr_act_minus_threat") + 1e-9)
    return frames.published(frame.withColumn("i_structural_break", (F.last_day("month") >= F.lit(BREAK).cast("date")).cast("int")))
