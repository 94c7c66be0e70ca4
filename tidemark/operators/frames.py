"""Point-in-time feature frames and their registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.columns import big, calendar_encodings, change, r6
from tidemark.operators import asof, bands, calendars as cal, windows as op
from tidemark.sources.tables import ROLES, densify


@dataclass(frozen=True)
class Feature:
    name: str
    source: str
    lag: str
    unit: str
    model: bool


@dataclass(frozen=True)
class Sources:
    """Input tables; an optional one left out makes its features fall back, not fail."""

    rates: DataFrame
    releases: DataFrame
    risk: DataFrame
    events: DataFrame
    quotes: DataFrame | None = None
    forward_prob: DataFrame | None = None
    tone: DataFrame | None = None


PRICE, KNOWN, RATE, RELEASE, RISK, EVENT, VOL = "prices", "calendar", "daily rates", "monthly releases", "risk index", "event calendar", "volatility quotes"


def _registry() -> list[Feature]:
    """Specs by rule: names follow <role>_<measure>; the model subset is the stated constant."""
    rows = []
    add = lambda n, s, l, u: rows.append(Feature(n, s, l, u, n in MODEL_FEATURES))
    for role in "csif":
        for n in (21, 63, 126, 252):
            add(f"{role}_mom_{n}", PRICE, "session close", "return")
        add(f"{role}_mom_12_1", PRICE, "session close", "return")
        add(f"{role}_dd", PRICE, "session close", "return")
    for n in (21, 63, 252):
        add(f"g_mom_{n}", PRICE, "session close", "return")
    for n in ("sma50", "sma100", "sma200", "sma10m"):
        add(f"c_above_{n}", PRICE, "session close", "0/1")
    for role in "sif":
        add(f"{role}_above_sma200", PRICE, "session close", "0/1")
    for n in ("c_sma200_slope", "c_dist_vol", "c_rv20", "c_rv63", "c_vvol", "c_downside", "c_vol_pct", "c_ulcer"):
        add(n, PRICE, "session close", "number")
    add("c_days_since_peak", PRICE, "session close", "sessions")
    for role in "csi":
        add(f"{role}_rs_rank", PRICE, "session close", "rank")
        add(f"{role}_dual_mom", PRICE, "session close", "0/1")
    for n in ("month", "month_sin", "month_cos", "turn_of_month", "pre_holiday", "nov_apr", "pres_cycle"):
        add(n, KNOWN, "known ahead", "number")
    for n in ("spread_10y_3m", "spread_10y_2y", "spread_10y_3m_chg_63", "spread_10y_2y_chg_63", "curve_inverted", "months_inverted", "tbill_minus_effr", "g_minus_tbill"):
        add(n, RATE, "next weekday", "points")
    add("cpi_yoy", RELEASE, "15th of next month", "return")
    add("cpi_chg_3m", RELEASE, "15th of next month", "return")
    add("unemp_gap", RELEASE, "8th of next month", "points")
    for n in ("vol_level", "vol_pct", "vol_chg_5", "vol_minus_rv"):
        add(n, VOL, "same day", "number")
    for n in ("gpr_z", "gpr_act_minus_threat", "gpr_spike"):
        add(n, RISK, "next day", "number")
    for n in ("days_since_war", "days_since_crisis", "days_since_rate", "days_since_pandemic", "in_war_window", "in_crisis_window"):
        add(n, EVENT, "reaction session", "sessions")
    add("i_structural_break", KNOWN, "from the break date", "0/1")
    for n in OPTIONAL:
        add(n, "optional", "next day or shifted", "number")
    return rows


# Features used by models, in registry order.
MODEL_FEATURES = (
    "c_mom_21", "c_mom_63", "c_mom_126", "c_mom_252", "c_mom_12_1", "s_mom_252", "i_mom_252", "f_mom_252",
    "c_above_sma50", "c_above_sma200", "c_above_sma10m", "c_dist_vol", "c_rv20", "c_rv63", "c_downside", "c_vol_pct", "c_dd", "c_ulcer",
    "c_rs_rank", "c_dual_mom", "month_sin", "month_cos", "turn_of_month", "nov_apr",
    "spread_10y_3m", "spread_10y_2y", "spread_10y_3m_chg_63", "curve_inverted", "months_inverted",
    "cpi_yoy", "unemp_gap", "vol_level", "vol_chg_5", "gpr_z", "gpr_spike", "in_war_window", "in_crisis_window",
)
# Features present only when their table is supplied.
OPTIONAL = ("news_tone_z", "news_volume_z", "nyfed_rec_prob")
REGISTRY = _registry()
FORBIDDEN = "nber"


def guard(frame: DataFrame) -> None:
    """Evaluation-only columns must never reach a feature frame."""
    leaked = [c for c in frame.columns if FORBIDDEN in c.lower()]
    if leaked:
        raise ValueError(f"evaluation columns in the feature frame: {leaked}")


def published(frame: DataFrame) -> DataFrame:
    """Numbers rounded to 6 digits, counters and flags as BIGINT."""
    out = []
    for name, kind in frame.dtypes:
        if name == "pos":
            continue
        out.append(F.col(name) if kind == "date" else r6(F.col(name)).alias(name) if kind == "double" else big(F.col(name)).alias(name))
    return frame.select(*out)


def _price_long(dense: DataFrame) -> DataFrame:
    """Per entity and session: momenta, averages, volatility, drawdown measures (two window passes)."""
    w = op.by_entity()
    px, ret = F.col("px"), F.col("ret")
    first = op.rows_since_peak(op.with_returns(dense), "px", w).select(
        "entity", "ord", "d", "pos", "px", "ret", "since_peak", *[op.total_return(px, n, w).alias(f"mom_{n}") for n in (21, 63, 126, 252)],
        op.skip_return(px, 21, 252, w).alias("mom_12_1"), op.drawdown(px, w).alias("dd"), *[op.moving_average(px, n, w).alias(f"m{n}") for n in (50, 100, 200, 210)],
        op.realized_vol(ret, 20, 252, w).alias("rv20"), op.realized_vol(ret, 63, 252, w).alias("rv63"))
    t = op.trailing(w, 63)
    loss = F.when(ret.isNotNull(), F.least(ret, F.lit(0.0)))
    flag = lambda m: F.when(F.col(m).isNotNull(), F.when(px > F.col(m), 1).otherwise(0))
    guarded = lambda c, x: F.when(F.count(x).over(t) >= 63, c)
    return first.select(
        "*", flag("m50").alias("above_sma50"), flag("m100").alias("above_sma100"), flag("m200").alias("above_sma200"), flag("m210").alias("above_sma10m"),
        change(F.col("m200"), F.lag("m200", 20).over(w)).alias("sma200_slope"), F.try_divide(px / F.col("m200") - 1.0, F.col("rv63")).alias("dist_vol"),
        guarded(F.stddev_samp("rv20").over(t), F.col("rv20")).alias("vvol"), guarded(F.sqrt(F.avg(loss * loss).over(t)), ret).alias("downside"),
        guarded(F.sqrt(F.avg(F.col("dd") * F.col("dd")).over(t)), F.col("dd")).alias("ulcer"))


def _pick(role: str, column: str) -> Column:
    return F.max(F.when(F.col("ord") == ROLES.index(role), F.col(column))).alias(f"{role}_{column}")


def _price_wide(long: DataFrame) -> DataFrame:
    """One row per session; the pivot is a conditional aggregate over the five roles."""
    cols = [_pick(r, f"mom_{n}") for r in "csif" for n in (21, 63, 126, 252)] + [_pick("g", f"mom_{n}") for n in (21, 63, 252)]
    cols += [_pick(r, c) for r in "csif" for c in ("mom_12_1", "dd", "above_sma200")]
    cols += [_pick("c", c) for c in ("above_sma50", "above_sma100", "above_sma10m", "sma200_slope", "dist_vol", "rv20", "rv63", "vvol", "downside", "ulcer")]
    cols.append(F.max(F.when(F.col("ord") == ROLES.index("c"), F.col("since_peak"))).alias("c_days_since_peak"))
    return long.groupBy("d", "pos").agg(*cols)


def _cross_section(wide: DataFrame, safe_needed: bool = True) -> DataFrame:
    """Average-tie ranks and dual-momentum flags among c, s, i from one row's own columns."""
    peers = {r: F.col(f"{r}_mom_252") for r in "csi"}
    best = F.greatest(*peers.values())  # skips NULLs
    out = wide
    for i, (r, m) in enumerate(peers.items()):
        others = [x for k, x in peers.items() if k != r]
        below = sum((F.when(x < m, 1.0).otherwise(0.0) for x in others), F.lit(0.0))
        ties = sum((F.when(x == m, 0.5).otherwise(0.0) for x in others), F.lit(0.0))
        earlier = list(peers.values())[:i]
        first = F.lit(True)
        for x in earlier:
            first = first & ~F.coalesce(x == m, F.lit(False))
        known = m.isNotNull() & F.col("g_mom_252").isNotNull() if safe_needed else m.isNotNull()
        leads = (m == best) & first & F.coalesce(m > F.col("g_mom_252"), F.lit(False))
        out = out.withColumn(f"{r}_rs_rank", F.when(m.isNotNull(), 1.0 + below + ties)).withColumn(f"{r}_dual_mom", F.when(known, F.when(leads, 1).otherwise(0)))
    return out


def _macro(days: DataFrame, s: Sources) -> DataFrame:
    """Every macro series as known on each session of the calendar."""
    rates = s.rates.withColumn("available_on", cal.next_weekday(F.col("obs_d")))
    series = [(rates, "available_on", ["spread_10y_3m", "spread_10y_2y", "ust_3m", "effr"], "obs_d")]
    w = W.orderBy("month")
    t = w.rowsBetween(-11, 0)
    rel = s.releases.select("month", change(F.col("cpi"), F.lag("cpi", 12).over(w)).alias("cpi_yoy"), change(F.col("cpi"), F.lag("cpi", 3).over(w)).alias("cpi_chg_3m"),
                            F.when(F.count("unemp").over(t) >= 12, F.col("unemp") - F.min("unemp").over(t)).alias("unemp_gap"))
    for name, day in (("cpi_yoy", 15), ("cpi_chg_3m", 15), ("unemp_gap", 8)):
        known = rel.filter(F.col(name).isNotNull()).select(name, "month", cal.next_month_day(F.col("month"), day).alias("available_on"))
        series.append((known, "available_on", [name], "month"))
    risk = s.risk.select(F.date_add("obs_d", 1).alias("available_on"), op.zscore(F.col("idx"), 365, 60, W.orderBy("obs_d")).alias("gpr_z"),
                         (F.col("acts") - F.col("threats")).alias("gpr_act_minus_threat"))
    series.append((risk, "available_on", ["gpr_z", "gpr_act_minus_threat"], None))
    if s.quotes is not None:
        series.append((s.quotes, "obs_d", ["quote"], None))
    if s.forward_prob is not None:
        shifted = s.forward_prob.select(F.col("prob").alias("nyfed_rec_prob"), cal.year_back(F.col("fwd_d")).alias("available_on"))
        series.append((shifted, "available_on", ["nyfed_rec_prob"], None))
    if s.tone is not None:
        tw = W.orderBy("obs_d")
        daily = s.tone.groupBy("obs_d").agg(F.avg("score").alias("tone"), F.count(F.lit(1)).cast("double").alias("volume"))
        z = daily.select(F.date_add("obs_d", 1).alias("available_on"), op.zscore(F.col("tone"), 252, 60, tw).alias("news_tone_z"), op.zscore(F.col("volume"), 252, 60, tw).alias("news_volume_z"))
        series.append((z, "available_on", ["news_tone_z", "news_volume_z"], None))
    out = asof.asof_many(days, series)
    if s.quotes is None:
        out = out.withColumn("quote", F.lit(None).cast("double"))
    d = W.orderBy("pos")
    inverted = F.col("spread_10y_3m") < 0
    out = op.run_length(out.withColumn("series", F.lit("curve")), inverted, ("series",)).drop("series")
    known = F.col("spread_10y_3m").isNotNull()
    return out.select(
        *[c for c in out.columns if c not in ("run",)],
        op.row_diff(F.col("spread_10y_3m"), 63, d).alias("spread_10y_3m_chg_63"), op.row_diff(F.col("spread_10y_2y"), 63, d).alias("spread_10y_2y_chg_63"),
        F.when(known, F.when(inverted, 1).otherwise(0)).alias("curve_inverted"), F.when(known, F.col("run") / 21.0).alias("months_inverted"),
        (F.col("ust_3m") - F.col("effr")).alias("tbill_minus_effr"), F.when(F.col("gpr_z").isNotNull(), F.when(F.col("gpr_z") > 2, 1).otherwise(0)).alias("gpr_spike"))


# Event category to its feature suffix.
EVENT_FEATURES = {"war": "war", "financial_crisis": "crisis", "rate_shock": "rate", "pandemic": "pandemic"}


def _events(days: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions since the latest event of each category (capped) and the 21-session windows.

    Events located past the end of the sample have no session, so they cannot reach any row.
    """
    located = bands.locate_events(days.select("d", "pos"), events).filter(F.col("loc").isNotNull())
    marks = located.groupBy(F.col("loc").alias("pos")).agg(*[F.max(F.when(F.col("category") == c, F.col("loc"))).alias(f"__{n}") for c, n in EVENT_FEATURES.items()])
    run = op.running(W.orderBy("pos"))
    joined = days.select("d", "pos").join(marks, "pos", "left")
    since = {n: F.col("pos") - F.last(f"__{n}", ignorenulls=True).over(run) for n in EVENT_FEATURES.values()}
    out = joined.select("d", *[F.when(x.isNotNull(), F.least(x, F.lit(252))).alias(f"days_since_{n}") for n, x in since.items()])
    return out.select("*", *[F.when(F.col(f"days_since_{n}") <= 20, 1).otherwise(0).alias(f"in_{n}_window") for n in ("war", "crisis")])


def _calendar(days: DataFrame, scheduled: DataFrame, break_on: str) -> DataFrame:
    flagged = cal.schedule_flags(days.select("d"), scheduled)
    nth = F.row_number().over(W.partitionBy(F.trunc("d", "MM")).orderBy("d"))
    enc = calendar_encodings(F.col("d"))
    return flagged.select(
        "d", ((nth <= 3) | (F.col("is_month_end") == 1)).cast("int").alias("turn_of_month"), F.col("is_pre_holiday").alias("pre_holiday"),
        *[c.alias(n) for n, c in enc.items()], (F.col("d") >= F.lit(break_on).cast("date")).cast("int").alias("i_structural_break"))


def daily(panel: DataFrame, s: Sources, scheduled: DataFrame, break_on: str) -> DataFrame:
    """The daily frame keyed by session.

    `panel` should be a written table: the calendar, the grid and the prices are read from it.
    """
    from tidemark.session import materialize

    dense = densify(panel)
    wide = materialize(_cross_section(_price_wide(_price_long(dense))))
    days = wide.select("d", "pos")
    macro = _macro(days, s)
    joined = (
        wide.join(macro.drop("pos"), "d").join(_events(days, s.events), "d").join(_calendar(days, scheduled, break_on), "d")
        .withColumn("vol_level", F.coalesce("quote", "c_rv20"))
    )
    w = W.orderBy("pos")
    minus = F.col("vol_level") - 100.0 * F.col("c_rv63") if s.quotes is not None else F.lit(0.0)
    out = joined.select(
        "*", op.row_diff(F.col("vol_level"), 5, w).alias("vol_chg_5"), minus.alias("vol_minus_rv"), (F.col("g_mom_21") * 12 * 100 - F.col("ust_3m")).alias("g_minus_tbill"))
    ranks = _expanding_pair(out.select("d", "pos", "vol_level", "c_rv63"), {"vol_level": "vol_pct", "c_rv63": "c_vol_pct"}, 252)
    frame = out.join(ranks, "d").drop("quote", "ust_3m", "effr")
    guard(frame)
    return frame


def _expanding_pair(rows: DataFrame, columns: dict[str, str], min_rows: int, day: str = "d", order: str = "pos") -> DataFrame:
    """Expanding percentiles of several columns at once: columns become the groups of one pass.

    The columns are computed deviations: the same returns in another order differ in their last digits, so values
    are compared at 12 digits, far below any difference of the data. The rank itself takes values as they are.
    """
    long = rows.unpivot([day, order], list(columns), "series", "v")
    ranked = op.expanding_rank(long.withColumn("v", F.round("v", 12)), "v", order, ["series"], min_rows)
    return ranked.groupBy(day).agg(*[F.max(F.when(F.col("series") == c, F.col("pct"))).alias(n) for c, n in columns.items()])


def monthly(dense: DataFrame, rates: DataFrame, releases: DataFrame, risk: DataFrame) -> DataFrame:
    """The month-end frame: same names on month rows, macro series lagged one month.

    `releases` are already transformed (`yoy`, `chg_3m`, `gap`).
    """
    me = W.partitionBy("entity").orderBy("month")
    run = op.running(me)
    ends = dense.groupBy("entity", "ord", F.trunc("d", "MM").alias("month")).agg(F.max_by(F.struct("px"), "d")["px"].alias("last_px"))
    ends = ends.withColumn("r", change(F.col("last_px"), F.lag("last_px").over(me)))
    px, ret = F.col("px"), F.col("ret")
    level = ends.withColumn("px", op.compound_hold(F.col("r"), me)).withColumn("ret", change(F.col("px"), F.lag("px").over(me))).withColumn("dd", change(px, F.max("px").over(run)))
    t = op.trailing(me, 12)
    loss = F.when(ret.isNotNull(), F.least(ret, F.lit(0.0)))
    long = level.withColumn("m10", op.moving_average(px, 10, me)).select(
        "ord", "month", "dd", *[op.total_return(px, k, me).alias(f"mom_{n}") for k, n in ((1, 21), (3, 63), (6, 126), (12, 252))], op.skip_return(px, 1, 12, me).alias("mom_12_1"),
        F.when(F.col("m10").isNotNull(), F.when(px > F.col("m10"), 1).otherwise(0)).alias("above_sma200"), change(F.col("m10"), F.lag("m10").over(me)).alias("sma200_slope"),
        F.when(F.count("ret").over(t) >= 12, F.stddev_samp("ret").over(t) * F.sqrt(F.lit(12.0))).alias("rv63"), (px / F.col("m10") - 1.0).alias("__dist"),
        F.when(F.count("ret").over(t) >= 12, F.sqrt(F.avg(loss * loss).over(t))).alias("downside"), F.when(F.count("dd").over(t) >= 12, F.sqrt(F.avg(F.col("dd") * F.col("dd")).over(t))).alias("ulcer"))
    long = long.withColumn("dist_vol", F.try_divide(F.col("__dist"), F.col("rv63")))
    cols = [_pick(r, c) for r in ROLES for c in ("mom_21", "mom_63", "mom_126", "mom_252")] + [_pick(r, c) for r in "csif" for c in ("mom_12_1", "dd", "above_sma200")]
    cols += [_pick("c", c) for c in ("sma200_slope", "rv63", "dist_vol", "downside", "ulcer")]
    wide = _cross_section(long.groupBy("month").agg(*cols), safe_needed=False)
    m = W.orderBy("month")
    macro = rates.groupBy(F.trunc("obs_d", "MM").alias("month")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("obs_d"))).alias(c) for c in ("spread_10y_3m", "spread_10y_2y", "ust_3m", "effr")])
    macro = macro.select("month", *[F.lag(c).over(m).alias(c) for c in ("spread_10y_3m", "spread_10y_2y", "ust_3m", "effr")])
    rel = releases.select("month", F.lag("yoy").over(m).alias("cpi_yoy"), F.lag("chg_3m").over(m).alias("cpi_chg_3m"), F.lag("gap").over(m).alias("unemp_gap"))
    index = risk.groupBy(F.trunc("obs_d", "MM").alias("month")).agg(F.round(F.avg("idx"), 6).alias("v"), F.avg("acts").alias("acts"), F.avg("threats").alias("threats"))
    index = index.withColumn("z", op.zscore(F.col("v"), 12, 12, m)).select("month", F.lag("z").over(m).alias("gpr_z"), F.lag(F.col("acts") - F.col("threats")).over(m).alias("gpr_act_minus_threat"))
    frame = wide.join(macro, "month", "left").join(rel, "month", "left").join(index, "month", "left")
    ranks = _expanding_pair(frame.select("month", F.col("month").alias("k"), "c_rv63"), {"c_rv63": "c_vol_pct"}, 36, "month", "k")
    inverted = F.col("spread_10y_3m") < 0
    frame = op.run_length(frame.join(ranks, "month", "left").withColumn("series", F.lit("curve")), inverted, ("series",), "month")
    known = F.col("spread_10y_3m").isNotNull()
    enc = calendar_encodings(F.last_day("month"))
    zero = {n: F.lit(0) for n in ("days_since_war", "days_since_crisis", "days_since_rate", "days_since_pandemic", "in_war_window", "in_crisis_window", "c_days_since_peak")}
    out = frame.select(
        *[c for c in frame.columns if c not in ("series", "run", "ust_3m", "effr")],
        F.col("c_above_sma200").alias("c_above_sma10m"), F.col("c_above_sma200").alias("c_above_sma50"), F.col("c_above_sma200").alias("c_above_sma100"), F.col("c_rv63").alias("c_rv20"),
        op.row_diff(F.col("spread_10y_3m"), 3, m).alias("spread_10y_3m_chg_63"), op.row_diff(F.col("spread_10y_2y"), 3, m).alias("spread_10y_2y_chg_63"),
        F.when(known, F.when(inverted, 1).otherwise(0)).alias("curve_inverted"), F.when(known, F.col("run").cast("double")).alias("months_inverted"),
        (F.col("ust_3m") - F.col("effr")).alias("tbill_minus_effr"), (F.col("g_mom_21") * 12.0 * 100.0 - F.col("ust_3m")).alias("g_minus_tbill"),
        F.col("c_rv63").alias("vol_level"), F.col("c_vol_pct").alias("vol_pct"), op.row_diff(F.col("c_rv63"), 1, m).alias("vol_chg_5"), F.lit(0.0).alias("vol_minus_rv"),
        F.when(F.count("c_rv63").over(op.trailing(m, 12)) >= 12, F.stddev_samp("c_rv63").over(op.trailing(m, 12))).alias("c_vvol"),
        F.when(F.col("gpr_z").isNotNull(), F.when(F.col("gpr_z") > 2, 1).otherwise(0)).alias("gpr_spike"), F.lit(1).alias("turn_of_month"),
        *[c.alias("month_no" if n == "month" else n) for n, c in enc.items()], *[c.alias(n) for n, c in zero.items()])
    guard(out)
    return out
