"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    return F.round(c, 6)


def big(c: Column) -> Column:
    return c.cast("bigint")


def flag(c: Column) -> Column:
    """Boolean to 0/1, keeping NULL."""
    return c.cast("int").cast("bigint")


def coerce_number(name: str) -> Column:
    """Text to DOUBLE; text that is not a number, and NaN, become NULL."""
    parsed = F.expr(f"try_cast(trim({name}) AS DOUBLE)")
    return F.nanvl(parsed, F.lit(None).cast("double"))


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b with NULL for a zero or missing denominator."""
    return F.try_divide(a, b)


def change(a: Column, b: Column) -> Column:
    return F.try_divide(a, b) - 1.0


def full_window(value: Column, counted: Column, window, rows: int) -> Column:
    """value over window, NULL until `rows` non-null observations are inside it."""
    return F.when(F.count(counted).over(window) >= rows, value)


def calendar_encodings(d: Column) -> dict[str, Column]:
    month = F.month(d)
    angle = 2.0 * F.lit(3.141592653589793) * month / 12.0
    return {
        "month": month,
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
        "nov_apr": F.when(month.isin(11, 12, 1, 2, 3, 4), 1).otherwise(0),
        "pres_cycle": F.year(d) % 4,
    }


def verdict(excess: Column, low: Column, high: Column, dsr_ok: Column) -> Column:
    """Beat / Underperformed / Inconclusive; a missing dsr can never beat."""
    return (
        F.when((excess > 0) & (low > 0) & F.coalesce(dsr_ok, F.lit(False)), F.lit("Beat"))
        .when((excess < 0) & (high < 0), F.lit("Underperformed"))
        .otherwise(F.lit("Inconclusive"))
    )


def comparison_sentence(name: Column, baseline: Column, excess: Column, low: Column, high: Column, label: Column) -> Column:
    return F.concat(
        F.format_string(
            "%s against %s: excess growth %s points a year, 90%% interval %s to %s, verdict %s.",
            name, baseline,
            *[F.round(c * 100, 2).cast("decimal(18,2)").cast("string") for c in (excess, low, high)],
            label,
        ),
        F.when(excess < 0, F.lit(" The point estimate is below this baseline.")).otherwise(F.lit("")),
    )


def stance(ord_col: Column) -> Column:
    return F.when(ord_col == 0, "Shelter").when(ord_col == 1, "Neutral").otherwise("Risk On")


def suspect_rule(asset: Column, asset_wanted: str, hold: Column, trigger: Column, tokens: list[str]) -> Column:
    """One-session rules on a stale-priced asset that key off a same-day move elsewhere."""
    text = F.lower(trigger)
    hit = F.lit(False)
    for token in tokens:
        hit = hit | text.contains(token)
    return (F.upper(asset) == asset_wanted) & (hold <= 1) & hit


def normalize_headers(df: DataFrame) -> DataFrame:
    """Collapse runs of blanks inside column names and trim their ends."""
    return df.toDF(*[" ".join(name.split()) for name in df.columns])


def keep_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[F.col(f"`{name}`") for name in wanted if name in have])
