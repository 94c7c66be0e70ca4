"""Allocation vectors as ARRAY<DOUBLE>; position 0 is the safe component."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hot(position: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == position, 1.0).otherwise(0.0))


def total(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)


def weight_status(w: Column, size: int) -> Column:
    """Why a vector is unusable, or 'ok'."""
    bad = F.exists(w, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    negative = F.exists(w, lambda x: x < 0)
    return (
        F.when(w.isNull(), "missing")
        .when(F.size(w) != size, "wrong length")
        .when(bad, "not finite")
        .when(negative, "negative")
        .when(total(w) <= 0, "zero sum")
        .otherwise("ok")
    )


def normalized(w: Column, size: int) -> Column:
    """Valid vectors scaled to sum 1 (only when they are off by more than 1e-6), else NULL."""
    s = total(w)
    scaled = F.when(F.abs(s - 1.0) > 1e-6, F.transform(w, lambda x: x / s)).otherwise(w)
    return F.when(weight_status(w, size) == "ok", scaled)


def same(a: Column, b: Column, atol: float = 1e-8) -> Column:
    """Component-wise equality within atol plus the 1e-5 relative slack of the usual closeness test."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + 1e-5 * F.abs(y)), lambda ok: ok)


def safe_only_move(current: Column, target: Column) -> Column:
    """The move differs, does not cut component 0 and raises no other component."""
    no_cut = F.get(target, F.lit(0)) >= F.get(current, F.lit(0)) - 1e-8
    steps = F.zip_with(current, target, lambda x, y: y - x)
    no_raise = F.forall(F.slice(steps, 2, F.size(steps) - 1), lambda x: x <= 1e-8)
    return ~same(current, target) & no_cut & no_raise


def top_position(w: Column) -> Column:
    """0-based position of the largest component; the first one wins ties."""
    return (F.array_position(w, F.array_max(w)) - 1).cast("int")


def dominant(w: Column, names: Column) -> Column:
    """Name of the component holding at least half, else MIX."""
    return F.when(F.array_max(w) + 1e-9 >= 0.5, F.get(names, top_position(w))).otherwise(F.lit("MIX"))


def chosen_position(w: Column) -> Column:
    """Single-call position; a split without a half counts as the safe component."""
    return F.when(F.array_max(w) + 1e-9 >= 0.5, top_position(w)).otherwise(F.lit(0))


def renormalized(p: Column) -> Column:
    s = total(p)
    return F.transform(p, lambda x: x / F.when(s == 0, F.lit(1.0)).otherwise(s))


def policy_position(p: Column, mu: Column, min_prob: float = 0.34) -> Column:
    """Arg-max of probability times mean excess, component 0 scored at 0; falls back to 0."""
    score = F.transform(F.zip_with(p, mu, lambda x, m: x * m), lambda x, i: F.when(i == 0, 0.0).otherwise(x))
    best = top_position(score)
    take = (best != 0) & (F.get(p, best) >= min_prob) & (F.get(mu, best) > 0) & (F.get(score, best) > 0)
    return F.when(p.isNotNull(), F.when(take, best).otherwise(F.lit(0)))


def squared_error(p: Column, position: Column) -> Column:
    """Sum over classes of (p - one_hot)^2 for one row."""
    parts = F.transform(p, lambda x, i: F.pow(x - F.when(i == position, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
