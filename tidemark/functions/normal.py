"""Standard normal probability and quantile as column expressions, each with the same formula as DuckDB text.

The probability is Simpson's rule over [0, z] with PANELS panels: for |z| <= REACH its error is below
1.2 * REACH^5 / (180 * PANELS^4), 4e-9; beyond REACH the true value is within 1e-15 of 0 or 1 and REACH stands
for z. The quantile is Newton's iteration from 0 on that probability; it climbs to the root from one side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PANELS, REACH, STEPS = 512, 8.0, 60
PEAK = 1 / math.sqrt(2 * math.pi)


def density(z: Column) -> Column:
    return F.lit(PEAK) * F.exp(-0.5 * z * z)


def probability(z: Column) -> Column:
    """P(X <= z); NULL and NaN give NULL."""
    x = F.greatest(F.least(z, F.lit(REACH)), F.lit(-REACH))

    def panel(i):
        weight = F.when(i.isin(0, PANELS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        at = x * i / PANELS
        return weight * F.exp(-0.5 * at * at)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(PANELS)), F.lit(0.0), lambda s, i: s + panel(i))
    return F.when(z.isNotNull() & ~F.isnan(z), 0.5 + x * total * (PEAK / (3 * PANELS)))


def quantile(p: Column) -> Column:
    """z with P(X <= z) = p for 0 < p < 1."""
    upper = F.greatest(p, 1 - p)
    z = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), lambda z, _: z + (upper - probability(z)) / density(z))
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -z).otherwise(z))


def probability_sql(z: str) -> str:
    x = f"greatest(least({z}, {REACH}::DOUBLE), -{REACH}::DOUBLE)"
    return (f"CASE WHEN {z} IS NOT NULL THEN (0.5 + {x} * list_sum(list_transform(range(0, {PANELS + 1}), lambda i: CASE WHEN i IN (0, {PANELS}) THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
            f" * exp(-0.5 * ({x} * i / {PANELS}) * ({x} * i / {PANELS})))) * {PEAK / (3 * PANELS)!r}::DOUBLE) END")


def quantile_sql(name: str, source: str, p: str) -> str:
    """A recursive CTE `name`(z) over the one row of `source`, for p >= 0.5."""
    return f"""{name}_steps AS (SELECT 0 AS step, 0.0::DOUBLE AS z, {p} AS p FROM {source}
      UNION ALL SELECT step + 1, z + (p - ({probability_sql('z')})) / ({PEAK!r}::DOUBLE * exp(-0.5 * z * z)), p FROM {name}_steps WHERE step < {STEPS}),
    {name} AS (SELECT z FROM {name}_steps WHERE step = {STEPS})"""
