"""Numeric expressions that stay safe under ANSI mode and on empty input."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 when there is no whole."""
    return F.coalesce(
        F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)
    )


def percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * share(part, whole)


def double_literal(value: float) -> str:
    """A double as SQL text; infinities and NaN have no numeric form there."""
    return f"{value!r}D" if math.isfinite(value) else f"CAST('{value}' AS DOUBLE)"


EULER_GAMMA = 0.5772156649015329


def digamma(n: Column) -> Column:
    """Digamma at positive whole numbers.

    psi(n) = psi(n + 6) - sum of 1 / (n + j), with the asymptotic series at n + 6,
    where its first dropped term is below 1e-12.
    """
    x = n.cast("double") + F.lit(6.0)
    square = F.lit(1.0) / (x * x)
    series = F.log(x) - F.lit(0.5) / x - square * (
        F.lit(1.0 / 12)
        - square * (F.lit(1.0 / 120) - square * (F.lit(1.0 / 252) - square * (F.lit(1.0 / 240) - square * F.lit(1.0 / 132))))
    )
    steps = sum((F.lit(1.0) / (n.cast("double") + F.lit(float(j))) for j in range(1, 6)), F.lit(1.0) / n.cast("double"))
    return series - steps
