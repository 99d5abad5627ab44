"""Exact rates, truncation and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % quantile of the normal distribution used for intervals.
Z = 1.959963984540054


def trunc4(n: Column, d: Column) -> Column:
    """floor(n / d * 10^4) / 10^4 in integers, null for d = 0; negative n round down too."""
    n, d = n.cast("long"), d.cast("long")
    scaled = F.lit(10000) * n
    return F.when(d != 0, (scaled - F.pmod(scaled, F.when(d != 0, d))) / F.when(d != 0, d) / F.lit(10000.0))


def pct(value: Column) -> Column:
    """A share as per cent, rounded down to 0.1."""
    return (F.floor(value.cast("string").cast("decimal(20,10)") * 1000) / 10).cast("double")


def wilson(c: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson interval of c of n; (0, 1) without observations."""
    c, n = c.cast("double"), n.cast("double")
    p, m = c / F.when(n > 0, n), F.when(n > 0, n)
    centre = p + z * z / (2 * m)
    spread = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    below = F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / m))
    above = F.least(F.lit(1.0), (centre + spread) / (1 + z * z / m))
    return F.when(n > 0, below).otherwise(0.0), F.when(n > 0, above).otherwise(1.0)


def fraction(n: Column, d: Column) -> Column:
    return F.format_string("%d/%d", n.cast("long"), d.cast("long"))
