"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def rescale(c: Column, lo: Column, hi: Column) -> Column:
    """Min-max position of ``c`` inside [lo, hi]; not clipped."""
    return (c - lo) / (hi - lo + EPS)


def guarded(condition: Column, value: Column, otherwise=0.0) -> Column:
    """``value`` where ``condition`` holds, the documented fallback elsewhere."""
    return F.when(condition, value).otherwise(F.lit(otherwise))


def correlation(x, y) -> Column:
    """Aggregate: Pearson correlation over rows that carry both sides.

    NULL for a constant side (the built-in raises there in ANSI mode).
    """
    x, y = (c if isinstance(c, Column) else F.col(c) for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def hash32(*parts) -> Column:
    """Integer in [0, 2^32) that depends only on the parts, on any partitioning and engine."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    return hash32(*parts) / F.lit(4294967296.0)


def gaussian(*parts) -> Column:
    """Standard normal draw (Box-Muller over two hashed uniforms)."""
    u1 = (hash32(*parts, "r") + F.lit(0.5)) / F.lit(4294967296.0)
    u2 = uniform(*parts, "t")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def rounded(names, digits=6):
    """Select-list entries that round the named double columns."""
    return [F.round(F.col(n), digits).alias(n) for n in names]


def linspace_grid(start: float, count: int, step: float, digits: int = 6):
    """Array literal column of an evenly spaced parameter grid."""
    return F.array(*[F.lit(round(start + i * step, digits)) for i in range(count)])
