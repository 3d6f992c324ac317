"""Column functions that the operators share; all of them stay in the JVM.

Two null rules differ from SQL's own and are named for it: ``clip`` keeps null
(``greatest`` and ``least`` skip it), and ``ratio`` gives a chosen value where
the divisor is 0, but null where either side is null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def clean(c: Column) -> Column:
    """NaN is null: averages skip it, comparisons are unknown."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def ratio(a: Column, b: Column, at_zero: float | None = 0.0) -> Column:
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(at_zero))).otherwise(F.try_divide(a, b))


def clip(c: Column, lo: float | Column | None, hi: float | Column | None) -> Column:
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo) if not isinstance(lo, Column) else lo)
    if hi is not None:
        out = F.least(out, F.lit(hi) if not isinstance(hi, Column) else hi)
    return F.when(c.isNotNull(), out)


def log_positive(c: Column, base: float | None = None) -> Column:
    """Logarithm; 0 where the value is not positive or null."""
    return F.when(c > 0, F.ln(c) if base is None else F.log10(c) if base == 10 else F.ln(c) / math.log(base)).otherwise(F.lit(0.0))


def log1p(c: Column) -> Column:
    return F.log1p(clip(c, 0.0, None))


def digitize(c: Column, edges: Sequence[float]) -> Column:
    """Number of inner edges at or below the value; null counts as the last bin."""
    inner = list(edges)[1:-1]
    steps = sum((F.when(c >= e, 1).otherwise(0) for e in inner), F.lit(0))
    return F.when(c.isNull(), F.lit(len(inner))).otherwise(steps).cast("int")


def right_closed(c: Column, edges: Sequence[float]) -> Column:
    """Bins (e0, e1], (e1, e2], ... with the first edge included; null stays null."""
    steps = sum((F.when(c > e, 1).otherwise(0) for e in list(edges)[1:-1]), F.lit(0))
    return F.when(c.isNull() | (c < edges[0]) | (c > edges[-1]), F.lit(None)).otherwise(steps).cast("int")


def even_edges(lo: float, hi: float, n: int, pad: bool = False) -> list[float]:
    """n + 1 equally spaced edges; ``pad`` lowers the first by 0.1 % of the range."""
    lo, hi = float(lo), float(hi)
    out = [lo + (hi - lo) * i / n for i in range(n + 1)]
    if pad:
        out[0] -= (hi - lo) * 0.001
    return out


def cyclical(c: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * c / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres along the great circle; degrees in."""
    a1, b1, a2, b2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((b2 - b1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a1, b1, a2, b2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(b2 - b1) * F.cos(a2)
    x = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(b2 - b1)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def md5_mod(c: Column, n: int) -> Column:
    """The MD5 of a string as a 128-bit number, modulo n: Horner over 32-bit limbs."""
    digest, out = F.md5(c.cast("binary")), F.lit(0).cast("long")
    for i in range(4):
        limb = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        out = (out * F.lit((1 << 32) % n) + limb) % F.lit(n)
    return out


def bucket(c: Column, n: int, salt: str = "") -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), c), F.lit(n)).cast("int")


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of complete pairs; null for a constant side (the
    built-in one raises there in ANSI mode)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def percent_rank_average(c: Column, over, ties) -> Column:
    """Average rank of ties over the number of rows: ``over`` is ordered by c,
    ``ties`` partitions by c as well."""
    return (F.rank().over(over) + (F.count("*").over(ties) - 1) / 2)


UNARY = {
    "log": lambda c: F.ln(clip(c, 1e-10, None)),
    "log1p": log1p,
    "sqrt": lambda c: F.sqrt(clip(c, 0.0, None)),
    "square": lambda c: c * c,
    "cube": lambda c: c * c * c,
    "cbrt": F.cbrt,
    "abs": F.abs,
    "reciprocal": lambda c: ratio(F.lit(1.0), c, None),
    "sigmoid": lambda c: 1 / (1 + F.exp(-clip(c, -500.0, 500.0))),
    "identity": lambda c: c,
}
BINARY = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: ratio(a, b, None),
    "ratio": lambda a, b: ratio(a - b, a + b, 0.0),
    "geometric_mean": lambda a, b: F.sqrt(F.abs(a * b)),
    "harmonic_mean": lambda a, b: ratio(2 * a * b, a + b, 0.0),
    "max": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
    "min": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
}
