"""Seasonal-trend decomposition by local regression (STL), per entity.

The published procedure (Cleveland and others, 1990): an inner loop smooths
the values of each phase by local lines, takes what is slow out of them again
and smooths what is left to a trend; an outer loop lets values far from the
fit weigh less. It runs in Arrow batches, one slice of an entity each.

Long entities are cut into slices of ``STEP`` periods that overlap on both
sides by what the windows reach; each slice is decomposed by itself and keeps
its core. Rows are numbered in ranges of the order column, so no task sorts a hot entity.

Edge cases: a null or NaN value has no weight, gets a trend and a season and a
null rest; an entity with fewer than two periods of rows gets nulls;
entities with a null key are one entity; rows that tie in the order are in
the order of the further order columns; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Periods of a slice's core; rows of an entity that one task numbers.
STEP, ROWS = 200, 1_000_000
#: Numbers that a smoother has in memory for its windows.
HELD = 1 << 21


def loess(y: np.ndarray, q: int, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Local lines through the q nearest of the points 1, 2, ... with tricube
    weights, at the places ``at`` (also beyond the ends); where nothing has
    weight, the nearest value."""
    n = len(y)
    size = min(q, n)
    left = np.clip(at - (q + 1) // 2 + 1, 1, n - size + 1) if q < n else np.ones(len(at), np.int64)
    # Outside, the nearest points are those at the end.
    left = np.where(at < 1, 1, np.where(at > n, n - size + 1, left))
    out, rows = np.empty(len(at)), max(1, HELD // size)
    for i in range(0, len(at), rows):
        x, l = at[i : i + rows].astype(float), left[i : i + rows]  # noqa: E741
        j = l[:, None] + np.arange(size)
        h = np.maximum(x - l, l + size - 1 - x) + (max(0, q - n) // 2)
        r = np.abs(j - x[:, None]) / np.where(h > 0, h, 1.0)[:, None]
        w = np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1 - np.minimum(r, 1.0) ** 3) ** 3, 0.0)) * weight[j - 1]
        total = w.sum(axis=1)
        w /= np.where(total > 0, total, 1.0)[:, None]
        middle = (w * j).sum(axis=1)
        spread = (w * (j - middle[:, None]) ** 2).sum(axis=1)
        steep = np.sqrt(spread) > 0.001 * (n - 1)
        slope = np.where(steep, (x - middle) / np.where(steep, spread, 1.0), 0.0)
        w *= slope[:, None] * (j - middle[:, None]) + 1
        near = y[np.clip(x, 1, n).astype(np.int64) - 1]
        out[i : i + rows] = np.where(total > 0, (w * y[j - 1]).sum(axis=1), near)
    return out


def _odd(x: float) -> int:
    n = math.ceil(x)
    return n if n % 2 else n + 1


class Windows:
    """Points of the three smoothers, by default those usually taken for a period."""

    def __init__(self, period: int, seasonal: int = 7, trend: int | None = None, low: int | None = None):
        if period < 2 or seasonal < 3 or seasonal % 2 == 0:
            raise ValueError("the period is at least 2, the seasonal window odd and at least 3")
        self.period, self.seasonal = period, seasonal
        self.trend = trend or _odd(1.5 * period / (1 - 1.5 / seasonal))
        self.low = low or _odd(period + 1)

    def reach(self) -> int:
        """Rows on each side that have any say in a slice's core, in whole periods."""
        most = max(self.trend, self.low, self.seasonal * self.period)
        return -(-2 * most // self.period) * self.period


def stl(y: np.ndarray, windows: Windows, robust: bool = False, inner: int | None = None, outer: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Season and trend of a series with at least two periods; NaN is a missing value."""
    inner, outer = inner or (2 if robust else 5), (15 if robust else 0) if outer is None else outer
    n, p = len(y), windows.period
    known = ~np.isnan(y)
    y = np.interp(np.arange(n), np.flatnonzero(known), y[known]) if known.any() else np.zeros(n)
    base = known.astype(float)
    weight, every = base.copy(), np.arange(1, n + 1)
    trend, season = np.zeros(n), np.zeros(n)
    for turn in range(outer + 1):
        for _ in range(inner):
            rest = y - trend
            cycle = np.empty(n + 2 * p)
            for phase in range(p):
                own = rest[phase::p]
                cycle[phase::p][: len(own) + 2] = loess(own, windows.seasonal, weight[phase::p], np.arange(len(own) + 2))
            slow = cycle
            for size in (p, p, 3):
                total = np.cumsum(np.concatenate([[0.0], slow]))
                slow = (total[size:] - total[:-size]) / size
            season = cycle[p : p + n] - loess(slow, windows.low, np.ones(n), every)
            trend = loess(y - season, windows.trend, weight, every)
        if turn < outer:
            off = np.abs(y - season - trend)
            far = 6 * np.median(off[known]) if known.any() else 0.0
            u = off / far if far > 0 else np.zeros(n)
            weight = base * np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - np.minimum(u, 1.0) ** 2) ** 2, 0.0))
    return season, trend


def _same(left: str, right: str, by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in by], F.lit(True))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, rows: int = ROWS) -> DataFrame:
    """Running numbers from 0 within each entity, and how many rows it has
    (``<name>_of``): ranges of the first order column are numbered apart and set
    off by the rows before them."""
    first = F.col(f"`{order[0]}`").cast("double")
    counts = df.groupBy(*by).agg(F.count("*").alias(f"{name}_of"))
    most = counts.agg(F.max(f"{name}_of")).first()[0] or 0
    parts = min(1000, -(-most // rows))
    if parts > 1:
        at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        counts = df.groupBy(*by).agg(F.count("*").alias(f"{name}_of"), F.percentile_approx(first, at, 10_000).alias("_cuts"))
    else:
        counts = counts.withColumn("_cuts", F.array().cast("array<double>"))
    found = df.alias("a").join(counts.alias("b"), _same("a", "b", by)).select("a.*", f"b.{name}_of", "b._cuts")
    # Equal values are in one part; null comes first.
    found = found.withColumn("_part", F.when(first.isNull(), -1).otherwise(F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < first)))).drop("_cuts")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts_of = found.groupBy(*by, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    found = found.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1)
    both = found.alias("a").join(parts_of.alias("b"), _same("a", "b", [*by, "_part"])).select("a.*", "b._before")
    return both.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")


def decompose_stl(df: DataFrame, column: str, period: int, by: list[str], order: list[str], robust: bool = False, seasonal: int = 7, trend: int | None = None, low: int | None = None, step: int = STEP) -> DataFrame:
    """Adds ``<c>_trend``, ``<c>_seasonal``, ``<c>_residual`` and the entity's
    ``<c>_seasonal_strength``: the share of the season in what the trend leaves."""
    windows = Windows(period, seasonal, trend, low)
    core, reach = step * period, windows.reach()
    made = [f"{column}_{x}" for x in ("trend", "seasonal", "residual")]
    rows = numbered(df, by, order, "_no")
    # A row belongs to the slice of its core and to those that reach it.
    low_slice = F.greatest(F.floor((F.col("_no") - core - reach) / core) + 1, F.lit(0))
    high_slice = F.floor((F.col("_no") + reach) / core)
    last = F.floor((F.col("_no_of") - 1) / core)
    rows = rows.withColumn("_slice", F.explode(F.sequence(low_slice.cast("long"), F.least(high_slice, last).cast("long"))))
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in made]])

    def run(table: pa.Table) -> pa.Table:
        number = table.column("_no").to_numpy()
        table = table.take(pa.array(np.argsort(number, kind="stable")))
        number, slice_ = table.column("_no").to_numpy(), table.column("_slice")[0].as_py()
        y = table.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        own = np.flatnonzero((number >= slice_ * core) & (number < (slice_ + 1) * core))
        kept = table.take(pa.array(own)).drop_columns(["_no", "_no_of", "_slice"])
        if table.column("_no_of")[0].as_py() < 2 * period or len(y) < 2 * period or np.isnan(y).all():
            parts = [pa.nulls(len(own), pa.float64())] * 3
        else:
            season, slow = stl(y, windows, robust)
            parts = [pa.array(v[own], pa.float64(), from_pandas=True) for v in (slow, season, y - slow - season)]
        for name, part in zip(made, parts, strict=True):
            kept = kept.append_column(name, part)
        return kept

    out = rows.groupBy(*by, "_slice").applyInArrow(run, schema)
    rest, season = F.col(made[2]), F.col(made[1])
    of = out.groupBy(*by).agg(F.var_pop(rest).alias("_r"), F.var_pop(rest + season).alias("_both"))
    strength = F.when(F.col("b._both") > 0, F.greatest(F.lit(0.0), 1 - F.col("b._r") / F.col("b._both"))).when(F.col("b._both").isNotNull(), 0.0)
    return out.alias("a").join(of.alias("b"), _same("a", "b", by)).select("a.*", strength.alias(f"{column}_seasonal_strength"))
