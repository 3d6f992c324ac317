"""Dates, and features over ordered rows.

A window needs an order that is unique within its partition; without one the
operators refuse to run. Without a partition Spark sorts all rows in one task:
give an entity wherever there is one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalar as S
from millrace.functions.quantiles import average_ranks
from millrace.operators.base import Operator, maybe_broadcast, numeric_columns, register, time_columns

PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
    "dayofweek": F.weekday, "dayofyear": F.dayofyear, "weekofyear": F.weekofyear,
    "is_weekend": lambda c: (F.weekday(c) >= 5).cast("int"),
    "is_month_start": lambda c: (F.dayofmonth(c) == 1).cast("int"),
    "is_month_end": lambda c: (F.to_date(c) == F.last_day(c)).cast("int"),
    "is_quarter_start": lambda c: (F.to_date(c) == F.to_date(F.date_trunc("quarter", c))).cast("int"),
    "is_quarter_end": lambda c: (F.date_add(F.to_date(c), 1) == F.to_date(F.date_trunc("quarter", F.date_add(F.to_date(c), 1)))).cast("int"),
    "is_year_start": lambda c: ((F.month(c) == 1) & (F.dayofmonth(c) == 1)).cast("int"),
    "is_year_end": lambda c: ((F.month(c) == 12) & (F.dayofmonth(c) == 31)).cast("int"),
}
PERIODS = {"month": 12, "day": 31, "hour": 24, "minute": 60, "dayofweek": 7, "dayofyear": 365}
UNITS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0, "weeks": 604800.0}


def stamp(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


class Temporal(Operator):
    kind = staticmethod(time_columns)


@register("components", "temporal", "parts of a date")
class DateParts(Temporal):
    def __init__(self, columns=None, parts=("year", "month", "day", "dayofweek", "hour", "is_weekend"), cyclical=True):
        super().__init__(columns)
        self.parts, self.cyclical = parts, cyclical

    def expressions(self, df):
        out = {}
        for c in self.columns:
            ts = F.try_to_timestamp(c) if isinstance(df.schema[c].dataType, T.StringType) else stamp(c)
            for p in self.parts:
                out[f"{c}_{p}"] = PARTS[p](ts)
                if self.cyclical and p in PERIODS:
                    out[f"{c}_{p}_sin"], out[f"{c}_{p}_cos"] = S.cyclical(PARTS[p](ts), PERIODS[p])
        return out


@register("holidays", "temporal", "distance to fixed holidays")
class Holidays(Temporal):
    """Days to the next and from the last of fixed dates (month, day)."""

    #: New Year, Independence Day, Christmas, New Year's Eve.
    DATES = ((1, 1), (7, 4), (12, 25), (12, 31))

    def __init__(self, columns=None, dates: Sequence[tuple[int, int]] = DATES, near=2):
        super().__init__(columns)
        self.dates, self.near = dates, near

    def expressions(self, df):
        out = {}
        for c in self.columns:
            day = F.to_date(stamp(c))
            found = [F.datediff(F.make_date(F.year(day) + y, F.lit(m), F.lit(d)), day) for y in (-1, 0, 1) for m, d in self.dates]
            ahead = F.least(*[F.when(x >= 0, x) for x in found])
            behind = F.least(*[F.when(x <= 0, -x) for x in found])
            out |= {f"{c}_is_holiday": (ahead == 0).cast("int"), f"{c}_days_to_holiday": ahead, f"{c}_days_from_holiday": behind, f"{c}_near_holiday": (F.least(ahead, behind) <= self.near).cast("int")}
        return out


@register("time_difference", "temporal", "time between dates, or to a reference")
class TimeDifference(Temporal):
    def __init__(self, columns=None, pairs=None, reference: str | None = None, units=("days",)):
        super().__init__(columns)
        self.pairs, self.reference, self.units = pairs, reference, units

    def expressions(self, df):
        pairs = self.pairs if self.pairs is not None else list(zip(self.columns, self.columns[1:], strict=False))
        out = {}
        for u in self.units:
            for a, b in pairs:
                out[f"{a}_to_{b}_{u}"] = (F.unix_micros(stamp(b)) - F.unix_micros(stamp(a))) / (1e6 * UNITS[u])
            if self.reference is not None:
                at = F.lit(self.reference).cast("timestamp")
                out |= {f"{c}_age_{u}": (F.unix_micros(at) - F.unix_micros(stamp(c))) / (1e6 * UNITS[u]) for c in self.columns}
        return out


@register("fourier", "temporal", "waves of given periods")
class Fourier(Temporal):
    PERIODS = {"yearly": 365.25, "weekly": 7.0, "monthly": 30.44}

    def __init__(self, column, periods=None, terms=3):
        super().__init__([column])
        self.periods, self.terms = periods or self.PERIODS, terms

    def aggregates(self, df):
        return {"base": F.min(F.unix_micros(stamp(self.columns[0])))}

    def expressions(self, df):
        t = (F.unix_micros(stamp(self.columns[0])) - F.lit(self.state["base"])) / 86400e6
        out = {}
        for name, p in self.periods.items():
            for k in range(1, self.terms + 1):
                out[f"fourier_{name}_sin_{k}"], out[f"fourier_{name}_cos_{k}"] = S.cyclical(t * k, p)
        return out


class Ordered(Operator):
    """Base of features over ordered rows."""

    def __init__(self, columns=None, by: str | list[str] | None = None, order: str | list[str] | None = None):
        super().__init__(columns)
        self.by = [by] if isinstance(by, str) else list(by or [])
        self.order = [order] if isinstance(order, str) else list(order or [])
        if not self.order:
            raise ValueError("an order is needed: rows of a DataFrame have none of their own")

    def pick(self, df):
        return super().pick(df) if self.columns is not None else [c for c in numeric_columns(df) if c not in (*self.by, *self.order)]

    @property
    def window(self):
        return Window.partitionBy(*self.by).orderBy(*self.order)


@register("lag", "temporal", "earlier values")
class Lag(Ordered):
    def __init__(self, columns=None, lags=(1, 7, 14, 28), by=None, order=None, fill=None):
        super().__init__(columns, by, order)
        self.lags, self.fill = lags, fill

    def expressions(self, df):
        out = {f"{c}_lag_{k}": F.lag(c, k).over(self.window) for c in self.columns for k in self.lags}
        return out if self.fill is None else {k: F.coalesce(v, F.lit(self.fill)) for k, v in out.items()}


@register("diff", "temporal", "changes against earlier values")
class Diff(Ordered):
    """Relative changes fill nulls forward first."""

    def __init__(self, columns=None, periods=(1, 7), percent=True, by=None, order=None):
        super().__init__(columns, by, order)
        self.periods, self.percent = periods, percent

    def transform(self, df):
        filled = {f"_ff_{c}": F.last(c, True).over(self.window.rowsBetween(Window.unboundedPreceding, 0)) for c in self.columns if self.percent}
        out = super().transform(df.withColumns(filled))
        return out.drop(*filled)

    def expressions(self, df):
        out = {}
        for c in self.columns:
            for p in self.periods:
                out[f"{c}_diff_{p}"] = F.col(c) - F.lag(c, p).over(self.window)
                if self.percent:
                    before = F.lag(f"_ff_{c}", p).over(self.window)
                    out[f"{c}_pct_change_{p}"] = S.ratio(F.col(f"_ff_{c}") - before, before, None)
        return out


FRAME = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "count": F.count, "median": lambda c: F.percentile(c, F.lit(0.5)), "std_pop": F.stddev_pop}


def shape(v: Column, stat: str, frame) -> Column:
    """Sample skewness (of three values or more) or excess kurtosis (of four) in
    a frame, corrected for its size; null where all values are the same."""
    n = F.count(v).over(frame)
    if stat == "skew":
        return F.when((n > 2) & (F.max(v).over(frame) > F.min(v).over(frame)), F.skewness(v).over(frame) * F.sqrt(n * (n - 1)) / (n - 2))
    return F.when((n > 3) & (F.max(v).over(frame) > F.min(v).over(frame)), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v).over(frame) + 6))


def framed(c: str, stat: str, frame, least: int) -> Column:
    v = F.col(c).cast("double")
    if stat in ("skew", "kurt"):
        return F.when(F.count(v).over(frame) >= least, shape(v, stat, frame))
    return F.when(F.count(v).over(frame) >= least, FRAME[stat](v).over(frame))


@register("rolling", "temporal", "statistics of the last rows")
class Rolling(Ordered):
    def __init__(self, columns=None, windows=(7, 14, 30), statistics=("mean", "std"), by=None, order=None, least=1, center=False):
        super().__init__(columns, by, order)
        self.windows, self.statistics, self.least, self.center = windows, statistics, least, center

    def frame(self, w: int):
        after = (w - 1) // 2 if self.center else 0
        return self.window.rowsBetween(after - w + 1, after)

    def expressions(self, df):
        return {f"{c}_rolling_{w}_{s}": framed(c, s, self.frame(w), self.least) for c in self.columns for w in self.windows for s in self.statistics}


@register("expanding", "temporal", "statistics of all rows so far")
class Expanding(Ordered):
    def __init__(self, columns=None, statistics=("mean", "std", "min", "max", "sum", "count"), by=None, order=None, least=1):
        super().__init__(columns, by, order)
        self.statistics, self.least = statistics, least

    def expressions(self, df):
        frame = self.window.rowsBetween(Window.unboundedPreceding, 0)
        return {f"{c}_expanding_{s}": framed(c, s, frame, self.least) for c in self.columns for s in self.statistics}


@register("time_to_event", "temporal", "time to the next and since the last event")
class TimeToEvent(Ordered):
    def __init__(self, time: str, event: str, by=None, order=None, unit="days"):
        super().__init__([event], by, order or [time])
        self.time, self.event, self.unit = time, event, unit

    def expressions(self, df):
        at = F.when(F.col(self.event).cast("boolean"), F.unix_micros(stamp(self.time)))
        now, unit = F.unix_micros(stamp(self.time)), 1e6 * UNITS[self.unit]
        # From the end, the next event is the last one seen: a running value, where a frame to the end is summed up anew for each row.
        back = Window.partitionBy(*self.by).orderBy(*[F.desc(c) for c in self.order])
        ahead = F.last(at, True).over(back.rowsBetween(Window.unboundedPreceding, -1))
        behind = F.last(at, True).over(self.window.rowsBetween(Window.unboundedPreceding, -1))
        return {f"time_to_next_{self.event}_{self.unit}": (ahead - now) / unit, f"time_since_last_{self.event}_{self.unit}": (now - behind) / unit}


@register("cumulative", "temporal", "running sums, extrema and ranks")
class Cumulative(Ordered):
    def expressions(self, df):
        frame = self.window.rowsBetween(Window.unboundedPreceding, 0)
        return {f"{c}_cum{n}": f(F.col(c)).over(frame) for c in self.columns for n, f in (("sum", F.sum), ("max", F.max), ("min", F.min))}


def percent_rank(df: DataFrame, c: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``<c>_rank``, the average rank of ties over the number of
    values; null without a value. Without a group, values are counted first and
    ranked in slices of their range, and the ranks join back."""
    if by:
        over, ties, group = Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last()), Window.partitionBy(*by, c), Window.partitionBy(*by)
        return df.withColumn(f"{c}_rank", F.when(F.col(c).isNotNull(), S.percent_rank_average(F.col(c), over, ties) / F.count(c).over(group)))
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("k"))
    total = counts.agg(F.sum("k")).first()[0] or 1
    ranks = average_ranks(counts).select(F.col("v").alias("_v"), (F.col("rank") / total).alias(f"{c}_rank"))
    return df.join(maybe_broadcast(ranks), F.col(c).cast("double") == F.col("_v"), "left").drop("_v")


def exponential(df: DataFrame, columns: list[str], by: list[str], order: list[str], spans: Sequence[int]) -> DataFrame:
    """Exponentially weighted mean and deviation (adjusted weights), per entity.

    Rows so far back that their weight is lost to rounding (below 1e-18 of the
    newest) are out of the frame, so an entity of any length passes through one
    sorted window that holds about 20 rows for each unit of the span. A null
    keeps the values of the row before it; one value has no deviation.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_i", F.row_number().over(w))
    for c in columns:
        out = out.withColumn("_x", S.clean(F.col(c)))
        for s in spans:
            keep = F.lit(1 - 2 / (s + 1))
            back = math.ceil(math.log(1e-18) / math.log(1 - 2 / (s + 1))) if s > 1 else 0
            seen = F.collect_list(F.when(F.col("_x").isNotNull(), F.struct("_i", "_x"))).over(w.rowsBetween(-back, 0))
            out = out.withColumn("_seen", F.when(F.col("_x").isNotNull(), seen))
            weights = F.transform("_seen", lambda r: F.pow(keep, F.col("_i") - r["_i"]))  # noqa: B023
            out = out.withColumn("_w", weights).withColumn("_v", F.transform("_seen", lambda r: r["_x"]))
            total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)
            out = out.withColumn("_s", total(F.col("_w"))).withColumn("_m", total(F.zip_with("_w", "_v", lambda a, x: a * x)) / F.nullif(F.col("_s"), F.lit(0.0)))
            spread = total(F.zip_with("_w", "_v", lambda a, x: a * (x - F.col("_m")) * (x - F.col("_m"))))
            free = F.col("_s") * F.col("_s") - total(F.transform("_w", lambda a: a * a))
            deviation = F.when(F.size("_seen") > 1, F.sqrt(F.try_divide(spread * F.col("_s"), free)))
            far = w.rowsBetween(Window.unboundedPreceding, 0)
            # A struct, so that a first value carries its missing deviation along.
            out = out.withColumn("_e", F.when(F.col("_seen").isNotNull(), F.struct(F.col("_m").alias("m"), deviation.alias("d")))).withColumn("_e", F.last("_e", True).over(far))
            out = out.withColumns({f"{c}_ewm_{s}_mean": F.col("_e.m"), f"{c}_ewm_{s}_std": F.col("_e.d")})
    return out.drop("_i", "_x", "_seen", "_w", "_v", "_s", "_m", "_e")


class TimeSeries(Ordered):
    """Lags, rolling and expanding statistics, changes and date parts in one
    projection over one ordering."""

    def __init__(self, time: str, columns=None, by=None, order=None, lags=(1, 7), windows=(7,), expanding=False, percent=False, parts=True):
        super().__init__(columns, by, order or [time])
        self.time, self.lags, self.windows, self.use_expanding, self.percent, self.parts = time, lags, windows, expanding, percent, parts

    def expressions(self, df):
        args = {"by": self.by, "order": self.order}
        out = Lag(self.columns, self.lags, **args).expressions(df) | Rolling(self.columns, self.windows, **args).expressions(df)
        if self.use_expanding:
            out |= Expanding(self.columns, **args).expressions(df)
        out |= {f"{c}_diff_1": F.col(c) - F.lag(c, 1).over(self.window) for c in self.columns}
        if self.parts:
            out |= DateParts([self.time]).expressions(df)
        return out


def decompose(df: DataFrame, column: str, period: int, by: list[str], order: list[str], model: str = "additive") -> DataFrame:
    """Classical decomposition: centred moving average, phase means, rest.

    Adds ``<c>_trend``, ``<c>_seasonal``, ``<c>_residual``; rows whose centred
    window is not full have no trend.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    v, half = F.col(column).cast("double"), period // 2
    frame = w.rowsBetween(-half, half)
    full = F.count(v).over(frame) == 2 * half + 1
    if period % 2:
        trend = F.avg(v).over(frame)
    else:  # the outer two count half
        trend = (F.sum(v).over(frame) - (F.lag(v, half).over(w) + F.lead(v, half).over(w)) / 2) / period
    out = df.withColumn("_phase", (F.row_number().over(w) - 1) % period).withColumn(f"{column}_trend", F.when(full, trend))
    rest = v - F.col(f"{column}_trend") if model == "additive" else S.ratio(v, F.col(f"{column}_trend"), None)
    out = out.withColumn("_rest", rest).withColumn("_mean", F.avg("_rest").over(Window.partitionBy(*by, "_phase")))
    level = F.avg("_phase_mean").over(Window.partitionBy(*by))
    out = out.withColumn("_phase_mean", F.col("_mean"))
    centred = F.col("_mean") - level if model == "additive" else F.col("_mean") / level
    out = out.withColumn(f"{column}_seasonal", centred)
    left = v - F.col(f"{column}_trend") - F.col(f"{column}_seasonal") if model == "additive" else v / F.col(f"{column}_trend") / F.col(f"{column}_seasonal")
    return out.withColumn(f"{column}_residual", left).drop("_phase", "_rest", "_mean", "_phase_mean")
