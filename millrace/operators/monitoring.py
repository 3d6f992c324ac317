"""What changed between two tables, over time, or between variants."""

from __future__ import annotations

import random
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalar as S
from millrace.operators.base import numeric_columns, require
from millrace.operators.text import PERSONAL, scan_personal

# Labels of the kinds of personal data.
TAGS = {
    "email": ["PII", "GDPR"],
    "phone": ["PII", "GDPR"],
    "ssn": ["PII", "SENSITIVE", "GDPR"],
    "credit_card": ["PII", "SENSITIVE", "SOX"],
    "ip_address": ["PII", "GDPR"],
}


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, rows, nulls, mean, std, min, max`` of numeric columns: one aggregation."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    v = F.col("v")
    return df.select(F.inline(F.array(*cells))).groupBy("column").agg(F.count("*").alias("rows"), F.count_if(v.isNull()).alias("nulls"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def compare_frames(before: DataFrame, after: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per numeric column of either table: its description before and
    after, and the change of its mean. Columns of one table only have nulls on
    the other side; an empty table has no rows to describe."""
    sides = []
    for name, df in (("before", before), ("after", after)):
        own = [c for c in numeric_columns(df) if columns is None or c in columns]
        d = described(df, own) if own else described(df.sparkSession.range(0).select(F.lit(0.0).alias("x")), ["x"])
        sides.append(d.select("column", *[F.col(c).alias(f"{c}_{name}") for c in d.columns[1:]]))
    both = sides[0].join(sides[1], "column", "full_outer")
    return both.withColumn("mean_change", F.col("mean_after") - F.col("mean_before"))


def profile_boolean(df: DataFrame, column: str) -> DataFrame:
    """One row: ``rows, trues, falses, nulls, true_share`` (of the rows with a value)."""
    v = F.col(column).cast("boolean")
    return df.agg(F.count("*").alias("rows"), F.count_if(v).alias("trues"), F.count_if(~v).alias("falses"), F.count_if(v.isNull()).alias("nulls"), F.avg(v.cast("double")).alias("true_share"))


def compliance_tags(df: DataFrame, least: float = 0.3, patterns: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Labels of every column that holds personal data, without repeats."""
    out: dict[str, list[str]] = {}
    for found in scan_personal(df, least, patterns or PERSONAL):
        have = out.setdefault(found["column"], [])
        have += [t for t in TAGS.get(found["kind"], ["PII"]) if t not in have]
    return out


def importance_shifts(baseline: dict[str, float], now: dict[str, float], least: float = 0.3) -> dict[str, float]:
    """Columns whose importance moved by a share of at least ``least`` of their
    baseline (by as much itself, where that is not positive)."""
    moved = {c: abs(now.get(c, 0.0) - b) / b if b > 0 else abs(now.get(c, 0.0)) for c, b in baseline.items()}
    return {c: x for c, x in moved.items() if x >= least}


# Metrics over time

HISTORY = "metric string, name string, value double, at timestamp"


def record_metrics(df: DataFrame, path: str, metric: str, values: dict[str, Column], at) -> None:
    """Append one row per named aggregate of ``df`` to the history at ``path``."""
    row = df.agg(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))]).alias("m"))
    row.select(F.lit(metric).alias("metric"), F.explode("m").alias("name", "value"), F.lit(at).cast("timestamp").alias("at")).write.mode("append").partitionBy("metric").parquet(path)


def metric_history(spark, path: str, metric: str, since=None) -> DataFrame:
    """``name, value, at`` of a metric; the folder of the metric alone is read."""
    h = spark.read.schema(HISTORY).parquet(path).where(F.col("metric") == metric)
    return (h.where(F.col("at") >= F.lit(since).cast("timestamp")) if since is not None else h).select("name", "value", "at")


def metric_trend(history: DataFrame) -> DataFrame:
    """``name, n, first, last, per_day``: the slope of a least-squares line."""
    days = F.unix_micros("at") / 86400e6
    return history.groupBy("name").agg(F.count("value").alias("n"), F.min_by("value", "at").alias("first"), F.max_by("value", "at").alias("last"), F.regr_slope(F.col("value"), days).alias("per_day"))


def backfill(source: DataFrame, path: str, time: str, compute, changed: str | None = None, unit: str = "day") -> DataFrame:
    """Write the time slices of ``compute(source)`` that are missing at ``path``
    or, given a column of change times, older than their newest row; returns
    ``slice`` of those written. Other slices stay as they are.

    Slices are compared in Spark, never listed on the driver, and replace their
    own folders alone. ``compute`` keeps the rows' ``slice``.
    """
    spark = source.sparkSession
    cut = source.withColumn("slice", F.date_trunc(unit, F.col(time)).cast("string"))
    newest = cut.where("slice is not null").groupBy("slice").agg((F.max(changed) if changed else F.lit(None)).cast("timestamp").alias("_new"))
    try:
        done = spark.read.parquet(path).groupBy(F.col("slice").cast("string").alias("slice")).agg(F.max("written").alias("_old"))
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], "slice string, _old timestamp")
    stale = newest.join(done, "slice", "left").where("_old is null or _new > _old").select("slice").checkpoint()
    rows = compute(cut.join(stale, "slice", "left_semi")).withColumn("written", F.current_timestamp())
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(path)
    return stale


# Experiments


def guardrails(df: DataFrame, variant: str, bounds: dict[str, dict[str, float]], control: str | None = None) -> DataFrame:
    """``variant, metric, mean, kind, bound`` of every bound a variant breaks.

    ``bounds`` gives a metric ``min`` and ``max`` of its mean, or
    ``max_drop``, the share it may fall below the control's. The metrics' means
    are one aggregation by variant; a variant without values breaks nothing.
    """
    require(df, [variant, *bounds])
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in bounds]
    means = df.select(F.col(variant).cast("string").alias("variant"), F.inline(F.array(*cells))).where("v is not null and variant is not null").groupBy("variant", "metric").agg(F.avg("v").alias("mean"))
    limits = [(m, k, float(x)) for m, b in bounds.items() for k, x in b.items()]
    rules = df.sparkSession.createDataFrame(limits, "metric string, kind string, bound double")
    base = means.where(F.col("variant") == control).select("metric", F.col("mean").alias("base"))
    told = means.join(F.broadcast(rules), "metric").join(F.broadcast(base), "metric", "left")
    drop = F.try_divide(F.col("base") - F.col("mean"), F.abs("base"))
    broken = ((F.col("kind") == "min") & (F.col("mean") < F.col("bound"))) | ((F.col("kind") == "max") & (F.col("mean") > F.col("bound")))
    broken = broken | ((F.col("kind") == "max_drop") & (F.col("variant") != F.lit(control)) & (drop > F.col("bound")))
    return told.where(broken).select("variant", "metric", "mean", "kind", "bound")


def sequential_bound(look: int, looks: int, alpha: float = 0.05) -> tuple[float, float]:
    """The critical value of a look and the error spent up to it, by the
    O'Brien-Fleming kind of spending function."""
    share = max(1, min(look, looks)) / looks
    z = NormalDist().inv_cdf(1 - alpha / 2)
    return z / share**0.5, 2 * (1 - NormalDist().cdf(z / share**0.5))


# Privacy


def private_columns(df: DataFrame, bounds: dict[str, tuple[float, float]], epsilon: float = 1.0, seed: int | None = None) -> DataFrame:
    """Columns clipped to their bounds, with Laplace noise of a row's own; the
    columns share epsilon. Nulls stay. Without a seed noise is drawn afresh;
    noise is drawn anew whenever a row is computed, so write the result once."""
    draws = random.Random(seed) if seed is not None else random.SystemRandom()
    new = {}
    for c, (lo, hi) in bounds.items():
        draw = [F.ln(1 - F.rand(draws.getrandbits(62))) for _ in range(2)]
        scale = (hi - lo) * len(bounds) / epsilon
        new[c] = S.clip(F.col(c).cast(T.DoubleType()), lo, hi) + (draw[0] - draw[1]) * scale
    return df.withColumns(new)
