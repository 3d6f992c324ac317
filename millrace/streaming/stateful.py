"""Structured Streaming: event-time windows, and state per entity.

Event-time windows use Spark's own. Statistics over all or the last rows of an
entity keep state: one group per entity, one micro-batch at a time, with Arrow
batches in ``applyInPandasWithState``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions import scalar as S
from millrace.operators.temporal import stamp


def tumbling(df: DataFrame, time: str, value: str, size: str, by: list[str] | None = None, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count, sum and mean per window of event time (sliding with ``slide``)."""
    df = df.withColumn(time, stamp(time))
    if df.isStreaming:
        df = df.withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.groupBy(w.alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), *(by or []), "n", "sum", "mean")


def sessions(df: DataFrame, time: str, value: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    df = df.withColumn(time, stamp(time))
    if df.isStreaming:
        df = df.withWatermark(time, late)
    return df.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("sum")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n", "sum")


def interactions(df: DataFrame, pairs: list[tuple[str, str]], operations=("multiply", "divide", "add", "subtract")) -> DataFrame:
    """Stateless pair features, on batch and streaming frames alike."""
    return df.withColumns({f"{a}_{op}_{b}": S.BINARY[op](F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs for op in operations})


class Moments:
    """Count, mean, spread and extremes; two of them merge (Chan's formula)."""

    def __init__(self, n=0, mean=0.0, m2=0.0, lo=math.inf, hi=-math.inf):
        self.n, self.mean, self.m2, self.lo, self.hi = n, mean, m2, lo, hi

    @classmethod
    def of(cls, x: pd.Series) -> Moments:
        x = x.dropna().astype(float)
        return cls(len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum()), float(x.min()), float(x.max())) if len(x) else cls()

    def merge(self, o: Moments) -> Moments:
        n = self.n + o.n
        if not n:
            return Moments()
        d = o.mean - self.mean
        return Moments(n, self.mean + d * o.n / n, self.m2 + o.m2 + d * d * self.n * o.n / n, min(self.lo, o.lo), max(self.hi, o.hi))

    def std(self) -> float | None:
        return math.sqrt(self.m2 / (self.n - 1)) if self.n > 1 else None


def _stateful(df: DataFrame, key: str, columns: list[str], schema: str, step: Callable[[dict, pd.DataFrame], tuple[dict, dict]]) -> DataFrame:
    """``step(state, batch) -> state, row`` for each entity in a micro-batch."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {}
        row: dict = {}
        for pdf in batches:
            kept, row = step(kept, pdf)
        state.update((json.dumps(kept),))
        yield pd.DataFrame([{key: k[0], **row}])

    return df.select(key, *columns).groupBy(key).applyInPandasWithState(run, schema, "s string", "update", GroupStateTimeout.NoTimeout)


def running(df: DataFrame, key: str, value: str) -> DataFrame:
    """Statistics of all of an entity's rows so far, one row per entity and
    micro-batch: ``key, n, mean, std, min, max``."""

    def step(kept: dict, pdf: pd.DataFrame):
        m = Moments(**kept).merge(Moments.of(pdf[value])) if kept else Moments.of(pdf[value])
        some = m.n > 0
        return (m.__dict__ if some else {}), {"n": m.n, "mean": m.mean if some else None, "std": m.std(), "min": m.lo if some else None, "max": m.hi if some else None}

    kind = df.schema[key].dataType.simpleString()
    return _stateful(df, key, [value], f"{key} {kind}, n long, mean double, std double, min double, max double", step)


def last_rows(df: DataFrame, key: str, value: str, order: str, size: int = 100) -> DataFrame:
    """Statistics of an entity's last ``size`` rows by ``order`` in a batch."""

    def step(kept: dict, pdf: pd.DataFrame):
        held = (kept.get("x", []) + pdf.sort_values(order)[value].dropna().astype(float).tolist())[-size:]
        s = pd.Series(held, dtype=float)
        return {"x": held}, {"n": len(s), "mean": float(s.mean()) if len(s) else None, "min": float(s.min()) if len(s) else None, "max": float(s.max()) if len(s) else None}

    kind = df.schema[key].dataType.simpleString()
    return _stateful(df, key, [value, order], f"{key} {kind}, n long, mean double, min double, max double", step)


def moving_average(df: DataFrame, key: str, value: str, order: str, alpha: float = 0.1) -> DataFrame:
    """Exponential moving average of an entity's rows."""

    def step(kept: dict, pdf: pd.DataFrame):
        e = kept.get("e")
        for x in pdf.sort_values(order)[value].dropna().astype(float):
            e = x if e is None else alpha * x + (1 - alpha) * e
        return {"e": e}, {"ema": e}

    kind = df.schema[key].dataType.simpleString()
    return _stateful(df, key, [value, order], f"{key} {kind}, ema double", step)


def drift(df: DataFrame, key: str, value: str, order: str, limit: float = 3.0, size: int = 100, least: int = 10) -> DataFrame:
    """Whether the mean of the last rows is far from that of all before."""

    def step(kept: dict, pdf: pd.DataFrame):
        held = (kept.get("x", []) + pdf.sort_values(order)[value].dropna().astype(float).tolist())[-size:]
        m = Moments(**kept["m"]) if kept.get("m") else Moments()
        recent = sum(held) / len(held) if held else 0.0
        far = abs(recent - m.mean) / m.std() if m.n >= least and m.std() else 0.0
        m = m.merge(Moments.of(pdf[value]))
        return {"x": held, "m": m.__dict__ if m.n else None}, {"score": far, "drifted": far > limit}

    kind = df.schema[key].dataType.simpleString()
    return _stateful(df, key, [value, order], f"{key} {kind}, score double, drifted boolean", step)


def run_available(df: DataFrame, name: str, mode: str = "update", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its memory table."""
    w = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return df.sparkSession.table(name)
