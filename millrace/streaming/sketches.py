"""Sketches of streams that merge: quantiles and frequent items, per entity and window.

A micro-batch is summed up before it moves: each Arrow batch of a task becomes
one small sketch per entity and window, so what is shuffled to an entity's
state is sketches, however many rows a hot entity has. State is a sketch of
each entity, too, in buckets of entities; it is bounded for any number of rows
and dropped once the watermark has passed its window.

``Digest``: centroids of a t-digest. While a group has at most ``most`` values
it holds them all and its quantiles are exact (interpolated between neighbours); beyond that
neighbours merge if they span less than one step of
k(q) = most / (2 pi) * asin(2 q - 1), so a rank is wrong by at most
``rank_error(most)`` of all values, and by much less near the ends.

``Frequent``: counters of Misra and Gries. With ``most`` counters over N items
every item's count is known to ``missed`` <= N / (most + 1): it is between
the counter and the counter plus ``missed``. Items that occur more often than that are all there.

Edge cases: null and NaN values are left out of quantiles, a null item is an
item of its own; a null key is an entity of its own; groups without a value
give no row; late rows beyond the watermark are dropped by Spark.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.temporal import stamp
from millrace.sources import io

MOST, COUNTERS = 200, 256
#: A window's entities share so many states, as calls for each of many small entities take most of the time.
BUCKETS = 256


def rank_error(most: int) -> float:
    """Bound of a quantile's error in rank, as a share of all values: a
    centroid spans at most pi / most of the ranks, merged ones twice that."""
    return 2 * math.pi / most


class Digest:
    """Centroids in ascending order with their weights, and both ends."""

    def __init__(self, mean: np.ndarray, weight: np.ndarray, low: float, high: float, most: int = MOST):
        self.mean, self.weight, self.low, self.high, self.most = mean, weight, low, high, most

    @classmethod
    def of(cls, values: np.ndarray, most: int = MOST) -> Digest:
        values = np.sort(values[~np.isnan(values)])
        ends = (float(values[0]), float(values[-1])) if len(values) else (math.inf, -math.inf)
        return cls(values, np.ones(len(values)), *ends, most).compressed()

    def merge(self, other: Digest) -> Digest:
        mean = np.concatenate([self.mean, other.mean])
        order = np.argsort(mean, kind="stable")
        weight = np.concatenate([self.weight, other.weight])[order]
        return Digest(mean[order], weight, min(self.low, other.low), max(self.high, other.high), self.most).compressed()

    def compressed(self) -> Digest:
        if len(self.mean) <= self.most:
            return self
        total = self.weight.sum()
        k = lambda q: self.most / (2 * math.pi) * math.asin(min(1.0, max(-1.0, 2 * q - 1)))
        mean, weight, before = [self.mean[0]], [self.weight[0]], 0.0
        for m, w in zip(self.mean[1:].tolist(), self.weight[1:].tolist(), strict=True):
            if k((before + weight[-1] + w) / total) - k(before / total) <= 1:
                weight[-1] += w
                mean[-1] += (m - mean[-1]) * w / weight[-1]
            else:
                before += weight[-1]
                mean.append(m)
                weight.append(w)
        return Digest(np.array(mean), np.array(weight), self.low, self.high, self.most)

    def quantile(self, q: float) -> float | None:
        """Interpolated between centroids' middles; exact while all weigh one."""
        if not len(self.mean):
            return None
        n = self.weight.sum()
        middle = np.cumsum(self.weight) - self.weight / 2 - 0.5
        at, value = np.concatenate([[0.0], middle, [n - 1]]), np.concatenate([[self.low], self.mean, [self.high]])
        place = q * (n - 1)
        j = min(max(int(np.searchsorted(at, place, side="right")), 1), len(at) - 1)
        low, high = value[j - 1], value[j]
        part = (place - at[j - 1]) / (at[j] - at[j - 1]) if at[j] > at[j - 1] else 0.0
        return float(low if part == 0 else low + (high - low) * part)


class Frequent:
    """Counters per item and what a missing item may have at most."""

    def __init__(self, counts: dict, missed: int = 0, most: int = COUNTERS):
        self.counts, self.missed, self.most = counts, missed, most

    @classmethod
    def of(cls, items: pd.Series, most: int = COUNTERS) -> Frequent:
        return cls({None if pd.isna(i) else i: int(n) for i, n in items.value_counts(dropna=False).items()}, 0, most).compressed()

    def merge(self, other: Frequent) -> Frequent:
        counts = dict(self.counts)
        for item, n in other.counts.items():
            counts[item] = counts.get(item, 0) + n
        return Frequent(counts, self.missed + other.missed, self.most).compressed()

    def compressed(self) -> Frequent:
        """Take the largest count that has no room from all."""
        if len(self.counts) <= self.most:
            return self
        taken = sorted(self.counts.values(), reverse=True)[self.most]
        return Frequent({i: n - taken for i, n in self.counts.items() if n > taken}, self.missed + taken, self.most)


def _windowed(df: DataFrame, time: str | None, size: str | None) -> DataFrame:
    """``df`` with its keys and the window's bounds; without a window both are null."""
    if time is None:
        return df.withColumns({"window_start": F.lit(None).cast("timestamp"), "window_end": F.lit(None).cast("timestamp")})
    df = df.withColumn(time, stamp(time))
    w = F.window(time, size)
    return df.withColumn("w", w).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")})


def _coded(df: DataFrame, keys: list[str]) -> Column:
    """The keys as one text, from which ``_decoded`` makes them again."""

    def text(k: str) -> Column:
        kind, c = df.schema[k].dataType, F.col(f"`{k}`")
        if isinstance(kind, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(kind, T.BinaryType):
            c = F.hex(c)
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = c + F.lit(0).cast(kind)  # -0.0 is 0.0
        return c.cast("string")

    return F.to_json(F.array(*map(text, keys))) if keys else F.lit("[]")


def _decoded(df: DataFrame, keys: list[str]) -> list[Column]:
    def value(i: int, k: str) -> Column:
        kind, c = df.schema[k].dataType, F.from_json("_k", "array<string>")[i]
        if isinstance(kind, T.TimestampType):
            return F.timestamp_micros(c.cast("long")).alias(k)
        return (F.unhex(c) if isinstance(kind, T.BinaryType) else c.cast(kind)).alias(k)

    return [value(i, k) for i, k in enumerate(keys)]


def _sketched(df: DataFrame, keys: list[str], value: str, time: str | None, size: str | None, late: str, state: str, result: str, make: Callable, load: Callable, dump: Callable, rows: Callable, buckets: int | None) -> DataFrame:
    """The way of both kinds: partial sketches per Arrow batch, then one state
    per window and bucket of entities, which holds a sketch of each of these,
    merges them and gives ``rows`` of those that changed."""
    frame = _windowed(df, time, size)
    columns = [f.name for f in T._parse_datatype_string(state).fields]
    names = ["_k", "window_start", "window_end", *[f.name for f in T._parse_datatype_string(result).fields]]
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                code = pdf.groupby(["_k", "window_start", "window_end"], dropna=False, sort=False).ngroup().to_numpy()
                order = np.argsort(code, kind="stable")
                bounds = np.flatnonzero(np.diff(code[order], prepend=-1))
                values = make(pdf[value].iloc[order])
                found = [dump(values(a, b)) for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(pdf)], strict=True)]
                out = pdf[["_k", "window_start", "window_end"]].iloc[order[bounds]].reset_index(drop=True)
                out["at"] = pdf["at"].groupby(code).max().to_numpy() if time else pd.NaT
                yield out.assign(**{c: [f[i] for f in found] for i, c in enumerate(columns)})

    # The event time goes along, as the watermark is checked behind it.
    at = F.col(time) if time else F.lit(None).cast("timestamp")
    named = frame.select(_coded(frame, keys).alias("_k"), "window_start", "window_end", at.alias("at"), F.col(f"`{value}`").alias(value))
    parts = named.mapInPandas(partial, f"_k string, window_start timestamp, window_end timestamp, at timestamp, {state}")
    parts = parts.withColumn("_bucket", F.pmod(F.xxhash64("_k"), F.lit(buckets or BUCKETS)).cast("int"))

    def joined(held: dict, pdf: pd.DataFrame, changed: dict) -> None:
        for k, *part in zip(pdf["_k"], *[pdf[c] for c in columns], strict=True):
            known = changed.get(k) or (load(*held[k]) if k in held else None)
            changed[k] = load(*part) if known is None else known.merge(load(*part))

    def shown(start, end, changed: dict) -> pd.DataFrame:
        found = [(k, start, end, *r) for k, sketch in changed.items() for r in rows(sketch)]
        return pd.DataFrame(found, columns=names)

    def merged(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        if time:
            ends, passed = int(pd.Timestamp(key[1]).tz_localize(zone).timestamp() * 1000), held.getCurrentWatermarkMs()
            if ends <= passed:
                return  # too late: the window is closed
            held.setTimeoutTimestamp(ends)
        before, changed = pickle.loads(held.get[0]) if held.exists else {}, {}
        for pdf in batches:
            joined(before, pdf, changed)
        held.update((pickle.dumps(before | {k: dump(sketch) for k, sketch in changed.items()}),))
        if len(found := shown(key[0], key[1], changed)):
            yield found

    out = f"_k string, window_start timestamp, window_end timestamp, {result}"
    back = lambda found: found.select(*_decoded(frame, keys), *names[1:])
    group = ["window_start", "window_end", "_bucket"]
    if not df.isStreaming:

        def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            joined({}, pdf, changed := {})
            return shown(key[0], key[1], changed)

        return back(parts.groupBy(*group).applyInPandas(whole, out))
    if time:
        parts = parts.withWatermark("at", late)
    kept = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return back(parts.groupBy(*group).applyInPandasWithState(merged, out, "sketches binary", "update", kept))


def quantiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.5, 0.9, 0.99), time: str | None = None, size: str | None = None, late: str = "10 minutes", most: int = MOST, buckets: int | None = None) -> DataFrame:
    """Quantiles per entity (and window of ``size`` by ``time``), on batch and
    streaming frames: ``keys, window_start, window_end, n, q`` with one value per
    fraction of ``at``. A stream gives the groups that a micro-batch changed.
    ``buckets``: states of a window, among which its entities are dealt."""
    dump = lambda d: (d.mean.tolist(), d.weight.tolist(), d.low, d.high)
    load = lambda mean, weight, low, high: Digest(np.asarray(mean, float), np.asarray(weight, float), low, high, most)

    def make(x: pd.Series) -> Callable:
        v = x.to_numpy(dtype=float, na_value=math.nan)
        return lambda a, b: Digest.of(v[a:b], most)

    rows = lambda d: [(int(d.weight.sum()), [d.quantile(q) for q in at])] if len(d.mean) else []
    df = df.withColumn(value, F.col(value).cast("double"))
    return _sketched(df, keys, value, time, size, late, "mean array<double>, weight array<double>, low double, high double", "n long, q array<double>", make, load, dump, rows, buckets)


def frequent(df: DataFrame, keys: list[str], item: str, time: str | None = None, size: str | None = None, late: str = "10 minutes", most: int = COUNTERS, buckets: int | None = None) -> DataFrame:
    """Frequent items per entity (and window): ``keys, window_start, window_end,
    item, at_least, at_most``. Every item that occurs more often than
    N / (most + 1) is there, and its count is between the bounds."""
    dump = lambda f: (list(f.counts), [int(n) for n in f.counts.values()], int(f.missed))
    load = lambda items, counts, missed: Frequent(dict(zip(items, map(int, counts), strict=True)), int(missed), most)

    def make(x: pd.Series) -> Callable:
        v = x.astype(object).where(x.notna(), None)
        return lambda a, b: Frequent.of(v.iloc[a:b], most)

    rows = lambda f: [(i, n, n + f.missed) for i, n in f.counts.items()]
    df = df.withColumn(item, F.col(item).cast("string"))
    return _sketched(df, keys, item, time, size, late, "items array<string>, counts array<long>, missed long", "item string, at_least long, at_most long", make, load, dump, rows, buckets)


def write_table(df: DataFrame, path: str, checkpoint: str, more: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what is there now into the table at ``path`` (in a
    folder that driver and executors share), one folder per micro-batch.

    A micro-batch that runs again after a failure overwrites its own folder, so
    a stream that is stopped anywhere and started again leaves the same rows.
    ``more`` is called with each batch once it is written. The table is
    returned with the number of the micro-batch as ``batch``.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if more:
            more(batch, number)

    spark, schema = df.sparkSession, T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    q = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    if not io.exists(spark, path):
        return spark.createDataFrame([], schema)  # nothing came
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each group's last micro-batch in a table of ``write_table``."""
    last = table.groupBy(*keys).agg(F.max("batch").alias("_last"))
    same = [F.col(f"t.`{k}`").eqNullSafe(F.col(f"l.`{k}`")) for k in keys]
    found = table.alias("t").join(last.alias("l"), [*same, F.col("t.batch") == F.col("l._last")], "left_semi")
    return found.drop("batch")
