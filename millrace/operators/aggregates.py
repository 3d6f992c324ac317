"""Aggregates of the user's own, and exact medians and modes of heavy groups.

An own aggregate says how values become a state, how states merge and what a
state finally gives. ``Declared`` says it with built-in aggregates, which Spark
merges itself; it has a name and then serves in group statistics and in features along
relationships. ``Reduced`` says it in Python: some ``HELD`` rows of a task leave one
state per group, so states leave the task, not rows, and states of a hot group are
merged in ``FANS`` parts first; states of many groups come by sorted, without a call for each. The same object serves on streams.

Medians and modes count different values by group first. Where a group has
more than ``ROWS`` of them, their range is cut and the wanted rank is found in the one
part that has it, so no task holds a group.

Edge cases: null values are left out unless an own aggregate wants them (``nulls``);
NaN is larger than any number; a null key is a group of its own; a group
without values has null; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce as fold
from itertools import pairwise
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

FANS, ROWS = 16, 1_000_000
#: Rows that a task reduces in one go.
HELD = 1 << 17
DECLARED: dict[str, Declared] = {}


@dataclass(frozen=True)
class Declared:
    """``parts``: built-in aggregates of the column; ``finish``: the result from them, by name."""

    name: str
    parts: dict[str, Callable[[Column], Column]]
    finish: Callable[[dict[str, Column]], Column]

    def __call__(self, column: Column) -> Column:
        return self.finish({k: f(column) for k, f in self.parts.items()})


def register_aggregate(aggregate: Declared) -> Declared:
    """From now on its name can be used wherever aggregates are named."""
    DECLARED[aggregate.name] = aggregate
    return aggregate


@dataclass(frozen=True)
class Reduced:
    """``reduce(values) -> state``, ``merge(state, state) -> state``,
    ``finish(state) -> value``; a state is a tuple with the types of ``state``."""

    name: str
    state: str
    result: str
    reduce: Callable[[pd.Series], tuple]
    merge: Callable[[tuple, tuple], tuple]
    finish: Callable[[tuple], Any]
    nulls: bool = False
    fields: list[str] = field(init=False, default_factory=list)

    def __post_init__(self):
        self.fields.extend(f.name for f in T._parse_datatype_string(self.state).fields)


def _plain(value: Any) -> Any:
    return list(value) if hasattr(value, "__len__") and not isinstance(value, str) else value


def reduced(df: DataFrame, by: list[str], column: str, aggregate: Reduced, name: str | None = None) -> DataFrame:
    """``by`` and the aggregate of ``column``, one row per group with a value."""
    name, kinds = name or f"{column}_{aggregate.name}", ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    rows = df.select(*by, F.col(f"`{column}`").alias("_value"))
    rows = rows if aggregate.nulls else rows.where("_value is not null")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def states() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            code = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            values = pdf["_value"].iloc[order]
            found = [aggregate.reduce(values.iloc[i:j]) for i, j in pairwise([*first.tolist(), len(pdf)])]
            # A group's states go to parts by their batch, so that a hot one is spread.
            spread = len(pdf) + int(pd.util.hash_pandas_object(pdf["_value"].iloc[:1].astype(str), index=False).iloc[0] % FANS)
            out = pdf[by].iloc[order[first]].reset_index(drop=True).assign(_fan=(np.arange(len(first)) + spread) % FANS)
            parts = zip(*found, strict=True)
            return out.assign(**{f: pd.Series(list(v), dtype=object if isinstance(v[0], (list, np.ndarray)) else None) for f, v in zip(aggregate.fields, parts, strict=True)})

        for pdf in batches:
            # Whole numbers of a batch without nulls are not to become floating ones by those of another.
            if held and (sum(map(len, held)) >= HELD or list(pdf.dtypes) != list(held[0].dtypes)):
                yield states()
                held.clear()
            held.append(pdf)
        if sum(map(len, held)):
            yield states()

    def runs(keys: list[str], result: list[str], give: Callable[[tuple], tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """States of equal keys stand together and are merged as they come by: one
        state is held, and no call is made for a group."""
        alike = lambda key: tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in key)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = key = state = None
            for batch in batches:
                columns, out = [c.to_pylist() for c in batch.columns], []
                for row in zip(*columns, strict=True):
                    mine, other = row[: len(keys)], tuple(map(_plain, row[len(keys) :]))
                    if at == alike(mine):
                        state = aggregate.merge(state, other)
                        continue
                    if at is not None:
                        out.append((*key[: len(by)], *give(state)))
                    at, key, state = alike(mine), mine, other
                yield from emitted(out)
            if at is not None:
                yield from emitted([(*key[: len(by)], *give(state))])

        def emitted(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([_plain(v) for v in c], t) for c, t in zip(zip(*rows, strict=True), types + (inner if result is aggregate.fields else outer), strict=True)], names=[*by, *result])

        return run

    types = [to_arrow_type(df.schema[c].dataType) for c in by]
    inner, outer = ([to_arrow_type(f.dataType) for f in T._parse_datatype_string(x).fields] for x in (aggregate.state, f"x {aggregate.result}"))
    states = rows.mapInPandas(partial, f"{kinds}, _fan int, {aggregate.state}")
    together = lambda df, keys: df.repartition(*keys).sortWithinPartitions(*keys).select(*keys, *aggregate.fields)
    ticked = [f"`{c}`" for c in by]
    states = together(states, [*ticked, "_fan"]).mapInArrow(runs([*by, "_fan"], aggregate.fields, lambda s: s), f"{kinds}, {aggregate.state}")
    return together(states, ticked).mapInArrow(runs(by, [name], lambda s: (aggregate.finish(s),)), f"{kinds}, `{name}` {aggregate.result}")


def _null_safe(left: str, right: str, by: list[str]) -> Column:
    return fold(lambda a, b: a & b, [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in by], F.lit(True))


def _cells(df: DataFrame, by: list[str], column: str) -> DataFrame:
    return df.where(F.col(f"`{column}`").isNotNull()).groupBy(*by, F.col(f"`{column}`").alias("_v")).agg(F.count("*").alias("_k"))


def group_quantile(df: DataFrame, by: list[str], column: str, at: float = 0.5, name: str | None = None, rows: int = ROWS) -> DataFrame:
    """``by`` and the exact quantile (interpolated) of ``column`` in each group."""
    name = name or f"{column}_q{at:g}"
    cells = _cells(df.withColumn(column, F.col(f"`{column}`").cast("double") + 0.0), by, column)
    sizes = cells.groupBy(*by).agg(F.sum("_k").alias("_n"), F.count("*").alias("_d"))
    most = sizes.agg(F.max("_d")).first()[0] or 0
    parts = min(1000, -(-most // rows))
    if parts > 1:
        cuts = F.percentile_approx("_v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000)
        sizes = cells.groupBy(*by).agg(F.sum("_k").alias("_n"), cuts.alias("_cuts"))
    else:
        sizes = sizes.withColumn("_cuts", F.array().cast("array<double>"))
    # The two ranks between which the quantile lies.
    place = F.lit(at) * (F.col("_n") - 1)
    sizes = sizes.withColumn("_lo", F.floor(place)).withColumn("_hi", F.ceil(place)).withColumn("_part_of", place - F.floor(place))
    placed = cells.alias("c").join(sizes.alias("s"), _null_safe("c", "s", by)).select("c.*", "s._n", "s._cuts", "s._lo", "s._hi", "s._part_of")
    placed = placed.withColumn("_p", F.size(F.filter("_cuts", lambda e: e < F.col("_v")))).drop("_cuts")
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = placed.groupBy(*by, "_p").agg(F.sum("_k").alias("_t")).withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    joined = placed.alias("c").join(offsets.alias("o"), _null_safe("c", "o", [*by, "_p"])).select("c.*", "o._o", "o._t")
    # Only parts that have one of the two ranks are sorted.
    wanted = joined.where((F.col("_hi") >= F.col("_o")) & (F.col("_lo") < F.col("_o") + F.col("_t")))
    run = wanted.withColumn("_end", F.col("_o") + F.sum("_k").over(Window.partitionBy(*by, "_p").orderBy("_v")))
    has = lambda rank: (F.col(rank) < F.col("_end")) & (F.col(rank) >= F.col("_end") - F.col("_k"))
    found = run.groupBy(*by).agg(F.max(F.when(has("_lo"), F.col("_v"))).alias("_a"), F.max(F.when(has("_hi"), F.col("_v"))).alias("_b"), F.max("_part_of").alias("_f"))
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") * (1 - F.col("_f")) + F.col("_b") * F.col("_f"))
    return found.select(*by, value.alias(name))


def group_mode(df: DataFrame, by: list[str], column: str, name: str | None = None) -> DataFrame:
    """``by`` and the most frequent value of ``column``, the smallest of equals:
    values are counted before they meet, and a group keeps one of them."""
    cells = _cells(df, by, column)
    top = cells.groupBy(*by).agg(F.max("_k").alias("_most"))
    same = cells.alias("c").join(top.alias("t"), _null_safe("c", "t", by) & (F.col("c._k") == F.col("t._most"))).select("c.*")
    return same.groupBy(*by).agg(F.min("_v").alias(name or f"{column}_mode"))


#: Two that are at hand. The geometric mean of what is positive:
register_aggregate(Declared("geomean", {"s": lambda c: F.sum(F.when(c > 0, F.ln(c))), "n": lambda c: F.count(F.when(c > 0, c))}, lambda p: F.when(p["n"] > 0, F.exp(p["s"] / p["n"]))))


def largest(k: int) -> Reduced:
    """The sum of the k largest different values."""

    def top(values) -> tuple:
        return (sorted({float(v) for v in values if not math.isnan(v)}, reverse=True)[:k],)

    return Reduced(f"top{k}", "top array<double>", "double", lambda x: top(x), lambda a, b: top([*a[0], *b[0]]), lambda s: sum(s[0]) if s[0] else None)
