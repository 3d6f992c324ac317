"""Exact quantiles of whole columns, without one task that holds every value.

An approximate summary brackets the wanted ranks, one grouped count says how
many values lie between the brackets, and only the few values of the interval
that holds a rank are sorted. Wide intervals are bracketed again.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of ranks in the summaries is one over this.
ACCURACY = 10_000
#: Values of one interval that are sorted; a wider one is bracketed again.
KEEP = 4_096
#: Edges up to which cells are expressions; more are searched batch by batch, as so long an expression is slow.
FEW = 16


@dataclass(frozen=True)
class Quantile:
    """An aggregate like ``F.percentile``: a value for one fraction, a list for several."""

    value: Column
    at: float | tuple[float, ...]

    @property
    def fractions(self) -> tuple[float, ...]:
        return (self.at,) if isinstance(self.at, (int, float)) else tuple(self.at)

    def number(self) -> Column:
        return self.value.cast("double")

    def brackets(self) -> Column:
        return summary(self.number(), self.fractions)


def summary(v: Column, fractions: Iterable[float]) -> Column:
    near = sorted({min(1.0, max(0.0, p + d / ACCURACY)) for p in fractions for d in (-2, 2)})
    return F.percentile_approx(v, F.array(*[F.lit(p) for p in near]), ACCURACY)


def ascending(values: list[float]) -> list[float]:
    """Different values, NaN last and once."""
    return sorted({v for v in values if v == v}) + [math.nan] * any(v != v for v in values)


def cells(df: DataFrame, wanted: list[Quantile], edges: list[list[float]]) -> DataFrame:
    """``i, cell, v``: odd cells hold values equal to an edge, even ones those between."""
    step = lambda v, b: (v > b).cast("int") + (v >= b).cast("int")
    cell = [sum((step(q.number(), F.lit(b)) for b in edges[i]), F.lit(0)) for i, q in enumerate(wanted)]
    rows = [F.struct(F.lit(i).alias("i"), cell[i].alias("cell"), q.number().alias("v")) for i, q in enumerate(wanted)]
    return df.select(F.inline(F.array(*rows))).where("v is not null")


def _columns(batch: pa.RecordBatch, edges: list[list[float]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each column its number, the cells of its values and the values; no nulls."""
    for i, e in enumerate(edges):
        v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
        yield i, np.searchsorted(e, v, "left") + np.searchsorted(e, v, "right"), v


def cell_counts(df: DataFrame, wanted: list[Quantile], edges: list[list[float]]) -> DataFrame:
    """``i, cell, n``: how many values are in each cell of ``cells``."""
    if sum(map(len, edges)) <= FEW:
        return cells(df, wanted, edges).groupBy("i", "cell").agg(F.count("*").alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(2 * len(e) + 1, np.int64) for e in edges]
        for batch in batches:
            for i, cell, _ in _columns(batch, edges):
                total[i] += np.bincount(cell, minlength=len(total[i]))
        some = [(i, c, n) for i, t in enumerate(total) for c, n in enumerate(t.tolist()) if n]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*some), (pa.int32(), pa.int32(), pa.int64()))], names=["i", "cell", "n"])

    return _values(df, wanted).mapInArrow(count, "i int, cell int, n long").groupBy("i", "cell").agg(F.sum("n").alias("n"))


def cell_values(df: DataFrame, wanted: list[Quantile], edges: list[list[float]], kept: Iterable[tuple[int, int]]) -> DataFrame:
    """``i, cell, v``: the values in the cells ``kept`` alone."""
    kept = list(kept)
    if sum(map(len, edges)) <= FEW:
        return cells(df, wanted, edges).where(F.struct("i", "cell").isin([F.struct(F.lit(i).alias("i"), F.lit(c).alias("cell")) for i, c in kept]))
    mine = [np.array([c for j, c in kept if j == i], np.int64) for i in range(len(edges))]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, cell, v in _columns(batch, edges):
                at = np.flatnonzero(np.isin(cell, mine[i]))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(cell[at], pa.int32()), pa.array(v[at], pa.float64())], names=["i", "cell", "v"])

    return _values(df, wanted).mapInArrow(take, "i int, cell int, v double")


def _values(df: DataFrame, wanted: list[Quantile]) -> DataFrame:
    return df.select(*[q.number().alias(f"q{i}") for i, q in enumerate(wanted)])


def exact(df: DataFrame, wanted: list[Quantile], sizes: list[int], found: list[list[float] | None]) -> list[float | list[float] | None]:
    """Interpolated quantiles, given each column's count and first brackets;
    null for a column without values. NaN is larger than any number."""
    edges = [ascending(f or []) if n > KEEP else [] for n, f in zip(sizes, found)]
    places = [[p * (n - 1) for p in q.fractions] if n else [] for q, n in zip(wanted, sizes)]
    ranks = [sorted({f(x) for x in xs for f in (math.floor, math.ceil)}) for xs in places]
    values: list[dict[int, float]] = [{} for _ in wanted]
    while True:
        counts = [{0: n} if not e else {} for n, e in zip(sizes, edges)]
        if any(edges):
            for r in cell_counts(df, wanted, edges).collect():
                counts[r["i"]][r["cell"]] = r["n"]
        # (column, cell) -> its count and the ranks wanted within it
        inside: dict[tuple[int, int], tuple[int, dict[int, int]]] = {}
        for i, per in enumerate(counts):
            before = 0
            for c in sorted(per):
                for r in ranks[i]:
                    if before <= r < before + per[c]:
                        if c % 2:
                            values[i][r] = edges[i][c // 2]
                        else:
                            inside.setdefault((i, c), (per[c], {}))[1][r] = r - before
                before += per[c]
        wide = [k for k, (n, _) in inside.items() if n > KEEP]
        if not wide:
            break
        rows, finer = cell_values(df, wanted, edges, wide), [list(e) for e in edges]
        for i, c in wide:
            n, local = inside[i, c]
            near = rows.where((F.col("i") == i) & (F.col("cell") == c)).agg(summary(F.col("v"), [x / n for x in local.values()])).first()[0]
            finer[i] = ascending([*finer[i], *near])
        edges = finer
    if inside:
        few = cell_values(df, wanted, edges, inside)
        for r in few.groupBy("i", "cell").agg(F.array_sort(F.collect_list("v")).alias("v")).collect():
            for rank, place in inside[r["i"], r["cell"]][1].items():
                values[r["i"]][rank] = r["v"][place]
    out = []
    for i, q in enumerate(wanted):
        at = [between(x, values[i][math.floor(x)], values[i][math.ceil(x)]) for x in places[i]]
        out.append(None if not at else at[0] if isinstance(q.at, (int, float)) else at)
    return out


def between(x: float, low: float, high: float) -> float:
    return low if low == high or x == math.floor(x) else (math.ceil(x) - x) * low + (x - math.floor(x)) * high


def average_ranks(counts: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``v, rank`` of ``counts`` (v, k): the average rank of the k rows that
    have v. Slices of some ``rows`` values (1,000 slices at most) are ranked
    apart and set off by the number of rows before them."""
    n, near = counts.agg(F.count("*"), F.percentile_approx("v", F.array(*[F.lit(i / 1000) for i in range(1, 1000)]))).first()
    slices = min(1000, max(1, -(-n // rows)))
    cuts = sorted({near[1000 * i // slices - 1] for i in range(1, slices)} if near else set())
    part = F.size(F.filter(F.array(*[F.lit(q) for q in cuts]), lambda q: q <= F.col("v"))) if cuts else F.lit(0)
    cells = counts.withColumn("p", part)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offsets = cells.groupBy("p").agg(F.sum("k").alias("t")).withColumn("o", F.coalesce(F.sum("t").over(before), F.lit(0)))
    run = cells.withColumn("c", F.sum("k").over(Window.partitionBy("p").orderBy("v"))).join(F.broadcast(offsets), "p")
    return run.select("v", (F.col("o") + F.col("c") - (F.col("k") - 1) / 2).alias("rank"))
