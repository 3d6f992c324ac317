"""Missing values and outliers."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.functions.quantiles import Quantile
from millrace.operators.base import Operator, numeric_columns, register, run_aggregates, string_columns
from millrace.operators.graph import cut


class InPlace(Operator):
    """Rewrites its columns instead of adding any."""


@register("impute", "missing", "mean, median, mode or a constant for null")
class Impute(InPlace):
    """auto: median of numbers, mode of strings; ``indicator`` adds
    ``<c>_missing`` for columns that had nulls when fitted."""

    kind = staticmethod(lambda df: numeric_columns(df) + string_columns(df))

    def __init__(self, columns=None, strategy="auto", fill=0, fills=None, indicator=False):
        super().__init__(columns)
        self.strategy, self.fill, self.fills, self.indicator = strategy, fill, fills or {}, indicator

    def how(self, df: DataFrame, c: str) -> str:
        number = c in numeric_columns(df)
        if self.strategy == "auto":
            return "median" if number else "mode"
        return self.strategy if number or self.strategy in ("mode", "constant") else "mode"

    def aggregates(self, df):
        pick = {"mean": lambda c: F.avg(c), "median": lambda c: Quantile(c, 0.5), "mode": lambda c: F.mode(c, True)}
        out = {c: pick[how](F.col(c)) for c in self.columns if (how := self.how(df, c)) != "constant"}
        return out | ({f"{c}|null": F.count_if(F.col(c).isNull()) for c in self.columns} if self.indicator else {})

    def expressions(self, df):
        out = {f"{c}_missing": F.col(c).isNull().cast("int") for c in self.columns if self.indicator and self.state[f"{c}|null"]}
        for c in self.columns:
            value = self.fills.get(c, self.fill) if self.strategy == "constant" else self.state.get(c)
            out[c] = F.coalesce(F.col(c), F.lit(value))
        return out


@register("missing_indicator", "missing", "a flag per column with nulls")
class MissingIndicator(Operator):
    kind = staticmethod(lambda df: list(df.columns))

    def __init__(self, columns=None, missing_only=True, prefix="missing_"):
        super().__init__(columns)
        self.missing_only, self.prefix = missing_only, prefix

    def aggregates(self, df):
        return {c: F.count_if(F.col(c).isNull()) for c in self.columns}

    def expressions(self, df):
        return {f"{self.prefix}{c}": F.col(c).isNull().cast("int") for c in self.columns if self.state[c] or not self.missing_only}


@register("missing_pattern", "missing", "which columns are null together")
class MissingPattern(Operator):
    """Code of the pattern among the most frequent (else -1), number and share."""

    kind = staticmethod(lambda df: list(df.columns))

    def __init__(self, columns=None, most=10):
        super().__init__(columns)
        self.most = most

    def bits(self):
        return F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in self.columns])

    def fit(self, df, target=None):
        self.columns = self.pick(df)
        found = df.groupBy(self.bits().alias("p")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(self.most).collect()
        self.state = {r["p"]: i for i, r in enumerate(found)}
        return self

    def expressions(self, df):
        code = F.lit(-1)
        for p, i in self.state.items():
            code = F.when(self.bits() == p, i).otherwise(code)
        n = sum((F.col(c).isNull().cast("int") for c in self.columns), F.lit(0))
        return {"missing_pattern": code, "n_missing": n, "missing_ratio": n / len(self.columns)}


@register("knn_impute", "missing", "means of the nearest rows of the fitted table")
class NeighbourImpute(InPlace):
    """Distances over what both rows have, scaled up for what is missing.

    Every fitted row that has the wanted value is a candidate; rows as near as
    each other are taken in an order that hangs on their values alone. Equal
    rows are one candidate with a count, and equal rows to fill are one
    question. Candidates that lack the same columns lie in ranges of a column
    that they share with the question. A question meets its own range first;
    the distance of the last neighbour found there says which other ranges may
    have nearer ones, and it meets those, so nothing is missed. A range with too many
    rows for one task is dealt to several. Where rows lack their values in more
    than ``PATTERNS`` ways, questions meet all candidates block by block.
    Without any neighbour the column's mean is taken. NaN is missing; the
    columns become doubles.
    """

    #: Questions and candidates of a block.
    QUESTIONS, CANDIDATES = 2_048, 16_384
    #: Patterns of missing values whose rows lie in ranges, and ranges of one column.
    PATTERNS, RANGES = 64, 2_000

    def __init__(self, columns=None, k=5, weights="uniform"):
        super().__init__(columns)
        self.k, self.weights = k, weights

    def numbers(self):
        return {c: S.clean(F.col(c).cast("double")) for c in self.columns}

    def fit(self, df, target=None):
        self.columns = self.pick(df)
        own = df.select(*[v.alias(f"c{i}") for i, v in enumerate(self.numbers().values())])
        self.rows = own.groupBy(*own.columns).agg(F.count("*").alias("n"))
        self.state = run_aggregates(own, {c: F.avg(f"c{i}") for i, c in enumerate(self.columns)})
        return self

    def transform(self, df):
        typed = df.withColumns(self.numbers())
        own = [f"c{i}" for i in range(len(self.columns))]
        empty = [F.col(c).isNull() for c in own]
        asked = typed.select(*[F.col(c).alias(x) for c, x in zip(self.columns, own)]).where(functools.reduce(operator.or_, empty)).distinct()
        asked = cut(asked.select(F.monotonically_increasing_id().alias("id"), "*"))
        found = asked.join(self.answers(asked, own), "id").select(*[F.col(c).alias(f"_{c}") for c in own], *[F.col(f"v{i}").alias(f"_v{i}") for i in range(len(own))])
        same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_{x}")) for c, x in zip(self.columns, own)])
        out = typed.join(found, same, "left")
        filled = {c: F.coalesce(F.col(c), F.col(f"_v{i}"), F.lit(self.state[c])) for i, c in enumerate(self.columns)}
        return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])

    def answers(self, asked: DataFrame, own: list[str]) -> DataFrame:
        """One row per question (``id``) with ``v<i>`` where it lacks column i."""
        hashed = F.xxhash64(*[F.coalesce(F.col(c), F.lit(0.0)) for c in own], *[F.col(c).isNull() for c in own])
        pattern = F.concat(*[F.when(F.col(c).isNull(), "0").when(F.col(c) == math.inf, "+").when(F.col(c) == -math.inf, "-").otherwise("1") for c in own])
        asked, rows = (d.select("*", hashed.alias("h"), pattern.alias("p")) for d in (asked, self.rows))
        rows = cut(rows)
        few = [dict(map(tuple, d.groupBy("p").count().limit(self.PATTERNS + 1).collect())) for d in (asked, rows)]
        if max(map(len, few)) > self.PATTERNS:
            near = self.by_blocks(asked, rows, own)
        else:
            near = self.by_ranges(asked, rows, own, *few)
        near = self.first(near)
        w = F.least("n", F.lit(self.k) - F.col("before")) * (F.lit(1.0) if self.weights == "uniform" else 1 / F.greatest("d", F.lit(1e-12)))
        mean = near.groupBy("id", "j").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))
        return mean.groupBy("id").agg(*[F.max(F.when(F.col("j") == i, F.col("v"))).alias(f"v{i}") for i in range(len(own))])

    def first(self, near: DataFrame) -> DataFrame:
        """k candidates are enough; fewer where counts already make up k rows."""
        by = Window.partitionBy("id", "j").orderBy("d", "h")
        near = near.withColumn("i", F.row_number().over(by)).where(F.col("i") <= self.k)
        return near.withColumn("before", F.sum("n").over(by) - F.col("n")).where(F.col("before") < self.k)

    def by_blocks(self, asked: DataFrame, rows: DataFrame, own: list[str]) -> DataFrame:
        sizes = [max(1, -(-d.count() // n)) for d, n in ((asked, self.QUESTIONS), (rows, self.CANDIDATES))]
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        mine = asked.select("id", *own, F.pmod("h", F.lit(sizes[0])).cast("long").alias("a"), every(sizes[1]).alias("b"))
        theirs = rows.select(*own, "n", "h", F.pmod("h", F.lit(sizes[1])).cast("long").alias("b"), every(sizes[0]).alias("a"))
        k = self.k
        return mine.groupBy("a", "b").cogroup(theirs.groupBy("a", "b")).applyInPandas(lambda q, r: nearest(q, r, own, k), NEAR)

    def by_ranges(self, asked: DataFrame, rows: DataFrame, own: list[str], questions: dict[str, int], candidates: dict[str, int]) -> DataFrame:
        finite = lambda i: F.when(F.substring("p", i + 1, 1) == "1", F.col(own[i]))
        spread = rows.agg(*[F.stddev(finite(i)).alias(c) for i, c in enumerate(own)]).first()
        ranges = Ranges(questions, candidates, sorted(range(len(own)), key=lambda i: -(spread[i] or 0.0)))
        cuts = {}
        for i, (p, axis) in enumerate(ranges.lists):
            parts = min(self.RANGES, -(-candidates[p] // self.CANDIDATES))
            if parts > 1:
                cuts[i] = F.percentile_approx(F.when(F.col("p") == p, F.col(own[axis])), [j / parts for j in range(1, parts)], 10_000)
        found = rows.agg(*[c.alias(f"r{i}") for i, c in cuts.items()]).first() if cuts else {}
        ranges.cuts = [np.unique(found[f"r{i}"]) if i in cuts else np.zeros(0) for i in range(len(ranges.lists))]
        k, no, reach = self.k, {}, [f"r{i}" for i in range(len(own))]

        def crowded(placed: DataFrame, most: int) -> dict[int, int]:
            """In how many parts the cells with too many rows are dealt."""
            return {c: -(-n // most) for c, n in placed.groupBy("cell").count().where(F.col("count") > most).collect()}

        def met(asked: DataFrame, columns: list[str]) -> DataFrame:
            kept = ["id", *own, "h", "p"]
            schema = "cell long, part long, id long, " + ", ".join(f"{c} double" for c in own) + ", h long, p string"
            place = lambda mine, theirs: asked.select(*kept, *columns).mapInPandas(lambda pdfs: (ranges.questions(x, own, columns, mine, theirs)[["cell", "part", *kept]] for x in pdfs), schema)
            held = "cell long, part long, " + ", ".join(f"{c} double" for c in own) + ", n long, h long"
            store = lambda mine, theirs: rows.mapInPandas(lambda pdfs: (ranges.candidates(x, own, mine, theirs)[["cell", "part", *own, "n", "h"]] for x in pdfs), held)
            many = crowded(place(no, no), 8 * self.QUESTIONS), crowded(store(no, no), 2 * self.CANDIDATES)
            both = place(*many).groupBy("cell", "part").cogroup(store(*many).groupBy("cell", "part"))
            return both.applyInPandas(lambda key, q, r: ranges.nearest(int(key[0]) >> 32, q, r, own, k), NEAR)

        one = cut(self.first(met(asked, [])).drop("i", "before"))
        bound = one.groupBy("id", "j").agg(F.when(F.sum("n") >= k, F.max("d")).alias("d"))
        bound = bound.groupBy("id").agg(*[F.max(F.when(F.col("j") == i, F.col("d"))).alias(c) for i, c in enumerate(reach)])
        return one.unionByName(met(cut(asked.join(bound, "id", "left")), reach))


#: A question, the column that it lacks, and of a candidate: distance, value, number of rows and hash.
NEAR = "id long, j int, d double, v double, n long, h long"


class Ranges:
    """Candidates of one pattern (a sign per column: 0 missing, 1 finite, + and -
    infinite) in ranges of one column. A cell is a list, which is a pattern and a column,
    and a range of it."""

    def __init__(self, questions: dict[str, int], candidates: dict[str, int], order: list[int]):
        self.lists: list[tuple[str, int]] = []
        self.asks: dict[str, list[int]] = {q: [] for q in questions}
        self.stored: dict[str, list[int]] = {r: [] for r in candidates}
        self.cuts: list[np.ndarray] = []
        for q in questions:
            for r in candidates:
                shared, wanted = self.pair(q, r)
                if not shared or not wanted or any(a != b and "0" not in a + b for a, b in zip(q, r, strict=True)):
                    continue  # an infinite gap, or nothing to compare or to give
                key = r, next(i for i in order if i in shared)
                if key not in self.lists:
                    self.stored[r].append(len(self.lists))
                    self.lists.append(key)
                self.asks[q].append(self.lists.index(key))

    @staticmethod
    def pair(q: str, r: str) -> tuple[list[int], list[int]]:
        """Columns that both have and columns that a question gets from a candidate."""
        both = list(zip(q, r, strict=True))
        return [i for i, (a, b) in enumerate(both) if a == b == "1"], [i for i, (a, b) in enumerate(both) if a == "0" != b]

    @staticmethod
    def dealt(rows: pd.DataFrame, mine: dict[int, int], theirs: dict[int, int], question: bool) -> pd.DataFrame:
        """``part`` of a cell: one of the parts of the rows' own kind, and every part of the other kind."""
        own, other = (rows["cell"].map(x).fillna(1).to_numpy(np.int64) if x else np.ones(len(rows), np.int64) for x in (mine, theirs))
        at = np.repeat(np.arange(len(rows)), other)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(other) - other, other)
        own = (rows["h"].to_numpy() % own)[at]
        return rows.iloc[at].assign(part=own << 32 | nth if question else nth << 32 | own)

    def candidates(self, rows: pd.DataFrame, own: list[str], asked: dict[int, int], stored: dict[int, int]) -> pd.DataFrame:
        out = [rows.iloc[:0].assign(cell=np.zeros(0, np.int64))]
        for p, some in rows.groupby("p"):
            for i in self.stored[p]:
                out.append(some.assign(cell=i << 32 | np.searchsorted(self.cuts[i], some[own[self.lists[i][1]]].to_numpy())))
        return self.dealt(pd.concat(out), stored, asked, False)

    def questions(self, rows: pd.DataFrame, own: list[str], reach: list[str], asked: dict[int, int], stored: dict[int, int]) -> pd.DataFrame:
        """Questions in the cell that they lie in or, with ``reach``, in the others
        that may have something as near as what was found for a column."""
        out = [rows.iloc[:0].assign(cell=np.zeros(0, np.int64))]
        for p, some in rows.groupby("p"):
            for i in self.asks[p]:
                r, axis = self.lists[i]
                shared, wanted = self.pair(p, r)
                x = some[own[axis]].to_numpy()
                home = np.searchsorted(self.cuts[i], x)
                if not reach:
                    out.append(some.assign(cell=i << 32 | home))
                    continue
                far = some[[reach[j] for j in wanted]].fillna(math.inf).to_numpy(dtype=float).max(axis=1)
                # A little more than that, so that rounding loses nothing.
                gap = far * math.sqrt(len(shared) / len(own)) * (1 + 1e-9) + np.abs(x) * 1e-12
                low, high = (np.searchsorted(self.cuts[i], v) for v in (x - gap, x + gap))
                at = np.repeat(np.arange(len(some)), high - low + 1)
                cell = np.arange(len(at)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[at]
                other = cell != home[at]
                out.append(some.iloc[at[other]].assign(cell=i << 32 | cell[other]))
        return self.dealt(pd.concat(out), asked, stored, True)

    def nearest(self, i: int, q: pd.DataFrame, r: pd.DataFrame, own: list[str], k: int) -> pd.DataFrame:
        """Of a cell's candidates, the k nearest to each question."""
        out = {c: [] for c in ("id", "j", "d", "v", "n", "h")}
        pattern, axis = self.lists[i]
        r = r.sort_values([own[axis], "h"]) if len(q) else r
        ref, n, h = r[own].to_numpy(dtype=float), r["n"].to_numpy(), r["h"].to_numpy()
        for p, some in q.groupby("p") if len(ref) else ():
            shared, wanted = self.pair(p, pattern)
            for row, at, d in windows(some[own].to_numpy(dtype=float), ref, h, axis, shared, k):
                for j in wanted:
                    for c, v in zip(out, (some["id"].to_numpy()[row], np.full(len(at), j), d, ref[at, j], n[at], h[at]), strict=True):
                        out[c].append(v)
        kinds = {"id": "int64", "j": "int32", "d": "float64", "v": "float64", "n": "int64", "h": "int64"}
        return pd.DataFrame({c: np.concatenate(v).astype(kinds[c]) if v else np.zeros(0, kinds[c]) for c, v in out.items()})


def windows(x: np.ndarray, ref: np.ndarray, h: np.ndarray, axis: int, shared: list[int], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``x``, the places of their k nearest in ``ref`` and the distances.
    ``ref`` is sorted by ``axis``: a window around a row grows until
    whatever lies outside is further in that column alone."""
    places, size, width, todo = ref[:, axis].copy(), len(ref), max(k, 16), np.arange(len(x))
    middle, k_th = np.searchsorted(places, x[:, axis]), min(k, size) - 1
    while len(todo):
        width, left = min(width, size), []
        for chunk in np.array_split(todo, -(-len(todo) * 2 * width // (1 << 20))):
            low, high = np.maximum(middle[chunk] - width, 0), np.minimum(middle[chunk] + width, size)
            at = low[:, None] + np.arange(int((high - low).max(initial=0)))
            inside = at < high[:, None]
            at = np.minimum(at, size - 1)
            far = np.zeros(at.shape)
            for i in shared:
                far += (x[chunk, i, None] - ref[at, i]) ** 2
            d = np.where(inside, np.sqrt(far * x.shape[1] / len(shared)), np.inf)
            last = np.partition(d, k_th, axis=1)[:, k_th]
            before = np.where(low > 0, x[chunk, axis] - places[low - 1], np.inf)
            after = np.where(high < size, places[np.minimum(high, size - 1)] - x[chunk, axis], np.inf)
            done = (np.sqrt(np.minimum(before, after) ** 2 * x.shape[1] / len(shared)) > last) | ((low == 0) & (high == size))
            left.append(chunk[~done])
            row, column = np.nonzero((d <= last[:, None]) & np.isfinite(d) & done[:, None])
            place, d = at[row, column], d[row, column]
            order = np.lexsort((h[place], d, row))
            row, place, d = row[order], place[order], d[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield chunk[row[first]], place[first], d[first]
        todo, width = np.concatenate(left), width * 2


def nearest(q: pd.DataFrame, r: pd.DataFrame, own: list[str], k: int) -> pd.DataFrame:
    """Of one block of rows, the k nearest to each question that have what it lacks."""
    r = r.sort_values("h", kind="stable")
    ref, ask, n, h = r[own].to_numpy(dtype=float), q[own].to_numpy(dtype=float), r["n"].to_numpy(), r["h"].to_numpy()
    ids, out = q["id"].to_numpy(), []
    for start in range(0, len(ask) if len(ref) else 0, 64):
        x = ask[start : start + 64]
        far, shared = np.zeros((len(x), len(ref))), np.zeros((len(x), len(ref)))
        for i in range(len(own)):
            gap = x[:, i, None] - ref[None, :, i]
            both = ~np.isnan(gap)
            far += np.where(both, gap, 0.0) ** 2
            shared += both
        far = np.where(shared > 0, np.sqrt(far * len(own) / np.maximum(shared, 1)), np.inf)
        for j in range(len(own)):
            has = np.flatnonzero(~np.isnan(ref[:, j]))
            for i in np.flatnonzero(np.isnan(x[:, j])) if len(has) else ():
                d = far[i, has]
                edge = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                at = np.flatnonzero((d <= edge) & np.isfinite(d))
                at = at[np.argsort(d[at], kind="stable")[:k]]
                out += [(ids[start + i], j, d[t], ref[has[t], j], n[has[t]], h[has[t]]) for t in at]
    out = pd.DataFrame(out, columns=["id", "j", "d", "v", "n", "h"])
    return out.astype({"d": "float64", "v": "float64", "j": "int32", "id": "int64", "n": "int64", "h": "int64"})


class Bounds(InPlace):
    """Limits per column from quantiles; ``method`` iqr or percentile."""

    def __init__(self, columns=None, method="iqr", factor=1.5, low=0.01, high=0.99):
        super().__init__(columns)
        self.method, self.factor, self.low, self.high = method, factor, low, high

    def aggregates(self, df):
        at = (0.25, 0.75) if self.method == "iqr" else (self.low, self.high)
        return {c: Quantile(F.col(c), at) for c in self.columns}

    def limits(self, c: str) -> tuple[float | None, float | None]:
        if self.state[c] is None:
            return None, None
        a, b = self.state[c]
        return (a - self.factor * (b - a), b + self.factor * (b - a)) if self.method == "iqr" else (a, b)


@register("cap", "outliers", "clip to quantile limits")
class Cap(Bounds):
    def expressions(self, df):
        return {c: S.clip(F.col(c).cast("double"), *self.limits(c)) for c in self.columns}


@register("winsorize", "outliers", "clip to percentiles")
class Winsorize(Cap):
    def __init__(self, columns=None, low=0.01, high=0.99):
        super().__init__(columns, "percentile", low=low, high=high)


@register("cap_at", "outliers", "clip to given limits")
class CapAt(InPlace):
    def __init__(self, limits: dict[str, tuple[float | None, float | None]]):
        super().__init__(list(limits))
        for c, (lo, hi) in limits.items():
            if lo is not None and hi is not None and lo > hi:
                raise ValueError(f"limits of {c}: {lo} > {hi}")
        self.given = limits

    def expressions(self, df):
        return {c: S.clip(F.col(c).cast("double"), *self.given[c]) for c in self.columns}


@register("trim", "outliers", "drop rows outside quantile limits")
class Trim(Bounds):
    """A null is outside."""

    def transform(self, df):
        keep = F.lit(True)
        for c in self.columns:
            lo, hi = self.limits(c)
            keep = keep & F.col(c).between(lo, hi)
        return df.where(keep)


def sample_frame(df: DataFrame, rows: int, seed: int = 0) -> pd.DataFrame:
    """A preview of about that many rows (bounded) for display."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(rows).toPandas()
