"""Several tables: keys, relationships, features along them, as-of joins."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.operators.aggregates import DECLARED
from millrace.operators.base import numeric_columns, run_aggregates, string_columns
from millrace.operators.temporal import stamp

AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": lambda c: F.count(F.lit(1)), "nunique": F.count_distinct,
    "mode": lambda c: F.mode(c, True), "median": F.median, "percent_true": lambda c: F.avg(c.cast("double")),
    "skew": lambda c: F.when(F.count(c) > 2, F.skewness(c) * F.sqrt(F.count(c) * (F.count(c) - 1)) / (F.count(c) - 2)),
}


def _named(name: str):
    """An aggregate by its name, also one of the user's own."""
    return AGGREGATES[name] if name in AGGREGATES else DECLARED[name]


TRANSFORMS = {
    "log": lambda c: S.log1p(c), "sqrt": lambda c: F.sqrt(S.clip(c, 0.0, None)), "square": lambda c: c * c, "abs": F.abs, "negate": lambda c: -c,
    "year": lambda c: F.year(stamp(c)), "month": lambda c: F.month(stamp(c)), "day": lambda c: F.dayofmonth(stamp(c)), "weekday": lambda c: F.weekday(stamp(c)), "is_weekend": lambda c: (F.weekday(stamp(c)) >= 5).cast("int"),
}


@dataclass(frozen=True)
class Relationship:
    """One parent row, any number of child rows."""

    parent: str
    parent_key: str
    child: str
    child_key: str
    one_to_one: bool = False
    confidence: float = 1.0


class Graph:
    """Tables and the relationships between them."""

    def __init__(self, tables: dict[str, DataFrame], edges: list[Relationship] | None = None):
        self.tables, self.edges = tables, list(edges or [])

    def children(self, table: str) -> list[Relationship]:
        return [e for e in self.edges if e.parent == table]

    def parents(self, table: str) -> list[Relationship]:
        return [e for e in self.edges if e.child == table]

    def paths(self, start: str, end: str, depth: int = 3, most: int = 5) -> list[list[str]]:
        """Cycle-free paths over edges in either direction, shortest first."""
        found, todo = [], deque([[start]])
        while todo:
            path = todo.popleft()
            if path[-1] == end and len(path) > 1:
                found.append(path)
                continue
            if len(path) > depth:
                continue
            near = [e.child for e in self.children(path[-1])] + [e.parent for e in self.parents(path[-1])]
            todo.extend([*path, t] for t in sorted(set(near)) if t not in path)
        return found[:most]

    def reachable(self, start: str, depth: int = 3) -> dict[str, list[str]]:
        return {t: p[0] for t in self.tables if t != start and (p := self.paths(start, t, depth, 1))}

    def edge(self, a: str, b: str) -> Relationship:
        return next(e for e in self.edges if {e.parent, e.child} == {a, b})

    def orphans(self) -> DataFrame:
        """Child rows whose key has no parent: a row per relationship."""
        out = None
        for e in self.edges:
            child = self.tables[e.child].select(F.col(e.child_key).alias("k")).where("k is not null")
            lost = child.join(self.tables[e.parent].select(F.col(e.parent_key).alias("k")), "k", "left_anti")
            row = lost.agg(F.lit(f"{e.parent}.{e.parent_key}->{e.child}.{e.child_key}").alias("relationship"), F.count("*").alias("orphans"))
            out = row if out is None else out.unionByName(row)
        return out


def primary_key(df: DataFrame, endings=("_id", "id", "key", "_key")) -> str | None:
    """A unique column without nulls, those named like a key first."""
    if not df.columns:
        return None
    # Approximate counts screen the columns in one pass; only likely keys are grouped, one by one.
    named = {f"{i}|{k}": f(F.col(f"`{c}`")) for i, c in enumerate(df.columns) for k, f in (("n", F.count), ("d", lambda v: F.approx_count_distinct(v, 0.02)))}
    s = run_aggregates(df, {"n": F.count("*")} | named)
    likely = [c for i, c in enumerate(df.columns) if s["n"] and s[f"{i}|n"] == s["n"] and s[f"{i}|d"] >= 0.9 * s["n"]]
    likely.sort(key=lambda c: not c.lower().endswith(tuple(endings)))
    return next((c for c in likely if df.groupBy(f"`{c}`").count().where("count > 1").isEmpty()), None)


def detect(tables: dict[str, DataFrame], least: float = 0.8, prefix: bool = True) -> list[Relationship]:
    """Keys by uniqueness, then columns named like a key whose distinct values
    are found among it. ``prefix`` ignores what stands before the first ``_``."""
    keys = {t: primary_key(df) for t, df in tables.items()}

    def bare(c: str) -> str:
        return (c.split("_", 1)[-1] if prefix else c).lower()

    out = []
    for parent, pk in keys.items():
        if pk is None:
            continue
        single = parent.lower().removesuffix("s")
        for child, df in tables.items():
            if child == parent:
                continue
            for c in df.columns:
                if not (bare(c) == bare(pk) or c == pk or single in bare(c)) or tables[parent].schema[pk].dataType.typeName() not in (df.schema[c].dataType.typeName(), "integer", "long"):
                    continue
                values = df.select(F.col(c).alias("k")).where("k is not null").distinct()
                n = values.count()
                hit = values.join(tables[parent].select(F.col(pk).alias("k")), "k", "left_semi").count() if n else 0
                if n and hit / n >= least:
                    out.append(Relationship(parent, pk, child, c, keys[child] == c, hit / n))
    return out


def synthesize(graph: Graph, target: str, aggregates=("sum", "mean", "count"), depth: int = 2, most: int = 100, transforms=(), ignore=()) -> DataFrame:
    """Features of ``target`` from the tables around it, leaf first.

    Children are summed up by their key before they join, so a join never
    multiplies rows; parents are looked up. Names are the path and the
    aggregate.
    """

    def build(table: str, left: int, seen: tuple[str, ...]) -> DataFrame:
        df = graph.tables[table]
        for e in graph.parents(table) if left else []:
            if e.parent in seen:
                continue
            up = build(e.parent, left - 1, (*seen, table))
            # Of rows that share a key the least one counts, whatever the order they come in.
            rest = [c for c in up.columns if c != e.parent_key]
            up = up.groupBy(e.parent_key).agg(F.min(F.struct(*rest)).alias("_r")).select(e.parent_key, "_r.*") if rest else up.distinct()
            df = df.join(up.select(F.col(e.parent_key).alias("_k"), *[F.col(c).alias(f"{table}__{e.parent}__{c}") for c in up.columns if c not in (e.parent_key, *ignore)]), F.col(e.child_key) == F.col("_k"), "left").drop("_k")
        for e in graph.children(table) if left else []:
            if e.child in seen:
                continue
            down = build(e.child, left - 1, (*seen, table))
            keys = {x.child_key for x in graph.parents(e.child)} | {x.parent_key for x in graph.children(e.child)} | set(ignore)
            named = []
            for c in (c for c in numeric_columns(down) if c not in keys):
                named += [_named(a)(F.col(c).cast("double")).alias(f"{table}__{e.child}__{c}__{a}") for a in aggregates if a != "count"]
            for c in (c for c in string_columns(down) if c not in keys):
                named += [AGGREGATES[a](F.col(c)).alias(f"{table}__{e.child}__{c}__{a}") for a in aggregates if a in ("nunique", "mode")]
            if "count" in aggregates:
                named.append(F.count(F.lit(1)).alias(f"{table}__{e.child}__count"))
            if named:
                summed = down.groupBy(F.col(e.child_key).alias("_k")).agg(*named)
                df = df.join(summed, F.col(e.parent_key) == F.col("_k"), "left").drop("_k")
                if "count" in aggregates:
                    df = df.fillna(0, [f"{table}__{e.child}__count"])
        return df

    out = build(target, depth, ())
    new = [c for c in out.columns if c not in graph.tables[target].columns]
    extra = {f"{t}__{c}": TRANSFORMS[t](F.col(c).cast("double")) for t in transforms if t in ("log", "sqrt", "square", "abs", "negate") for c in new if c in numeric_columns(out)}
    out = out.withColumns(extra)
    return out.select(*graph.tables[target].columns, *[*new, *extra][:most])


def path_aggregate(graph: Graph, path: list[str], columns: list[str] | None = None, aggregates=("count", "mean", "sum", "min", "max", "std")) -> DataFrame:
    """Values of the last table of ``path``, summed up by the first one's key.

    From the leaf on, a table's rows are summed up by the key that leads to the
    table before it, so no join multiplies rows. Medians, modes, skewness and
    numbers of distinct values cannot be merged: asked for one of these, the
    rows themselves are joined.
    """
    links = []
    for a, b in zip(path, path[1:], strict=False):
        e = graph.edge(a, b)
        links.append((e.parent_key, e.child_key) if e.parent == a else (e.child_key, e.parent_key))
    key, last = links[0][0], path[-1]
    skip = {x.parent_key for x in graph.edges} | {x.child_key for x in graph.edges}
    columns = columns or [c for c in numeric_columns(graph.tables[last]) if c not in skip]
    name = lambda c, f: f"{'_'.join(path[1:])}_{c}_{f}"
    if set(aggregates) - {"count", "mean", "sum", "min", "max", "std"}:
        df = graph.tables[path[0]].select(F.col(key).alias("_first"), F.col(key).alias("_at"))
        for i, (_, there) in enumerate(links):
            right = graph.tables[path[i + 1]]
            onward = links[i + 1][0] if i + 1 < len(links) else there
            right = right.select(F.col(there).alias("_k"), F.col(onward).alias("_on"), *[F.col(c).cast("double").alias(f"_v{j}") for j, c in enumerate(columns) if right is graph.tables[last]])
            df = df.join(right, F.col("_at") == F.col("_k"), "left").drop("_at", "_k").withColumnRenamed("_on", "_at")
        made = [F.coalesce(F.count(f"_v{j}") if f == "count" else _named(f)(F.col(f"_v{j}")), F.lit(0)).alias(name(c, f)) for j, c in enumerate(columns) for f in aggregates]
        return df.groupBy(F.col("_first").alias(key)).agg(*made)
    value = {c: F.col(c).cast("double") for c in columns}
    # Deviations are taken from the whole table's mean, so that squares of large values don't cancel.
    middle = run_aggregates(graph.tables[last], {c: F.avg(v) for c, v in value.items()}) if "std" in aggregates else {}
    parts = {}
    for j, c in enumerate(columns):
        v, d = value[c], value[c] - F.lit(middle.get(c) or 0.0)
        parts |= {f"n{j}": v.isNotNull().cast("long"), f"s{j}": v, f"d{j}": d, f"q{j}": d * d, f"lo{j}": v, f"hi{j}": v}
    merge = [(F.min if p.startswith("lo") else F.max if p.startswith("hi") else F.sum)(p).alias(p) for p in parts]
    summed = graph.tables[last].select(F.col(links[-1][1]).alias("_k"), *[x.alias(p) for p, x in parts.items()]).groupBy("_k").agg(*merge)
    for i in range(len(links) - 1, -1, -1):
        back = links[i - 1][1] if i else key
        rows = graph.tables[path[i]].select(F.col(links[i][0]).alias("_h"), F.col(back).alias("_b"))
        summed = rows.join(summed, F.col("_h") == F.col("_k"), "left").groupBy("_b").agg(*merge).withColumnRenamed("_b", "_k")
    made = []
    for j, c in enumerate(columns):
        n, total = F.coalesce(F.col(f"n{j}"), F.lit(0)), F.coalesce(F.col(f"s{j}"), F.lit(0.0))
        spread = F.greatest(F.col(f"q{j}") - F.col(f"d{j}") * F.col(f"d{j}") / n, F.lit(0.0)) / (n - 1)
        of = {
            "count": n, "sum": total, "mean": F.when(n > 0, total / n).otherwise(0.0), "std": F.when(n > 1, F.sqrt(spread)).otherwise(0.0),
            "min": F.coalesce(F.col(f"lo{j}"), F.lit(0.0)), "max": F.coalesce(F.col(f"hi{j}"), F.lit(0.0)),
        }
        made += [of[f].alias(name(c, f)) for f in aggregates]
    return summed.select(F.col("_k").alias(key), *made)


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], tolerance: float | None = None) -> DataFrame:
    """For each left row the right values of the last time at or before it.

    One sort of both sides together by entity and time; ``tolerance`` in
    seconds. Entities may be hot: the window streams through its rows.
    """
    l_cols = [F.col(c) for c in left.columns]
    value = F.struct(*[F.col(c) for c in columns], F.unix_micros(stamp(right_time)).alias("_at"))
    r = right.select(*[F.col(b).alias(f"_{b}") for b in by], F.unix_micros(stamp(right_time)).alias("_t"), F.lit(0).alias("_side"), value.alias("_v"))
    packed = left.select(*[F.col(b).alias(f"_{b}") for b in by], F.unix_micros(stamp(left_time)).alias("_t"), F.lit(1).alias("_side"), F.struct(*l_cols).alias("_row"))
    both = r.unionByName(packed, allowMissingColumns=True)
    w = Window.partitionBy(*[f"_{b}" for b in by]).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("_v", F.last("_v", True).over(w)).where("_side = 1")
    fresh: Column = F.lit(True) if tolerance is None else (F.col("_t") - F.col("_v._at") <= tolerance * 1e6)
    return out.select("_row.*", *[F.when(fresh, F.col(f"_v.{c}")).alias(c if c not in left.columns else f"{c}_asof") for c in columns])


def change_join(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows that were added, removed or changed between two versions."""
    rest = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("_old"))
    b = new.select(*key, F.struct(*rest).alias("_new"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(*key, kind.alias("change")).where("change is not null")
