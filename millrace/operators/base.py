"""Operators: what to aggregate when fitting, which columns to add.

``aggregates`` names the global aggregates an operator needs; fitting any
number of operators together runs one ``agg`` job. ``expressions`` turns that
state into columns; together they are one ``select``. Operators that keep a
table (one row per group) override ``fit`` and ``transform`` and join it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.quantiles import Quantile, exact

#: Rows up to which a fitted table of groups is broadcast.
BROADCAST_ROWS = 200_000


class NotFitted(RuntimeError):
    pass


class MissingColumn(ValueError):
    pass


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def require(df: DataFrame, columns: Iterable[str]) -> list[str]:
    columns = list(columns)
    if missing := [c for c in columns if c not in df.columns]:
        raise MissingColumn(f"no such columns: {missing}")
    return columns


def require_numeric(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """The given columns, or all numeric ones; an error if one is not numeric, or there is none."""
    columns = require(df, columns) if columns is not None else numeric_columns(df)
    if wrong := [c for c in columns if c not in numeric_columns(df)]:
        raise TypeError(f"not numeric: {wrong}")
    if not columns:
        raise MissingColumn("there is no numeric column")
    return columns


def require_categorical(df: DataFrame, columns: Iterable[str] | None = None, most: int | None = None) -> list[str]:
    """The given columns, or all of text; with ``most``, an error if one has
    more different values: sketched for all in one job, exactly where that is not clear."""
    columns = require(df, columns) if columns is not None else string_columns(df)
    if not columns:
        raise MissingColumn("there is no column of text")
    if most is not None:
        sizes = run_aggregates(df, {c: F.approx_count_distinct(c, 0.02) for c in columns})
        near = [c for c in columns if most * 0.85 <= sizes[c] <= most * 1.15 + 2]
        # No more values are looked at than it takes to tell.
        sizes |= {c: df.select(c).where(F.col(f"`{c}`").isNotNull()).distinct().limit(most + 1).count() for c in near}
        if wrong := [c for c in columns if sizes[c] > most]:
            raise ValueError(f"more than {most} values: {wrong}")
    return columns


def require_target(df: DataFrame, target: str, classes: bool | None = None, nulls: bool = False) -> str:
    """The target; an error if it has no value, a null (unless ``nulls``), is not
    numeric though ``classes`` is false, or has a single value."""
    require(df, [target])
    if classes is False and target not in numeric_columns(df):
        raise TypeError(f"not numeric: {target}")
    v = F.col(f"`{target}`")
    s = run_aggregates(df, {"n": F.count("*"), "some": F.count(v), "low": F.min(v.cast("string")), "high": F.max(v.cast("string"))})
    if not s["some"]:
        raise ValueError(f"{target} has no value")
    if s["some"] < s["n"] and not nulls:
        raise ValueError(f"{target} has {s['n'] - s['some']} nulls")
    if s["low"] == s["high"]:
        raise ValueError(f"{target} has a single value")
    return target


def clean_frame(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a fitted table only after its size is known to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Operator:
    """Adds columns; ``columns=None`` picks all of the operator's kind."""

    kind: Callable[[DataFrame], list[str]] = staticmethod(numeric_columns)

    def __init__(self, columns: list[str] | None = None):
        self.columns = columns
        self.state: dict[str, Any] | None = None
        self.new_columns: list[str] = []

    def pick(self, df: DataFrame) -> list[str]:
        return require(df, self.columns) if self.columns is not None else self.kind(df)

    def aggregates(self, df: DataFrame) -> dict[str, Column | Quantile]:
        return {}

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def fit(self, df: DataFrame, target: str | None = None) -> Operator:
        self.columns = self.pick(df)
        self.state = run_aggregates(df, self.aggregates(df))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.state is None:
            raise NotFitted(type(self).__name__)
        require(df, self.columns or [])
        new = self.expressions(df)
        self.new_columns = list(new)
        return df.withColumns(new)

    def fit_transform(self, df: DataFrame, target: str | None = None) -> DataFrame:
        return self.fit(df, target).transform(df)


def run_aggregates(df: DataFrame, wanted: dict[str, Column | Quantile]) -> dict[str, Any]:
    """One job for all of them; quantiles take one or two more, for all together."""
    if not wanted:
        return {}
    # Places, not names: names of columns may hold anything.
    names, ranked = list(wanted), [k for k, c in wanted.items() if isinstance(c, Quantile)]
    plain = [F.count(c.number()) if isinstance(c, Quantile) else c for c in wanted.values()]
    row = list(df.agg(*[c.alias(f"a{i}") for i, c in enumerate(plain + [wanted[k].brackets() for k in ranked])]).first().asDict(recursive=True).values())
    out = dict(zip(names, row))
    if ranked:
        out |= zip(ranked, exact(df, [wanted[k] for k in ranked], [out[k] for k in ranked], row[len(names):]))
    return out


class Union(Operator):
    """Operators side by side: one fit job, one projection."""

    def __init__(self, members: list[Operator]):
        super().__init__([])
        self.members = members

    def fit(self, df: DataFrame, target: str | None = None) -> Union:
        wanted = {}
        for i, m in enumerate(self.members):
            m.columns = m.pick(df)
            wanted |= {f"{i}|{k}": c for k, c in m.aggregates(df).items()}
        found = run_aggregates(df, wanted)
        for i, m in enumerate(self.members):
            m.state = {k.partition("|")[2]: v for k, v in found.items() if k.partition("|")[0] == str(i)}
        self.state = {}
        return self

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for m in self.members:
            out |= m.expressions(df)
        return out


class Pipeline:
    """Steps one after another; fitting a step sees the output of those before."""

    def __init__(self, steps: list[tuple[str, Any] | None]):
        self.steps = [s for s in steps if s is not None and s[1] is not None]

    def fit(self, df: DataFrame, target: str | None = None) -> Pipeline:
        for _, step in self.steps:
            df = step.fit(df, target).transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step.transform(df)
        return df

    def fit_transform(self, df: DataFrame, target: str | None = None) -> DataFrame:
        for _, step in self.steps:
            df = step.fit(df, target).transform(df)
        return df

    def __getitem__(self, key: int | str):
        return self.steps[key][1] if isinstance(key, int) else dict(self.steps)[key]

    def trace(self, df: DataFrame) -> list[dict[str, Any]]:
        """What each fitted step adds and drops, from schemas alone."""
        out = []
        for name, step in self.steps:
            after = step.transform(df)
            out.append({"step": name, "added": [c for c in after.columns if c not in df.columns], "dropped": [c for c in df.columns if c not in after.columns]})
            df = after
        return out


class Select(Operator):
    """Projection onto the listed columns."""

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*require(df, self.columns or []))


class Passthrough(Operator):
    def expressions(self, df: DataFrame) -> dict[str, Column]:
        return {}


class Function(Operator):
    """An operator from a function of the DataFrame to named columns."""

    def __init__(self, make: Callable[[DataFrame], dict[str, Column]]):
        super().__init__([])
        self.make = make

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        return self.make(df)


REGISTRY: dict[str, tuple[type, str, str]] = {}


def register(name: str, category: str = "general", description: str = ""):
    """Class decorator: makes an operator known by name."""

    def add(cls: type) -> type:
        REGISTRY[name] = (cls, category, description)
        return cls

    return add
