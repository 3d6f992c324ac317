"""Features by declaration: a dict or YAML document becomes columns, or SQL.

    version: "1.0"
    features:
      - {name: spend, transform: log1p, columns: [l_extendedprice]}
      - {name: q_x_d, transform: multiply, columns: [l_quantity, l_discount]}
    selection: {method: variance, threshold: 0.0}

The columns and the SQL text are made from one table of templates, so both
paths agree. Plain sentences (``ratio of a to b``) become features too.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import selection

#: Spark SQL of each transform: {a}, {b} are columns, others are parameters.
#: Values of the whole table are subqueries; those of a group ({g}) are aggregated
#: in parts and joined back; ``bin`` ranks all rows in one task.
TEMPLATES = {
    "log": "ln(greatest({a}, 0) + 1)",
    "log1p": "ln(1 + greatest({a}, 0))",
    "sqrt": "sqrt(greatest({a}, 0))",
    "square": "({a}) * ({a})",
    "reciprocal": "1.0 / nullif({a}, 0)",
    "abs": "abs({a})",
    "standard_scale": "({a} - (select avg({a}) from {source})) / nullif((select stddev_samp({a}) from {source}), 0)",
    "min_max_scale": "({a} - (select min({a}) from {source})) / nullif((select max({a}) - min({a}) from {source}), 0)",
    "bin": "ntile({bins}) over (order by {a})",
    "multiply": "({a}) * ({b})",
    "divide": "({a}) / nullif({b}, 0)",
    "add": "({a}) + ({b})",
    "subtract": "({a}) - ({b})",
    "length": "length({a})",
    "word_count": "size(filter(split(trim({a}), '\\\\s+'), w -> w <> ''))",
    "year": "year({a})",
    "month": "month({a})",
    "hour": "hour({a})",
    "day_of_week": "weekday({a})",
    "is_weekend": "cast(weekday({a}) >= 5 as int)",
    "null_flag": "cast({a} is null as int)",
    "greater_than": "cast({a} > {value} as int)",
    "less_than": "cast({a} < {value} as int)",
    "lag": "lag({a}, {periods}) over (partition by {by} order by {order})",
    "diff": "{a} - lag({a}, {periods}) over (partition by {by} order by {order})",
    "rolling_mean": "avg({a}) over (partition by {by} order by {order} rows between {before} preceding and current row)",
    "rolling_std": "stddev_samp({a}) over (partition by {by} order by {order} rows between {before} preceding and current row)",
    "frequency": "coalesce(if({a} is null, 0, {g}.v0), 0) / nullif((select count({a}) from {source}), 0)",
    "target": "({g}.v0 + {smoothing} * (select avg({y}) from {source})) / ({g}.v1 + {smoothing})",
    "group_mean": "{g}.v0",
}
#: Of transforms that need numbers of a group: what is aggregated of it.
GROUPED = {"frequency": ["count(*)"], "target": ["sum({y})", "count({y})"], "group_mean": ["avg({a})"]}
#: Rows of a group are dealt to at most so many parts, each of which meets a copy of the group's numbers.
PARTS = 64
DEFAULTS = {"bins": 10, "periods": 1, "window": 7, "smoothing": 10.0, "value": 0}


@dataclass
class Feature:
    name: str
    transform: str
    columns: list[str]
    params: dict[str, Any] = field(default_factory=dict)

    def sql(self, source: str = "source_data") -> str:
        """An expression over ``source``, whose rows are called ``s``."""
        if self.transform not in TEMPLATES:
            raise ValueError(f"unknown transform: {self.transform}")
        q = [f"`{c}`" for c in self.columns]
        p = DEFAULTS | self.params
        names = lambda v: ", ".join(f"`{x}`" for x in ([v] if isinstance(v, str) else v or []))
        text = TEMPLATES[self.transform]
        for need in ("b", "by", "order", "y"):
            if (f"{{{need}}}" in text or need == "by" and self.transform == "group_mean") and not (len(q) > 1 if need == "b" else p.get("target" if need == "y" else need)):
                raise ValueError(f"{self.name}: {self.transform} needs {need}")
        return text.format(a=q[0], b=q[1] if len(q) > 1 else "", by=names(p.get("by")), order=names(p.get("order")), y=names(p.get("target")), source=source, g=f"`g|{self.name}`", before=int(p["window"]) - 1, **{k: v for k, v in p.items() if k in ("bins", "periods", "smoothing", "value")})

    def join(self, source: str) -> str:
        """The join with the numbers of the row's group, if there are any. A
        group's numbers are copied once a part and rows are dealt to the parts,
        so a large group does not meet in one task. With many groups for the
        rows there are fewer parts, so copies are never more than rows."""
        if self.transform not in GROUPED:
            return ""
        by = self.params.get("by") if self.transform == "group_mean" else self.columns[0]
        keys, g = [by] if isinstance(by, str) else list(by), f"`g|{self.name}`"
        values = ", ".join(f"{t.format(a=f'`{self.columns[0]}`', y=f'`{self.params.get("target")}`')} as v{i}" for i, t in enumerate(GROUPED[self.transform]))
        grouped = f"select {', '.join(f'`{k}` as k{i}' for i, k in enumerate(keys))}, {values}, count(*) as n from {source} group by {', '.join(f'`{k}`' for k in keys)}"
        parts = f"(select cast(greatest(1, least({PARTS}, sum(n) div count(*))) as int) from ({grouped}))"
        table = f"(select *, explode(sequence(0, coalesce({parts}, 1) - 1)) as part from ({grouped}))"
        same = " and ".join(f"{g}.k{i} <=> s.`{k}`" for i, k in enumerate(keys))
        return f" LEFT JOIN {table} AS {g} ON {same} AND {g}.part = pmod(s.`|row`, coalesce({parts}, 1))"


@dataclass
class Spec:
    features: list[Feature]
    selection: dict[str, Any] | None = None
    target: str | None = None
    version: str = "1.0"


def parse(source: str | dict) -> Spec:
    if isinstance(source, str):
        import yaml

        source = yaml.safe_load(source)
    if not isinstance(source, dict) or not isinstance(source.get("features"), list):
        raise ValueError("a list of features is needed")
    if str(source.get("version", "1.0")) != "1.0":
        raise ValueError(f"unknown version: {source['version']}")
    out = []
    for f in source["features"]:
        cols = f.get("columns") or ([f["column"]] if "column" in f else [])
        if not cols or "transform" not in f:
            raise ValueError(f"a feature needs columns and a transform: {f}")
        extra = {k: v for k, v in f.items() if k not in ("name", "transform", "columns", "column")}
        out.append(Feature(f.get("name") or "_".join([*cols, f["transform"]]), f["transform"], list(cols), extra))
    if len({f.name for f in out}) < len(out):
        raise ValueError("names of features repeat")
    return Spec(out, source.get("selection"), source.get("target"))


def to_sql(spec: Spec, source: str = "source_data") -> str:
    """One SELECT over the named view."""
    made, joins = ", ".join(f"{f.sql(source)} AS `{f.name}`" for f in spec.features), "".join(f.join(source) for f in spec.features)
    if not joins:
        return f"SELECT *, {made} FROM {source} AS s"
    return f"SELECT s.* EXCEPT (`|row`), {made} FROM (SELECT *, monotonically_increasing_id() AS `|row` FROM {source}) AS s{joins}"


def apply(df: DataFrame, spec: Spec) -> DataFrame:
    """The features as columns of ``df``, and the selection on them."""
    view = f"declared_{uuid.uuid4().hex}"
    new = {f.name for f in spec.features}
    out = run_sql(df.sparkSession, df, spec, view).toDF(*df.columns, *[f"|{f.name}" for f in spec.features])
    df.sparkSession.catalog.dropTempView(view)
    out = out.select(*[f"`{c}`" for c in df.columns if c not in new], *[F.col(f"`|{f.name}`").alias(f.name) for f in spec.features])
    if spec.selection:
        methods = {"variance": selection.Variance, "correlation": selection.Correlation, "vif": selection.Multicollinearity, "quasi_constant": selection.QuasiConstant, "statistical": selection.Statistical, "importance": selection.Importance}
        args = {k: v for k, v in spec.selection.items() if k != "method"}
        if spec.selection["method"] == "statistical":
            args["method"] = args.pop("score", "anova")
        out = methods[spec.selection["method"]]([f.name for f in spec.features], **args).fit(out, spec.target).transform(out)
    return out


def run_sql(spark: SparkSession, df: DataFrame, spec: Spec, view: str = "source_data") -> DataFrame:
    df.createOrReplaceTempView(view)
    return spark.sql(to_sql(spec, view))


SENTENCES = [
    (r"(?:ratio of|divide) (\w+) (?:to|by|over) (\w+)", "divide"),
    (r"(?:product of|multiply) (\w+) (?:and|by) (\w+)", "multiply"),
    (r"(?:difference (?:between|of)|subtract) (\w+) (?:and|from) (\w+)", "subtract"),
    (r"(?:sum of|add) (\w+) (?:and|to) (\w+)", "add"),
    (r"log(?:arithm)? of (\w+)", "log1p"),
    (r"(?:square )?root of (\w+)", "sqrt"),
    (r"square of (\w+)", "square"),
    (r"bins? (?:of )?(\w+)", "bin"),
    (r"(?:whether )?(\w+) is (?:null|missing)", "null_flag"),
    (r"(\w+) (?:greater|more|higher) than ([0-9.]+)", "greater_than"),
    (r"(\w+) (?:less|lower|smaller) than ([0-9.]+)", "less_than"),
]


def from_sentence(text: str, columns: list[str]) -> Feature | None:
    """A feature from a plain sentence about known columns; nothing is executed."""
    for pattern, op in SENTENCES:
        if m := re.search(pattern, text.lower()):
            names = {c.lower(): c for c in columns}
            cols = [names[g] for g in m.groups() if g in names]
            need = 1 if op in ("log1p", "sqrt", "square", "bin", "null_flag", "greater_than", "less_than") else 2
            if len(cols) == need:
                params = {"value": float(m.group(2))} if op.endswith("_than") else {}
                return Feature("_".join([*cols, op]), op, cols, params)
    return None


class Builder:
    """Fluent form: ``Builder().log("a").ratio("a", "b").apply(df)``."""

    def __init__(self):
        self.spec = Spec([])

    def add(self, transform: str, *columns: str, name: str | None = None, **params) -> Builder:
        self.spec.features.append(Feature(name or "_".join([*columns, transform]), transform, list(columns), params))
        return self

    def log(self, c: str) -> Builder:
        return self.add("log1p", c)

    def ratio(self, a: str, b: str) -> Builder:
        return self.add("divide", a, b)

    def interaction(self, a: str, b: str) -> Builder:
        return self.add("multiply", a, b)

    def apply(self, df: DataFrame) -> DataFrame:
        return apply(df, self.spec)
