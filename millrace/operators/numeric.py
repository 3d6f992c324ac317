"""Numeric features: pairs, powers, logarithms, bins, splines, group statistics."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.functions.quantiles import Quantile
from millrace.operators.aggregates import DECLARED, Reduced, group_mode, group_quantile, reduced
from millrace.operators.base import Operator, maybe_broadcast, register, run_aggregates

PAIR_NAMES = {"multiply": "{a}_x_{b}", "divide": "{a}_div_{b}", "add": "{a}_plus_{b}", "subtract": "{a}_minus_{b}", "ratio": "{a}_ratio_{b}"}


@register("interaction", "numeric", "pairs of columns combined by arithmetic")
class Interactions(Operator):
    def __init__(self, columns=None, operations=("multiply", "divide"), squares=False, most=None):
        super().__init__(columns)
        self.operations, self.squares, self.most = operations, squares, most

    def expressions(self, df):
        out: dict[str, Column] = {}
        for a, b in itertools.combinations(self.columns, 2):
            for op in self.operations:
                x, y = F.col(a).cast("double"), F.col(b).cast("double")
                out[PAIR_NAMES[op].format(a=a, b=b)] = S.ratio(x, y, 0.0) if op == "divide" else S.BINARY[op](x, y)
        if self.squares:
            out |= {f"{c}_squared": F.col(c).cast("double") * F.col(c) for c in self.columns}
        return dict(list(out.items())[: self.most])


@register("difference", "numeric", "differences of named pairs")
class Differences(Operator):
    SUFFIXES = (("_high", "_low"), ("_max", "_min"), ("_open", "_close"), ("_start", "_end"), ("_begin", "_end"))

    def __init__(self, pairs=None, ratios=True, percent=True):
        super().__init__([])
        self.pairs, self.ratios, self.percent = pairs, ratios, percent

    def fit(self, df, target=None):
        if self.pairs is None:
            names = set(df.columns)
            self.pairs = [(a, a.removesuffix(x) + y) for x, y in self.SUFFIXES for a in df.columns if a.endswith(x) and a.removesuffix(x) + y in names]
        return super().fit(df, target)

    def expressions(self, df):
        out = {}
        for a, b in self.pairs:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            out[f"{a}_minus_{b}"] = x - y
            if self.ratios:
                out[f"{a}_over_{b}"] = S.ratio(x, y, 0.0)
            if self.percent:
                out[f"{a}_pct_change_{b}"] = S.ratio(x - y, F.abs(y), 0.0)
        return out


@register("polynomial", "numeric", "products of columns up to a degree")
class Polynomial(Operator):
    def __init__(self, columns=None, degree=2, interaction_only=False, bias=False, most=None):
        super().__init__(columns)
        self.degree, self.interaction_only, self.bias, self.most = degree, interaction_only, bias, most

    def expressions(self, df):
        out: dict[str, Column] = {"bias": F.lit(1.0)} if self.bias else {}
        choose = itertools.combinations if self.interaction_only else itertools.combinations_with_replacement
        for d in range(2, self.degree + 1):
            for combo in choose(self.columns, d):
                powers = {c: combo.count(c) for c in dict.fromkeys(combo)}
                value = F.lit(1.0)
                for c in combo:
                    value = value * F.col(c).cast("double")
                out["_x_".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())] = value
        return dict(list(out.items())[: self.most])


@register("log", "numeric", "logarithms")
class Log(Operator):
    """``negative``: abs, shift (by the minimum, fitted) or raw."""

    def __init__(self, columns=None, kind="log1p", negative="abs"):
        super().__init__(columns)
        self.log, self.negative = kind, negative

    def aggregates(self, df):
        return {c: F.min(c) for c in self.columns} if self.negative == "shift" else {}

    def expressions(self, df):
        out = {}
        for c in self.columns:
            v = F.col(c).cast("double")
            if self.negative == "abs":
                v = F.abs(v)
            elif self.negative == "shift" and (low := self.state[c]) is not None and low <= 0:
                v = v + abs(float(low)) + 1
            out[f"{c}_{self.log}"] = S.log1p(v) if self.log == "log1p" else S.log_positive(v, 10.0 if self.log == "log10" else None)
        return out


@register("power", "numeric", "roots and powers, and fitted power transforms")
class Power(Operator):
    """yeo-johnson and box-cox pick the exponent with the greatest likelihood
    on a grid, all of it in one aggregation; box-cox needs positive values and
    leaves a column as it is otherwise."""

    GRID = tuple(round(-2 + 0.25 * i, 2) for i in range(17))

    def __init__(self, columns=None, transforms=("sqrt", "square")):
        super().__init__(columns)
        self.transforms = transforms

    @staticmethod
    def fitted(v: Column, kind: str, p: float) -> Column:
        if kind == "box-cox":
            return F.ln(v) if p == 0 else (F.pow(v, F.lit(p)) - 1) / p
        up = F.log1p(v) if p == 0 else (F.pow(v + 1, F.lit(p)) - 1) / p
        down = -F.log1p(-v) if p == 2 else -(F.pow(1 - v, F.lit(2 - p)) - 1) / (2 - p)
        return F.when(v >= 0, up).otherwise(down)

    def aggregates(self, df):
        out = {}
        for c in self.columns:
            v = F.col(c).cast("double")
            for kind in self.transforms:
                if kind not in ("box-cox", "yeo-johnson"):
                    continue
                out[f"{c}|{kind}|min"], out[f"{c}|n"] = F.min(v), F.count(v)
                ok = F.when(v > 0, v) if kind == "box-cox" else v
                out[f"{c}|{kind}|jac"] = F.sum(F.ln(ok) if kind == "box-cox" else F.signum(v) * F.log1p(F.abs(v)))
                for p in self.GRID:
                    out[f"{c}|{kind}|{p}"] = F.var_pop(self.fitted(ok, kind, p))
        return out

    def exponent(self, c: str, kind: str) -> float | None:
        s = self.state
        if kind == "box-cox" and not (s[f"{c}|{kind}|min"] or 0) > 0:
            return None
        n, jac = s[f"{c}|n"], s[f"{c}|{kind}|jac"]
        scores = {p: -n / 2 * math.log(v) + (p - 1) * jac for p in self.GRID if (v := s[f"{c}|{kind}|{p}"])}
        return max(scores, key=scores.get) if scores else None

    def expressions(self, df):
        out = {}
        for c in self.columns:
            v = F.col(c).cast("double")
            for kind in self.transforms:
                if kind in ("box-cox", "yeo-johnson"):
                    p = self.exponent(c, kind)
                    out[f"{c}_{kind.replace('-', '_')}"] = v if p is None else self.fitted(v, kind, p)
                else:
                    out[f"{c}_{kind}"] = S.UNARY[kind](v)
        return out


@register("bin", "numeric", "bins at quantiles or of equal width")
class Bins(Operator):
    """``closed``: left (null in the last bin) or right (null stays null)."""

    def __init__(self, columns=None, n=5, strategy="quantile", onehot=False, closed="left"):
        super().__init__(columns)
        self.n, self.strategy, self.onehot, self.closed = n, strategy, onehot, closed

    def aggregates(self, df):
        if self.strategy == "quantile":
            return {c: Quantile(F.col(c), tuple(i / self.n for i in range(self.n + 1))) for c in self.columns}
        return {c: F.array(F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))) for c in self.columns}

    def edges(self, c: str) -> list[float]:
        found = self.state[c] or [0.0, 0.0]
        if self.strategy == "quantile":
            return sorted(set(found))
        return S.even_edges(found[0] or 0.0, found[-1] or 0.0, self.n, pad=self.closed == "right")

    def expressions(self, df):
        out = {}
        for c in self.columns:
            edges = self.edges(c)
            value = (S.digitize if self.closed == "left" else S.right_closed)(F.col(c).cast("double"), edges)
            if self.onehot:
                out |= {f"{c}_bin_{i}": F.coalesce((value == i).cast("int"), F.lit(0)) for i in range(max(1, len(edges) - 1))}
            else:
                out[f"{c}_binned"] = value
        return out


@register("spline", "numeric", "B-spline basis")
class Spline(Operator):
    def __init__(self, columns=None, knots=5, degree=3, strategy="quantile"):
        super().__init__(columns)
        self.knots, self.degree, self.strategy = knots, degree, strategy

    def aggregates(self, df):
        return Bins.aggregates(Bins(self.columns, self.knots - 1, self.strategy), df) if self.strategy == "quantile" else {c: F.array(F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))) for c in self.columns}

    def basis(self, v: Column, knots: list[float]) -> list[Column]:
        """Cox and de Boor's recursion over columns; the last interval is closed."""
        d = self.degree
        t = [knots[0]] * d + knots + [knots[-1]] * d
        last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1]) if t[0] < t[-1] else 0
        b = [F.when((v >= t[i]) & ((v <= t[i + 1]) if i == last else (v < t[i + 1])), 1.0).otherwise(0.0) if t[i] < t[i + 1] else F.lit(0.0) for i in range(len(t) - 1)]
        for k in range(1, d + 1):
            new = []
            for i in range(len(b) - 1):
                term = F.lit(0.0)
                if t[i + k] > t[i]:
                    term = term + (v - t[i]) / (t[i + k] - t[i]) * b[i]
                if t[i + k + 1] > t[i + 1]:
                    term = term + (t[i + k + 1] - v) / (t[i + k + 1] - t[i + 1]) * b[i + 1]
                new.append(term)
            b = new
        return b

    def expressions(self, df):
        out = {}
        for c in self.columns:
            found = self.state[c]
            knots = sorted(set(found)) if self.strategy == "quantile" else S.even_edges(found[0], found[1], self.knots - 1)
            v = S.clip(F.col(c).cast("double"), knots[0], knots[-1])
            out |= {f"{c}_spline_{i}": F.coalesce(x, F.lit(0.0)) for i, x in enumerate(self.basis(v, knots))}
        return out


@register("scale", "numeric", "z-scores or the range 0 to 1")
class Scale(Operator):
    def __init__(self, columns=None, kind="standard"):
        super().__init__(columns)
        self.how = kind

    def aggregates(self, df):
        pick = (F.avg, F.stddev_samp) if self.how == "standard" else (F.min, F.max)
        return {f"{c}|{i}": f(F.col(c).cast("double")) for c in self.columns for i, f in enumerate(pick)}

    def expressions(self, df):
        out = {}
        for c in self.columns:
            a, b = self.state[f"{c}|0"], self.state[f"{c}|1"]
            width = (b or 0.0) if self.how == "standard" else (b or 0.0) - (a or 0.0)
            out[f"{c}_{'zscore' if self.how == 'standard' else 'minmax'}"] = F.when(F.col(c).isNotNull(), (F.col(c) - F.lit(a)) / F.lit(width) if width else F.lit(0.0))
        return out


def group_aggregate(name: str, c: Column) -> Column:
    """Aggregates by name; sample variance, exact median."""
    if name in DECLARED:
        return DECLARED[name](c.cast("double"))
    c = c if name in ("nunique", "count", "mode", "first", "last") else c.cast("double")
    return {
        "mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "count": F.count,
        "median": F.median, "nunique": F.count_distinct, "skew": F.skewness, "mode": lambda x: F.mode(x, True),
        "percent_true": lambda x: F.avg(x),
    }[name](c)


@register("aggregate", "numeric", "statistics of a row's group")
class GroupStatistics(Operator):
    """Group by ``by``; statistics of ``columns`` join back to every row. Null
    keys are no group. The fitted table is broadcast if it is small.

    ``functions``: names, also of own aggregates, or ``Reduced`` ones. Medians
    and modes are found without a task that holds a group."""

    def __init__(self, by, columns=None, functions=("mean", "sum", "std"), prefix=None, separate=False):
        super().__init__(columns)
        self.by, self.functions, self.prefix = [by] if isinstance(by, str) else list(by), functions, prefix
        self.table: DataFrame | None = None

    def pick(self, df):
        return super().pick(df) if self.columns is not None else [c for c in self.kind(df) if c not in self.by]

    def fit(self, df, target=None):
        self.columns = self.pick(df)
        start = f"{self.prefix}_" if self.prefix else ""
        name = lambda c, f: f"{start}{'_'.join(self.by)}_{c}_{getattr(f, 'name', f)}"
        apart = lambda f: isinstance(f, Reduced) or f in ("median", "mode")
        rows, each = df.dropna(subset=self.by), [(c, f) for c in self.columns for f in self.functions]
        named = [group_aggregate(f, F.col(c)).alias(name(c, f)) for c, f in each if not apart(f)]
        self.table = rows.groupBy(*self.by).agg(*named) if named else rows.select(*self.by).distinct()
        for c, f in each:
            if isinstance(f, Reduced):
                self.table = self.table.join(reduced(rows, self.by, c, f, name(c, f)), self.by, "left")
            elif f == "median":
                self.table = self.table.join(group_quantile(rows, self.by, c, 0.5, name(c, f)), self.by, "left")
            elif f == "mode":
                self.table = self.table.join(group_mode(rows, self.by, c, name(c, f)), self.by, "left")
        self.table = self.table.select(*self.by, *[name(c, f) for c, f in each])
        self.state = {}
        return self

    def transform(self, df):
        self.new_columns = [c for c in self.table.columns if c not in self.by]
        return df.join(maybe_broadcast(self.table), self.by, "left").select(*df.columns, *self.new_columns)


def discover_interactions(df: DataFrame, target: str, columns=None, operations=("multiply", "divide", "add", "subtract", "ratio"), most=50, least=0.01) -> list[tuple[str, float]]:
    """Pairs scored by absolute correlation with the target, in one aggregation."""
    columns = [c for c in (columns or [c for c in Operator.kind(df) if c != target])]
    made = {PAIR_NAMES[op].format(a=a, b=b): S.ratio(F.col(a).cast("double"), F.col(b).cast("double"), 0.0) if op == "divide" else S.BINARY[op](F.col(a).cast("double"), F.col(b).cast("double")) for a, b in itertools.combinations(columns, 2) for op in operations}
    found = run_aggregates(df, {k: S.correlation(v, F.col(target).cast("double")) for k, v in made.items()})
    scores = sorted(((k, abs(v)) for k, v in found.items() if v is not None and not math.isnan(v) and abs(v) >= least), key=lambda x: (-x[1], x[0]))
    return scores[:most]


class GroupedInteractions(Operator):
    """Pairs within and between named groups of columns."""

    def __init__(self, groups: dict[str, list[str]], operations=("multiply", "ratio"), within=True, between=True, most=20):
        super().__init__([c for g in groups.values() for c in g])
        self.groups, self.operations, self.within, self.between, self.most = groups, operations, within, between, most

    def expressions(self, df):
        pairs: list[list[tuple[str, str]]] = []
        if self.within:
            pairs += [list(itertools.combinations(g, 2)) for g in self.groups.values()]
        if self.between:
            pairs += [list(itertools.product(a, b)) for a, b in itertools.combinations(self.groups.values(), 2)]
        out = {}
        for group in pairs:
            made = {}
            for (a, b), op in itertools.product(group, self.operations):
                x, y = F.col(a).cast("double"), F.col(b).cast("double")
                made[PAIR_NAMES[op].format(a=a, b=b)] = x / (y + 1e-8) if op == "ratio" else S.ratio(x, y, 0.0) if op == "divide" else S.BINARY[op](x, y)
            out |= dict(list(made.items())[: self.most])
        return out
