"""Encoders. Fitting counts groups; a fitted table joins back by broadcast when
it is small and by shuffle otherwise, so cardinality has no limit."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.functions.quantiles import Quantile
from millrace.operators.base import Operator, maybe_broadcast, register, run_aggregates, string_columns


class Encoder(Operator):
    kind = staticmethod(string_columns)


class Lookup(Encoder):
    """A table per column: category to encoded values, with defaults."""

    def __init__(self, columns=None):
        super().__init__(columns)
        self.tables: dict[str, DataFrame] = {}
        self.defaults: dict[str, float | int | None] = {}

    def table(self, df: DataFrame, c: str, target: str | None) -> DataFrame:
        """``_k`` and one column per new column of ``c``."""
        raise NotImplementedError

    def fit(self, df, target=None):
        self.columns, self.state = self.pick(df), {}
        self.prepare(df, target)
        for c in self.columns:
            self.tables[c] = self.table(df, c, target)
        return self

    def prepare(self, df: DataFrame, target: str | None) -> None:
        pass

    def transform(self, df):
        self.new_columns = []
        for c in self.columns:
            t = self.tables[c]
            new = [x for x in t.columns if x != "_k"]
            df = df.join(maybe_broadcast(t), F.col(c) == F.col("_k"), "left").drop("_k")
            df = df.withColumns({x: F.coalesce(x, F.lit(self.defaults[x])) for x in new if self.defaults.get(x) is not None})
            self.new_columns += new
        return df


def counts(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_k")).agg(F.count("*").alias("_n"))


@register("onehot", "categorical", "an indicator per frequent category")
class OneHot(Encoder):
    """Most frequent first, ties by value; null and unknown are all zeros."""

    def __init__(self, columns=None, most=50, least=None, drop_first=False):
        super().__init__(columns)
        self.most, self.least, self.drop_first = most, least, drop_first

    def fit(self, df, target=None):
        self.columns, self.state = self.pick(df), {}
        total = df.count() if isinstance(self.least, float) else 0
        for c in self.columns:
            t = counts(df, c)
            if self.least is not None:
                t = t.where(F.col("_n") >= (self.least * total if isinstance(self.least, float) else self.least))
            self.state[c] = [r[0] for r in t.orderBy(F.desc("_n"), "_k").limit(self.most).collect()]
        return self

    def expressions(self, df):
        return {f"{c}_{v}": F.coalesce(F.col(c) == v, F.lit(False)).cast("int") for c in self.columns for v in self.state[c][int(self.drop_first) :]}


@register("ordinal", "categorical", "a rank per category")
class Ordinal(Lookup):
    """By frequency (ties by value), alphabet, or a given order."""

    def __init__(self, columns=None, by="frequency", order: dict[str, list[str]] | None = None, unknown=-1):
        super().__init__(columns)
        self.by, self.order, self.unknown = by, order or {}, unknown

    def table(self, df, c, target):
        name = f"{c}_ordinal"
        self.defaults[name] = self.unknown
        if c in self.order:
            return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(self.order[c])], f"_k string, {name} int")
        from pyspark.sql import Window

        over = Window.orderBy(F.desc("_n"), "_k") if self.by == "frequency" else Window.orderBy("_k")
        # One row per category.
        return counts(df, c).select("_k", (F.row_number().over(over) - 1).alias(name))


@register("frequency", "categorical", "how common a category is")
class Frequency(Lookup):
    def __init__(self, columns=None, share=True):
        super().__init__(columns)
        self.share = share

    def prepare(self, df, target):
        self.total = df.agg(*[F.count(c).alias(c) for c in self.columns]).first().asDict() if self.columns else {}

    def table(self, df, c, target):
        self.defaults[f"{c}_freq"] = 0.0 if self.share else 0
        value = F.col("_n") / self.total[c] if self.share and self.total[c] else F.col("_n")
        return counts(df, c).select("_k", value.alias(f"{c}_freq"))


class TargetLookup(Lookup):
    """Encoders from the target's count, sum and spread in a category."""

    #: Medians are taken where they are asked for.
    statistics: tuple[str, ...] = ()

    def prepare(self, df, target):
        if target is None:
            raise ValueError("a target is needed")
        y = F.col(target).cast("double")
        wanted = {"mean": F.avg(y), "std": F.stddev_samp(y), "events": F.sum((y > 0).cast("double")), "rest": F.sum((y <= 0).cast("double"))}
        self.all = run_aggregates(df, wanted | ({"median": Quantile(y, 0.5)} if "median" in self.statistics else {}))

    def groups(self, df, c, target):
        y = F.col(target).cast("double")
        return df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_k")).agg(
            F.count(y).alias("n"), F.sum(y).alias("s"), F.avg(y).alias("m"), F.stddev_samp(y).alias("sd"),
            F.min(y).alias("lo"), F.max(y).alias("hi"), F.sum((y > 0).cast("double")).alias("e"), F.sum((y <= 0).cast("double")).alias("r"),
            *([F.median(y).alias("md")] if "median" in self.statistics else []),
        )


@register("target", "categorical", "smoothed target mean")
class Target(TargetLookup):
    def __init__(self, columns=None, smoothing=10.0, least=1):
        super().__init__(columns)
        self.smoothing, self.least = smoothing, least

    def table(self, df, c, target):
        name, g = f"{c}_target", self.all["mean"]
        self.defaults[name] = g
        value = (F.col("n") * F.col("m") + self.smoothing * F.lit(g)) / (F.col("n") + self.smoothing)
        return self.groups(df, c, target).select("_k", F.when(F.col("n") >= self.least, value).otherwise(F.lit(g)).alias(name))


@register("target_statistics", "categorical", "statistics of the target by category")
class TargetStatistics(TargetLookup):
    COLUMNS = {"mean": "m", "std": "sd", "median": "md", "count": "n", "min": "lo", "max": "hi", "sum": "s"}

    def __init__(self, columns=None, statistics=("mean", "std", "count"), smoothing=10.0):
        super().__init__(columns)
        self.statistics, self.smoothing = statistics, smoothing

    def table(self, df, c, target):
        out = []
        for s in self.statistics:
            name = f"{c}_target_{s}"
            self.defaults[name] = self.all[s] if s in ("mean", "std", "median") else 0
            v = F.col(self.COLUMNS[s])
            if s == "mean":
                v = (F.col("n") * v + self.smoothing * F.lit(self.all["mean"])) / (F.col("n") + self.smoothing)
            out.append((F.coalesce(v, F.lit(0.0)) if s == "std" else v).alias(name))
        return self.groups(df, c, target).select("_k", *out)


@register("woe", "categorical", "weight of evidence for a binary target")
class WeightOfEvidence(TargetLookup):
    def __init__(self, columns=None, regular=0.5):
        super().__init__(columns)
        self.regular = regular

    def parts(self):
        r, big_e, big_r = self.regular, self.all["events"] or 0.0, self.all["rest"] or 0.0
        return (F.col("e") + r) / (big_e + r), (F.col("r") + r) / (big_r + r)

    def table(self, df, c, target):
        self.defaults[f"{c}_woe"] = 0.0
        a, b = self.parts()
        return self.groups(df, c, target).select("_k", F.ln(a / b).alias(f"{c}_woe"))

    def information(self, df: DataFrame, c: str, target: str) -> DataFrame:
        """Information value of a column: one row."""
        a, b = self.parts()
        return self.groups(df, c, target).agg(F.sum((a - b) * F.ln(a / b)).alias("iv"))


@register("prior", "categorical", "target mean with a prior")
class Prior(TargetLookup):
    """(sum + a prior) / (count + a) over all rows; ``ordered`` uses the rows
    before a row only, in the order of the given columns."""

    def __init__(self, columns=None, a=1.0, prior=None, ordered: list[str] | None = None):
        super().__init__(columns)
        self.a, self.prior, self.ordered = a, prior, ordered

    def table(self, df, c, target):
        self.target = target
        g = self.all["mean"] if self.prior is None else self.prior
        self.defaults[f"{c}_prior"] = g
        return self.groups(df, c, target).select("_k", ((F.col("s") + self.a * F.lit(g)) / (F.col("n") + self.a)).alias(f"{c}_prior"))

    def transform(self, df):
        if not self.ordered:
            return super().transform(df)
        from pyspark.sql import Window

        new = {}
        for c in self.columns:
            before = Window.partitionBy(c).orderBy(*self.ordered).rowsBetween(Window.unboundedPreceding, -1)
            y, g = F.col(self.target).cast("double"), self.defaults[f"{c}_prior"]
            new[f"{c}_prior"] = (F.coalesce(F.sum(y).over(before), F.lit(0.0)) + self.a * g) / (F.count(y).over(before) + self.a)
        self.new_columns = list(new)
        return df.withColumns(new)


@register("leave_one_out", "categorical", "target mean, optionally without a row's own")
class LeaveOneOut(TargetLookup):
    def __init__(self, columns=None, smoothing=1.0, exclude_own=False):
        super().__init__(columns)
        self.smoothing, self.exclude_own = smoothing, exclude_own

    def table(self, df, c, target):
        self.target, g = target, self.all["mean"]
        self.defaults[f"{c}_loo"] = g
        value = (F.col("s") + self.smoothing * F.lit(g)) / (F.col("n") + self.smoothing)
        return self.groups(df, c, target).select("_k", F.when(F.col("n") > 1, value).otherwise(F.lit(g)).alias(f"{c}_loo"), F.col("s").alias("_s"), F.col("n").alias("_c"))

    def transform(self, df):
        out = super().transform(df)
        if self.exclude_own:
            y, g = F.col(self.target).cast("double"), self.all["mean"]
            for c in self.columns:
                others = (F.col("_s") - y + self.smoothing * g) / (F.col("_c") - 1 + self.smoothing)
                out = out.withColumn(f"{c}_loo", F.when((F.col("_c") > 1) & y.isNotNull(), others).otherwise(F.col(f"{c}_loo")))
        self.new_columns = [x for x in self.new_columns if x not in ("_s", "_c")]
        return out.drop("_s", "_c")


@register("hashing", "categorical", "signed hash buckets")
class Hashing(Encoder):
    """md5: bucket and sign from the digest as one number; else xxhash64."""

    def __init__(self, columns=None, n=8, method="md5"):
        super().__init__(columns)
        self.n, self.method = n, method

    def expressions(self, df):
        out = {}
        for c in self.columns:
            v = F.col(c).cast("string")
            both = S.md5_mod(F.concat(v, F.lit("0")), 2 * self.n) if self.method == "md5" else F.pmod(F.xxhash64(F.lit(c), v), F.lit(2 * self.n))
            for i in range(self.n):
                # What stands first is always evaluated, so all columns share one digest a row.
                out[f"{c}_hash_{i}"] = F.coalesce((both == i).cast("int") - (both == i + self.n).cast("int"), F.lit(0))
        return out


@register("combine", "categorical", "pairs of categories, rare ones together")
class Combine(Encoder):
    def __init__(self, columns=None, separator="_x_", most=100, least=5, pairs=10, null="nan"):
        super().__init__(columns)
        self.separator, self.most, self.least, self.pairs, self.null = separator, most, least, pairs, null

    def both(self, a: str, b: str) -> Column:
        return F.concat(F.coalesce(F.col(a).cast("string"), F.lit(self.null)), F.lit(self.separator), F.coalesce(F.col(b).cast("string"), F.lit(self.null)))

    def fit(self, df, target=None):
        self.columns, self.state = self.pick(df), {}
        for a, b in list(itertools.combinations(self.columns, 2))[: self.pairs]:
            t = df.groupBy(self.both(a, b).alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") >= self.least)
            self.state[a, b] = [r[0] for r in t.orderBy(F.desc("_n"), "_k").limit(self.most).collect()]
        return self

    def expressions(self, df):
        return {f"{a}_x_{b}": F.when(self.both(a, b).isin(kept), self.both(a, b)).otherwise(F.lit("__other__")) for (a, b), kept in self.state.items()}


@register("embedding", "categorical", "seeded vectors per category, scaled by how common it is")
class Embedding(Encoder):
    def __init__(self, columns=None, dim: int | None = None, seed=0):
        super().__init__(columns)
        self.dim, self.seed = dim, seed

    def fit(self, df, target=None):
        self.columns = self.pick(df)
        found = df.agg(*[F.count_distinct(c).alias(c) for c in self.columns], F.count("*").alias("|n")).first().asDict()
        self.state = {c: self.dim or min(50, 1 + found[c] // 2) for c in self.columns}
        self.frequency = Frequency(self.columns).fit(df)
        return self

    def transform(self, df):
        keep = df.columns
        out = self.frequency.transform(df)
        new = {}
        for c, dim in self.state.items():
            for d in range(dim):
                unit = F.pmod(F.xxhash64(F.lit(self.seed + d), F.lit(c), F.col(c)), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1
                new[f"{c}_emb_{d}"] = F.when(F.col(f"{c}_freq") > 0, unit * F.sqrt(F.col(f"{c}_freq"))).otherwise(F.lit(0.0))
        self.new_columns = list(new)
        return out.withColumns(new).select(*keep, *new)


@register("cross", "neural", "cross layers with seeded weights")
class CrossLayers(Operator):
    """x0 * (x W) + b + x W, layer upon layer, of z-scores."""

    def __init__(self, columns=None, layers=2, dim=None, seed=0):
        super().__init__(columns)
        self.layers, self.dim, self.seed = layers, dim, seed

    def aggregates(self, df):
        return {f"{c}|{n}": f(F.col(c).cast("double")) for c in self.columns for n, f in (("m", F.avg), ("s", F.stddev_samp))}

    def expressions(self, df):
        rng, out = random.Random(self.seed), {}
        z = [F.coalesce((F.col(c) - F.lit(self.state[f"{c}|m"])) / F.lit(self.state[f"{c}|s"] or 1.0), F.lit(0.0)) for c in self.columns]
        dim = self.dim or len(z)
        scale = 1 / math.sqrt(max(1, len(z)))
        x0 = [z[i % len(z)] for i in range(dim)]
        x = z
        for layer in range(self.layers):
            mixed = []
            for _ in range(dim):
                w = [rng.gauss(0, 1) * scale for _ in x]
                mixed.append(sum((a * b for a, b in zip(x, w, strict=True)), F.lit(0.0)))
            x = [a * m + rng.gauss(0, 0.01) + m for a, m in zip(x0, mixed, strict=True)]
            out |= {f"cross_L{layer + 1}_d{d}": v for d, v in enumerate(x)}
        return out
