"""Feature selection: scores from one or a few aggregations, choices on the
driver over vectors as long as the number of columns."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.functions import stats
from millrace.functions.concordance import kendall
from millrace.functions.quantiles import Quantile, average_ranks
from millrace.operators.base import Operator, numeric_columns, run_aggregates


def doubles(df: DataFrame, columns: list[str]):
    return {c: F.col(c).cast("double") for c in columns}


class Selector(Operator):
    """``scores`` after fitting; ``transform`` drops what was not kept."""

    def __init__(self, columns=None):
        super().__init__(columns)
        self.scores: dict[str, float] = {}
        self.kept: list[str] = []

    def fit(self, df, target=None):
        self.columns = [c for c in self.pick(df) if c != target]
        self.state = {}
        self.kept = self.choose(df, target)
        return self

    def choose(self, df: DataFrame, target: str | None) -> list[str]:
        raise NotImplementedError

    def transform(self, df):
        return df.drop(*[c for c in self.columns if c not in self.kept])


class Variance(Selector):
    """Variance (over the squared mean, if normalised) above the threshold."""

    def __init__(self, columns=None, threshold=0.0, normalize=True):
        super().__init__(columns)
        self.threshold, self.normalize = threshold, normalize

    def choose(self, df, target):
        s = run_aggregates(df, {f"{c}|{k}": f(v) for c, v in doubles(df, self.columns).items() for k, f in (("v", F.var_samp), ("m", F.avg))})
        for c in self.columns:
            v, m = s[f"{c}|v"] or 0.0, s[f"{c}|m"] or 0.0
            self.scores[c] = v / (m * m) if self.normalize and m else v
        return [c for c in self.columns if self.scores[c] > self.threshold]


class QuasiConstant(Selector):
    """Drops columns whose most common value has at least the given share."""

    kind = staticmethod(lambda df: list(df.columns))

    def __init__(self, columns=None, threshold=0.99):
        super().__init__(columns)
        self.threshold = threshold

    def choose(self, df, target):
        if not self.columns:
            return []
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in self.columns])).alias("x")).select("x.*").where("v is not null")
        per = long.groupBy("c", "v").agg(F.count("*").alias("n")).groupBy("c").agg((F.max("n") / F.sum("n")).alias("s"))
        self.scores = {c: 1.0 for c in self.columns} | {r["c"]: r["s"] for r in per.collect()}
        return [c for c in self.columns if self.scores[c] < self.threshold]


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Pearson correlation of all pairs, complete rows of a pair, one job."""
    v = doubles(df, columns)
    place = {c: i for i, c in enumerate(columns)}
    s = run_aggregates(df, {"n": F.count("*")} | {f"{k}{place[c]}": f(x) for c, x in v.items() for k, f in (("n", F.count), ("v", F.var_pop))})
    varies = [c for c in columns if (s[f"v{place[c]}"] or 0.0) > 0]
    full = [c for c in varies if s[f"n{place[c]}"] == s["n"]]
    out: dict[tuple[str, str], float] = {}
    if len(full) > 8:  # one matrix instead of hundreds of aggregates
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.stat import Correlation as Matrix

        x = VectorAssembler(inputCols=full, outputCol="_x").transform(df.select(*[v[c].alias(c) for c in full])).select("_x")
        r = Matrix.corr(x, "_x").first()[0].toArray()
        out = {(a, b): float(r[full.index(a), full.index(b)]) for a, b in itertools.combinations(full, 2)}
    # The built-in function raises for a constant side, which a complete pair cannot have here.
    pairs = [p for p in itertools.combinations(varies, 2) if p not in out]
    found = run_aggregates(df, {str(i): (F.corr if {a, b} <= set(full) else S.correlation)(v[a], v[b]) for i, (a, b) in enumerate(pairs)})
    out |= {pairs[int(i)]: x for i, x in found.items() if x is not None}
    return {p: out[p] for p in itertools.combinations(varies, 2) if p in out and not math.isnan(out[p])}


def rank_correlation(df: DataFrame, a: str, b: str) -> float | None:
    """Spearman's correlation of the rows that have both values: Pearson's of
    their average ranks. Rows are counted by pair of values first; ranks are
    running counts over slices of the values, so no task sorts a whole column."""
    cells = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null and not isnan(a) and not isnan(b)").groupBy("a", "b").agg(F.count("*").alias("k"))
    ranked = cells
    for c in ("a", "b"):
        ranked = ranked.join(average_ranks(cells.groupBy(F.col(c).alias("v")).agg(F.sum("k").alias("k"))).select(F.col("v").alias(c), F.col("rank").alias(f"r{c}")), c)
    n = F.sum("k").alias("n")
    total = cells.agg(n).first()[0] or 0
    x, y, k = F.col("ra") - (total + 1) / 2, F.col("rb") - (total + 1) / 2, F.col("k")
    s = ranked.agg(F.sum(k * x * y).alias("xy"), F.sum(k * x * x).alias("xx"), F.sum(k * y * y).alias("yy")).first()
    return s["xy"] / math.sqrt(s["xx"] * s["yy"]) if s["xx"] and s["yy"] else None


def correlation_pairs(df: DataFrame, columns: list[str], method: str = "pearson") -> dict[tuple[str, str], float]:
    """Correlation of all pairs that have one: Pearson's, Spearman's or Kendall's tau-b."""
    if method == "pearson":
        return correlations(df, columns)
    pairs = list(itertools.combinations(columns, 2))
    if method == "kendall":
        found = {(r["left"], r["right"]): r["tau"] for r in kendall(df, pairs).collect()} if pairs else {}
    elif method == "spearman":
        found = {p: rank_correlation(df, *p) for p in pairs}
    else:
        raise ValueError(f"method is pearson, spearman or kendall, not {method}")
    return {p: found[p] for p in pairs if found[p] is not None}


class Correlation(Selector):
    """Of a pair above the threshold one goes: the later, the earlier, that of
    the smaller variance, or that less correlated with the target."""

    def __init__(self, columns=None, threshold=0.95, keep="first", method="pearson"):
        super().__init__(columns)
        self.threshold, self.keep, self.method = threshold, keep, method

    def choose(self, df, target):
        r = correlation_pairs(df, self.columns, self.method)
        weight: dict[str, float] = {}
        if self.keep == "higher_variance":
            weight = run_aggregates(df, {c: F.var_samp(v) for c, v in doubles(df, self.columns).items()})
        elif self.keep == "target" and target:
            weight = {c: abs(x or 0.0) for c, x in run_aggregates(df, {c: S.correlation(v, F.col(target).cast("double")) for c, v in doubles(df, self.columns).items()}).items()}
        gone: set[str] = set()
        for (a, b), x in r.items():
            self.scores[b] = max(self.scores.get(b, 0.0), abs(x))
            if abs(x) > self.threshold and a not in gone and b not in gone:
                gone.add(a if self.keep == "last" or weight and (weight.get(a) or 0.0) < (weight.get(b) or 0.0) else b)
        return [c for c in self.columns if c not in gone]


class Multicollinearity(Selector):
    """Drops the column with the worst variance inflation until none exceeds
    the threshold; one job for the correlation matrix."""

    def __init__(self, columns=None, threshold=5.0):
        super().__init__(columns)
        self.threshold = threshold

    def choose(self, df, target):
        import numpy as np

        cols = list(self.columns)
        r = correlations(df, cols)
        full = np.eye(len(cols))
        for (a, b), x in r.items():
            i, j = cols.index(a), cols.index(b)
            full[i, j] = full[j, i] = x
        left = list(range(len(cols)))
        while len(left) > 1:
            inverse = np.diag(np.linalg.pinv(full[np.ix_(left, left)]))
            self.scores |= {cols[i]: float(v) for i, v in zip(left, inverse, strict=True)}
            if inverse.max() <= self.threshold:
                break
            left.pop(int(inverse.argmax()))
        return [cols[i] for i in left]


class Statistical(Selector):
    """The k best by F of classes (anova), F of a regression, chi-square of
    sums by class, or mutual information of binned values."""

    def __init__(self, columns=None, method="anova", k: int | float | str = 10, threshold=None, bins=10):
        super().__init__(columns)
        self.method, self.k, self.threshold, self.bins = method, k, threshold, bins
        self.p_values: dict[str, float] = {}

    def anova(self, df, target):
        named = [F.count("*").alias("|n"), *[f(F.coalesce(v, F.lit(0.0))).alias(f"{c}|{k}") for c, v in doubles(df, self.columns).items() for k, f in (("s", F.sum), ("q", lambda x: F.sum(x * x)))]]
        # One row per value of the target, however many: summed up where they are.
        groups = df.where(F.col(target).isNotNull()).groupBy(target).agg(*named)
        col = lambda c, k: F.col(f"`{c}|{k}`")
        sums = {f"{c}|{k}": F.sum(x) for c in self.columns for k, x in (("s", col(c, "s")), ("q", col(c, "q")), ("b", col(c, "s") ** 2 / F.col("`|n`")))}
        r = run_aggregates(groups, {"|n": F.sum(F.col("`|n`")), "|g": F.count("*")} | sums)
        n, g = r["|n"] or 0, r["|g"]
        for c in self.columns:
            total, square = r[f"{c}|s"] or 0.0, r[f"{c}|q"] or 0.0
            between = (r[f"{c}|b"] or 0.0) - total * total / max(1, n)
            within = square - total * total / max(1, n) - between
            f = (between / (g - 1)) / (within / (n - g)) if g > 1 and n > g and within > 0 else 0.0
            self.scores[c], self.p_values[c] = f, stats.f_sf(f, g - 1, n - g) if g > 1 and n > g else 1.0

    def regression(self, df, target):
        y = F.col(target).cast("double")
        s = run_aggregates(df, {"n": F.count(y)} | {c: S.correlation(F.coalesce(v, F.lit(0.0)), y) for c, v in doubles(df, self.columns).items()})
        for c in self.columns:
            r2, n = (s[c] or 0.0) ** 2, s["n"]
            f = r2 / (1 - r2) * (n - 2) if r2 < 1 and n > 2 else math.inf
            self.scores[c], self.p_values[c] = f, stats.f_sf(f, 1, n - 2) if n > 2 else 1.0

    def chi2(self, df, target):
        named = [F.count("*").alias("|n"), *[F.sum(F.abs(F.coalesce(v, F.lit(0.0)))).alias(c) for c, v in doubles(df, self.columns).items()]]
        groups = df.where(F.col(target).isNotNull()).groupBy(target).agg(*named)
        r = run_aggregates(groups, {"|n": F.sum(F.col("`|n`")), "|g": F.count("*")} | {c: F.sum(F.col(f"`{c}`")) for c in self.columns})
        some = [c for c in self.columns if r[c]]
        expected = {c: F.lit(r[c] / r["|n"]) * F.col("`|n`") for c in some}
        x = run_aggregates(groups, {c: F.sum((F.col(f"`{c}`") - e) ** 2 / e) for c, e in expected.items()}) if some else {}
        for c in self.columns:
            self.scores[c] = x.get(c) or 0.0
            self.p_values[c] = stats.chi2_sf(self.scores[c], r["|g"] - 1)

    def information(self, df, target):
        edges = run_aggregates(df, {c: Quantile(F.coalesce(v, F.lit(0.0)), tuple(i / self.bins for i in range(1, self.bins))) for c, v in doubles(df, self.columns).items()})
        v = doubles(df, self.columns)
        binned = [F.struct(F.lit(c).alias("c"), sum(((F.coalesce(v[c], F.lit(0.0)) >= e).cast("int") for e in sorted(set(edges[c] or []))), F.lit(0)).alias("b")) for c in self.columns]
        cells = df.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), F.explode(F.array(*binned)).alias("x")).groupBy("x.c", "x.b", "y").agg(F.count("*").alias("n"))
        # The information is a difference of sums of n ln n over cells, bins and values of the target, which Spark sums up.
        weight = F.sum(F.col("n") * F.ln("n"))
        parts = [dict(cells.groupBy("c", *by).agg(F.sum("n").alias("n")).groupBy("c").agg(F.struct(weight.alias("w"), F.sum("n").alias("n")).alias("x")).collect()) for by in (("b", "y"), ("b",), ("y",))]
        for c in self.columns:
            n = parts[0][c]["n"] if c in parts[0] else 0
            self.scores[c] = max(0.0, (parts[0][c]["w"] - parts[1][c]["w"] - parts[2][c]["w"]) / n + math.log(n)) if n else 0.0

    def choose(self, df, target):
        if target is None:
            raise ValueError("a target is needed")
        {"anova": self.anova, "f_regression": self.regression, "chi2": self.chi2, "mutual_info": self.information}[self.method](df, target)
        return best(self.scores, self.columns, self.k, self.threshold)


def best(scores: dict[str, float], columns: list[str], k=None, threshold: float | str | None = None) -> list[str]:
    """The k best (a share, if a fraction), or all at or above a threshold."""
    values = [scores.get(c, 0.0) for c in columns]
    if threshold == "mean":
        threshold = sum(values) / max(1, len(values))
    elif threshold == "median":
        threshold = sorted(values)[len(values) // 2] if values else 0.0
    if threshold is not None:
        return [c for c in columns if scores.get(c, 0.0) >= threshold]
    if k == "all" or k is None:
        return list(columns)
    k = max(1, int(k * len(columns))) if isinstance(k, float) else k
    top = set(sorted(columns, key=lambda c: (-scores.get(c, 0.0), c))[:k])
    return [c for c in columns if c in top]


def assembled(df: DataFrame, columns: list[str], target: str, classify: bool | None = None):
    """Vectors, an indexed label and whether this is a classification (few or
    textual values)."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    x = df.where(F.col(target).isNotNull()).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    if classify is None:
        n = x.agg(F.approx_count_distinct(target).alias("d"), F.count("*").alias("n")).first()
        classify = df.schema[target].dataType.typeName() == "string" or n["d"] <= 10 or n["d"] < 0.05 * n["n"]
    x = StringIndexer(inputCol=target, outputCol="_y").fit(x).transform(x) if classify else x.withColumn("_y", F.col(target).cast("double"))
    return VectorAssembler(inputCols=columns, outputCol="_x").transform(x).select("_x", "_y"), classify


class Importance(Selector):
    """Impurity importances of a random forest or boosted trees."""

    def __init__(self, columns=None, k=None, threshold="mean", model="forest", trees=20, depth=5, seed=42):
        super().__init__(columns)
        self.k, self.threshold, self.model, self.trees, self.depth, self.seed = k, threshold, model, trees, depth, seed

    def choose(self, df, target):
        from pyspark.ml import classification, regression

        data, classify = assembled(df, self.columns, target)
        m = classification if classify else regression
        args = {"featuresCol": "_x", "labelCol": "_y", "maxDepth": self.depth, "seed": self.seed}
        kind = "Classifier" if classify else "Regressor"
        model = getattr(m, f"RandomForest{kind}")(numTrees=self.trees, **args) if self.model == "forest" else getattr(m, f"GBT{kind}")(maxIter=self.trees, **args)
        self.scores = dict(zip(self.columns, model.fit(data).featureImportances.toArray().tolist(), strict=True))
        return best(self.scores, self.columns, self.k, None if self.k else self.threshold)


def score(df: DataFrame, columns: list[str], target: str, folds: int = 3, seed: int = 42) -> float:
    """Held-out quality of a small forest: accuracy, or R2."""
    from pyspark.ml import classification, regression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

    from pyspark.ml.functions import vector_to_array

    data, classify = assembled(df, columns, target)
    # A row's fold is a hash of its values: the same whatever the partitions.
    data = data.withColumn("_f", F.pmod(F.xxhash64(F.lit(seed), "_y", vector_to_array("_x")), F.lit(folds))).persist()
    args = {"featuresCol": "_x", "labelCol": "_y", "numTrees": 10, "maxDepth": 4, "seed": seed}
    out = []
    for f in range(folds):
        model = (classification.RandomForestClassifier if classify else regression.RandomForestRegressor)(**args).fit(data.where(F.col("_f") != f))
        judge = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy") if classify else RegressionEvaluator(labelCol="_y", metricName="r2")
        out.append(judge.evaluate(model.transform(data.where(F.col("_f") == f))))
    data.unpersist()
    return sum(out) / len(out)


class Permutation(Selector):
    """Loss of quality when a column's values are dealt to other rows: each
    column is joined with itself at a shifted row number."""

    def __init__(self, columns=None, k=None, threshold="mean", seed=42):
        super().__init__(columns)
        self.k, self.threshold, self.seed = k, threshold, seed

    def choose(self, df, target):
        from pyspark.ml import classification, regression
        from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

        data, classify = assembled(df, self.columns, target)
        data = data.persist()
        model = (classification.RandomForestClassifier if classify else regression.RandomForestRegressor)(featuresCol="_x", labelCol="_y", numTrees=10, seed=self.seed).fit(data)
        judge = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy") if classify else RegressionEvaluator(labelCol="_y", metricName="r2")
        base = judge.evaluate(model.transform(data))
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        flat = data.select("_y", *[vector_to_array("_x")[i].alias(c) for i, c in enumerate(self.columns)]).withColumn("_r", F.xxhash64(F.lit(self.seed), F.monotonically_increasing_id()))
        wide = VectorAssembler(inputCols=self.columns, outputCol="_x")
        for c in self.columns:
            from pyspark.sql import Window

            # Neighbours in a random order, in slices: no global sort.
            w = Window.partitionBy(F.pmod("_r", F.lit(64))).orderBy("_r")
            mixed = flat.withColumn(c, F.coalesce(F.lag(c).over(w), F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
            self.scores[c] = base - judge.evaluate(model.transform(wide.transform(mixed)))
        data.unpersist()
        return best(self.scores, self.columns, self.k, None if self.k else self.threshold)


#: Classes up to which each has a column for its probability.
FEW_CLASSES = 16


class Shapley(Selector):
    """Mean absolute Shapley values of a forest's predictions, sampled: in
    every round a row turns into another one column by column, in a random
    order, and each column is credited with the change it makes. Credits of a
    row add up to its prediction less the mean of its partners'.

    Partners are neighbours in a random order, in slices, so rows move once."""

    def __init__(self, columns=None, k=None, threshold="mean", rounds=4, trees=10, depth=5, seed=42):
        super().__init__(columns)
        self.k, self.threshold, self.rounds, self.trees, self.depth, self.seed = k, threshold, rounds, trees, depth, seed

    def credits(self, df: DataFrame, target: str) -> DataFrame:
        """One array per column (of classes, or of one number), and ``_whole``, what they add up to."""
        from pyspark.ml import classification, regression
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.sql import Window

        data, classify = assembled(df, self.columns, target)
        kind = classification.RandomForestClassifier if classify else regression.RandomForestRegressor
        model = kind(featuresCol="_x", labelCol="_y", numTrees=self.trees, maxDepth=self.depth, seed=self.seed).fit(data)
        names, rng = [f"_c{i}" for i in range(len(self.columns))], random.Random(self.seed)
        rows = data.select(*[vector_to_array("_x")[i].alias(c) for i, c in enumerate(names)]).withColumn("_r", F.xxhash64(F.lit(self.seed), *names, F.monotonically_increasing_id()))
        # Predictions are columns of numbers, one a class, as arrays are worked on by interpreted functions; those of many classes are arrays, which do not move.
        self.classes = model.numClasses if classify else 1
        many = self.classes > FEW_CLASSES
        of = lambda name: [name] if many else [f"{name}_{k}" for k in range(self.classes)]
        minus = (lambda a, b: F.zip_with(a, b, lambda x, y: x - y)) if many else (lambda a, b: a - b)
        plus = (lambda a, b: F.zip_with(a, b, lambda x, y: x + y)) if many else (lambda a, b: a + b)

        def predicted(rows: DataFrame, columns: list, into: str) -> DataFrame:
            rows = rows.withColumn("_v", array_to_vector(F.array(*columns)))
            model.setFeaturesCol("_v").setPredictionCol("_p")
            if classify:
                model.setProbabilityCol("_q").setRawPredictionCol("")
            rows = model.transform(rows)
            if classify:
                rows = rows.withColumn("_q", vector_to_array("_q"))
            return rows.withColumns({c: F.col("_q") if many else F.col("_q")[k] if classify else F.col("_p") for k, c in enumerate(of(into))}).drop("_v", "_p", "_q")

        # A partner brings its prediction along, which is that of a row that has turned into it.
        if not many:
            rows = predicted(rows, names, "_own")
        rows = rows.select("_r", F.struct(*[c for c in rows.columns if c != "_r"]).alias("_row"))
        slices = Window.partitionBy(F.pmod("_r", F.lit(64))).orderBy("_r")
        every = slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({"_last": F.last("_row").over(every)} | {f"_lag{t}": F.lag("_row", t + 1).over(slices) for t in range(self.rounds)})
        rows = rows.select("_row.*", *[F.coalesce(f"_lag{t}", "_last").alias(f"_with{t}") for t in range(self.rounds)])
        if many:
            rows = predicted(rows, names, "_own")
        steps: dict[str, list] = {c: [] for c in names}
        ends = []
        for t in range(self.rounds):
            mixed, before = list(names), [F.col(c) for c in of("_own")]
            order = rng.sample(range(len(names)), len(names))
            for n, i in enumerate(order):
                mixed[i] = F.col(f"_with{t}.{names[i]}")
                if many or n + 1 < len(order):
                    rows = predicted(rows, mixed, f"_f{t}_{n}")
                    after = [F.col(c) for c in of(f"_f{t}_{n}")]
                else:
                    after = [F.col(f"_with{t}.{c}") for c in of("_own")]
                steps[names[i]].append(list(map(minus, before, after)))
                before = after
            ends.append(list(map(minus, [F.col(c) for c in of("_own")], before)))

        def mean(parts):
            sums = [reduce(plus, of_class) for of_class in zip(*parts, strict=True)]
            return F.transform(sums[0], lambda x: x / len(parts)) if many else F.array(*[x / len(parts) for x in sums])

        return rows.select(*[mean(steps[n]).alias(c) for n, c in zip(names, self.columns, strict=True)], mean(ends).alias("_whole"))

    def choose(self, df, target):
        found = self.credits(df, target)
        if self.classes > FEW_CLASSES:
            total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + F.abs(x))
        else:
            total = lambda c: sum((F.abs(F.col(c)[k]) for k in range(self.classes)), F.lit(0.0))
        size = {c: F.avg(total(c)).alias(c) for c in self.columns}
        row = found.agg(*size.values()).first()
        self.scores = {c: row[c] or 0.0 for c in self.columns}
        return best(self.scores, self.columns, self.k, None if self.k else self.threshold)


class Ensemble(Selector):
    """Mean rank, mean or median score, or votes of several selectors."""

    def __init__(self, members: list[Selector], columns=None, k=None, how="rank"):
        super().__init__(columns)
        self.members, self.k, self.how = members, k, how

    def choose(self, df, target):
        for m in self.members:
            m.columns = list(self.columns)
            m.fit(df, target)
        n = len(self.columns)
        for c in self.columns:
            ranks = [1 - sorted(self.columns, key=lambda x, m=m: (-m.scores.get(x, 0.0), x)).index(c) / max(1, n - 1) for m in self.members]
            values = sorted(m.scores.get(c, 0.0) / (max(m.scores.values(), default=0.0) or 1.0) for m in self.members)
            self.scores[c] = {"rank": sum(ranks) / len(ranks), "mean": sum(values) / len(values), "median": values[len(values) // 2], "vote": sum(c in m.kept for m in self.members) / len(self.members)}[self.how]
        return best(self.scores, self.columns, self.k, None if self.k else "mean")


class Stability(Selector):
    """How often a selector keeps a column over random parts of the rows."""

    def __init__(self, make: Callable[[], Selector], columns=None, rounds=10, share=0.8, threshold=0.6, seed=42):
        super().__init__(columns)
        self.make, self.rounds, self.share, self.threshold, self.seed = make, rounds, share, threshold, seed

    def choose(self, df, target):
        hits = dict.fromkeys(self.columns, 0)
        for i in range(self.rounds):
            s = self.make()
            s.columns = list(self.columns)
            for c in s.fit(df.sample(False, self.share, self.seed + i), target).kept:
                hits[c] += 1
        self.scores = {c: n / self.rounds for c, n in hits.items()}
        return [c for c in self.columns if self.scores[c] >= self.threshold]


class Sequential(Selector):
    """Adds the column that helps most (or drops the one that helps least)."""

    def __init__(self, columns=None, k=3, forward=True, judge: Callable = score):
        super().__init__(columns)
        self.k, self.forward, self.judge = k, forward, judge

    def choose(self, df, target):
        now = [] if self.forward else list(self.columns)
        while len(now) != min(self.k, len(self.columns)):
            options = [[*now, c] for c in self.columns if c not in now] if self.forward else [[x for x in now if x != c] for c in now]
            scored = [(self.judge(df, o, target), -i, o) for i, o in enumerate(options)]
            value, _, now = max(scored)
            self.scores |= {c: value for c in now if c not in self.scores}
        return [c for c in self.columns if c in now]


class Genetic(Selector):
    """Subsets bred by tournament, crossover and mutation; scores are kept."""

    def __init__(self, columns=None, population=8, generations=3, seed=42, judge: Callable = score):
        super().__init__(columns)
        self.population, self.generations, self.seed, self.judge = population, generations, seed, judge

    def choose(self, df, target):
        rng, known = random.Random(self.seed), {}

        def fitness(mask):
            if mask not in known:
                cols = [c for c, m in zip(self.columns, mask, strict=True) if m]
                known[mask] = self.judge(df, cols, target) if cols else -math.inf
            return known[mask]

        people = [tuple(rng.random() < 0.5 for _ in self.columns) for _ in range(self.population)]
        for _ in range(self.generations):
            people.sort(key=fitness, reverse=True)
            new = people[:2]
            while len(new) < self.population:
                a, b = (max(rng.sample(people, min(3, len(people))), key=fitness) for _ in range(2))
                new.append(tuple((x if rng.random() < 0.5 else y) ^ (rng.random() < 0.1) for x, y in zip(a, b, strict=True)))
            people = new
        top = max(people, key=fitness)
        self.scores = {c: float(m) for c, m in zip(self.columns, top, strict=True)}
        return [c for c, m in zip(self.columns, top, strict=True) if m]


def search(df: DataFrame, target: str, columns: list[str] | None = None, rounds: int = 3, width: int = 50, keep: int = 10, seed: int = 42) -> list[tuple[str, float]]:
    """Random programs of unary and binary operations, scored together by
    their correlation with the target; halves survive and are combined."""
    rng = random.Random(seed)
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    pool = {c: F.col(c).cast("double") for c in columns}
    scored: dict[str, float] = {}
    y = F.col(target).cast("double")
    for _ in range(rounds):
        made = {}
        while len(made) < width and pool:
            if rng.random() < 0.4 or len(pool) < 2:
                op, a = rng.choice(sorted(S.UNARY)), rng.choice(sorted(pool))
                made[f"{op}({a})"] = S.UNARY[op](pool[a])
            else:
                op, (a, b) = rng.choice(sorted(S.BINARY)), rng.sample(sorted(pool), 2)
                made[f"{op}({a},{b})"] = S.BINARY[op](pool[a], pool[b])
        found = run_aggregates(df, {k: S.correlation(F.when(F.abs(v) < 1e300, v), y) for k, v in made.items()})
        scored |= {k: abs(v) for k, v in found.items() if v is not None and not math.isnan(v)}
        top = sorted(((k, scored[k]) for k in made if k in scored), key=lambda x: (-x[1], x[0]))[: max(2, width // 4)]
        pool = {c: F.col(c).cast("double") for c in columns} | {k: made[k] for k, _ in top if k.count("(") < 3}
    return sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:keep]


def pareto(results: list[tuple[float, int]]) -> list[tuple[float, int]]:
    """Results (score, size) that no other beats in both."""
    return sorted(r for r in set(results) if not any((o[0] >= r[0] and o[1] <= r[1]) and o != r for o in results))


def knee(front: list[tuple[float, int]]) -> tuple[float, int] | None:
    """The point of a front farthest above the line between its ends."""
    if not front:
        return None
    front = sorted(front, key=lambda r: r[1])
    (a, x), (b, z) = front[0], front[-1]
    if z == x:
        return front[0]
    return max(front, key=lambda r: (r[0] - a) - (b - a) * (r[1] - x) / (z - x))
