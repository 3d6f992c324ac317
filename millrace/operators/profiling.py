"""Profiles, quality, contracts, drift, privacy, fairness, experiments.

Everything a table is asked is one aggregation where it can be; what is left
for the driver are a few numbers per column.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalar as S
from millrace.functions import stats
from millrace.functions.quantiles import Quantile
from millrace.operators.base import maybe_broadcast, numeric_columns, run_aggregates, string_columns, time_columns
from millrace.operators.temporal import stamp
from millrace.operators.text import words

TRUTHS = ({"true", "false"}, {"0", "1"}, {"yes", "no"}, {"y", "n"}, {"t", "f"})


def infer_types(df: DataFrame, categorical: int = 50) -> dict[str, str]:
    """Meaning of every column: datetime, boolean, numeric, text, categorical
    or unknown (no values), in this order of precedence."""
    wanted = {}
    for c in df.columns:
        kind, v = df.schema[c].dataType, F.col(c)
        s = v.cast("string")
        wanted[f"{c}|n"] = F.count(c)
        if isinstance(kind, T.StringType):
            wanted |= {
                f"{c}|num": F.avg(s.try_cast("double").isNotNull().cast("double")), f"{c}|time": F.avg(F.try_to_timestamp(s).isNotNull().cast("double")),
                f"{c}|len": F.avg(F.char_length(s)), f"{c}|words": F.avg(F.size(words(s))),
            }
        # Other types say what they are, but for two numbers that may be truths: of two values the ends are the values, in any order.
        if isinstance(kind, T.NumericType):
            wanted |= {f"{c}|d": F.approx_count_distinct(v, 0.02), f"{c}|lo": F.min(v).cast("string"), f"{c}|hi": F.max(v).cast("string")}
        elif not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)):
            wanted |= {f"{c}|d": F.approx_count_distinct(s, 0.02), f"{c}|lo": F.min(F.lower(s)), f"{c}|hi": F.max(F.lower(s))}
    s, out = run_aggregates(df, wanted), {}
    for c in df.columns:
        kind, g = df.schema[c].dataType, lambda k, c=c: s[f"{c}|{k}"]
        string = isinstance(kind, T.StringType)
        if not g("n"):
            out[c] = "unknown"
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) or string and (g("time") or 0) > 0.9 and (g("num") or 0) <= 0.9:
            out[c] = "datetime"
        elif isinstance(kind, T.BooleanType) or g("d") <= 2 and any({g("lo"), g("hi")} <= t for t in TRUTHS):
            out[c] = "boolean"
        elif isinstance(kind, T.NumericType) or string and (g("num") or 0) > 0.9:
            out[c] = "numeric"
        elif string and g("d") > categorical and (g("len") > 50 or g("words") > 5):
            out[c] = "text"
        else:
            out[c] = "categorical"
    return out


def profile_numeric(df: DataFrame, columns: list[str] | None = None, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column: moments and exact percentiles."""
    cols = columns or numeric_columns(df)
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]
    long = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    v = F.col("v")
    moments = long.groupBy("column").agg(
        F.count("*").alias("rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"),
    )
    distinct = long.where(v.isNotNull()).groupBy("column", "v").agg(F.lit(1).alias("k")).groupBy("column").agg(F.count("*").alias("distinct"))
    ranked = run_aggregates(df, {c: Quantile(F.col(c), tuple(percentiles)) for c in cols})
    found = [(c, *(ranked[c] or [None] * len(percentiles))) for c in cols]
    middle = df.sparkSession.createDataFrame(found, ", ".join(["column string", *[f"p{round(100 * p)} double" for p in percentiles]]))
    whole = moments.join(F.broadcast(middle), "column").join(F.broadcast(distinct), "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    return whole.select("column", "rows", "n", "mean", "std", "min", "max", *middle.columns[1:], "skew", "kurtosis", "zeros", "negatives", "distinct")


def profile_categorical(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct values, mode, its share, entropy in nats."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return n.crossJoin(F.broadcast(total)).agg(F.count("*").alias("distinct"), F.max_by("v", F.struct("n", F.lit("x"))).alias("mode"), (F.max("n") / F.max("t")).alias("mode_share"), F.sum(-p * F.ln(p)).alias("entropy"))


def profile_text(df: DataFrame, column: str) -> DataFrame:
    c = F.coalesce(F.col(column), F.lit(""))
    n, w = F.char_length(c), F.size(words(c))
    return df.agg(F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(w).alias("avg_words"), F.max(w).alias("max_words"))


def profile_time(df: DataFrame, column: str) -> DataFrame:
    ts = stamp(column)
    return df.agg(F.min(ts).alias("min"), F.max(ts).alias("max"), ((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 86400e6).alias("range_days"), F.mode(F.weekday(ts), True).alias("weekday"), F.mode(F.month(ts), True).alias("month"))


def duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of their kind."""
    n = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"))


def quality(df: DataFrame, target: str | None = None, missing=0.3, constant=0.99, z=3.0, many=100) -> list[dict]:
    """Issues by column with a severity, worst first."""
    nums = numeric_columns(df)
    m = run_aggregates(df, {"|n": F.count("*")} | {f"{c}|{k}": v for c in df.columns for k, v in (("null", F.count_if(F.col(c).isNull())), ("d", F.approx_count_distinct(c)))} | {f"{c}|{k}": f(F.col(c).cast("double")) for c in nums for k, f in (("m", F.avg), ("s", F.stddev_samp))})
    n, out = m["|n"] or 1, []
    far = {c: F.avg((F.abs(F.col(c) - F.lit(m[f"{c}|m"])) > z * m[f"{c}|s"]).cast("double")) for c in nums if m[f"{c}|s"]}
    leak = {f"{c}|r": S.correlation(F.col(c).cast("double"), F.col(target).cast("double")) for c in nums if target and c != target}
    extra = run_aggregates(df, far | leak)
    for c in df.columns:
        share = m[f"{c}|null"] / n
        if share > missing:
            out.append({"column": c, "issue": "missing", "value": share, "severity": "high" if share > 0.7 else "medium"})
        if m[f"{c}|d"] <= 1:
            out.append({"column": c, "issue": "constant", "value": 1.0, "severity": "medium"})
        if c in string_columns(df) and m[f"{c}|d"] > many:
            out.append({"column": c, "issue": "cardinality", "value": m[f"{c}|d"], "severity": "low"})
        if (extra.get(c) or 0.0) > 0.01:
            out.append({"column": c, "issue": "outliers", "value": extra[c], "severity": "low"})
        if abs(extra.get(f"{c}|r") or 0.0) > 0.95:
            out.append({"column": c, "issue": "leakage", "value": extra[f"{c}|r"], "severity": "high"})
    rank = {"high": 0, "medium": 1, "low": 2}
    return sorted(out, key=lambda x: (rank[x["severity"]], x["column"], x["issue"]))


def quality_score(issues: list[dict]) -> float:
    return max(0.0, 100.0 - sum({"low": 2, "medium": 5, "high": 10}[i["severity"]] for i in issues))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts of equally wide bins; the last is closed."""
    v = F.col(column).cast("double")
    s = run_aggregates(df, {"lo": F.min(v), "hi": F.max(v)})
    lo, hi = s["lo"] or 0.0, s["hi"] or 0.0
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int")
    return df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("from", lo + F.col("bin") * width)


# Contracts


@dataclass
class ColumnContract:
    dtype: str
    max_null: float = 1.0
    min_value: float | None = None
    max_value: float | None = None
    mean_range: tuple[float, float] | None = None
    allowed: list[str] | None = None


@dataclass
class Contract:
    name: str
    columns: dict[str, ColumnContract] = field(default_factory=dict)
    min_rows: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> Contract:
        d = json.loads(text)
        return cls(d["name"], {k: ColumnContract(**{**v, "mean_range": tuple(v["mean_range"]) if v.get("mean_range") else None}) for k, v in d["columns"].items()}, d["min_rows"])


def make_contract(df: DataFrame, name: str = "contract", tolerance: float = 1.5, null_tolerance: float = 0.1, most: int = 100) -> Contract:
    nums, strs = numeric_columns(df), string_columns(df)
    m = run_aggregates(df, {"|n": F.count("*")} | {f"{c}|null": F.count_if(F.col(c).isNull()) for c in df.columns} | {f"{c}|{k}": f(F.col(c).cast("double")) for c in nums for k, f in (("lo", F.min), ("hi", F.max), ("m", F.avg), ("s", F.stddev_samp))} | {f"{c}|d": F.approx_count_distinct(c) for c in strs})
    out = Contract(name, min_rows=(m["|n"] or 0) // 10)
    for c in df.columns:
        k = ColumnContract(df.schema[c].dataType.simpleString(), min(1.0, (m[f"{c}|null"] or 0) / max(1, m["|n"]) + null_tolerance))
        if c in nums and m[f"{c}|lo"] is not None:
            spread = (m[f"{c}|hi"] - m[f"{c}|lo"]) * (tolerance - 1)
            sd = (m[f"{c}|s"] or 0.0) * tolerance
            k.min_value, k.max_value, k.mean_range = m[f"{c}|lo"] - spread, m[f"{c}|hi"] + spread, (m[f"{c}|m"] - sd, m[f"{c}|m"] + sd)
        elif c in strs and m[f"{c}|d"] <= most:
            k.allowed = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(2 * most).collect())
        out.columns[c] = k
    return out


def check_contract(df: DataFrame, contract: Contract) -> list[dict]:
    """Violations; one aggregation."""
    have = {c: k for c, k in contract.columns.items() if c in df.columns}
    wanted = {"|n": F.count("*")}
    for c, k in have.items():
        wanted[f"{c}|null"] = F.count_if(F.col(c).isNull())
        if k.min_value is not None or k.max_value is not None or k.mean_range:
            wanted |= {f"{c}|lo": F.min(F.col(c).cast("double")), f"{c}|hi": F.max(F.col(c).cast("double")), f"{c}|m": F.avg(F.col(c).cast("double"))}
        if k.allowed is not None:
            wanted[f"{c}|other"] = F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(k.allowed))
    m = run_aggregates(df, wanted)
    out = [{"column": c, "check": "exists", "value": None} for c in contract.columns if c not in have]
    if m["|n"] < contract.min_rows:
        out.append({"column": None, "check": "min_rows", "value": m["|n"]})
    for c, k in have.items():
        if m["|n"] and m[f"{c}|null"] / m["|n"] > k.max_null:
            out.append({"column": c, "check": "max_null", "value": m[f"{c}|null"] / m["|n"]})
        if k.dtype != df.schema[c].dataType.simpleString():
            out.append({"column": c, "check": "dtype", "value": df.schema[c].dataType.simpleString()})
        if (lo := m.get(f"{c}|lo")) is not None:
            if k.min_value is not None and lo < k.min_value:
                out.append({"column": c, "check": "min_value", "value": lo})
            if k.max_value is not None and m[f"{c}|hi"] > k.max_value:
                out.append({"column": c, "check": "max_value", "value": m[f"{c}|hi"]})
            if k.mean_range and not k.mean_range[0] <= m[f"{c}|m"] <= k.mean_range[1]:
                out.append({"column": c, "check": "mean_range", "value": m[f"{c}|m"]})
        if m.get(f"{c}|other"):
            out.append({"column": c, "check": "allowed", "value": m[f"{c}|other"]})
    return out


# Drift


def psi(expected: DataFrame, actual: DataFrame, columns: list[str], bins: int = 10, strategy: str = "quantile", epsilon: float = 1e-6) -> DataFrame:
    """``column, psi``: population stability index; edges of the expected
    side, the last bin closed, values outside in none (but in the total)."""
    v = {c: F.col(c).cast("double") for c in columns}
    if strategy == "quantile":
        edges = {c: sorted(set(e or [])) for c, e in run_aggregates(expected, {c: Quantile(v[c], tuple(i / bins for i in range(bins + 1))) for c in columns}).items()}
    else:
        s = run_aggregates(expected, {f"{c}|{k}": f(v[c]) for c in columns for k, f in (("lo", F.min), ("hi", F.max))})
        edges = {c: S.even_edges(s[f"{c}|lo"] or 0.0, s[f"{c}|hi"] or 0.0, bins) for c in columns}

    def shares(df):
        n = {f"{c}|n": F.count(v[c]) for c in columns}
        cells = {f"{c}|{i}": F.count_if((v[c] >= e[i]) & ((v[c] <= e[i + 1]) if i == len(e) - 2 else (v[c] < e[i + 1]))) for c, e in edges.items() for i in range(len(e) - 1)}
        return run_aggregates(df, n | cells)

    a, b, out = shares(expected), shares(actual), []
    for c, e in edges.items():
        total = 0.0
        for i in range(len(e) - 1):
            p, q = a[f"{c}|{i}"] / max(1, a[f"{c}|n"]) + epsilon, b[f"{c}|{i}"] / max(1, b[f"{c}|n"]) + epsilon
            total += (q - p) * math.log(q / p)
        out.append((c, total))
    return expected.sparkSession.createDataFrame(out, "column string, psi double")


def interpret_psi(x: float) -> str:
    return "none" if x < 0.1 else "minor" if x < 0.2 else "moderate" if x < 0.25 else "significant"


def ks(expected: DataFrame, actual: DataFrame, column: str) -> DataFrame:
    """``statistic, n, m``: largest distance of the two distribution functions.

    Counts by distinct value first; the running sum goes over slices of the
    value range, then over the slices' totals.
    """
    both = expected.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(actual.select(F.col(column).cast("double").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where("v is not null")
    cells = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    s = run_aggregates(both, {"n": F.sum("a"), "m": F.sum("b"), "q": F.percentile_approx("v", F.array(*[F.lit(i / 32) for i in range(1, 32)]))})
    part = sum(((F.col("v") >= q).cast("int") for q in sorted(set(s["q"] or []))), F.lit(0))
    cells = cells.withColumn("p", part)
    w = Window.partitionBy("p").orderBy("v")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    totals = cells.groupBy("p").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")).withColumns({"oa": F.coalesce(F.sum("ta").over(before), F.lit(0)), "ob": F.coalesce(F.sum("tb").over(before), F.lit(0))})
    run = cells.withColumns({"ca": F.sum("a").over(w), "cb": F.sum("b").over(w)}).join(F.broadcast(totals), "p")
    n, m = F.lit(s["n"] or 1), F.lit(s["m"] or 1)
    return run.agg(F.max(F.abs((F.col("ca") + F.col("oa")) / n - (F.col("cb") + F.col("ob")) / m)).alias("statistic"), F.lit(s["n"]).alias("n"), F.lit(s["m"]).alias("m"))


def js(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10) -> float:
    """Jensen-Shannon divergence over bins of the joint range."""
    v = F.col(column).cast("double")
    a, b = (run_aggregates(d, {"lo": F.min(v), "hi": F.max(v)}) for d in (expected, actual))
    lo, hi = min(a["lo"], b["lo"]), max(a["hi"], b["hi"])
    width = (hi - lo) / bins or 1.0
    cell = F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int")
    p, q = ({r[0]: r[1] for r in d.where(v.isNotNull()).groupBy(cell.alias("b")).count().collect()} for d in (expected, actual))
    sp, sq, out = sum(p.values()), sum(q.values()), 0.0
    for i in range(bins):
        x, y = p.get(i, 0) / sp, q.get(i, 0) / sq
        mid = (x + y) / 2
        out += (x * math.log(x / mid) if x else 0.0) / 2 + (y * math.log(y / mid) if y else 0.0) / 2
    return out


def observe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Metrics of a batch: one row per column."""
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    long = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return long.groupBy("column").agg((1 - F.count("v") / F.count("*")).alias("null_rate"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count_distinct("v").alias("cardinality"))


def retraining(psi_by_column: dict[str, float], limit: float = 0.2, share: float = 0.2) -> bool:
    return bool(psi_by_column) and sum(x >= limit for x in psi_by_column.values()) / len(psi_by_column) >= share


def freshness(df: DataFrame, time: str, now: str, max_hours: float) -> DataFrame:
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.max(stamp(time)))) / 3600e6
    return df.agg(age.alias("age_hours"), (age > max_hours).alias("stale"))


# Privacy


class Budget:
    """A ledger of privacy losses; spending beyond it raises."""

    def __init__(self, epsilon: float = 1.0, delta: float = 1e-5):
        self.epsilon, self.delta, self.log = epsilon, delta, []

    def spend(self, epsilon: float, what: str = "") -> None:
        if sum(e for e, _ in self.log) + epsilon > self.epsilon + 1e-12:
            raise ValueError(f"privacy budget exhausted: {what}")
        self.log.append((epsilon, what))


def compose(epsilons: Sequence[float], delta: float = 1e-5) -> float:
    """Least of basic and advanced composition."""
    return min(sum(epsilons), math.sqrt(2 * sum(e * e for e in epsilons) * math.log(1 / delta)))


def rdp_to_dp(alpha: float, epsilon: float, delta: float = 1e-5) -> float:
    return epsilon + math.log(1 / delta) / (alpha - 1)


def laplace(scale: float, rng: random.Random) -> float:
    u = rng.random() - 0.5
    return -scale * math.copysign(math.log(max(1e-300, 1 - 2 * abs(u))), u)


def private(df: DataFrame, column: str, what: str, lo: float, hi: float, epsilon: float | None = 0.1, budget: Budget | None = None, seed: int | None = None) -> float:
    """Mean, sum or count of clipped values with Laplace noise (none if epsilon
    is None)."""
    v = S.clip(F.col(column).cast("double"), lo, hi)
    s = run_aggregates(df, {"mean": F.avg(v), "sum": F.sum(v), "count": F.count(v)})
    if epsilon is None:
        return s[what]
    if budget:
        budget.spend(epsilon, f"{what}({column})")
    width = {"mean": (hi - lo) / max(1, s["count"]), "sum": hi - lo, "count": 1.0}[what]
    return (s[what] or 0.0) + laplace(width / epsilon, random.Random(seed))


def private_histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int = 10, epsilon: float = 0.1, seed: int | None = None) -> list[float]:
    v = S.clip(F.col(column).cast("double"), lo, hi)
    cell = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    n, rng = {r[0]: r[1] for r in df.where(v.isNotNull()).groupBy(cell.alias("b")).count().collect()}, random.Random(seed)
    return [max(0.0, n.get(i, 0) + laplace(1 / epsilon, rng)) for i in range(bins)]


def federated(df: DataFrame, party: str, column: str, lo: float, hi: float, epsilon: float | None = 1.0, seed: int | None = None) -> dict[str, float | None]:
    """Mean and deviation from two noisy sums per party, of which each spends
    half of epsilon. Noise is drawn afresh unless a seed is given; sums are
    taken over parties in Spark, as a party's noise is a column (the difference
    of two exponential draws). Without values both are null."""
    v = S.clip(F.col(column).cast("double"), lo, hi)
    parts = df.groupBy(party).agg(F.count(v).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("q"))

    seeds = random.Random(seed) if seed is not None else random.SystemRandom()

    def noise(width: float):
        draw = lambda: F.ln(1 - F.rand(seeds.getrandbits(62)))
        return (draw() - draw()) * (2 * width / epsilon) if epsilon else F.lit(0.0)

    told = parts.select("n", (F.col("s") + noise(max(abs(lo), abs(hi)))).alias("s"), (F.col("q") + noise(max(lo * lo, hi * hi))).alias("q"))
    r = told.agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).first()
    if not r["n"]:
        return {"mean": None, "std": None}
    return {"mean": r["s"] / r["n"], "std": math.sqrt(max(0.0, r["q"] / r["n"] - (r["s"] / r["n"]) ** 2))}


def k_anonymity(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Groups and rows below k."""
    n = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("groups"), F.min("n").alias("smallest"), F.count_if(F.col("n") < k).alias("groups_below"), F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias("rows_below"))


def suppress(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Quasi-identifiers become null in groups below k (null keys are a group)."""
    n = df.groupBy(*[F.col(c).alias(f"_{c}") for c in columns]).agg(F.count("*").alias("_n"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(n, same).select(*[F.when(F.col("_n") >= k, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def generalize(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """``column`` becomes the text of its equally wide, right-closed interval
    ``(lo, hi]``; the first one also holds the minimum. One value fills one."""
    s = run_aggregates(df, {"lo": F.min(column).cast("double"), "hi": F.max(column).cast("double")})
    if s["lo"] is None:
        return df.withColumn(column, F.lit(None).cast("string"))
    lo, width = s["lo"], (s["hi"] - s["lo"]) / bins
    i = F.greatest(F.ceil((F.col(column) - lo) / width), F.lit(1)) if width else F.lit(1)
    i = F.least(i, F.lit(bins)).cast("double")
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.format_string("(%.2f, %.2f]", F.lit(lo) + (i - 1) * width, F.lit(lo) + i * width)))


# Fairness


def parity(df: DataFrame, protected: str, column: str) -> DataFrame:
    """Range of group means over their largest size (demographic parity), and
    the ratio of the least to the largest share above the overall median."""
    middle = run_aggregates(df, {"m": Quantile(F.col(column), 0.5)})["m"]
    g = df.where(F.col(protected).isNotNull()).groupBy(protected).agg(F.avg(column).alias("m"), F.avg((F.col(column) > F.lit(middle)).cast("double")).alias("s"))
    return g.agg(S.ratio(F.max("m") - F.min("m"), F.max(F.abs("m")), 0.0).alias("parity_gap"), S.ratio(F.min("s"), F.max("s"), 0.0).alias("impact_ratio"))


def equal_odds(df: DataFrame, protected: str, column: str, label: str) -> DataFrame:
    """``groups, odds_gap``: range over groups of the correlation of a feature
    with the label (groups in which it is undefined say nothing)."""
    g = df.where(F.col(protected).isNotNull()).groupBy(protected).agg(F.corr(F.col(column).cast("double"), F.col(label).cast("double")).alias("r"))
    g = g.where(F.col("r").isNotNull() & ~F.isnan("r"))
    return g.agg(F.count("*").alias("groups"), (F.max("r") - F.min("r")).alias("odds_gap"))


def residualize(df: DataFrame, column: str, protected: str) -> DataFrame:
    """``<c>_fair``: what a least-squares line on the protected attribute (its
    rank, if it is text) leaves."""
    if protected in string_columns(df):
        code = df.select(F.col(protected).alias("_k")).where("_k is not null").distinct().withColumn("_x", (F.row_number().over(Window.orderBy("_k")) - 1).cast("double"))
        df = df.join(maybe_broadcast(code), F.col(protected) == F.col("_k"), "left").drop("_k")
    else:
        df = df.withColumn("_x", F.col(protected).cast("double"))
    y = F.col(column).cast("double")
    s = run_aggregates(df, {"b": F.regr_slope(y, F.col("_x")), "a": F.regr_intercept(y, F.col("_x"))})
    return df.withColumn(f"{column}_fair", y - (F.lit(s["a"] or 0.0) + F.lit(s["b"] or 0.0) * F.col("_x"))).drop("_x")


# Experiments


def variant(df: DataFrame, unit: str, variants: dict[str, float], salt: str = "") -> DataFrame:
    """A variant per unit by hash, in the given shares."""
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(F.col(unit).cast("string"), F.lit(""))).cast("binary"))
    x, upto, edges = F.pmod(F.conv(F.right(digest, F.lit(8)), 16, 10).cast("long"), F.lit(10_000)) / 10_000.0, 0.0, []
    for name, share in variants.items():
        upto += share
        edges.append((upto, name))
    out = F.lit(None).cast("string")
    for edge, name in reversed(edges):
        out = F.when(x < edge, name).otherwise(out)
    return df.withColumn("variant", out)


def compare_variants(df: DataFrame, variant_column: str, metric: str, control: str) -> list[dict]:
    """Welch's test of every variant against the control."""
    g = {r[0]: r for r in df.groupBy(variant_column).agg(F.avg(metric).alias("m"), F.var_samp(metric).alias("v"), F.count(metric).alias("n")).collect()}
    c, out = g[control], []
    for name, r in sorted(g.items()):
        if name != control and r["n"] > 1 and c["n"] > 1:
            t, p = stats.welch(r["m"], r["v"], r["n"], c["m"], c["v"], c["n"])
            out.append({"variant": name, "difference": r["m"] - c["m"], "t": t, "p": p})
    return out


def suggest(df: DataFrame) -> list[tuple[str, str]]:
    """Operators that suit the columns: (column, operator)."""
    kinds, out = infer_types(df), []
    nums = [c for c in numeric_columns(df) if kinds[c] == "numeric"]
    m = run_aggregates(df, {f"{c}|s": F.skewness(F.col(c).cast("double")) for c in nums} | {f"{c}|d": F.approx_count_distinct(c) for c in df.columns} | {f"{c}|n": F.count_if(F.col(c).isNull()) for c in df.columns})
    for c, k in kinds.items():
        if m[f"{c}|n"]:
            out.append((c, "impute"))
        if c in nums and abs(m[f"{c}|s"] or 0.0) > 1:
            out.append((c, "log"))
        if k == "categorical":
            out.append((c, "onehot" if m[f"{c}|d"] <= 10 else "target"))
        if k == "datetime" and c in time_columns(df):
            out.append((c, "components"))
        if k == "text":
            out.append((c, "text"))
    return out
