"""Fingerprints of columns: what worked on a column is tried on those like it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.operators.base import numeric_columns, run_aggregates

BINS = 10


def fingerprints(df: DataFrame, columns: list[str] | None = None) -> dict[str, list[float]]:
    """Null rate, cardinality, moments and a histogram of every column; two
    aggregations for all of them."""
    cols = columns or numeric_columns(df)
    v = {c: F.col(c).cast("double") for c in cols}
    s = run_aggregates(df, {"|n": F.count("*")} | {f"{c}|{k}": f(x) for c, x in v.items() for k, f in (("n", F.count), ("d", F.approx_count_distinct), ("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max), ("k", F.skewness))})
    cells = {}
    for c, x in v.items():
        lo, width = s[f"{c}|lo"] or 0.0, ((s[f"{c}|hi"] or 0.0) - (s[f"{c}|lo"] or 0.0)) / BINS or 1.0
        bin_ = F.least(F.floor((x - lo) / width), F.lit(BINS - 1))
        cells |= {f"{c}|{i}": F.count_if(bin_ == i) for i in range(BINS)}
    h, n, out = run_aggregates(df, cells), s["|n"] or 1, {}
    for c in cols:
        m, sd, k = s[f"{c}|m"] or 0.0, s[f"{c}|s"] or 0.0, s[f"{c}|k"]
        squash = lambda x: math.copysign(math.log1p(abs(x)), x)
        out[c] = [1 - s[f"{c}|n"] / n, s[f"{c}|d"] / n, squash(m) / 10, squash(sd) / 10, squash(k if k is not None and not math.isnan(k) else 0.0), *(3 * h[f"{c}|{i}"] / max(1, s[f"{c}|n"]) for i in range(BINS))]
    return out


def likeness(a: list[float], b: list[float]) -> float:
    return 1 / (1 + math.dist(a, b))


def match(source: DataFrame, target: DataFrame, least: float = 0.6) -> list[tuple[str, str, float]]:
    """Columns of the target with the source column most like them."""
    a, b, out = fingerprints(source), fingerprints(target), []
    for t, x in b.items():
        best = max(((likeness(x, y), s) for s, y in a.items()), default=None)
        if best and best[0] >= least:
            out.append((t, best[1], best[0]))
    return out


def apply(source: DataFrame, target: DataFrame, worked: dict[str, list[str]], least: float = 0.6) -> DataFrame:
    """Unary operations that worked on source columns, on target columns like
    them: ``<c>_<operation>_transfer``."""
    new = {f"{t}_{op}_transfer": S.UNARY[op](F.col(t).cast("double")) for t, s, _ in match(source, target, least) for op in worked.get(s, [])}
    return target.withColumns(new)
