"""Kendall's tau against all pairs of rows."""

import numpy as np
import pytest

from millrace.functions import concordance as C
from millrace.operators import selection


def plain(x, y):
    keep = ~(np.isnan(x) | np.isnan(y))
    x, y = x[keep], y[keep]
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    under = np.sqrt((sx != 0).sum() * (sy != 0).sum())
    return float((sx * sy).sum() / under) if under else None


def test_discordant_pairs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 17, 64, 200):
        x, y, k = rng.integers(0, 12, n).astype(float), rng.integers(0, 9, n).astype(float), rng.integers(1, 5, n)
        want = sum(k[i] * k[j] for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
        assert C.discordant(x, y, k) == want


@pytest.mark.parametrize("largest", [7, 60, 10**6])
def test_kendall(spark, largest, monkeypatch):
    """Rounds of any depth; ties, a value that half of the rows have, nulls and NaN."""
    monkeypatch.setattr(C, "SLICES", 4)
    rng = np.random.default_rng(1)
    n = 400
    a = rng.normal(size=n)
    b = np.where(rng.random(n) < 0.5, 3.0, a + rng.normal(size=n))
    c = rng.integers(0, 5, n).astype(float)
    d = np.full(n, 7.0)
    a[:5], c[3:9] = np.nan, np.nan
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(zip(a, b, c, d, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("a", "d"), ("a", "a")]
    col = dict(a=a, b=b, c=c, d=d)
    got = {(r["left"], r["right"]): r["tau"] for r in C.kendall(df, pairs, largest).collect()}
    for p in pairs:
        want = plain(col[p[0]], col[p[1]])
        assert got[p] == (None if want is None else pytest.approx(want, abs=1e-12)), p
    assert [r["tau"] for r in C.kendall(df.limit(0), pairs[:1], largest).collect()] == [None]


def test_selector_by_rank(spark):
    x = np.random.default_rng(4).normal(size=300)
    df = spark.createDataFrame([(float(v), float(np.exp(3 * v)), float(-v * v)) for v in x], "a double, b double, c double")
    for method in ("kendall", "spearman"):
        s = selection.Correlation(["a", "b", "c"], 0.95, method=method).fit(df)
        assert s.transform(df).columns == ["a", "c"]
    assert selection.Correlation(["a", "b", "c"], 0.95).fit(df).transform(df).columns == ["a", "b", "c"]


@pytest.mark.parametrize("rows", [10**6, 40, 3])
def test_ranks_in_slices(spark, rows):
    from millrace.functions.quantiles import average_ranks

    rng = np.random.default_rng(9)
    v = np.concatenate([rng.integers(0, 30, 300).astype(float), rng.normal(size=200)])
    counts = spark.createDataFrame([(float(x),) for x in v], "v double").groupBy("v").agg(C.F.count("*").alias("k"))
    got = {r["v"]: r["rank"] for r in average_ranks(counts, rows).collect()}
    assert got == {float(x): float((v < x).sum() + ((v == x).sum() + 1) / 2) for x in set(v.tolist())}
    assert average_ranks(counts.limit(0), rows).count() == 0
