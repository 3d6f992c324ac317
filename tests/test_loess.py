"""STL against a plain version: local lines by weighted least squares, point by point."""

import numpy as np
import pytest

from millrace.operators import loess as L


def plain_loess(y, q, weight, at):
    n, out = len(y), []
    for x in at:
        near = sorted(range(1, n + 1), key=lambda j: (abs(j - x), j))[: min(q, n)]
        # Of points equally far on both sides either may be taken; windows are odd, so ends only.
        lo, hi = min(near), max(near)
        h = max(abs(x - lo), abs(hi - x)) + max(0, q - n) // 2
        w = {j: (1 if abs(j - x) <= 0.001 * h else (1 - (abs(j - x) / h) ** 3) ** 3 if abs(j - x) <= 0.999 * h else 0) * weight[j - 1] for j in near}
        some = [j for j in near if w[j] > 0]
        if not some:
            out.append(y[min(max(x, 1), n) - 1])
            continue
        a = np.array([[1.0, j] for j in some]) * np.sqrt([[w[j]] for j in some])
        b = np.array([y[j - 1] for j in some]) * np.sqrt([w[j] for j in some])
        c = np.linalg.lstsq(a, b, rcond=None)[0] if len(some) > 1 else [y[some[0] - 1], 0.0]
        out.append(c[0] + c[1] * x)
    return np.array(out)


def plain_stl(y, w, inner, outer):
    n, p = len(y), w.period
    trend, season, rho = np.zeros(n), np.zeros(n), np.ones(n)
    mean = lambda v, k: np.array([v[i : i + k].mean() for i in range(len(v) - k + 1)])
    for turn in range(outer + 1):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * p)
            for f in range(p):
                own = (y - trend)[f::p]
                for k, v in enumerate(plain_loess(own, w.seasonal, rho[f::p], range(len(own) + 2))):
                    cycle[f + k * p] = v
            slow = plain_loess(mean(mean(mean(cycle, p), p), 3), w.low, np.ones(n), range(1, n + 1))
            season = cycle[p : p + n] - slow
            trend = plain_loess(y - season, w.trend, rho, range(1, n + 1))
        r = np.abs(y - trend - season)
        h = 6 * np.median(r)
        rho = np.where(r <= 0.001 * h, 1, np.where(r <= 0.999 * h, (1 - (r / h) ** 2) ** 2, 0))
    return season, trend


def series(n, p, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 0.02 * t + 3 * np.sin(2 * np.pi * t / p) + rng.normal(0, 0.3, n) + np.where(rng.random(n) < 0.03, 8, 0)


@pytest.mark.parametrize("n, p, robust", [(60, 7, False), (61, 4, True), (30, 12, False), (9, 4, False), (8, 4, False)])
def test_like_plain(n, p, robust):
    y, w = series(n, p), L.Windows(p)
    inner, outer = (2, 3) if robust else (5, 0)
    season, trend = L.stl(y, w, robust, inner, outer)
    s, t = plain_stl(y, w, inner, outer)
    assert np.allclose(season, s, atol=1e-8) and np.allclose(trend, t, atol=1e-8)


def test_robust_fits_ignore_outliers():
    y = series(140, 7, 3)
    clean = 0.02 * np.arange(140)
    errors = [np.abs(L.stl(y, L.Windows(7), robust)[1] - clean).max() for robust in (False, True)]
    assert errors[1] < errors[0] and errors[1] < 0.6


def test_missing_values_have_no_weight():
    y = series(80, 7, 5)
    holes = y.copy()
    holes[[10, 11, 40]] = np.nan
    s, t = L.stl(holes, L.Windows(7))
    assert not np.isnan(s + t).any() and np.abs(s + t - sum(L.stl(y, L.Windows(7)))).max() < 3


def frame(spark, n=700, p=7):
    rows = []
    for k, key in enumerate(["a", None]):
        rows += [(key, i, float(v), "x") for i, v in enumerate(series(n, p, k))]
    rows += [("short", i, 1.0, "x") for i in range(2 * p - 1)] + [("nulls", i, None, "x") for i in range(50)] + [("hole", i, None if i == 20 else float(i % p), "x") for i in range(60)]
    return spark.createDataFrame(rows, "k string, t int, v double, _no_name string").repartition(5)


def test_frames(spark):
    df = frame(spark)
    out = L.decompose_stl(df, "v", 7, ["k"], ["t"])
    assert out.columns == [*df.columns, "v_trend", "v_seasonal", "v_residual", "v_seasonal_strength"] and out.count() == df.count()
    pdf = out.toPandas().sort_values("t")
    for k, key in enumerate(["a", None]):
        own = pdf[pdf["k"].isna()] if key is None else pdf[pdf["k"] == key]
        s, t = L.stl(series(700, 7, k), L.Windows(7))
        assert np.allclose(own["v_seasonal"], s) and np.allclose(own["v_trend"], t) and np.allclose(own["v_trend"] + own["v_seasonal"] + own["v_residual"], own["v"])
        both = own["v_residual"] + own["v_seasonal"]
        assert np.allclose(own["v_seasonal_strength"], max(0, 1 - own["v_residual"].var(ddof=0) / both.var(ddof=0)))
    assert pdf[pdf["k"].isin(["short", "nulls"])]["v_trend"].isna().all()
    hole = pdf[(pdf["k"] == "hole") & (pdf["t"] == 20)].iloc[0]
    assert hole["v_residual"] != hole["v_residual"] and abs(hole["v_trend"] + hole["v_seasonal"] - 6) < 0.5
    assert L.decompose_stl(df.limit(0), "v", 7, ["k"], ["t"]).count() == 0


def test_slices_agree_with_the_whole(spark):
    """Long entities in overlapping slices: what lies outside a slice's reach hardly matters."""
    df = frame(spark, 700).where("k = 'a' or k is null")
    whole, parts = (L.decompose_stl(df, "v", 7, ["k"], ["t"], step=s).toPandas().sort_values(["k", "t"]) for s in (200, 15))
    for c in ("v_trend", "v_seasonal"):
        assert np.abs(whole[c].to_numpy() - parts[c].to_numpy()).max() < 0.05


def test_numbers_by_range(spark):
    """Rows numbered in ranges of their order, with ties and nulls."""
    rows = [(k, None if i % 50 == 0 else float(i % 37), i) for k in ("a", None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t double, i int")
    got = {(r["k"], r["i"]): (r["n"], r["n_of"]) for r in L.numbered(df, ["k"], ["t", "i"], "n", rows=40).collect()}
    for k in ("a", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[k, r[2]] for r in own] == [(i, 300) for i in range(300)]
