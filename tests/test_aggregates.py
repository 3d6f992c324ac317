"""Own aggregates, and medians and modes, against pandas."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from millrace.operators import aggregates as A
from millrace.operators import numeric, relational


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    # One group has half of all rows; values tie, are null or NaN.
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, 1.0, 2.0, float(rng.randrange(40)), rng.random()]), i) for i in range(1200)] + [("empty", None, 0)]
    return spark.createDataFrame(rows, "k string, v double, i int").repartition(6)


def groups(frame):
    pdf = frame.toPandas()
    return {None if pd.isna(k) else k: g["v"].dropna() for k, g in pdf.groupby("k", dropna=False)}


@pytest.mark.parametrize("rows", [10**6, 50, 7])
@pytest.mark.parametrize("at", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_quantiles_of_groups(frame, rows, at):
    got = {r["k"]: r["q"] for r in A.group_quantile(frame, ["k"], "v", at, "q", rows).collect()}
    want = {k: float(np.quantile(v, at)) for k, v in groups(frame).items() if len(v)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_modes_of_groups(frame):
    got = {r["k"]: r["m"] for r in A.group_mode(frame, ["k"], "v", "m").collect()}
    assert got == {k: float(v.mode().iloc[0]) for k, v in groups(frame).items() if len(v)}
    assert A.group_mode(frame.limit(0), ["k"], "v").count() == A.group_quantile(frame.limit(0), ["k"], "v").count() == 0


def test_reduced(frame, monkeypatch):
    span = A.Reduced("span", "lo double, hi double", "double", lambda x: (x.min(), x.max()), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: s[1] - s[0])
    got = {r["k"]: r["v_span"] for r in A.reduced(frame, ["k"], "v", span).collect()}
    assert got == {k: pytest.approx(v.max() - v.min()) for k, v in groups(frame).items() if len(v)}
    top = {r["k"]: r["x"] for r in A.reduced(frame, ["k"], "v", A.largest(3), "x").collect()}
    assert top == {k: pytest.approx(sum(sorted(set(v))[-3:])) for k, v in groups(frame).items() if len(v)}
    counted = A.Reduced("rows", "n long", "long", lambda x: (len(x),), lambda a, b: (a[0] + b[0],), lambda s: int(s[0]), nulls=True)
    assert sum(r["v_rows"] for r in A.reduced(frame, ["k"], "v", counted).collect()) == 1201
    plan = A.reduced(frame, ["k"], "v", span)._jdf.queryExecution().toString()
    assert plan.index("MapInPandas") < len(plan) and A.reduced(frame.limit(0), ["k"], "v", span).count() == 0


def test_own_names_everywhere(spark, frame):
    A.register_aggregate(A.Declared("meansquare", {"s": lambda c: A.F.sum(c * c), "n": A.F.count}, lambda p: p["s"] / p["n"]))
    try:
        out = numeric.GroupStatistics("k", ["v"], ("meansquare", "median", "mode", A.largest(2))).fit(frame).transform(frame)
        assert out.columns == [*frame.columns, "k_v_meansquare", "k_v_median", "k_v_mode", "k_v_top2"] and out.count() == frame.count()
        want = groups(frame)
        for r in out.where("k is not null").select("k", "k_v_meansquare", "k_v_median", "k_v_mode", "k_v_top2").distinct().collect():
            v = want[r["k"]]
            if len(v):
                assert r["k_v_meansquare"] == pytest.approx((v**2).mean()) and r["k_v_median"] == pytest.approx(v.median()) and r["k_v_mode"] == v.mode().iloc[0]
            else:
                assert all(x is None for x in r[1:])
        parents = spark.createDataFrame([("hot",), ("a",)], "id string")
        g = relational.Graph({"p": parents, "c": frame.select("k", "v")}, [relational.Relationship("p", "id", "c", "k")])
        made = relational.synthesize(g, "p", aggregates=("meansquare",), transforms=(), depth=1)
        name = [c for c in made.columns if c.endswith("meansquare")][0]
        assert {r["id"]: r[name] for r in made.collect()} == {k: pytest.approx((want[k] ** 2).mean()) for k in ("hot", "a")}
    finally:
        del A.DECLARED["meansquare"]


def test_nothing_is_left_of_infinities(spark):
    df = spark.createDataFrame([("a", math.inf), ("a", 1.0), ("a", -math.inf)], "k string, v double")
    assert A.group_quantile(df, ["k"], "v").first()[1] == 1.0


def test_reduced_makes_no_call_for_a_group(spark):
    """States are merged as they come by, sorted; null and NaN keys are groups."""
    span = A.Reduced("span", "lo double, hi double", "double", lambda x: (float(x.min()), float(x.max())), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: s[1] - s[0])
    rows = [(None if i % 7 == 0 else i % 7, float("nan") if i % 2 else 1.0, float(i)) for i in range(140)]
    df = spark.createDataFrame(rows, "k long, f double, v double").repartition(3)
    found = A.reduced(df, ["k", "f"], "v", span)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert len(found.collect()) == 14 and {r["v_span"] for r in found.collect()} == {126.0}
