"""Null rules, unseen categories, empty frames and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import quantiles, stats
from millrace.operators import base, categorical, cleaning, graph, numeric, profiling, relational, selection, temporal, text
from millrace.plans import dsl
from millrace.sources import io
from millrace.streaming.stateful import Moments


def one(df, c):
    return [r[0] for r in df.select(f"`{c}`").collect()]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, 1.0, 10.0, "x", 0), (2, 2.0, 0.0, "y", 1), (3, None, 30.0, "x", 0), (4, 4.0, None, None, 1), (5, 5.0, 50.0, "x", 0)], "id long, a double, b double, c string, y int")


def test_ratio_keeps_null_and_zero(small):
    out = numeric.Interactions(["a", "b"], ("divide",)).fit_transform(small)
    assert one(out.orderBy("id"), "a_div_b") == [0.1, 0.0, None, None, 0.1]


def test_log_of_null(small):
    df = numeric.Log(["a"], "log").fit_transform(small)
    assert one(df.orderBy("id"), "a_log")[2] == 0.0
    assert one(numeric.Log(["a"]).fit_transform(small).orderBy("id"), "a_log1p")[2] is None


def test_bins_of_null(small):
    assert one(numeric.Bins(["a"], 2).fit_transform(small).orderBy("id"), "a_binned")[2] == 1
    assert one(numeric.Bins(["a"], 2, closed="right").fit_transform(small).orderBy("id"), "a_binned")[2] is None


def test_box_cox_and_yeo_johnson(small):
    df = numeric.Power(["a", "b"], ("box-cox", "yeo-johnson")).fit_transform(small)
    assert one(df.orderBy("id"), "b_box_cox")[1] == 0.0  # not positive: as it is
    assert one(df.orderBy("id"), "a_yeo_johnson")[2] is None


def test_spline_sums_to_one(small):
    df = numeric.Spline(["a"], knots=4).fit_transform(small.where("a is not null"))
    total = sum((F.col(c) for c in df.columns if c.startswith("a_spline_")), F.lit(0.0))
    assert all(abs(x - 1) < 1e-9 for x in one(df.select(total.alias("t")), "t"))


def test_encoders_on_unseen(spark, small):
    new = spark.createDataFrame([("z",), (None,), ("x",)], "c string")
    t = categorical.Target(["c"]).fit(small, "y")
    mean = small.agg(F.avg("y")).first()[0]
    got = {r["c"]: r["c_target"] for r in t.transform(new).collect()}
    assert got["z"] == pytest.approx(mean) and got[None] == pytest.approx(mean)
    assert got["x"] == pytest.approx((3 * 0 + 10 * mean) / 13)
    o = categorical.Ordinal(["c"]).fit(small)
    assert {r["c"]: r["c_ordinal"] for r in o.transform(new).collect()} == {"x": 0, "z": -1, None: -1}
    h = categorical.OneHot(["c"]).fit(small)
    assert {r["c"]: (r["c_x"], r["c_y"]) for r in h.transform(new).collect()} == {"x": (1, 0), "z": (0, 0), None: (0, 0)}


def test_hashing_matches_md5(spark):
    import hashlib

    df = categorical.Hashing(["c"], 7).fit_transform(spark.createDataFrame([("hello",), (None,)], "c string"))
    h = int(hashlib.md5(b"hello0").hexdigest(), 16)
    want = [0] * 7
    want[h % 7] = 1 if h // 7 % 2 == 0 else -1
    rows = {r["c"]: [r[f"c_hash_{i}"] for i in range(7)] for r in df.collect()}
    assert rows["hello"] == want and rows[None] == [0] * 7


def test_order_is_required():
    with pytest.raises(ValueError):
        temporal.Lag(["a"])


def test_rolling_least(small):
    df = temporal.Rolling(["a"], (2,), ("mean",), order="id", least=2).fit_transform(small)
    assert one(df.orderBy("id"), "a_rolling_2_mean") == [None, 1.5, None, None, 4.5]


def test_union_is_one_job(small):
    u = base.Union([numeric.Scale(["a"]), numeric.Bins(["b"], 2), cleaning.Winsorize(["a"])])
    assert {"a_zscore", "b_binned", "a"} <= set(u.fit_transform(small).columns)


def test_missing_column(small):
    with pytest.raises(base.MissingColumn):
        numeric.Log(["nope"]).fit(small)
    with pytest.raises(base.NotFitted):
        numeric.Log(["a"]).transform(small)


def test_empty_frames(spark, small):
    empty = small.limit(0)
    for m in (numeric.Interactions(["a", "b"]), numeric.Bins(["a"]), numeric.Scale(["a"]), cleaning.Cap(["a"]), categorical.OneHot(["c"]), categorical.Frequency(["c"]), text.TextBasic(["c"])):
        assert m.fit_transform(empty).count() == 0


def test_impute_and_trim(small):
    df = cleaning.Impute(["a", "c"], indicator=True).fit_transform(small).orderBy("id")
    assert one(df, "a")[2] == 3.0 and one(df, "c")[3] == "x" and one(df, "a_missing") == [0, 0, 1, 0, 0]
    assert cleaning.Trim(["a"]).fit_transform(small).count() == 4


def test_knn_impute(small):
    out = cleaning.NeighbourImpute(["a", "b"], k=1).fit(small).transform(small).orderBy("id")
    assert None not in one(out, "a") and None not in one(out, "b")


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_knn_impute_by_brute_force(spark, monkeypatch, weights):
    """All rows are candidates, in many small blocks; repeated rows count as often as they are there."""
    monkeypatch.setattr(cleaning.NeighbourImpute, "QUESTIONS", 30)
    monkeypatch.setattr(cleaning.NeighbourImpute, "CANDIDATES", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3))
    x[rng.random(x.shape) < 0.25] = np.nan
    x = np.concatenate([x, x[:20], x[:20], np.full((2, 3), np.nan)])
    df = spark.createDataFrame([(i, *(None if v != v else float(v) for v in r)) for i, r in enumerate(x)], "id int, p double, q double, `c0` double")
    out = cleaning.NeighbourImpute(["p", "q", "c0"], k=4, weights=weights).fit(df).transform(df)
    assert out.columns == df.columns
    got = np.array([r[1:] for r in out.orderBy("id").collect()])
    want = x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x))):
        both = ~np.isnan(x) & ~np.isnan(x[i])
        shared = both.sum(axis=1)
        d = np.sqrt(np.where(both, (x - x[i]) ** 2, 0).sum(axis=1) * 3 / np.maximum(shared, 1))
        d[(shared == 0) | np.isnan(x[:, j])] = np.inf
        near = [t for t in np.argsort(d, kind="stable")[:4] if np.isfinite(d[t])]
        w = None if weights == "uniform" else 1 / np.maximum(d[near], 1e-12)
        want[i, j] = np.average(x[near, j], weights=w) if near else np.nanmean(x[:, j])
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_knn_impute_ways_agree(spark, monkeypatch):
    """Ranges give what all pairs give, also with many equal and infinite values."""
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=600) * 1000, rng.integers(0, 3, 600), rng.normal(size=600)])
    x[rng.random(x.shape) < 0.1] = np.nan
    x[::50, 0], x[3::70, 1], x[::90, 2] = 500.0, np.inf, -np.inf
    df = spark.createDataFrame([(i, *(None if v != v else float(v) for v in r)) for i, r in enumerate(x)], "id int, p double, q double, r double")
    found = []
    for patterns in (64, 0):
        for name, n in (("PATTERNS", patterns), ("QUESTIONS", 5), ("CANDIDATES", 40)):
            monkeypatch.setattr(cleaning.NeighbourImpute, name, n)
        imputer = cleaning.NeighbourImpute(["p", "q", "r"], k=3)
        found.append(np.array([r[1:] for r in imputer.fit(df).transform(df).orderBy("id").collect()]))
    assert not np.isnan(found[0]).any() and np.allclose(*found, rtol=1e-12)


def test_knn_impute_windows():
    """Windows of sorted rows give what a sort of all distances gives, and look at few of them."""
    rng = np.random.default_rng(2)
    ref = rng.normal(size=(3000, 2)) * [1000, 1]
    ref = ref[np.argsort(ref[:, 0])]
    x = rng.normal(size=(50, 2)) * [1000, 1]
    seen = {r: [] for r in range(50)}
    for row, at, d in cleaning.windows(x, ref, np.arange(3000), 0, [0, 1], 4):
        for r, a, v in zip(row, at, d, strict=True):
            seen[r].append((v, a))
    for r, v in enumerate(x):
        d = np.sqrt(((ref - v) ** 2).sum(axis=1))
        assert [a for _, a in seen[r]] == np.argsort(d, kind="stable")[:4].tolist()


@pytest.mark.parametrize("keep, accuracy", [(4096, 10_000), (3, 20), (40, 100)])
def test_quantiles_are_exact(spark, monkeypatch, keep, accuracy):
    """Equal to the percentile over all values, however often intervals are narrowed."""
    monkeypatch.setattr(quantiles, "KEEP", keep)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng, at = np.random.default_rng(3), (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    for n in (0, 1, 2, 700):
        rows = [(float(rng.normal()), float(rng.integers(0, 4)), None if i % 3 else math.nan if i % 2 else float(i)) for i in range(n)]
        df = spark.createDataFrame(rows, "`a|1` double, b double, c double")
        cols = {c: F.col(f"`{c}`") for c in df.columns}
        got = base.run_aggregates(df, {c: quantiles.Quantile(v, at) for c, v in cols.items()} | {"m": quantiles.Quantile(cols["b"], 0.5), "n": F.count("b")})
        want = df.agg(*[F.percentile(v, F.array(*map(F.lit, at))).alias(c) for c, v in cols.items()], F.median("b").alias("m"), F.count("b").alias("n")).first().asDict()
        assert repr(got) == repr(want)


def test_text_counts(spark):
    df = spark.createDataFrame([("Über 12 Äpfel! Ja.",), (None,), ("",)], "t string")
    r = text.TextBasic(["t"]).fit_transform(df).collect()
    assert (r[0]["t_word_count"], r[0]["t_digit_count"], r[0]["t_upper_count"], r[0]["t_sentence_count"]) == (4, 2, 3, 2)
    assert r[1]["t_char_count"] == 0 and r[2]["t_avg_word_length"] == 0.0


def test_tfidf_rows_have_length_one(spark):
    df = spark.createDataFrame([("cat dog",), ("cat cat fox",), ("dog fox",), ("",)], "t string")
    m = text.TfIdf(["t"], most_df=1.0).fit(df)
    for r in m.transform(df).collect():
        n = sum(r[c] ** 2 for c in m.new_columns)
        assert n == pytest.approx(1.0) or n == 0.0


def test_selection(spark, small):
    df = small.withColumn("twin", F.col("a") * 2).withColumn("flat", F.lit(1.0))
    assert selection.Variance(["a", "flat"]).fit(df).kept == ["a"]
    assert selection.Correlation(["a", "twin"]).fit(df).kept == ["a"]
    assert selection.QuasiConstant(["a", "flat"]).fit(df).kept == ["a"]
    assert "flat" not in selection.Correlation(["a", "twin", "flat"]).fit(df).scores
    assert selection.pareto([(1.0, 3), (0.9, 1), (0.8, 2)]) == [(0.9, 1), (1.0, 3)]


def test_tail_probabilities():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.f_sf(4.0, 1, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-7)
    assert stats.f_sf(0.0, 2, 5) == 1.0


def test_moments_merge():
    import pandas as pd

    x = pd.Series([1.0, 4.0, 9.0, 16.0, 25.0])
    m = Moments.of(x[:2]).merge(Moments.of(x[2:]))
    assert (m.n, m.mean, m.std()) == (5, pytest.approx(x.mean()), pytest.approx(x.std()))


def test_as_of_tolerance(spark):
    left = spark.createDataFrame([(1, "2024-01-02", 7), (2, "2024-01-02", 8)], "k long, t string, v int").withColumn("t", F.to_timestamp("t"))
    right = spark.createDataFrame([(1, "2024-01-01", 1.0), (2, "2023-01-01", 2.0)], "k long, t string, f double").withColumn("t", F.to_timestamp("t"))
    got = {r["k"]: r["f"] for r in relational.as_of(left, right, ["k"], "t", "t", ["f"], 86400 * 5).collect()}
    assert got == {1: 1.0, 2: None}


def test_graph_triangle(spark):
    e = graph.edges(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "s string, t string"), "s", "t")
    got = {r["node"]: (r["triangles"], round(r["clustering"], 3)) for r in graph.triangles(e).collect()}
    assert got == {"a": (1, 1.0), "b": (1, 1.0), "c": (1, 0.333), "d": (0, 0.0)}
    assert sum(r["rank"] for r in graph.pagerank(e, rounds=5).collect()) == pytest.approx(1.0)


def test_contract_round_trip(small):
    c = profiling.Contract.from_json(profiling.make_contract(small).to_json())
    assert profiling.check_contract(small, c) == []
    bad = profiling.check_contract(small.withColumn("a", F.lit(99.0)).drop("b"), c)
    assert {(v["column"], v["check"]) for v in bad} >= {("b", "exists"), ("a", "max_value")}


def test_privacy_budget(small):
    b = profiling.Budget(0.15)
    profiling.private(small, "a", "mean", 0.0, 5.0, 0.1, b, seed=1)
    with pytest.raises(ValueError):
        profiling.private(small, "a", "mean", 0.0, 5.0, 0.1, b)
    assert profiling.compose([0.1] * 200, 1e-5) < 20


def test_sentences_and_dsl(small):
    assert dsl.from_sentence("ratio of a to b", ["a", "b"]).transform == "divide"
    assert dsl.from_sentence("drop table a", ["a"]) is None
    out = dsl.apply(small, dsl.parse("features:\n  - {name: r, transform: divide, columns: [a, b]}\n"))
    assert one(out.orderBy("id"), "r") == [0.1, None, None, None, 0.1]
    with pytest.raises(ValueError):
        dsl.parse({"features": [{"transform": "log"}]})


def test_declared_values_of_whole_tables(spark):
    df = spark.createDataFrame([(1.0, "x", 1.0), (2.0, "x", 0.0), (None, "y", 1.0), (4.0, None, None), (5.0, None, 1.0)], "a double, g string, y double")
    made = [("z", "standard_scale", "a", {}), ("m", "min_max_scale", "a", {}), ("f", "frequency", "g", {}), ("t", "target", "g", {"target": "y"}), ("gm", "group_mean", "a", {"by": ["g"]}), ("a", "square", "a", {})]
    out = dsl.apply(df, dsl.parse({"features": [{"name": n, "transform": t, "columns": [c], **more} for n, t, c, more in made]}))
    want = df.selectExpr(
        "g", "y", "(a - avg(a) over ()) / stddev_samp(a) over () as z", "(a - min(a) over ()) / (max(a) over () - min(a) over ()) as m", "count(g) over (partition by g) / count(g) over () as f",
        "(sum(y) over (partition by g) + 10 * avg(y) over ()) / (count(y) over (partition by g) + 10) as t", "avg(a) over (partition by g) as gm", "a * a as a",
    )
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_store_and_operators(spark, small, tmp_path):
    s = io.FeatureStore(spark, str(tmp_path / "store"))
    s.register("f", "id", {"a": "double"})
    s.materialize("f", small.select("id", "a").withColumn("at", F.to_timestamp(F.lit("2024-01-01"))), "at")
    ask = spark.createDataFrame([(1, "2024-02-01"), (1, "2023-02-01")], "id long, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(str(r["a"]) for r in s.history("f", ask, "t").collect()) == ["1.0", "None"]
    m = categorical.Target(["c"]).fit(small, "y")
    io.save_operator(m, str(tmp_path / "op"), spark)
    again = io.load_operator(str(tmp_path / "op"), spark)
    assert sorted(one(again.transform(small), "c_target")) == sorted(one(m.transform(small), "c_target"))


def test_types(spark, small):
    k = profiling.infer_types(small)
    assert k["a"] == "numeric" and k["y"] == "boolean" and k["c"] in ("boolean", "categorical")
    assert not math.isnan(profiling.quality_score(profiling.quality(small)))


def test_command_line(spark, small, tmp_path, capsys):
    from millrace import cli

    data = str(tmp_path / "d.parquet")
    small.write.parquet(data)
    assert cli.main(["contract", data, "-o", str(tmp_path / "c.json")], spark) == 0
    assert cli.main(["validate", data, "--contract", str(tmp_path / "c.json")], spark) == 0
    (tmp_path / "s.yaml").write_text("features:\n  - {transform: square, column: a}\n")
    assert cli.main(["run", data, "--spec", str(tmp_path / "s.yaml"), "-o", str(tmp_path / "o.csv")], spark) == 0
    assert "a_square" in io.read(spark, str(tmp_path / "o.csv")).columns
    assert cli.main(["analyze", data], spark) == 0 and '"types"' in capsys.readouterr().out


def test_transfer(small):
    from millrace.operators import transfer

    out = transfer.apply(small, small, {"a": ["square"]})
    assert "a_square_transfer" in out.columns
    assert transfer.likeness([1.0, 2.0], [1.0, 2.0]) == 1.0


def two_cliques(spark):
    """Two groups of six, joined by one edge."""
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0")]
    return graph.edges(spark.createDataFrame(pairs, "s string, t string"), "s", "t")


def test_walks_follow_edges(spark):
    e = two_cliques(spark)
    edges = {(r["src"], r["dst"]) for r in e.collect()}
    found = {}
    for r in graph.walks(e, 2, 5).collect():
        found.setdefault((r["node"], r["walk"]), {})[r["step"]] = r["at"]
    assert len(found) == 24 and all(w[0] == node and len(w) == 5 for (node, _), w in found.items())
    assert all((w[i], w[i + 1]) in edges for w in found.values() for i in range(4))
    again = {(r["node"], r["walk"], r["step"], r["at"]) for r in graph.walks(e, 2, 5).collect()}
    assert again == {(n, k, i, at) for (n, k), w in found.items() for i, at in w.items()}


def test_walks_end_without_edges(spark):
    e = graph.edges(spark.createDataFrame([("a", "b")], "s string, t string"), "s", "t", directed=True)
    assert sorted((r["node"], r["step"], r["at"]) for r in graph.walks(e, 1, 4).collect()) == [("a", 0, "a"), ("a", 1, "b"), ("b", 0, "b")]


def test_node_vectors_tell_groups(spark):
    got = {r["node"]: np.array(r["vector"]) for r in graph.node_vectors(two_cliques(spark), size=3, per_node=6, length=10).collect()}
    unit = {k: v / np.linalg.norm(v) for k, v in got.items()}
    inside = np.mean([unit[f"{g}{i}"] @ unit[f"{g}{j}"] for g in "ab" for i in range(1, 6) for j in range(1, i)])
    across = np.mean([unit[f"a{i}"] @ unit[f"b{j}"] for i in range(1, 6) for j in range(1, 6)])
    assert len(got) == 12 and inside > across + 0.2


def test_ego_edges(spark):
    got = {r["node"]: r["ego_edges"] for r in graph.ego_edges(two_cliques(spark)).collect()}
    assert got["a0"] == 16 and got["a1"] == 15 and len(got) == 12


@pytest.mark.parametrize("target", ["y", "label"])
def test_shapley_credits_add_up(spark, target):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    rows = [(float(a), float(b), float(c), float(4 * a + b), "high" if a > 0 else "low") for a, b, c in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, label string")
    s = selection.Shapley(["a", "b", "c"], rounds=2, trees=5)
    for r in s.credits(df, target).collect():
        assert np.allclose(np.sum([r[c] for c in "abc"], axis=0), r["_whole"])
    s.fit(df, target)
    assert s.scores["a"] > 3 * s.scores["c"]


def test_generalize(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.1,), (10.0,), (None,)], "v double")
    assert [r[0] for r in profiling.generalize(df, "v").collect()] == ["(0.00, 2.00]", "(0.00, 2.00]", "(2.00, 4.00]", "(8.00, 10.00]", None]
    assert [r[0] for r in profiling.generalize(df.where("v = 2"), "v").collect()] == ["(2.00, 2.00]"]
    assert profiling.generalize(df.where("v is null"), "v").first()[0] is None


def test_equal_odds(spark):
    rows = [("a", float(i), float(i)) for i in range(5)] + [("b", float(i), float(-i)) for i in range(5)] + [("c", 1.0, 1.0), (None, 1.0, 2.0)]
    r = profiling.equal_odds(spark.createDataFrame(rows, "g string, v double, y double"), "g", "v", "y").first()
    assert r["groups"] == 2 and abs(r["odds_gap"] - 2) < 1e-9


def test_exponential_matches_pandas(spark):
    rng = np.random.default_rng(5)
    rows = [(g, i, None if rng.random() < 0.3 else float(rng.normal())) for g in "ab" for i in range(300)] + [("c", 0, None), ("c", 1, 2.0), ("c", 2, None)]
    got = temporal.exponential(spark.createDataFrame(rows, "g string, i int, v double"), ["v"], ["g"], ["i"], (1, 3, 10)).toPandas().sort_values(["g", "i"])
    assert list(got.columns) == ["g", "i", "v", *[f"v_ewm_{s}_{k}" for s in (1, 3, 10) for k in ("mean", "std")]]
    for _, part in got.groupby("g"):
        for s in (3, 10):
            want = part["v"].ewm(span=s, min_periods=1)
            assert np.allclose(part[f"v_ewm_{s}_mean"], want.mean(), equal_nan=True)
            assert np.allclose(part[f"v_ewm_{s}_std"].astype(float), want.std(), equal_nan=True)
        assert np.allclose(part["v_ewm_1_mean"], part["v"].ffill(), equal_nan=True)


def test_declared_numbers_of_few_groups_do_not_gather_rows(spark, tmp_path):
    """A group's rows are dealt to parts; null keys, many groups and empty tables are joined, too."""
    df = spark.range(0, 4000, 1, 8).selectExpr("id", "if(id % 4 = 0, null, id % 2) as g", "id % 3000 as many", "cast(id % 7 as double) as y")
    spec = dsl.parse({"features": [{"name": n, "transform": t, "columns": [c], **more} for n, t, c, more in [("t", "target", "g", {"target": "y"}), ("f", "frequency", "g", {}), ("m", "group_mean", "y", {"by": ["many", "g"]})]]})
    out = dsl.apply(df, spec)
    assert out.columns == ["id", "g", "many", "y", "t", "f", "m"]
    got, rows = out.toPandas().sort_values("id"), df.toPandas().sort_values("id")
    by = rows.groupby("g", dropna=False)["y"]
    want = (by.transform("sum") + 10 * rows["y"].mean()) / (by.transform("count") + 10)
    assert len(got) == 4000 and np.allclose(got["t"], want)
    share = by.transform("size") / rows["g"].count()
    assert np.allclose(got["f"], share.where(rows["g"].notna(), 0))
    assert np.allclose(got["m"], rows.groupby(["many", "g"], dropna=False)["y"].transform("mean"))
    assert dsl.apply(df.limit(0), spec).count() == 0
    sizes = {}
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "16")):
        sizes[k] = spark.conf.get(k)
        spark.conf.set(k, v)
    try:
        few = dsl.apply(df, dsl.Spec(spec.features[:1]))
        most = few.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for k, v in sizes.items():
            spark.conf.set(k, v)
    assert most < 1000
