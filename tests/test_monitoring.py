"""Comparisons, histories, guardrails, backfills and noise on small tables."""

import statistics

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, monitoring, profiling, relational


def test_tags_and_shifts(spark):
    df = spark.createDataFrame([("ann@example.com", "x"), ("bob@example.com", "y")], "mail string, other string")
    assert monitoring.compliance_tags(df) == {"mail": ["PII", "GDPR"]}
    assert monitoring.importance_shifts({"a": 0.5, "b": 0.5, "c": 0.0}, {"a": 0.55, "b": 0.3, "d": 1.0}) == {"b": pytest.approx(0.4)}


def test_compared_frames_with_other_columns(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "x int, y double")
    b = spark.createDataFrame([], "x int, z int")
    got = {r["column"]: r for r in monitoring.compare_frames(a, b).collect()}
    assert set(got) == {"x", "y"} and got["y"]["nulls_before"] == 1 and got["x"]["rows_after"] is None


def test_metric_history(spark, tmp_path):
    path = str(tmp_path / "history")
    for day in (1, 2, 3):
        df = spark.range(10).withColumn("v", F.col("id") * day)
        monitoring.record_metrics(df, path, "values", {"mean": F.avg("v"), "rows": F.count("*")}, f"2024-01-0{day} 00:00:00")
    h = monitoring.metric_history(spark, path, "values")
    assert h.count() == 6 and monitoring.metric_history(spark, path, "values", "2024-01-02 00:00:00").count() == 4
    got = {r["name"]: r for r in monitoring.metric_trend(h).collect()}
    assert got["mean"]["per_day"] == pytest.approx(4.5) and got["rows"]["per_day"] == pytest.approx(0.0)
    assert (got["mean"]["first"], got["mean"]["last"]) == (4.5, 13.5)


def test_backfill_writes_stale_slices_only(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    path = str(tmp_path / "feature")
    rows = [("2024-01-01 05:00:00", 1, "2024-01-01 06:00:00"), ("2024-01-02 05:00:00", 2, "2024-01-02 06:00:00")]
    make = lambda r: spark.createDataFrame(r, "ts string, v int, changed string").selectExpr("timestamp(ts) ts", "v", "timestamp(changed) changed")
    total = lambda df: df.groupBy("slice").agg(F.sum("v").alias("v"))
    assert monitoring.backfill(make(rows), path, "ts", total, "changed").count() == 2
    assert monitoring.backfill(make(rows), path, "ts", total, "changed").count() == 0
    rows[1] = ("2024-01-02 05:00:00", 20, "2999-01-01 00:00:00")
    assert monitoring.backfill(make(rows), path, "ts", total, "changed").count() == 1
    spark.catalog.refreshByPath(path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 20]


def test_sequential_bounds():
    bounds = [monitoring.sequential_bound(i, 4) for i in range(1, 5)]
    assert bounds[0][0] > bounds[-1][0] == pytest.approx(1.96, abs=0.001)
    assert [a for _, a in bounds] == sorted(a for _, a in bounds) and bounds[-1][1] == pytest.approx(0.05)


def test_guardrails_of_a_missing_control(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 5.0), (None, 9.0)], "variant string, m double")
    got = monitoring.guardrails(df, "variant", {"m": {"max": 4.0, "max_drop": 0.1}}, "none").collect()
    assert [(r["variant"], r["kind"]) for r in got] == [("b", "max")]


def test_noise_has_its_distribution(spark):
    df = spark.range(20_000).select(F.lit(5.0).alias("v"), F.when(F.col("id") == 0, None).otherwise(1.0).alias("w"))
    got = monitoring.private_columns(df, {"v": (0.0, 10.0), "w": (0.0, 1.0)}, epsilon=2.0, seed=7).toPandas()
    noise = got["v"] - 5.0
    # Laplace of scale b: mean 0, mean absolute value b, here 10 * 2 / 2
    assert abs(noise.mean()) < 0.5 and noise.abs().mean() == pytest.approx(10.0, rel=0.05)
    assert got["w"].isna().sum() == 1


def test_federated_noise_is_fresh_and_splits_epsilon(spark):
    df = spark.range(400).select((F.col("id") % 4).alias("p"), (F.col("id") % 10).cast("double").alias("v"))
    exact = profiling.federated(df, "p", "v", 0.0, 9.0, epsilon=None)
    assert exact["mean"] == pytest.approx(4.5) and exact["std"] == pytest.approx(2.872281, abs=1e-5)
    draws = [profiling.federated(df, "p", "v", 0.0, 9.0)["mean"] for _ in range(12)]
    assert len(set(draws)) == 12 and abs(statistics.mean(draws) - 4.5) < 0.3
    assert profiling.federated(df.where("id < 0"), "p", "v", 0.0, 9.0) == {"mean": None, "std": None}


def test_keys_are_checked_after_the_screen(spark):
    df = spark.range(2_000).selectExpr("id as a", "if(id = 7, 8, id) as x_id", "cast(id as string) as b_key")
    assert relational.primary_key(df) == "b_key"
    assert relational.primary_key(df.select("x_id")) is None and relational.primary_key(df.where("a < 0")) is None


def test_paths_along_branches(spark):
    g = relational.Graph(
        {
            "a": spark.createDataFrame([(1,), (2,), (3,)], "a_id int"),
            "b": spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "b_id int, a_id int"),
            "c": spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 8.0), (3, None), (4, 9.0)], "b_id int, v double"),
        },
        [relational.Relationship("a", "a_id", "b", "a_id"), relational.Relationship("b", "b_id", "c", "b_id")],
    )
    got = {r["a_id"]: r for r in relational.path_aggregate(g, ["a", "b", "c"], ["v"]).collect()}
    assert {k: (r["b_c_v_count"], r["b_c_v_sum"], r["b_c_v_max"]) for k, r in got.items()} == {1: (3, 12.0, 8.0), 2: (0, 0.0, 0.0), 3: (0, 0.0, 0.0)}
    assert got[1]["b_c_v_std"] == pytest.approx(statistics.stdev([1.0, 3.0, 8.0])) and got[2]["b_c_v_std"] == 0.0
    whole = {r["a_id"]: r["b_c_v_median"] for r in relational.path_aggregate(g, ["a", "b", "c"], ["v"], ("median",)).collect()}
    assert whole == {1: 3.0, 2: 0.0, 3: 0.0}


def test_walks_follow_edges(spark):
    pairs = [(0, i) for i in range(1, 200)] + [(i, 0) for i in range(1, 200)]
    e = graph.edges(spark.createDataFrame(pairs, "s int, t int"), "s", "t")
    w = graph.walks(e, per_node=1, length=4).toPandas()
    known = {(r["src"], r["dst"]) for r in e.collect()}
    for _, g in w.sort_values("step").groupby(["node", "walk"]):
        at = g["at"].tolist()
        assert len(at) == 4 and all(p in known for p in zip(at, at[1:], strict=False))
    assert w[w["step"] == 2]["at"].nunique() > 50
