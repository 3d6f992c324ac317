"""Lineage of plans that are written down here."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import lineage


def frame(spark):
    orders = spark.createDataFrame([(1, 2.0, 3.0, "x")], "id long, price double, tax double, note string")
    items = spark.createDataFrame([(1, 5)], "key long, n int")
    df = orders.withColumn("gross", F.col("price") + F.col("tax")).join(items, F.col("id") == F.col("key"))
    df = df.withColumn("share", F.col("gross") / F.sum("gross").over(Window.partitionBy("note"))).withColumn("one", F.lit(1))
    return df.select("id", F.col("price").alias("cost"), (F.col("gross") * F.col("n")).alias("total"), "share", "one")


def pairs(store, version="v1"):
    return {(r["feature"], r["source"]) for r in store.ancestors().where(F.col("version") == version).collect()}


def test_ancestors(spark):
    s = lineage.Store(spark)
    s.add("v1", frame(spark))
    assert pairs(s) == {("id", "id"), ("cost", "price"), ("total", "price"), ("total", "tax"), ("total", "n"), ("share", "price"), ("share", "tax"), ("share", "note")}
    assert {r["feature"] for r in s.descendants("v1", "tax").collect()} == {"total", "share"}
    with pytest.raises(ValueError):
        s.add("v1", frame(spark))


def test_groups_unions_python(spark):
    a = spark.createDataFrame([(1, 2.0)], "k long, v double")
    b = spark.createDataFrame([(3, 4.0)], "j long, w double")
    s = lineage.Store(spark)
    s.add("v1", a.union(b).groupBy("k").agg(F.sum("v").alias("total"), F.count("*").alias("rows")))
    assert pairs(s) == {("k", "k"), ("k", "j"), ("total", "v"), ("total", "w")}
    s.add("v2", a.mapInPandas(lambda batches: batches, "k long, out double"))
    assert pairs(s, "v2") == {("k", "k"), ("k", "v"), ("out", "k"), ("out", "v")}


def test_changes(spark):
    a = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    s = lineage.Store(spark)
    s.add("old", a.select((F.col("x") + 1).alias("kept"), (F.col("x") * 2).alias("how"), F.col("y").alias("from"), "z"))
    b = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    s.add("new", b.select((F.col("x") + 1).alias("kept"), (F.col("x") * 3).alias("how"), F.col("z").alias("from"), F.col("y").alias("more")))
    assert {(r["feature"], r["change"]) for r in s.changes("old", "new").collect()} == {("how", "expression"), ("from", "sources"), ("z", "removed"), ("more", "added")}
