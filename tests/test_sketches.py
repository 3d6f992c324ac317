"""Sketches of streams against exact results, and a table that survives failures."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.streaming import sketches as K


@pytest.mark.parametrize("kind", ["uniform", "normal", "ties", "heavy", "sorted"])
@pytest.mark.parametrize("parts", [1, 40])
def test_digest_rank_error(kind, parts):
    rng = np.random.default_rng(len(kind))
    x = {"uniform": rng.random(20_000), "normal": rng.normal(size=20_000), "ties": rng.integers(0, 9, 20_000).astype(float), "heavy": rng.pareto(0.5, 20_000), "sorted": np.arange(20_000.0)}[kind]
    d = None
    for part in np.array_split(x, parts):
        d = K.Digest.of(part) if d is None else d.merge(K.Digest.of(part))
    assert len(d.mean) <= K.MOST + 1 and d.weight.sum() == len(x) and (np.diff(d.mean) >= 0).all()
    assert (d.quantile(0), d.quantile(1)) == (x.min(), x.max())
    for q in (0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999):
        v = d.quantile(q)
        assert (x < v).mean() - K.rank_error(K.MOST) <= q <= (x <= v).mean() + K.rank_error(K.MOST)


def test_digest_is_exact_while_small():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 200):
        x = rng.normal(size=n)
        d = K.Digest.of(x[: n // 2]).merge(K.Digest.of(x[n // 2 :]))
        assert all(d.quantile(q) == pytest.approx(np.quantile(x, q), abs=1e-12) for q in (0, 0.1, 0.5, 0.77, 1))
    assert K.Digest.of(np.array([np.nan])).quantile(0.5) is None


@pytest.mark.parametrize("most", [5, 50])
def test_counters_are_within_bounds(most):
    rng = random.Random(most)
    items = [str(int(rng.paretovariate(0.9))) for _ in range(20_000)]
    exact = pd.Series(items).value_counts().to_dict()
    f = None
    for part in np.array_split(np.array(items, object), 23):
        g = K.Frequent.of(pd.Series(part), most)
        f = g if f is None else f.merge(g)
    assert len(f.counts) <= most and f.missed <= len(items) / (most + 1)
    assert all(n <= exact[i] <= n + f.missed for i, n in f.counts.items())
    assert all(i in f.counts for i, n in exact.items() if n > len(items) / (most + 1))


def events(spark, tmp_path, n=3000, files=6):
    rng = random.Random(2)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, rng.random()]), f"i{int(rng.paretovariate(1))}") for i in range(n)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v double, item string")
    for f in range(files):  # in the order of time
        spark.createDataFrame(rows[f * n // files : (f + 1) * n // files], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_like_batch(spark, tmp_path):
    """What the stream's table holds last is what a batch frame gives, and both are exact here."""
    df, stream = events(spark, tmp_path, 300)
    made = lambda d: K.quantiles(d, ["k"], "v", (0.5,), "ts", "1 hour", "1 day")
    table = K.write_table(made(stream), str(tmp_path / "t"), str(tmp_path / "c"))
    assert table.select("batch").distinct().count() > 1
    show = lambda d: sorted((str(r["k"]), r["window_start"], r["n"], round(r["q"][0], 9)) for r in d.collect())
    pdf = df.where("v is not null").toPandas()
    want = sorted((str(None if pd.isna(k) else k), w.to_pydatetime(), len(g), round(float(np.quantile(g, 0.5)), 9)) for (k, w), g in pdf.groupby([pdf["k"], pdf["ts"].dt.floor("h")], dropna=False)["v"])
    assert show(made(df)) == want == show(K.latest(table, ["k", "window_start"]))
    counts = K.latest(K.write_table(K.frequent(stream, ["k"], "item", most=8), str(tmp_path / "t2"), str(tmp_path / "c2")), ["k"])
    exact = {(r["k"], r["item"]): r["count"] for r in df.groupBy("k", "item").count().collect()}
    assert all(r["at_least"] <= exact[r["k"], r["item"]] <= r["at_most"] for r in counts.collect()) and counts.count() > 10


def test_closed_windows_leave_the_state(spark, tmp_path):
    df, stream = events(spark, tmp_path, 3000)
    sizes = []
    made = K.quantiles(stream, ["k"], "v", (0.5,), "ts", "1 hour", "0 seconds")
    q = made.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / f"t/batch={i}"))).trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    windows = 3 * 50
    assert sizes and sizes[-1] <= windows / 4 and max(sizes) < windows


def test_a_stream_that_fails_leaves_the_same_table(spark, tmp_path):
    df, stream = events(spark, tmp_path, 600)
    made = lambda: K.quantiles(stream, ["k"], "v", (0.5, 0.9))
    show = lambda t: sorted(map(str, t.collect()))
    want = show(K.write_table(made(), str(tmp_path / "t"), str(tmp_path / "c")))
    fails = {1, 3}

    def stop(batch, number):
        if number in fails:  # after its rows were written, before it is committed
            fails.remove(number)
            raise RuntimeError("lost")

    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            K.write_table(made(), str(tmp_path / "t2"), str(tmp_path / "c2"), stop)
    assert show(K.write_table(made(), str(tmp_path / "t2"), str(tmp_path / "c2"), stop)) == want


def test_empty_stream(spark, tmp_path):
    schema = "ts timestamp, k string, v double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    table = K.write_table(K.quantiles(stream, ["k"], "v"), str(tmp_path / "t"), str(tmp_path / "c"))
    assert table.count() == 0 and K.latest(table, ["k"]).count() == 0
    assert K.quantiles(spark.createDataFrame([], schema), ["k"], "v").count() == 0


def test_entities_of_a_window_share_states(spark, monkeypatch, tmp_path):
    """Many small entities are few groups; keys of any kind, null or not, come back as they were."""
    monkeypatch.setattr(K, "BUCKETS", 3)
    rows = [(None if i % 50 == 0 else 2**60 + i % 50, f'a"{i % 2}', None if i % 7 == 0 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, s string, v double").withColumn("t", F.timestamp_micros(F.col("k") % 3))
    df.write.parquet(str(tmp_path / "in"))
    keys = ["k", "s", "t"]
    show = lambda d: sorted((str(r[:3]), r["n"], tuple(r["q"])) for r in d.select(*keys, "n", "q").collect())
    want = df.where("v is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.array(F.percentile("v", F.lit(0.5))).alias("q"))
    assert show(K.quantiles(df, keys, "v", (0.5,))) == show(want)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = K.write_table(K.quantiles(stream, keys, "v", (0.5,)), str(tmp_path / "t"), str(tmp_path / "c"))
    assert show(K.latest(found, keys)) == show(want)
    plan = K.quantiles(df, keys, "v", (0.5,))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [window_start" in plan
