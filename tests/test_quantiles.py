import math

from pyspark.sql import functions as F

from millrace.functions import quantiles
from millrace.functions.quantiles import Quantile


def test_many_edges_are_searched_in_batches(spark):
    """Cells of more than FEW edges equal those by expressions; nulls are in none, NaN is the largest."""
    rows = [(float(i % 97) - 20, None if i % 5 == 0 else math.nan if i % 7 == 0 else -0.0 if i % 11 == 0 else i * 0.5) for i in range(1500)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    wanted = [Quantile(F.col("a"), 0.5), Quantile(F.col("b"), 0.5)]
    edges = [[float(x) for x in range(-20, 70, 7)], [0.0, 1.0, 40.5, 300.0, 555.25, math.nan]]
    assert sum(map(len, edges)) > quantiles.FEW
    plain = quantiles.cells(df, wanted, edges)
    counts = {(r["i"], r["cell"]): r["n"] for r in plain.groupBy("i", "cell").agg(F.count("*").alias("n")).collect()}
    found = quantiles.cell_counts(df, wanted, edges)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert {(r["i"], r["cell"]): r["n"] for r in found.collect()} == counts
    kept = sorted(counts)[::3]
    key = lambda r: (r["i"], r["cell"], str(r["v"] + 0.0))
    assert sorted(map(key, quantiles.cell_values(df, wanted, edges, kept).collect())) == sorted(key(r) for r in plain.collect() if (r["i"], r["cell"]) in kept)
