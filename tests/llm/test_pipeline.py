"""The stages one after another, and the queries of this subpackage with SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from millrace.llm import registry


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert 0 < docs.select("doc_id").distinct().count() < n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()


def test_run_on_odd_rows(spark, sf, tmp_path):
    """The whole of ``run`` on a table with nulls in every column, empty texts,
    repeated rows, copies of the least id that is kept, and further columns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("size", F.lit("s")).withColumn("key", F.lit(None).cast("int")).select("*", F.lit("x").alias("_d"))
    first = docs.orderBy("doc_id").limit(20)
    null = spark.createDataFrame([(None,) * len(docs.columns), (777001, None, None, None, None, None, None, None), (777002, "", "en", "x", 0, None, 1, None), (777003, "all of these words are of their own here", None, None, None, None, None, "y")], T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
    odd = docs.unionByName(null).unionByName(first).unionByName(first.withColumn("doc_id", F.col("doc_id") + 900_000))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    ids = set(out["doc_id"].dropna().astype(int))
    assert not any(i >= 900_000 for i in ids) and (out["n_tokens"] >= 0).all()
    kept = docs.select("doc_id").toPandas()["doc_id"]
    assert len(ids & set(kept)) > len(kept) // 2
    spark.createDataFrame([], odd.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_empty_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = registry.queries()[name](spark, sf).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    plain = lambda df: sorted(tuple("" if v is None or v != v else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())
    assert plain(got) == plain(want)


def test_all_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and set(registry.queries()) < set(names) and all(any(k.startswith(f"op{i}_") for k in names) for i in range(1, 11))
