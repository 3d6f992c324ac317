"""Every registered query with SQL gives the rows of that SQL."""

import duckdb
import pandas as pd
import pytest

from millrace.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"auto_features", "program_search", "graph_pagerank"}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame, cols: list[str]) -> list[tuple]:
    plain = lambda v: "" if v is None or v is pd.NA or v != v else repr(float(v) + 0.0) if hasattr(v, "dtype") or isinstance(v, (int, float)) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, sf, db, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), db.sql(catalogue.SQL[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - SLOW))
def test_runs(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry_names():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_graph_of_all_lines(spark, sf):
    """Every line's supplier and part count, none folded or left out."""
    lines = pd.read_parquet(f"{sf}/lineitem.parquet", columns=["l_suppkey", "l_partkey"]).dropna().drop_duplicates()
    want = {f"{k}{n}": d for k, c in (("s", "l_suppkey"), ("p", "l_partkey")) for n, d in lines[c].astype(int).value_counts().items()}
    got = catalogue.QUERIES["graph_all_degrees"](spark, sf).toPandas()
    assert dict(zip(got["node"], got["degree"])) == want and (got["degree"] == got["in_degree"]).all()


def test_marketing_scores_do_not_hang_on_the_order_of_sums(spark, tmp_path):
    from millrace.plans import catalogue

    rows = [(i * 3 + j, i, p) for i, prices in enumerate([(0.1, 0.2, 0.3), (0.3, 0.2, 0.1)], 1) for j, p in enumerate(prices)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).selectExpr("*", "timestamp'1998-01-01 00:00:00' as o_orderdate")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = catalogue.pack_marketing(spark, str(tmp_path)).collect()
    assert len(got) == 2 and len({r["marketing_rfm_score"] for r in got}) == 1


def test_flagship_fits_on_a_written_table(spark, sf):
    """No pass of the fits joins the lines anew."""
    from millrace.operators import base

    seen, run = [], base.run_aggregates

    def spy(df, wanted):
        if wanted:
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return run(df, wanted)

    with pytest.MonkeyPatch.context() as m:
        for module in (base, catalogue.categorical, catalogue.cleaning):
            m.setattr(module, "run_aggregates", spy, raising=False)
        catalogue.flagship(spark, sf)
    assert seen and not [p for p in seen if "Join" in p]
