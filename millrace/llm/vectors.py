"""What the two vector searches share: which vectors take part, the meeting of
blocks of queries with blocks of candidates, and the merge of their best.

Edge cases, for both: rows without id or vector, vectors with a null or
non-finite component, and vectors whose length is not the table's most common
one (the shorter on a tie) take no part; of rows with one id, the one with the
least vector is the query, all are candidates; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of a block of queries.
CANDIDATES, QUERIES = 4096, 1024


def usable(df: DataFrame, more: Callable[[Column], Column] | None = None) -> DataFrame:
    """``vec_id, v``: ids and vectors (as doubles) that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0)
    out = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    if more is not None:
        out = out.where(more(F.col("v")))
    common = out.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").limit(1)
    d = common.first()
    return out.where(F.size("v") == (d[0] if d else 0))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def meet(queries: DataFrame, candidates: DataFrame, keys: list[str], search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``search`` on each pair of blocks: rows of both sides that agree in ``keys``."""

    def run(_, q: pa.Table, c: pa.Table) -> pa.Table:
        return search(q, c)

    return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all its blocks, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def by_id(df: DataFrame, every: int) -> DataFrame:
    """The query set: ids divisible by ``every``, one vector each."""
    return df.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def table_of(query_id, vec_id, score, kind) -> pa.Table:
    return pa.table({"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, kind)})
