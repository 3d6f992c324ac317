"""Exact top-k by inner product with a table of pivot distances.

Each vector keeps its distances to a few pivots. For a query q and a candidate
x the triangle inequality gives ``|q - x| >= |d(q, p) - d(x, p)|`` for every
pivot p; the largest of these bounds the inner product from above, as
``<q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2``. Candidates of a block are
evaluated in the order of that bound, in steps, until the next bound is below
the k-th score found: nothing behind it can enter, so the result is exact.

Queries and candidates meet block by block, every pair of blocks in a task of
its own, of bounded memory; each block puts out k rows a query.
Components are whole numbers, ``floor(scale * x)``; sums that could exceed
2^53 are done in Python's integers, and a score that 64 bits cannot hold
counts as the nearest number that they can.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, table
from millrace.llm.vectors import CANDIDATES, QUERIES, best, blocks, by_id, matrix, meet, table_of, usable

#: Pivots, the rows from which they are chosen, and candidates per step.
PIVOTS, SAMPLE, STEP = 16, 1024, 512


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each next pivot is farthest from those before."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax(((sample - sample.mean(axis=0)) ** 2).sum(axis=1)))]
    gap = np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if not gap.max() > 0:
            break
        chosen.append(int(np.argmax(gap)))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - pivots[None]) ** 2).sum(axis=2))


def with_pivots(df: DataFrame, pivots: np.ndarray, scale: float) -> DataFrame:
    """``df`` (vec_id, v) with whole-number vectors and their pivot distances."""

    def lists(a):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(a.ravel()))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.floor(scale * matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x), lists(distances(x, pivots))], names=["vec_id", "v", "d"])

    return df.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, d array<double>")


def search_block(k: int, step: int = STEP):
    """Top k of a block of candidates for each of a block of queries."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return table_of([], [], [], pa.int64())
        a, b = matrix(q["v"]), matrix(c["v"])
        qi, ci = q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
        da, db = matrix(q["d"]), matrix(c["d"])
        most = a.shape[1] * np.abs(a).max() * np.abs(b).max()
        small = most < 2**53
        # Whole numbers up to 2^24 are exact in half the width.
        narrow = np.float32 if most < 2**24 else np.float64
        xs, ys = a.astype(narrow), b.astype(narrow)
        score = (lambda rows, i: (ys[rows] @ xs[i]).astype(np.int64)) if small else (lambda rows, i: np.array([min(max(sum(int(s) * int(t) for s, t in zip(y, a[i], strict=True)), -(1 << 63)), (1 << 63) - 1) for y in b[rows]], dtype=object))
        qq, cc = (a**2).sum(axis=1), (b**2).sum(axis=1)
        out_q, out_c, out_s = [], [], []
        by_pivot = np.ascontiguousarray(db.T)
        for i in range(len(a)):
            gap = np.zeros(len(b))
            for of, own in zip(by_pivot, da[i], strict=True):
                np.maximum(gap, np.abs(of - own), out=gap)
            # Rounding must not make a bound too low.
            bound = np.maximum((qq[i] + cc - gap**2) / 2 + 1e-9 * (qq[i] + cc) + 1, -(2.0**63))
            order = np.argsort(-bound, kind="stable")
            ids, scores, at, now = np.zeros(0, np.int64), np.zeros(0, np.int64 if small else object), 0, step
            while at < len(order) and (len(scores) < k or bound[order[at]] >= scores[-1]):
                # Steps grow: what is left is dropped as a whole or mostly evaluated.
                rows, at, now = order[at : at + now], at + now, 2 * now
                rows = rows[ci[rows] != qi[i]]
                ids, scores = np.concatenate([ids, ci[rows]]), np.concatenate([scores, score(rows, i)])
                if len(scores) > k and small:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    ids, scores = ids[scores >= least], scores[scores >= least]
                top = np.lexsort((ids, -scores))[:k] if small else sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k]
                ids, scores = ids[top], scores[top]
            out_q += [qi[i]] * len(ids)
            out_c += ids.tolist()
            out_s += [int(s) for s in scores]
        return table_of(out_q, out_c, out_s, pa.int64())

    return run


def top_k(df: DataFrame, every: int, k: int, scale: float = 1.0, pivots: int = PIVOTS) -> DataFrame:
    """For each id divisible by ``every`` its k best other rows:
    ``query_id, rank, vec_id, score``."""
    rows = usable(df)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    table_ = checkpoint(with_pivots(rows, choose_pivots(np.floor(scale * np.array(sample.tolist(), dtype=float)) if len(sample) else np.zeros((0, 1)), pivots), scale))
    queries = checkpoint(table_.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "d")).alias("x")).select("vec_id", "x.*"))
    nq, nc = blocks(queries.count(), QUERIES), blocks(table_.count(), CANDIDATES)
    q = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(nq))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nc - 1).cast("long"))))
    c = table_.withColumn("cb", F.pmod(F.monotonically_increasing_id(), F.lit(nc))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))
    return best(meet(q, c, ["qb", "cb"], search_block(k), "query_id long, vec_id long, score long"), k)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64.0)


ORACLE = """
with e as (select vec_id, [floor(64 * x::double)::bigint for x in embedding] as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
      from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
