"""Approximate nearest neighbours with learned partitions.

Fitted on a bounded sample: its k-nearest-neighbour graph is cut into equally
large parts with few edges between them (spectral bisection at the median,
then swaps that gain most, again and again), and a small network learns, from
a vector, the parts in which its neighbours lie. Every row of the table is
indexed under its most probable part; a query goes to as many parts as a
held-out half of the sample needs for the wanted recall, in the order of their
probability, and is compared with every row there, exactly.

Neighbours in a sample are further away than in the whole table, so the recall
measured on the sample is a cautious one. Vectors without any structure (all
directions alike) need most of the parts; clustered ones few.

Parts may be of any size: their rows are dealt over blocks of bounded size,
and queries over blocks too, so no task holds a part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, table
from millrace.llm.vectors import CANDIDATES, QUERIES, best, by_id, matrix, meet, table_of, usable

#: Rows on which the index is fitted, parts, neighbours in the graph, hidden units.
SAMPLE, PARTS, NEIGHBOURS, HIDDEN = 4096, 16, 10, 64
#: Recall wanted on held-out vectors of the sample.
RECALL = 0.96


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors at length 1, scaled by powers of two first so that no square overflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest others of each row, in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), dtype=np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for the half of ``nodes`` on one side of a balanced cut with few of
    the edges (a, b), which join positions in ``nodes``."""
    n = len(nodes)
    degree = np.maximum(1.0, np.bincount(a, minlength=n) + np.bincount(b, minlength=n))
    scale, v = 1 / np.sqrt(degree), rng.standard_normal(n)
    trivial = np.sqrt(degree) / np.sqrt(degree.sum())
    for _ in range(60):  # the second eigenvector, by power iteration
        v -= trivial * (trivial @ v)
        w = v * scale
        v = v + scale * (np.bincount(a, w[b], n) + np.bincount(b, w[a], n))
        v /= np.linalg.norm(v) or 1.0
    side = np.zeros(n, dtype=bool)
    side[np.argsort(v * scale, kind="stable")[: n // 2]] = True
    for _ in range(30):  # swap the nodes that gain most on either side
        cross = side[a] != side[b]
        gain = np.bincount(a, np.where(cross, 1.0, -1.0), n) + np.bincount(b, np.where(cross, 1.0, -1.0), n)
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, n // 50))
        pick = np.flatnonzero(gain[left[:m]] + gain[right[:m]] > 0)
        if not len(pick):
            break
        new = side.copy()
        new[left[pick]], new[right[pick]] = False, True
        if (new[a] != new[b]).sum() >= cross.sum():
            break
        side = new
    return side


def partition(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part for each node of the graph; parts is a power of two."""
    rng, n = np.random.default_rng(seed), len(graph)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    out, groups = np.zeros(n, dtype=np.int64), [np.arange(n)]
    for _ in range(parts.bit_length() - 1):
        halves = []
        for g in groups:
            at = np.full(n, -1)
            at[g] = np.arange(len(g))
            inside = (at[a] >= 0) & (at[b] >= 0)
            side = bisect(g, at[a][inside], at[b][inside], rng)
            halves += [g[~side], g[side]]
        groups = halves
    for i, g in enumerate(groups):
        out[g] = i
    return out


def fit_router(x: np.ndarray, share: np.ndarray, hidden: int, seed: int = 7, epochs: int = 60) -> list[np.ndarray]:
    """Weights of a network with one hidden layer that predicts ``share``, the
    distribution of a row's neighbours over the parts (Adam, cross entropy)."""
    rng, (n, d), parts = np.random.default_rng(seed), x.shape, share.shape[1]
    w = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden + d, parts)) * 0.1, np.zeros(parts)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            rows = order[i : i + 256]
            h, p = _forward(x[rows], w)
            g = (p - share[rows]) / len(rows)
            gh = (g @ w[2][:hidden].T) * (h[:, :hidden] > 0)
            step += 1
            for j, grad in enumerate([x[rows].T @ gh + 1e-4 * w[0], gh.sum(axis=0), h.T @ g + 1e-4 * w[2], g.sum(axis=0)]):
                m[j], v[j] = 0.9 * m[j] + 0.1 * grad, 0.999 * v[j] + 0.001 * grad**2
                w[j] = w[j] - 3e-3 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return w


def _forward(x: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([np.maximum(0, x @ w[0] + w[1]), x], axis=1)
    z = h @ w[2] + w[3]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return h, p / p.sum(axis=1, keepdims=True)


def fit(sample: np.ndarray, parts: int = PARTS, recall: float = RECALL, k: int = 5) -> tuple[list[np.ndarray], int]:
    """The router and the number of parts a query visits."""
    x = unit(sample)
    if len(x) < 4 * parts:
        return [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1 + x.shape[1], 1)), np.zeros(1)], 1
    held = np.arange(len(x)) % 4 == 3

    def train(rows: np.ndarray) -> list[np.ndarray]:
        graph = neighbour_graph(rows, NEIGHBOURS)
        part = partition(graph, parts)
        share = np.eye(parts)[part] + np.eye(parts)[part[graph]].sum(axis=1)
        return fit_router(rows, share / share.sum(axis=1, keepdims=True), HIDDEN)

    w = train(x[~held])
    home = _forward(x, w)[1].argmax(axis=1)
    s = x[held] @ x.T
    s[np.arange(held.sum()), np.flatnonzero(held)] = -np.inf
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-_forward(x[held], w)[1], axis=1, kind="stable"), axis=1)
    visit = rank[np.arange(len(near))[:, None], home[near]]
    share = np.array([(visit < m).mean() for m in range(1, parts + 1)])
    return w, int(np.argmax(share >= recall)) + 1


def route(df: DataFrame, w: list[np.ndarray], visits: int) -> DataFrame:
    """``df`` (vec_id, v) with ``parts``, its most probable parts in order."""

    def run(batches):
        for batch in batches:
            if len(batch):
                p = _forward(unit(matrix(batch.column(1))), w)[1]
                top = np.argsort(-p, axis=1, kind="stable")[:, :visits].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, top.shape[1]), pa.int32()), pa.array(top.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "v", "parts"])

    return df.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, parts array<int>")


def rerank(k: int):
    """The k most similar rows of a block of candidates for each query."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return table_of([], [], [], pa.float64())
        a, b = unit(matrix(q["v"])), unit(matrix(c["v"]))
        qi, ci = q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
        out = [], [], []
        for i in range(0, len(a), 256):
            s = a[i : i + 256] @ b.T
            s[qi[i : i + 256, None] == ci[None]] = -np.inf
            least = np.partition(s, -min(k, len(b)), axis=1)[:, -min(k, len(b))]
            for j in range(len(s)):
                # Again, in one order of summing, so that equal vectors have equal scores.
                rows = np.flatnonzero((s[j] >= least[j] - 1e-9) & (s[j] > -np.inf))
                exact = (b[rows] * a[i + j]).sum(axis=1)
                top = np.lexsort((ci[rows], -exact))[:k]
                out[0].extend([qi[i + j]] * len(top))
                out[1].extend(ci[rows][top].tolist())
                out[2].extend(exact[top].tolist())
        return table_of(*out, pa.float64())

    return run


def search(df: DataFrame, every: int, k: int, parts: int = PARTS, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """For each id divisible by ``every`` its k nearest others found:
    ``query_id, rank, vec_id, score`` (cosine)."""
    rows = usable(df, lambda v: F.exists(v, lambda x: x != 0))
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
    w, visits = fit(np.array(taken.tolist(), dtype=float) if len(taken) else np.zeros((0, 1)), parts, recall, k)
    index = checkpoint(route(rows, w, 1).select("vec_id", "v", F.col("parts")[0].alias("part")))
    queries = checkpoint(route(by_id(rows, every), w, visits).select("vec_id", "v", F.explode("parts").alias("part")))
    sizes = index.groupBy("part").agg(F.count("*").alias("c")).join(queries.groupBy("part").agg(F.count("*").alias("q")), "part")
    # One row per part: at most as many as the router has outputs.
    sizes = F.broadcast(sizes.select("part", F.ceil(F.col("c") / CANDIDATES).alias("nc"), F.ceil(F.col("q") / QUERIES).alias("nq")))
    q = queries.join(sizes, "part").withColumn("qb", F.pmod(F.xxhash64("vec_id"), "nq")).withColumn("cb", F.explode(F.expr("sequence(0L, nc - 1)")))
    c = index.join(sizes, "part").withColumn("cb", F.pmod(F.monotonically_increasing_id(), "nc")).withColumn("qb", F.explode(F.expr("sequence(0L, nq - 1)")))
    keys, cols = ["part", "qb", "cb"], ["part", "qb", "cb", "vec_id", "v"]
    return best(meet(q.select(*cols), c.select(*cols), keys, rerank(k), "query_id long, vec_id long, score double"), k)


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), every=50, k=5)
