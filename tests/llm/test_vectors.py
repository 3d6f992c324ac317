"""Both vector searches against brute force, and odd vectors."""

import random

import numpy as np
import pytest

from millrace.llm import exact_topk, learned_partitions


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, d int, score string")


def vectors(n, d, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    if clusters:
        x = 0.3 * x + rng.standard_normal((clusters, d))[rng.integers(0, clusters, n)]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


ODD = [(40_000, None), (40_020, [float("nan")] * 8), (40_040, [1.0, None] * 4), (40_060, [float("inf")] * 8), (40_080, []), (40_100, [1.0] * 3)]


def test_exact_topk(spark):
    x = vectors(300, 8, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(30)] + [(None, x[0].tolist()), (2000, [0.0] * 8)] + ODD
    got = {}
    for r in exact_topk.top_k(frame(spark, rows), every=20, k=20, scale=64.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    live = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v)]
    for q, a in live:
        if q % 20 == 0:
            best = sorted(((-sum(s * t for s, t in zip(a, b, strict=True)), i) for i, b in live if i != q))[:20]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    assert set(got) == {q for q, _ in live if q % 20 == 0}


def test_exact_topk_of_large_numbers(spark):
    rng = random.Random(0)
    rows = [(i, [rng.uniform(-1, 1) * 2**25 for _ in range(4)]) for i in range(60)]
    got = {(r["query_id"], r["rank"]): r["score"] for r in exact_topk.top_k(frame(spark, rows), every=20, k=3, scale=1.0).collect()}
    ints = {i: [int(np.floor(float(np.float32(c)))) for c in v] for i, v in rows}
    for q in (0, 20, 40):
        best = sorted((sum(s * t for s, t in zip(ints[q], ints[i], strict=True)) for i in ints if i != q), reverse=True)
        assert [got[q, k] for k in (1, 2, 3)] == best[:3]


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [2e30, 1.0]), (4, [1.0, 1.0])]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_k(frame(spark, rows), 20, 4, scale=64.0).collect())
    assert [v for _, v, _ in got] == [1, 3, 4, 2] and got[0][2] == 2**63 - 1 and got[3][2] == -(2**63)


def test_few_candidates_and_none(spark):
    assert exact_topk.top_k(frame(spark, []), 20, 20).count() == 0
    assert exact_topk.top_k(frame(spark, [(0, [1.0, 2.0])]), 20, 20).count() == 0
    assert exact_topk.top_k(frame(spark, [(0, [1.0, 2.0]), (1, [3.0, 1.0])]), 20, 20).count() == 1


@pytest.mark.parametrize("clusters", [0, 20])
def test_learned_partitions(spark, clusters):
    x = vectors(3000, 16, 2, clusters)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[100].tolist()) for i in range(8)] + [(9000, [0.0] * 16)] + ODD
    out = learned_partitions.search(frame(spark, rows), every=50, k=5).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    live = {i: np.array(v, dtype=float) for i, v in rows if v is not None and len(v) == 16 and any(v)}
    ids, m = np.array(list(live)), np.array(list(live.values()))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = total = 0
    for q in (i for i in live if i % 50 == 0):
        s = m @ m[list(ids).index(q)]
        order = [int(i) for i in ids[np.lexsort((ids, -np.round(s, 12)))] if i != q][:5]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(c - s[list(ids).index(v)]) < 1e-12 for _, v, c in mine)
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(mine, mine[1:], strict=False))
        hit, total = hit + len(set(order) & {v for _, v, _ in mine}), total + 5
    assert hit / total >= 0.9


def test_partition_is_balanced():
    x = vectors(1024, 16, 3, 12).astype(float)
    part = learned_partitions.partition(learned_partitions.neighbour_graph(x, 8), 8)
    assert set(np.bincount(part)) == {128}


def test_clustered_vectors_need_few_parts():
    _, visits = learned_partitions.fit(vectors(4096, 16, 4, 16).astype(float), 16)
    assert visits <= 6


def test_search_of_nothing(spark):
    assert learned_partitions.search(frame(spark, []), 50, 5).count() == 0
    assert learned_partitions.search(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]), 50, 5).count() == 1
