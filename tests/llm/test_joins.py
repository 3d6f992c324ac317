"""Near duplicates, mixing, sharding: against brute force, and odd tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import jaccard_join, mixing, sharding, shingles
from millrace.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType()), T.StructField("key", T.StringType())])


def docs_frame(spark, rows):
    """Rows (id, text, source) with two more columns whose names operators use."""
    return spark.createDataFrame([(*r, "s", "k") for r in rows], DOCS)


def shingle_set(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingle_set(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(n)]
    out = [base]
    for e in edits:
        v = list(out[rng.randrange(len(out))])
        for _ in range(e):
            v[rng.randrange(len(v))] = rng.choice(words)
        out.append(v)
    return [" ".join(x) for x in out]


def test_join_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for n, edits in ((60, [1, 2, 1, 3, 2, 1, 4]), (120, [2, 3, 5, 6, 8]), (12, [1, 0, 1]), (30, [0] * 20 + [1] * 20), (200, [1] * 15)):
        texts += family(rng, words, n, edits)
    shared = " ".join(rng.choice(words) for _ in range(40))
    texts += [f"{shared} " + " ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(60)]
    texts += [" ".join(rng.choice(words) for _ in range(80)) for _ in range(40)]
    texts += ["", "   ", None, "One", "one", "a b c d", "A B C D", "a b c d e", "x " * 3000]
    rng.shuffle(texts)
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs_frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_join_odd_tables(spark):
    assert jaccard_join.join(docs_frame(spark, [])).collect() == []
    rows = [(None, "a b c d e f", None), (3, "a b c d e f", None), (3, "a b c d e f", "s"), (5, None, None), (6, "", "s")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs_frame(spark, rows)).collect())
    assert got == [("3", 2, 3), ("3", 2, 3), ("5", 0, 5), ("6", 0, 6), ("None", 2, 3)]
    kept = jaccard_join.keep_one(docs_frame(spark, [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, "q", "z"), (3, "q", "z"), (None, "q", "z")]))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3] and kept.columns == DOCS.names
    # Of two rows with one id only that which is a copy goes.
    kept = jaccard_join.keep_one(docs_frame(spark, [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (2, "all of its own", "z")]))
    assert sorted((r["doc_id"], r["source"]) for r in kept.collect()) == [(1, "x"), (2, "z")]


def test_shingles_are_sets():
    texts = ["a b c d e f g", "", "one two", "a b c d e a b c d e a", "é ü\tz\x0bq  r", "x" * 5000 + " y"]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    found = list(shingles.shingle_sets(np.frombuffer(data, np.uint8), offsets, twice=True))
    assert [len(s) for s, _ in found] == [len(shingle_set(t)) for t in texts] == [len(s) for _, s in found]


def test_word_hashes_tell_words_apart():
    """Prefixes, padding, lengths around eight bytes, and words that agree under
    every polynomial modulo 2^64 (Thue-Morse and its complement)."""
    some = ["a" * n for n in range(1, 80)] + [f"{'b' * n}\0" for n in range(1, 80)] + ["abcdefgh", "abcdefgi", "abcdefghi"]
    for n in (16, 1024):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        some += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    data = np.frombuffer(" ".join(some).encode(), np.uint8)
    starts, ends, _ = shingles.words(data, np.array([0, len(data)]))
    for seed in shingles.SEEDS:
        assert len(starts) == len(some) and len(set(shingles.word_hashes(data, starts, ends, seed).tolist())) == len(set(some))
    upper = np.frombuffer(" ".join(some).upper().encode(), np.uint8)
    assert (shingles.word_hashes(upper, starts, ends) == shingles.word_hashes(data, starts, ends)).all()


def test_equal_under_polynomials_do_not_link(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits), "s"), (2, "".join("ba"[b] for b in bits), "s"), (3, "q", "s")]
    assert sorted(tuple(r) for r in jaccard_join.join(docs_frame(spark, rows)).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]


def test_cells_divide_and_lose_nothing(spark):
    """Well separated families with one passage in common are divided into
    cells; every pair of sets within 0.2 with one at home shares a cell."""
    rng = random.Random(9)
    sets, base = {}, list(range(40))
    for f in range(12):
        centre = base + rng.sample(range(1000 * (f + 1), 1000 * (f + 1) + 200), 80)
        for _ in range(8):
            v = list(centre)
            for _ in range(rng.randrange(6, 22)):
                v[rng.randrange(40, 120)] = rng.randrange(10**6, 10**7)
            sets[len(sets)] = set(v)
    dist = lambda a, b: 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pivots = [8 * f for f in range(12)]
    rest = [i for i in sets if i not in pivots and all(dist(i, p) > 0.2 for p in pivots)]
    frame = spark.createDataFrame([(5, i, len(sets[i]), 0, 999, 1.0, i % 9 != 0) for i in rest], "cell long, sid long, n long, own long, hi long, score double, home boolean")
    seen = spark.createDataFrame([(5, i, p, dist(i, p)) for i in rest for p in pivots if dist(i, p) <= 0.6], "cell long, sid long, pivot long, dist double")
    out = jaccard_join.divided(frame, seen).collect()
    assert len({r["cell"] for r in out}) > 5 and len(out) <= jaccard_join.GROWTH * len(rest)
    home, all_of = {}, {}
    for r in out:
        all_of.setdefault(r["cell"], set()).add(r["sid"])
        if r["home"]:
            assert r["sid"] not in home
            home[r["sid"]] = r["cell"]
    assert set(home) == {i for i in rest if i % 9}
    for i in rest:
        for j in rest:
            if i < j and dist(i, j) <= 0.2 and (i in home or j in home):
                assert any(a in home and b in all_of[home[a]] for a, b in ((i, j), (j, i)))


def test_cells_have_small_plans(spark):
    """What a round of cells reads is written: no step's plan repeats another's
    joins, of which the driver would hold hundreds."""
    frame = spark.createDataFrame([(5, i, 10, 0, 999, 1.0, True) for i in range(6)], "cell long, sid long, n long, own long, hi long, score double, home boolean")
    seen = spark.createDataFrame([(5, i, 100 + i % 2, 0.3) for i in range(6)], "cell long, sid long, pivot long, dist double")
    plan = jaccard_join.paired(jaccard_join.divided(frame, seen))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2


def test_large_group_of_near_copies(spark):
    """Hundreds of texts around one, some of which link only to few others."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(90)]
    texts = []
    for i in range(300):
        v = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            v[rng.randrange(90)] = rng.choice(words)
        texts.append(" ".join(v))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs_frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    lone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x not in lone}


def water(sizes, weights, cap):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, ws = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / ws > cap * sizes[s]]
        if not over:
            return fixed | {s: rest * w[s] / ws for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 50, 400, 2000]))), rng.choice(["a", "a", "a", "a", "b", "c", "dd", None, ""])) for i in range(600)]
    rows += [(9000, "same text here", "a")] * 50 + [(9001, None, "b"), (None, "x y", "c")]
    out = mixing.assign(docs_frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    for r in out:
        assert 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    want = water(dict(sizes), (5, 2, 1), 3)
    for s, t in target.items():
        assert t == pytest.approx(want[s])
        assert abs(taken[s] - t) <= max(60, 0.02 * t)
    again = mixing.assign(docs_frame(spark, rows).repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    for r in out:  # within one copy of the fraction, repeated rows together
        if r["size"] and r["doc_id"] != 9000:
            assert abs(r["copies"] - r["target"] / r["source_size"]) < 1


@pytest.mark.parametrize("each", [1, 2, 40, 70, 1500])
def test_mix_of_any_size(spark, each):
    """The tree rounds however many documents a source has: none is a copy or
    more off, and sources meet their targets within one document."""
    rng = random.Random(each)
    rows = [(i, "w " * rng.choice([1, 2, 7, 30, 200]), f"s{i % 3}") for i in range(3 * each)]
    out = mixing.assign(docs_frame(spark, rows)).collect()
    taken, target = Counter(), {}
    for r in out:
        assert abs(r["copies"] - r["target"] / r["source_size"]) < 1 and r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 200, (s, taken[s], t)


def test_mix_rows(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 7}") for i in range(200)] + [(500, "same here", "s1")] * 9
    df = docs_frame(spark, rows)
    copies = mixing.assign(df).agg(F.sum("copies")).first()[0]
    out = mixing.mix(df)
    assert out.count() == copies and out.columns == DOCS.names and set(out.collect()) <= set(df.collect())
    assert mixing.mix(docs_frame(spark, [])).count() == 0 and mixing.assign(docs_frame(spark, [])).count() == 0


def test_expectation_is_kept(spark):
    """Over many seeds a document is taken as often as its fraction says."""
    rows = [(i, "w " * 10, "a" if i < 100 else "b") for i in range(200)]
    df = docs_frame(spark, rows)
    share = {r["source"]: r["target"] / r["source_size"] for r in mixing.assign(df).collect()}
    units = df.selectExpr("doc_id", "source", "10L as size", "1L as n")
    src = mixing.targets(units)
    first = [r["copies"] for s in range(12) for r in mixing.round_units(units, src, seed=s).where("source = 'b'").collect()]
    assert sum(first) / len(first) == pytest.approx(share["b"], abs=0.06)


def shards_by_hand(keys, limit):
    def split(prefix, rows):
        if sum(b for _, b in rows) <= limit or len(rows) == 1 or len(prefix) == 60:
            return {h: prefix or "*" for h, _ in rows}
        return {k: v for bit in "01" for k, v in split(prefix + bit, [r for r in rows if r[0][len(prefix)] == bit]).items()} if rows else {}

    return split("", keys)


def test_sharding(spark):
    import hashlib

    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([0, 5, 80, 700]), "s") for i in range(500)] + [(1000, "y" * 5000, "s"), (1001, None, "s")]
    out = sharding.shard(docs_frame(spark, rows), limit=2000).collect()
    bits = lambda i, t: bin(int(hashlib.md5(f"{i}|{t or ''}".encode()).hexdigest()[:15], 16))[2:].zfill(60)
    want = shards_by_hand([(bits(i, t), len(t or "")) for i, t, _ in rows], 2000)
    assert {r["doc_id"]: r["_shard"] for r in out} == {i: want[bits(i, t)] for i, t, _ in rows}
    held = Counter()
    for r in out:
        held[r["_shard"]] += r["_bytes"]
    assert all(r["_shard_bytes"] == held[r["_shard"]] for r in out)
    assert all(held[r["_shard"]] <= 2000 or r["_shard_rows"] == 1 for r in out)


def test_sharding_of_equal_rows(spark):
    rows = [(1, "z" * 100, "s")] * 95 + [(2, "q", None)]
    out = sharding.shard(docs_frame(spark, rows).repartition(3), limit=1000).collect()
    held = Counter(r["_shard"] for r in out if r["doc_id"] == 1)
    assert len(out) == 96 and max(held.values()) <= 10 and len(held) >= 10
    assert all(r["_shard_rows"] == held[r["_shard"]] for r in out if r["doc_id"] == 1)
    assert sharding.shard(docs_frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(docs_frame(spark, rows), limit=0)


def test_components_end_with_stars(spark):
    """Edges that lead to roots need no round; a long path needs a few, and no round to see that nothing changes."""
    from millrace.llm import common, components

    class Counted(common.Tables):
        def keep(self, df):
            rounds.append(df)
            return super().keep(df)

    for edges, most in (([(2, 1), (1, 3), (9, 8)], 2), ([(i, i + 1) for i in range(40)], 20)):
        rounds = []
        found = components.components(spark.createDataFrame(edges, "a long, b long"), Counted(spark))
        roots = {n: min(e for e in sum(edges, ()) if (e < 8) == (n < 8) or most > 2) for n in sum(edges, ())}
        assert {r["node"]: r["root"] for r in found.collect()} == roots and len(rounds) <= most
