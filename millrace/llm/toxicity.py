"""Toxicity as an ordinal scale.

A cumulative-link model: ``P(grade <= k) = sigmoid(theta_k - w x)`` with one
weight vector for all thresholds ``theta_0 < theta_1 < ...``. Features are the
words of a text and their first letters (inflected forms share them), each with
1 + log(count); only those that clearly go with the label are kept, so a long
clean text does not add up to a toxic one.

The labels say only toxic or not. Grades among toxic texts come from how often
they use the words that mark toxic texts in the sample: the lower, middle and
upper third are 1, 2 and 3; clean texts are 0.

The model is fitted on the driver, on at most ``LABELLED`` labelled texts (in
the order of a hash of the id); every text is scored whole, in tasks.

Edge cases: null and empty texts have no words and get the grade of that, 0;
labels that are null are left out, several labels of one id count once (toxic
if any is); without toxic or without clean labels nothing is toxic; an empty
table gives an empty result; equal rows get equal scores; other columns are
kept by ``filter_toxic`` only.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, table

#: Labelled texts of the sample at most, and texts of it that a word must be in.
LABELLED, LEAST = 8000, 5
GRADES = 4
#: Weight of the penalty, steps of the fit.
PENALTY, STEPS = 3e-4, 200
#: Documents are rejected from this probability of a grade above 0.
REJECT = 0.3
#: Words whose features a task remembers.
REMEMBERED = 500_000
_words = re.compile(r"\w+").findall
#: Lengths of the beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)


def features(word: str) -> list[str]:
    """A word and its beginnings; a mark tells them apart."""
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) >= n)]


def counts(text: str) -> Counter:
    """How often a text's words occur, lower-cased."""
    return Counter(_words(text.lower()))


def spread(words: Counter) -> Counter:
    """How often the features of counted words occur."""
    out: Counter = Counter()
    for w, c in words.items():
        for f in features(w):
            out[f] += c
    return out


def graded(uses: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Severity grades of labelled texts, by their uses of marking features."""
    if not toxic.any():
        return np.zeros(len(toxic), dtype=int)
    cuts = np.quantile(uses[toxic], np.arange(1, grades - 1) / (grades - 1))
    return np.where(toxic, 1 + np.searchsorted(cuts, uses, side="left"), 0)


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """Weights by word, and the thresholds."""

    def __init__(self, weights: dict[str, float], theta: np.ndarray):
        self.weights, self.theta, self.memory = weights, theta, {}

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score z and threshold k."""
        return sigmoid(np.asarray(z)[:, None] - self.theta[None])

    def score(self, text: str) -> float:
        found: Counter = Counter()
        for word, c in counts(text).items():
            known = self.memory.get(word)
            if known is None:
                known = tuple(f for f in features(word) if f in self.weights)
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[word] = known
            for f in known:
                found[f] += c
        return sum(self.weights[f] * (1 + math.log(found[f])) for f in sorted(found))


def fit(names: list[str], r: np.ndarray, c: np.ndarray, v: np.ndarray, grade: np.ndarray, grades: int = GRADES, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """Maximum likelihood of ``P(grade = g) = sigmoid(theta_g - z) - sigmoid(theta_(g-1) - z)``
    by quasi-Newton steps, with a quadratic penalty on the weights. The first
    threshold and the logarithms of the gaps to the next ones are free, so the
    thresholds stay in order; a light penalty holds the gap of a grade without texts.

    Text ``r[i]`` has feature ``names[c[i]]`` with value ``v[i]``.
    """
    n, nb = len(grade), int((grade > 0).sum())
    if not 0 < nb < n or not len(r):
        return Model({}, np.full(grades - 1, 20.0))
    d, last = len(names), grades - 1
    above = (grade[:, None] > np.arange(last)).mean(axis=0)
    start = np.log((1 - above + 1 / n) / (above + 1 / n))
    inner, lower, upper = (grade > 0) & (grade < last), grade > 0, grade < last

    def thresholds(p):
        return p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])

    def loss(p):
        theta, z = thresholds(p), np.bincount(r, v * p[c], n)
        b, a = theta[np.minimum(grade, last - 1)] - z, theta[np.maximum(grade - 1, 0)] - z
        gap = np.maximum(np.where(inner, b - a, 1.0), 1e-12)
        # log(sigmoid(b) - sigmoid(a)), with a or b infinite at the ends of the scale
        fits = np.where(inner, np.log(-np.expm1(-gap)), 0.0) - np.where(upper, np.logaddexp(0, -b), 0.0) - np.where(lower, np.logaddexp(0, a), 0.0)
        to_b, to_a = np.where(upper, sigmoid(-b), 0.0), np.where(lower, -sigmoid(a), 0.0)
        apart = np.where(inner, 1 / np.expm1(gap), 0.0)
        by_z = (to_b + to_a) / n
        by_theta = np.bincount(grade[upper], (to_b + apart)[upper], last) + np.bincount(grade[lower] - 1, (to_a - apart)[lower], last)
        after = -np.cumsum(by_theta[::-1])[::-1] / n
        gaps = p[d + 1 :]
        value = -fits.mean() + penalty / 2 * (p[:d] @ p[:d] + gaps @ gaps)
        return value, np.concatenate([np.bincount(c, v * by_z[r], d) + penalty * p[:d], after[:1], np.exp(gaps) * after[1:] + penalty * gaps])

    p = minimise(loss, np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 1e-2))]), steps)
    return Model({word: float(w) for word, w in zip(names, p, strict=False)}, thresholds(p))


def minimise(loss, p: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a halving line search."""
    value, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step, slope = 1.0, g @ q
        while True:
            new, (new_value, new_g) = p - step * q, loss(p - step * q)
            if new_value <= value - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = new - p, new_g - g
        done = value - new_value < 1e-9
        p, value, g = new, new_value, new_g
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        if done:
            break
    return p


def sample_of(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``key, toxic, features, counts`` of at most ``most`` labelled texts; of
    copies (texts that agree in their four words of least hash) there is one."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                found = counts(batch.column(0)[i].as_py())
                key = sorted(found, key=lambda w: zlib.crc32(w.encode()))[:4] if len(found) > 20 else sorted(found)
                own = spread(found)
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(key)]), batch.column(1).slice(i, 1), pa.array([list(own)], pa.list_(pa.string())), pa.array([list(own.values())], pa.list_(pa.int32()))], names=["key", "toxic", "features", "counts"])

    rows = texts.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).mapInArrow(run, "key string, toxic int, features array<string>, counts array<int>")
    return checkpoint(rows.groupBy("key").agg(F.max(F.struct("toxic", "features", "counts")).alias("x")).select("key", "x.*"))


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED, grades: int = GRADES) -> Model:
    """Features are counted and chosen in Spark: of all features those that are
    in at least ``LEAST`` texts and two in a thousand, and that go with the
    label so clearly that none of all would by chance (chi-square over 27).
    The driver gets those features of the sample's texts only."""
    rows = sample_of(docs, labels, most)
    texts = rows.select("key", "toxic").orderBy("key").collect()
    n, nb = len(texts), sum(r["toxic"] for r in texts)
    if not 0 < nb < n:
        return Model({}, np.full(grades - 1, 20.0))
    one = rows.select("key", "toxic", F.explode(F.arrays_zip("features", "counts")).alias("x")).select("key", "toxic", F.col("x.features").alias("f"), F.col("x.counts").alias("n"))
    found = one.groupBy("f").agg(F.count("*").alias("c"), F.sum("toxic").alias("o")).where(F.col("c") >= max(LEAST, 0.002 * n))
    c, o = F.col("c").cast("double"), F.col("o").cast("double")
    chi2 = F.try_divide(n * F.pow(o * n - c * nb, 2), c * nb * (n - nb) * (n - c))
    chosen = checkpoint(found.where((chi2 > 27) | ((c == n) & (o != nb))))
    marks = {r["f"]: r["o"] / nb > 10 * (r["c"] - r["o"] + 0.5) / (n - nb) for r in chosen.orderBy("f").collect()}
    cells = one.join(F.broadcast(chosen.select("f")), "f").select("key", "f", "n").toPandas()
    at, names = {r["key"]: i for i, r in enumerate(texts)}, list(marks)
    place = {f: i for i, f in enumerate(names)}
    r, k = cells["key"].map(at).to_numpy(dtype=int), cells["f"].map(place).to_numpy(dtype=int)
    times = cells["n"].to_numpy(dtype=float)
    order = np.lexsort((k, r))  # sums do not depend on the order of arrival
    r, k, times = r[order], k[order], times[order]
    toxic = np.array([x["toxic"] > 0 for x in texts])
    uses = np.bincount(r, times * np.array([marks[f] for f in names], dtype=float)[k], n) if len(r) else np.zeros(n)
    return fit(names, r, k, 1 + np.log(times), graded(uses, toxic, grades), grades)


def scored(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``grade`` (the most
    probable), ``p_toxic`` and ``rejected``, in place of columns of these names."""
    weights, theta = model.weights, model.theta

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(weights, theta)
        for column in columns:
            z = np.array([own.score(x.as_py() or "") for x in column], dtype=float)
            yield pa.array(z)

    score = F.arrow_udf(run, "double")
    out = docs.select(F.struct(*docs.columns).alias("row"), score("text").alias("_z"))
    above = [1 / (1 + F.exp(F.lit(float(t)) - F.col("_z"))) for t in theta]
    exact = [1 - above[0], *[a - b for a, b in zip(above, above[1:], strict=False)], above[-1]]
    top = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-i).alias("i")) for i, p in enumerate(exact)]))
    new = {"severity": sum(above), "grade": (-top["i"]).cast("int"), "p_toxic": above[0], "rejected": above[0] >= reject}
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def filter_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the model rejects."""
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    return scored(rows, train(docs, labels)).where("not rejected").select("row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
