"""Kendall's tau-b of pairs of columns without listing pairs of rows.

tau-b = (C - D) / sqrt((n0 - n1) (n0 - n2)): what is hard is D, the number of
pairs of rows that the two columns put in different order. Rows are first
summed up to different (x, y). Then, in rounds, each group of them is cut into slices by
x and into slices by y, the values of the cuts being slices of their own. A pair
whose slices differ in both is decided by the slices, so a table of counts per pair of slices
settles all of these; what is left is pairs within a slice by x, and pairs within a
slice by y of different slices by x. Both are groups of the next round, some
``SLICES`` times smaller, until every group is small enough to be counted in
memory. A value that a third of the rows has is a slice of its own and has no
pairs left, so no hot value makes a large group.

Edge cases: rows in which either value is null or NaN take no part; a column
with one value only, or fewer than two rows, gives null; an empty table gives one row
per pair, with null.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources import io

#: Cuts of a group by each column; different pairs of values that one task counts in memory.
SLICES, LARGEST = 32, 200_000


def discordant(x: np.ndarray, y: np.ndarray, k: np.ndarray) -> float:
    """Pairs with x_i < x_j and y_i > y_j, weighed by k_i k_j: merges of halves
    of doubling size, all halves of a size at once."""
    if len(x) < 2:
        return 0.0
    order = np.lexsort((y, x))
    # Ties in x are in the order of y, so they are never inverted.
    rank = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    k, total, size, n = k[order].astype(float), 0.0, 1, len(order)
    place = np.arange(n)
    while size < n:
        block, left = place // (2 * size), place // size % 2 == 0
        # Within a block by y; of equal ones the left half first, so that they are not counted.
        at = np.lexsort((~left, rank, block))
        weight_left = np.where(left[at], k[at], 0.0)
        so_far = np.cumsum(weight_left)
        first = np.flatnonzero(np.concatenate([[True], np.diff(block[at]) > 0]))
        sizes = np.diff(np.concatenate([first, [n]]))
        ends = so_far[first + sizes - 1]
        larger = np.repeat(ends, sizes) - so_far
        total += float((larger * np.where(left[at], 0.0, k[at])).sum())
        size *= 2
    return total


def _slice(value: str, cuts: str):
    """Odd: the values of a cut; even: those between two cuts."""
    v, c = F.col(value), F.col(cuts)
    below = F.size(F.filter(c, lambda e: e < v))
    return (2 * below + F.array_contains(c, v).cast("int")).cast("int")


def _counted(pdf: pd.DataFrame) -> float:
    return discordant(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["k"].to_numpy())


def _small(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"pair": [key[0]], "d": [_counted(pdf)]})


def _table(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs whose slices differ in both, from the counts of pairs of slices."""
    return pd.DataFrame({"pair": [key[0]], "d": [discordant(pdf["p"].to_numpy(), pdf["q"].to_numpy(), pdf["k"].to_numpy())]})


def inversions(rows: DataFrame, largest: int = LARGEST) -> DataFrame:
    """``pair, d``: discordant pairs of rows of ``rows`` (pair, x, y, k: how many
    rows have x and y), by pair of columns."""
    spark = rows.sparkSession
    found: list[DataFrame] = []
    folder, n = f"{io.shared_folder(spark)}/concordance-{spark.sparkContext.applicationId}-{id(rows)}", 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        df.write.mode("overwrite").parquet(f"{folder}/{n}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{n}")

    rows = keep(rows.withColumn("g", F.lit(0).cast("long")))
    while True:
        sizes = rows.groupBy("pair", "g").agg(F.count("*").alias("n"))
        large = keep(sizes.where(F.col("n") > largest).select("pair", "g"))
        found.append(rows.join(large, ["pair", "g"], "left_anti").groupBy("pair", "g").applyInPandas(_small, "pair int, d double"))
        if large.isEmpty():
            break
        rest = rows.join(large, ["pair", "g"], "left_semi")
        at = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
        cut = lambda c: F.array_distinct(F.percentile_approx(c, at, 10_000))
        cuts = rest.groupBy("pair", "g").agg(cut("x").alias("cx"), cut("y").alias("cy"))
        placed = rest.join(cuts, ["pair", "g"]).withColumn("p", _slice("x", "cx")).withColumn("q", _slice("y", "cy")).drop("cx", "cy")
        placed = keep(placed)
        cells = placed.groupBy("pair", "g", "p", "q").agg(F.sum("k").alias("k"))
        found.append(cells.groupBy("pair", "g").applyInPandas(_table, "pair int, d double"))
        # Slices of one value have no pairs left on their own side.
        group = lambda side, part: F.xxhash64("g", F.lit(n), F.lit(side), part)
        by_x = placed.where("p % 2 = 0").select("pair", "x", "y", "k", group(0, "p").alias("g"))
        by_y = placed.where("q % 2 = 0").groupBy("pair", "g", "q", "p", "y").agg(F.sum("k").alias("k")).select("pair", F.col("p").cast("double").alias("x"), "y", "k", group(1, "q").alias("g"))
        rows = keep(by_x.unionByName(by_y))
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more)
    return total.groupBy("pair").agg(F.sum("d").alias("d"))


def kendall(df: DataFrame, pairs: list[tuple[str, str]], largest: int = LARGEST) -> DataFrame:
    """``left, right, n, tau``: tau-b of each pair of columns, over the rows in which both have a value."""
    named = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for i, (a, b) in enumerate(pairs)])
    rows = df.select(F.inline(named)).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    # Minus zero and zero are one value.
    rows = rows.select("pair", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).groupBy("pair", "x", "y").agg(F.count("*").alias("k"))
    two = lambda c: (F.col(c).cast("double") * (F.col(c) - 1) / 2)
    n0 = rows.groupBy("pair").agg(F.sum("k").alias("n"), F.sum(two("k")).alias("both"))
    ties = [rows.groupBy("pair", v).agg(F.sum("k").alias("k")).groupBy("pair").agg(F.sum(two("k")).alias(f"t{v}")) for v in ("x", "y")]
    spark = df.sparkSession
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, left string, right string")
    all_ = names.join(n0, "pair", "left").join(ties[0], "pair", "left").join(ties[1], "pair", "left").join(inversions(rows, largest), "pair", "left")
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2
    # Concordant less discordant: all pairs, less those tied in x or y, less twice the discordant.
    net = every - F.col("tx") - F.col("ty") + F.col("both") - 2 * F.coalesce("d", F.lit(0.0))
    under = (every - F.col("tx")) * (every - F.col("ty"))
    return all_.select("left", "right", F.coalesce("n", F.lit(0)).alias("n"), F.when(under > 0, net / F.sqrt(under)).alias("tau"))
