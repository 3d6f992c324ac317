"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of all words by its weight, but no more than ``cap``
times its own words; what is cut off is shared out again among the others. A
document's expected number of copies is its source's target over its source's
size. The whole part is taken as it is; the fractions are rounded together:
two documents meet, words move at random from one to the other (in either
direction, with odds that leave both expectations as they were) until one of
them is integral, and the other goes on. A source's expected words therefore
never change on the way. The pairs meet in groups of about ``FAN``, whose
residuals meet in groups again: a reduction tree of a few levels, each a
shuffle of a ``FAN``-th of the rows before, down to one residual a source,
however few or many documents that has. The last residual is drawn, which misses
its fraction by some words; those are made up for by ``POOL`` documents of the
source, on average: from the largest to the smallest, one is rounded the other way if that brings
the source closer to its target. Every document stays within one copy of its
fraction, and a source ends within about one small document of its target.

Edge cases: null text has size 0; null source is a source of its own, last in
order; rows of size 0 weigh nothing and are kept once or dropped by a coin of
their own; equal rows are counted together first, so no number of repeats
makes a group large; an empty table gives an empty result; other columns are
carried by ``mix`` only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_up_to, checkpoint, let, n_words, table, uniform

#: Documents or residuals that meet in one group of the tree, on average.
FAN = 32
#: Documents of a source that may make up for the last residual, on average.
POOL = 256
#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: No source's target and no document's copies exceed this many times its size.
CAP = 3
SEED = 20250


def targets(units: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, n_units, target``: one row per source.

    Water level: sources in order of the level at which they reach their cap;
    the first whose cap lies above the level that remains fixes the level.
    The windows see one row per source (a name and a number; ten million
    sources are some hundred megabytes in one task), never documents.
    """
    src = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_units"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    src = src.withColumn("w", weight).withColumn("full", F.lit(float(cap)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    below, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    src = (
        src.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(below), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
        .withColumn("at", F.when(F.col("rest") * F.col("w") <= F.col("full") * F.col("rest_w"), F.struct(F.col("rest_w"), F.col("rest"))))
        .withColumn("at", F.max("at").over(every))
    )
    share = F.col("at.rest") * F.col("w") / F.col("at.rest_w")
    target = F.when(F.col("at").isNull() | (share > F.col("full")), F.col("full")).otherwise(share)
    return src.select("source", "source_size", "n_units", target.alias("target"))


def _meet(state, unit):
    """The carried residual meets the next unit; what becomes integral is put out."""
    a, b = state["carry"], unit
    ab = let(
        F.struct(
            F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"]).alias("to_a"),
            F.least(a["size"] * a["p"], b["size"] * (1 - b["p"])).alias("to_b"),
        ),
        lambda d: F.when(
            b["u"] * (d["to_a"] + d["to_b"]) < d["to_b"],
            F.when(
                d["to_a"] == b["size"] * b["p"],
                F.struct(a["p"] + d["to_a"] / a["size"], F.lit(0.0)),
            ).otherwise(F.struct(F.lit(1.0), b["p"] - d["to_a"] / b["size"])),
        ).otherwise(
            F.when(
                d["to_b"] == a["size"] * a["p"],
                F.struct(F.lit(0.0), b["p"] + d["to_b"] / b["size"]),
            ).otherwise(F.struct(a["p"] - d["to_b"] / a["size"], F.lit(1.0)))
        ),
    )

    def with_p(x, p):
        return F.struct(*[(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) if f == "p" else x[f]).alias(f) for f in _FIELDS])

    def after(p):
        new_a, new_b = with_p(a, p["col1"]), with_p(b, p["col2"])
        a_done = p["col1"].isin(0.0, 1.0)
        return F.struct(
            F.when(a_done, new_b).otherwise(new_a).alias("carry"),
            F.concat(state["done"], F.array(F.when(a_done, new_a).otherwise(new_b))).alias("done"),
        )

    return F.when(a.isNull(), F.struct(unit.alias("carry"), state["done"].alias("done"))).otherwise(let(ab, after))


def _make_up(missed, units):
    """Ids of ``units`` (size, up, doc_id, n) in descending order that are
    rounded the other way, given the words that the source has too many."""

    def step(state, x):
        helps = (F.when(x["up"], state["left"]).otherwise(-state["left"]) * 2 > x["size"]) & (x["size"] > 0)
        left = state["left"] - F.when(helps, F.when(x["up"], x["size"]).otherwise(-x["size"])).otherwise(F.lit(0.0))
        return F.struct(left.alias("left"), F.when(helps, F.concat(state["turned"], F.array(x))).otherwise(state["turned"]).alias("turned"))

    none = F.array().cast("array<struct<size:double,up:boolean,doc_id:bigint,n:bigint>>")
    return F.aggregate(units, F.struct(missed.alias("left"), none.alias("turned")), step)["turned"]


_FIELDS = ("size", "doc_id", "n", "base", "p", "u")


def round_units(units: DataFrame, src: DataFrame, seed: int = SEED) -> DataFrame:
    """``units`` (doc_id, source, size, n) with ``copies``, the whole number of
    copies that the n equal rows get together."""
    src = broadcast_up_to(src, 100_000)
    units = (
        units.withColumnRenamed("source", "s").join(src, F.col("s").eqNullSafe(F.col("source")), "inner").drop("s")
        .withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0)) * F.col("n"))
        .withColumn("base", F.floor("f"))
        .withColumn("p", F.col("f") - F.col("base"))
        .withColumn("u", uniform(F.lit(seed), "doc_id", "source", "size"))
        .withColumn("groups", F.ceil(F.col("n_units") / FAN))
        .withColumn("gid", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "source", "size"), "groups"))
    )
    known = ["source", "source_size", "target"]
    moving = (F.col("size") > 0) & (F.col("p") > 0)
    done = [units.where(~moving).select(*known, "doc_id", "size", "n", (F.col("base") + (F.col("u") < F.col("p")).cast("long")).alias("copies"))]
    level = units.where(moving).withColumn("size", F.col("size").cast("double"))
    most = src.agg(F.max(F.ceil(F.col("n_units") / FAN))).first()[0] or 1
    kind = "struct<" + ",".join(f"{f}:{t}" for f, t in zip(_FIELDS, ("double", "bigint", "bigint", "bigint", "double", "double"))) + ">"
    none = F.array().cast(f"array<{kind}>").alias("done")
    unit = F.struct(*[F.col(f) for f in _FIELDS])
    start = F.struct(F.lit(None).cast(kind).alias("carry"), none)
    rounded = []
    while True:
        level = checkpoint(
            level.groupBy(*known, "gid").agg(F.sort_array(F.collect_list(unit)).alias("units")).select(*known, "gid", F.aggregate("units", start, _meet).alias("r"))
        )
        rounded.append(level.select(*known, F.inline("r.done")))
        level = level.select(*known, (F.col("gid") / FAN).cast("long").alias("gid"), "r.carry.*")
        if most == 1:
            break
        most = -(-most // FAN)
    # The last residual of a source: a draw, and the words by which it misses.
    last = level.withColumn("up", (F.col("u") < F.col("p")).cast("double"))
    missed = last.select(F.col("source").alias("_s"), ((F.col("up") - F.col("p")) * F.col("size")).alias("missed"))
    done.append(last.select(*known, "doc_id", F.col("size").cast("long").alias("size"), "n", (F.col("base") + F.col("up").cast("long")).alias("copies")))
    every = reduce(DataFrame.unionByName, rounded)
    # A draw of its own decides who is in the pool: those of the rounding stay independent of it.
    drawn = F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id", "source", F.col("size").cast("long")), "n_units") < POOL
    units_of = src.select(F.col("source").alias("_s2"), "n_units")
    pool = every.join(units_of, F.col("source").eqNullSafe(F.col("_s2"))).where(drawn).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", (F.col("p") == 1).alias("up"), "doc_id", "n")), asc=False).alias("l"))
    turned = pool.join(broadcast_up_to(missed, 100_000), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.inline(_make_up(F.col("missed"), F.col("l"))))
    turned = checkpoint(turned.select("_s", F.col("doc_id").alias("_d"), F.col("size").alias("_z"), F.lit(True).alias("_turn")))
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_z"))
    every = every.join(broadcast_up_to(turned, 100_000), same, "left").withColumn("p", F.when(F.col("_turn"), 1 - F.col("p")).otherwise(F.col("p")))
    done.append(every.select(*known, "doc_id", F.col("size").cast("long").alias("size"), "n", (F.col("base") + F.col("p").cast("long")).alias("copies")))
    return reduce(DataFrame.unionByName, done)


def assign(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies``."""
    units = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    out = round_units(units, checkpoint(targets(units, weights, cap)), seed)
    each = F.expr("explode(sequence(1L, n))")
    return out.withColumn("i", each).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.floor(F.col("copies") / F.col("n")) + (F.col("i") <= F.col("copies") % F.col("n")).cast("long")).alias("copies"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken."""
    taken = assign(docs, weights, cap, seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_k"), F.count("*").alias("_n"))
    taken = taken.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_k", "_n")
    # Whole rows travel as one column: theirs may have any names.
    rows = docs.select(F.struct(*docs.columns).alias("row"), n_words(F.col("text")).alias("_size"), F.lit(1).alias("_i"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_d")) & F.col("row.source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))
    once = rows.join(taken.where("_n = 1"), same)
    # Equal keys are rare: only they need a number within their key.
    several = taken.where("_n > 1")
    number = Window.partitionBy("_d", "_s", "_z").orderBy(F.xxhash64("row.text"))
    several = rows.join(several, same).withColumn("_i", F.row_number().over(number))
    copies = F.floor(F.col("_k") / F.col("_n")) + (F.col("_i") <= F.col("_k") % F.col("_n")).cast("long")
    both = once.unionByName(several).withColumn("_copies", copies).where("_copies > 0")
    return both.withColumn("_c", F.expr("explode(sequence(1L, _copies))")).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
