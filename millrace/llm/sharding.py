"""Sharding by extendible hashing.

A directory is indexed by the first bits of a row's hash. A bucket holds all
rows whose hash begins with its bits; only a bucket whose bytes exceed the
limit splits, on one more bit, so sparse and dense regions end at different
depths. One aggregation counts bytes at the directory's full depth; rolling
those counts up gives every bucket above, so the splits need no further pass.
Cells that are still too large at that depth, and only those, go on with more
bits.

Edge cases: a null text has 0 bytes; a row larger than the limit gets a bucket
of its own (its shard exceeds the limit: a row is never cut); equal rows share
all bits, so once the bits are used up they fill numbered overflow pages; an
empty table gives an empty result; other columns are carried by ``shard``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_up_to, checkpoint, table

LIMIT = 1 << 20
#: Bits of a hash: 15 hexadecimal digits of an MD5.
BITS = 60
#: Most bits by which one pass refines the directory.
STEP = 20


def row_hash(*cols: str):
    """The first 60 bits of the MD5 of the columns' text, joined by bars."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int, bits: int, depth: int) -> DataFrame:
    """``cell, depth, prefix, bytes, rows``: for each cell of ``depth + bits``
    bits, the bucket of ``depth`` or more bits that holds it.

    A bucket above a cell is a leaf if it fits and the bucket one bit shorter
    does not; a cell that does not fit keeps its full depth.
    """
    full = depth + bits
    cells = rows.groupBy(F.shiftright("h", BITS - full).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    cells = checkpoint(cells)
    above = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(full)))).withColumn("prefix", F.expr(f"shiftright(cell, {full} - depth)"))
    sums = above.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    # From short to long, the first bucket of a cell that fits.
    fit = (F.col("bytes") <= limit) | (F.col("rows") == 1)
    fits = above.select("cell", "depth", "prefix").join(sums.where(fit | (F.col("depth") == full)), ["depth", "prefix"])
    return fits.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "bytes", "rows")).alias("b")).select("cell", "b.*")


def directories(docs: DataFrame, limit: int = LIMIT, key: tuple[str, ...] = ("doc_id", "text"), payload: str = "text") -> list[tuple[int, DataFrame]]:
    """``(bits, directory)`` pairs whose cells of that many bits together cover
    the table: ``cell, depth, prefix, bytes, rows`` of the bucket of each cell."""
    if limit < 1:
        raise ValueError("the limit must be positive")
    rows = docs.select(row_hash(*key).alias("h"), _bytes(payload).alias("bytes"))
    left = checkpoint(rows.groupBy("h").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")))
    total = left.agg(F.sum("bytes")).first()[0] or 0
    out: list[tuple[int, DataFrame]] = []
    bits, depth = min(STEP, max(1, math.ceil(math.log2(max(1, total / limit))) + 3)), 0
    while True:
        full = depth + bits
        known = checkpoint(directory(left, limit, bits, depth))
        fit = (F.col("bytes") <= limit) | (F.col("rows") == 1) | F.lit(full == BITS)
        over = known.where(~fit).select("cell")
        out.append((full, known.where(fit)))
        if full == BITS or not over.head(1):
            return out
        left = left.withColumn("cell", F.shiftright("h", BITS - full)).join(over, "cell", "left_semi").drop("cell")
        depth, bits = full, min(STEP, BITS - full)


def _bytes(payload: str):
    return F.coalesce(F.octet_length(payload), F.lit(0)).cast("long")


def shard(docs: DataFrame, limit: int = LIMIT, key: tuple[str, ...] = ("doc_id", "text"), payload: str = "text") -> DataFrame:
    """``docs`` with ``_shard`` (its bits, ``*`` for none, then the page if it
    overflows), ``_depth``, ``_bytes``, ``_shard_bytes`` and ``_shard_rows``.

    Rows meet the directory, which is broadcast while it has few cells, so
    their other columns need no shuffle.
    """
    # Whole rows travel as one column: theirs may have any names.
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_hash(*key).alias("_h"), _bytes(payload).alias("_bytes"))
    name = F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.expr("right(concat(repeat('0', 60), bin(prefix)), cast(depth as int))"))
    found = directories(docs, limit, key, payload)
    parts = [
        rows.withColumn("_cell", F.shiftright("_h", BITS - full)).join(broadcast_up_to(cells, 1_000_000), F.col("_cell") == F.col("cell"))
        .select("row", "_h", "_bytes", name.alias("_shard"), F.col("depth").cast("long").alias("_depth"), F.col("bytes").cast("long").alias("_shard_bytes"), F.col("rows").cast("long").alias("_shard_rows"))
        for full, cells in found
    ]
    out = reduce(DataFrame.unionByName, parts)
    if found[-1][0] < BITS or not found[-1][1].where((F.col("bytes") > limit) & (F.col("rows") > 1)).head(1):
        return _flat(out.drop("_h"))
    # Pages of equal rows: numbered within a partition first, then by partitions' offsets.
    chained = (F.col("_shard_bytes") > limit) & (F.col("_shard_rows") > 1)
    long = checkpoint(out.where(chained).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = long.groupBy("_h", "_part").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_h", "_part").orderBy("_bytes")) - 1 + F.col("_off")
    a_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("_bytes"), F.lit(1))))
    paged = long.join(offsets, ["_h", "_part"]).withColumn("_i", nth).withColumn("_page", F.floor(F.col("_i") / a_page))
    a = F.least(a_page, F.col("_shard_rows") - F.col("_page") * a_page)
    paged = paged.withColumn("_shard", F.concat_ws("+", "_shard", F.col("_page").cast("string"))).withColumn("_shard_rows", a).withColumn("_shard_bytes", a * F.col("_bytes"))
    return _flat(out.where(~chained).drop("_h").unionByName(paged.select(*[c for c in out.columns if c != "_h"])))


def _flat(out: DataFrame) -> DataFrame:
    """A row's columns beside those of its shard, which take the place of any of their names."""
    new = [c for c in out.columns if c != "row"]
    return out.select(*[F.col(f"row.`{c}`") for c in out.schema["row"].dataType.names if c not in new], *new)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_shard").alias("shard"), F.col("_depth").alias("depth"), F.col("_bytes").alias("n_bytes"), F.col("_shard_bytes").alias("shard_bytes"), F.col("_shard_rows").alias("shard_rows"))


ORACLE = f"""
with k as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 15))::bigint as h
  from documents),
d as (select h, unnest(generate_series(0, 40)) as depth, n_bytes from k),
s as (select depth, h >> (60 - depth) as prefix, sum(n_bytes)::bigint as shard_bytes, count(*)::bigint as shard_rows from d group by 1, 2),
f as (select k.h, min(s.depth) as depth from (select distinct h from k) k join s on s.prefix = k.h >> (60 - s.depth)
      where s.shard_bytes <= {LIMIT} or s.shard_rows = 1 group by 1)
select k.doc_id,
       case when f.depth = 0 then '*' else right(repeat('0', 60) || bin(s.prefix), f.depth::int) end as shard,
       f.depth::bigint as depth, k.n_bytes, s.shard_bytes, s.shard_rows
from k join f using (h) join s on s.depth = f.depth and s.prefix = k.h >> (60 - f.depth)
"""
