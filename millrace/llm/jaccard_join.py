"""Near duplicates: an exact Jaccard join in metric space.

Texts become sets of five-word shingles; their distance is 1 - Jaccard, a
metric; two documents link at distance 0.2 or less. Equal sets are one class
throughout.

1. Outsiders. A set with more than a fifth of members that no other set has is
   further than 0.2 from everything. Counting owners of the members in a fixed
   part of the hash range is enough to prove that of nearly all such sets,
   without moving the rest of their members.
2. First regions. Between texts of different origin every distance is close to
   1, where pivots tell nothing. Sets that link share one of their first
   ``n - ceil(0.8 n) + 1`` members, rarest first, so each such member is a region,
   and what lies outside its regions needs no comparison. How far back the
   member stands bounds the sizes of partners; sets without any leave.
3. Pivots and Voronoi cells. Every region picks pivots among its sets, the most
   typical of their size, and measures exact distances to them. Pivots leave:
   they have met everything. So do sets within 0.2 of a pivot, which is a link.
   Any other set within 0.4 of a pivot is at home in the cell of the nearest
   one, and the rest in one cell of their own. Windows by the triangle
   inequality replicate sets across boundaries: one at home at distance r from
   p links only to sets within r + 0.2 of p, so those are copied to its cell.
4. Recursion. Each cell is a region again, with more pivots the deeper it lies,
   until none has two sets that may link. Where the windows of a region
   overlap so much that its cells would hold more than ``GROWTH`` times its
   sets, it stays whole and goes on without those that left.
5. A set x that left for its link to p may still link to a set y within 0.4 of
   p. Such y are compared with the sets x that have d(x, p) >= d(y, p) - 0.2,
   unless links found so far connect y with p anyway. That is every pair left,
   so nothing is missed.

No step gathers a region: pivots are maxima, distances a join, and members
are fetched for pairs of a set and a pivot only, each pair once a round. Tables of a
round are removed after it. Keys of 128 bits stand for sets; shingles are
compared by 64-bit hashes, pair by pair. Steps that work with half a key keep
sets that share it.

Edge cases: null and empty texts have no shingles and link with nothing (also
not with each other); one to four words count as one shingle; equal rows and
equal ids are kept, one result row per input row; null ids form a component of
the least id that is not null; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Tables, broadcast_up_to, table
from millrace.llm.components import components
from millrace.llm.shingles import KEY_SCHEMA, MEMBER_SCHEMA, set_keys, set_members

#: Eighths of the hash range whose members step 1 counts.
COUNTED = 3
#: Rows up to which a list of keys is broadcast.
SMALL = 500_000
#: Rows of a class from which its rows do not meet by key in one task; at most
#: so many classes can be that large.
HOT, CLASSES = 100, 100_000
#: Pivots of a size class in the n-th round: FAN ** n. Most rows of cells for one of their region.
FAN, GROWTH = 4, 1.5
#: Windows must not lose a pair to rounding.
SLACK = 1e-9
KEY = ["half", "rest"]


def outsiders(rows: DataFrame) -> DataFrame:
    """``half, alone``: how many of its counted members no other set has."""
    owned = rows.select("half", F.explode("members").alias("t")).groupBy("t").agg(F.min("half").alias("half"), F.max("half").alias("other"))
    return owned.where("half = other").groupBy("half").agg(F.count("*").alias("alone"))


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (sid, pivot, n, m, ...; written) with the size of the intersection."""
    ids = pairs.select("sid").union(pairs.select("pivot")).distinct()
    some = sets.select("sid", "members").join(broadcast_up_to(ids, SMALL), "sid", "left_semi")
    with_b = pairs.join(some.select(F.col("sid").alias("pivot"), F.col("members").alias("_b")), "pivot")
    both = F.size(F.array_intersect("_a", "_b")).cast("long").alias("both")
    return with_b.join(some.withColumnRenamed("members", "_a"), "sid").select(*pairs.columns, both)


def near(percent: int):
    return 100 * F.col("both") >= percent * (F.col("n") + F.col("m") - F.col("both"))


def distance():
    return 1 - F.col("both") / (F.col("n") + F.col("m") - F.col("both"))


def regions(sets: DataFrame) -> DataFrame:
    """``cell, sid, n, own, hi, score, home``: each set in the regions of its first members.

    With t as the first member that two sets share, all before it (rank i)
    differ, which leaves room only for partners of up to ``hi`` members.
    ``own`` is the number of members that no other set has; ``score``, the mean
    number of sets that own a member, is high in the middle of a group of copies.
    """
    owned = sets.select("sid", "n", F.explode("members").alias("t"))
    shared = owned.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    ranked = owned.join(shared, "t").groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("ts"), F.sum("c").alias("sum"))
    # Members that no other set has come first and make no region.
    ranked = ranked.withColumn("own", F.col("n") - F.size("ts")).withColumn("left", F.expr("cast(floor(n / 5) + 1 - own as int)")).where("left > 0")
    ranked = ranked.withColumn("score", (F.col("sum") + F.col("own")) / F.col("n"))
    out = ranked.select("sid", "n", "own", "score", F.posexplode(F.expr("slice(ts, 1, left)")).alias("i", "x"))
    return out.select(F.col("x.t").alias("cell"), "sid", "n", "own", F.expr("cast(floor((5 * n - 9 * (own + i)) / 4) as bigint)").alias("hi"), "score", F.lit(True).alias("home"))


def paired(region: DataFrame) -> DataFrame:
    """Rows of ``region`` that may have a partner in their cell, one of the two
    at home there; classes are sizes within a factor of 1.25, so partners are
    in the next ones at most."""
    rows = region.withColumn("c", F.floor(F.log("n") / F.log(F.lit(1.25))))
    sizes = rows.groupBy("cell", "c", "home").agg(F.min("n").alias("lo"), F.max("n").alias("up"), F.max("hi").alias("most"), F.count("*").alias("k"), F.min("sid").alias("one"))
    around = sizes.select("cell", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"), "lo", "up", "most", "k", "one", F.col("home").alias("there"))
    meets = rows.join(around, ["cell", "c"]).where("(home or there) and lo <= hi and most >= n and 5 * up >= 4 * n and (k > 1 or one <> sid)")
    return meets.groupBy("cell", "sid").agg(*[F.first(c).alias(c) for c in ("n", "own", "hi", "score", "home")])


def distinct_regions(region: DataFrame) -> DataFrame:
    """Of regions with the same sets and partner sizes one is enough."""
    same = region.groupBy("cell").agg(F.count("*").alias("c"), F.sum(F.xxhash64("sid", "hi").cast("decimal(38,0)")).alias("s"), F.expr("bit_xor(xxhash64(hi, sid))").alias("x"))
    one = same.where("c > 1").groupBy("c", "s", "x").agg(F.min("cell").alias("cell")).select("cell")
    return region.join(one, "cell", "left_semi")


def divided(rest: DataFrame, seen: DataFrame, tables: Tables | None = None) -> DataFrame:
    """``rest`` (rows of regions, written) in the cells of their pivots; written.

    ``seen``: cell, sid, pivot, dist for all pairs within 0.6 of each other.
    What several branches read is written first: as a plan it would be repeated
    in each, and the driver holds all of it.
    """
    tables = tables or Tables(rest.sparkSession)
    nearest = seen.groupBy("cell", "sid").agg(F.min(F.struct("dist", "pivot")).alias("p"))
    placed = rest.join(nearest, ["cell", "sid"], "left")
    placed = tables.keep(placed.withColumn("at", F.when(F.col("p.dist") <= 0.4 + SLACK, F.col("p.pivot"))))
    homes = placed.where("home")
    radius = homes.where("at is not null").groupBy("cell", F.col("at").alias("pivot")).agg(F.max("p.dist").alias("r"))
    inside = homes.select("cell", "at", "sid", "n", "own", "hi", "score", F.lit(True).alias("home"))
    copies = seen.join(radius, ["cell", "pivot"]).where(F.col("dist") <= F.col("r") + 0.2 + SLACK)
    copies = copies.join(placed, ["cell", "sid"]).where("not (home and at <=> pivot)").select("cell", F.col("pivot").alias("at"), "sid", "n", "own", "hi", "score", F.lit(False).alias("home"))
    # Sets at home elsewhere find those far from all pivots in their own cell; copies have none.
    far = placed.where("not home").select("cell", F.lit(None).cast("long").alias("at"), "sid", "n", "own", "hi", "score", F.lit(False).alias("home"))
    cells = tables.keep(inside.unionByName(copies).unionByName(far))
    size = rest.groupBy("cell").agg(F.count("*").alias("before"))
    apart = cells.groupBy("cell").agg(F.count("*").alias("after")).join(size, "cell").where(F.col("after") <= GROWTH * F.col("before")).select("cell")
    apart = tables.keep(apart)
    new = cells.join(apart, "cell", "left_semi").withColumn("cell", F.xxhash64("cell", "at")).select(*rest.columns)
    out = tables.keep(new.unionByName(rest.join(apart, "cell", "left_anti").select(*rest.columns)))
    tables.drop(placed, cells, apart)
    return out


def connected(sets: DataFrame, tables: Tables) -> DataFrame:
    """``node, root``: components of ``sets`` (sid, n, members) by links within
    0.2; sets without a link are left out."""
    first = tables.keep(regions(sets))
    region = tables.keep(paired(first))
    tables.drop(first)
    first = region
    region = tables.keep(distinct_regions(region))
    tables.drop(first)
    k, found = 1, []
    while region.head(1):
        size = F.floor(F.log("n") / F.log(F.lit(1.25)))
        slot = F.pmod(F.xxhash64(F.lit(k), "sid"), F.lit(k))
        pivots = region.where("home").groupBy("cell", size.alias("c"), slot.alias("slot")).agg(F.max(F.struct("score", "sid", "n")).alias("p"))
        pivots = tables.keep(pivots.select("cell", F.col("p.sid").alias("pivot"), F.col("p.n").alias("m")))
        # Pairs whose sizes differ more are further than 0.6 apart.
        met = region.join(pivots, "cell").where("sid <> pivot and 100 * least(n, m) >= 40 * greatest(n, m)")
        pairs = tables.keep(met.groupBy("sid", "pivot").agg(*[F.first(c).alias(c) for c in ("n", "m", "own")]))
        d = tables.keep(measured(pairs, sets).where(near(40)))
        found.append(d)
        seen = tables.keep(met.select("cell", "sid", "pivot").join(d.select("sid", "pivot", distance().alias("dist"), near(80).alias("linked")), ["sid", "pivot"]))
        gone = pivots.select("cell", F.col("pivot").alias("sid")).unionByName(seen.where("linked").select("cell", "sid")).distinct()
        rest = tables.keep(region.join(gone, ["cell", "sid"], "left_anti"))
        more = bool(rest.where("home").head(1))
        if more:
            left = tables.keep(seen.join(rest.select("cell", "sid"), ["cell", "sid"], "left_semi").select("cell", "sid", "pivot", "dist"))
            cells = divided(rest, left, tables)
            after = tables.keep(paired(cells))
            tables.drop(left, cells)
        tables.drop(region, pivots, pairs, seen, rest)
        if not more:
            break
        region, k = after, k * FAN
    if not found:
        return sets.select(F.col("sid").alias("node"), F.col("sid").alias("root")).limit(0)
    d = tables.keep(reduce(DataFrame.unionByName, found).where(near(60)).distinct())
    tables.drop(*found)
    direct = tables.keep(d.where(near(80)).select(F.col("sid").alias("a"), F.col("pivot").alias("b")))
    root = components(direct, tables)
    more = across(d, root, sets, tables)
    if more.head(1):
        # What is connected already is so by one edge a node.
        found = root.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        root = components(found.unionByName(more), tables)
    tables.drop(d, direct, more)
    return root


def across(d: DataFrame, root: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """Links between sets on the boundary of a pivot and sets that link to it,
    where these are not connected yet."""
    of, there = root.withColumnRenamed("node", "sid"), root.select(F.col("node").alias("pivot"), F.col("root").alias("there"))
    side = d.select("sid", "pivot", "n", "own", distance().alias("d"), near(80).alias("linked"))
    y = side.where("not linked").join(of, "sid", "left").join(there, "pivot", "left")
    # All that link to a pivot are connected with it; so is y, or it has to be compared with each.
    y = tables.keep(y.where("coalesce(root, sid) <> coalesce(there, pivot)").select("pivot", F.col("sid").alias("y"), F.col("n").alias("m"), F.col("own").alias("other"), F.col("d").alias("e")))
    x = side.where("linked").select("pivot", "sid", "n", "own", "d")
    window = F.expr(f"d >= e - 0.2 - {SLACK} and 9 * least(n - own, m - other) >= 4 * (n + m)")
    pairs = tables.keep(x.join(y, "pivot").where(window).select("sid", F.col("y").alias("pivot"), "n", "m").distinct())
    out = tables.keep(measured(pairs, sets).where(near(80)).select(F.col("sid").alias("a"), F.col("pivot").alias("b")))
    tables.drop(y, pairs)
    return out


def classified(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, mark, n_shingles, component_id``;
    ``mark``, a hash of the text, tells rows of one id apart."""
    tables = Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    base = tables.keep(docs.mapInArrow(set_keys, KEY_SCHEMA))
    real = base.where("n > 0")
    classes = tables.keep(real.groupBy(*KEY).agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count("*").alias("c")))
    # Sets that share half a key are not told apart in this step and stay.
    alone = outsiders(docs.select("text").mapInArrow(set_members(COUNTED), MEMBER_SCHEMA).select("half", "members"))
    shared = classes.groupBy("half").agg(F.count("*").alias("k"), F.max("n").alias("most")).join(alone, "half", "left")
    shared = tables.keep(shared.where("k > 1 or 5 * coalesce(alone, 0) <= most").select("half"))
    inside = tables.keep(classes.join(broadcast_up_to(shared, SMALL), "half", "left_semi").select(F.col("least").alias("doc_id")).distinct())
    again = docs.select("doc_id", "text").join(broadcast_up_to(inside, SMALL), docs["doc_id"].eqNullSafe(inside["doc_id"]), "left_semi").select("text")
    sets = again.mapInArrow(set_members(8), MEMBER_SCHEMA).where("size(members) > 0").groupBy(*KEY).agg(F.first("members").alias("members"))
    sets = tables.keep(sets.select(F.monotonically_increasing_id().alias("sid"), *KEY, F.size("members").cast("long").alias("n"), "members"))
    tables.drop(shared, inside)
    roots = connected(sets, tables).withColumnRenamed("node", "sid")
    grown = classes.join(sets.select("sid", *KEY).join(roots, "sid"), KEY).select(*KEY, "root", "least")
    least = grown.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grown.join(least, "root").select(*KEY, "component_id")
    named = tables.keep(classes.join(named, KEY, "left").select(*KEY, "c", F.coalesce("component_id", "least").alias("component_id")))
    tables.drop(sets)
    hot = max(HOT, classes.count() // CLASSES)
    large = F.broadcast(named.where(F.col("c") > hot).drop("c"))
    out = real.join(large, KEY).unionByName(real.join(large, KEY, "left_anti").join(named.where(F.col("c") <= hot).drop("c"), KEY))
    out = out.select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(base.where("n = 0").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``."""
    return classified(docs).drop("mark")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; of rows with
    the same id and text one stays. Rows without an id stay."""
    tables = Tables(docs.sparkSession)
    found = tables.keep(classified(docs).select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "component_id").where("_d is not null"))
    gone = tables.keep(found.where("_d > component_id").select("_d", "_m").distinct())
    # Whole rows travel as one column: theirs may have any names.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    same = (F.col("row.doc_id").cast("long") == F.col("_d")) & (F.xxhash64("row.text") == F.col("_m"))
    kept = rows.join(broadcast_up_to(gone, SMALL), same, "left_anti")
    again = tables.keep(found.groupBy("_d", "_m").agg(F.count("*").alias("_c")).where("_c > 1").select("_d", "_m"))
    if not again.head(1):
        return kept.select("row.*")
    again = broadcast_up_to(again, SMALL)
    once = kept.join(again, same).withColumn("_text", F.col("row.text")).dropDuplicates(["_d", "_text"]).select("row")
    return kept.join(again, same, "left_anti").unionByName(once).select("row.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: Every pair of sets that share a shingle, then what each can reach.
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
k as (select doc_id, len(sh)::bigint as n_shingles, sha256(list_sort(sh)::varchar) as same from s),
c as (select same, min(doc_id) as a from k where n_shingles > 0 group by 1),
m as (select c.a, len(s.sh) as n, unnest(s.sh) as sh from c join s on s.doc_id = c.a),
p as (select x.a, y.a as b, x.n, y.n as m, count(*) as common from m x join m y on x.sh = y.sh and x.a <> y.a
      where 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by 1, 2, 3, 4),
l as (select a, b from p where 100 * common >= 80 * (n + m - common)),
t as (select a, a as b from c union select t.a, l.b from t join l on t.b = l.a),
z as (select a, min(b) as component_id from t group by 1)
select k.doc_id, k.n_shingles, coalesce(z.component_id, k.doc_id) as component_id
from k left join c on c.same = k.same and k.n_shingles > 0 left join z on z.a = c.a
"""
