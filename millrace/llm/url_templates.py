"""URL filter: lists of rules, and a tree of path templates where no rule fits.

For every host the segments of its paths form a tree. A segment with few pages,
or with a small part of its node's pages and too few labels to be told from the
others, is variable and becomes a wildcard (``*``, with its extension), so
/en/825.html and /en/97.html are one branch, /en/*.html. Segments are judged as
deep as enough pages of a host go: each depth is one count more. Labelled pages give every branch a share of bad ones. Sibling branches are
merged, from the lowest share up, as long as the next one differs significantly
neither from all of its group so far nor from the group's lowest, and a
branch's share is smoothed towards its parent's, the host's and the whole table's, by as much as
it has few labels. Pages of a branch with a smoothed share of at least
``REJECT`` are blocked.

Everything but the page's own row is a count by host and template, so a hot
host is summed up before it moves.

Edge cases: a null url or one without ``://`` has an empty host and path, fits
no rule and is judged like any host; what only fewer than ``SUPPORT`` pages of
a host are deep enough for is wildcards, in the tree one branch; rows with
equal ids are judged each; repeated labels of a page count once (bad if any is); an empty table gives an empty result and no
labels allow everything; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_up_to, checkpoint, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Least pages that keep a segment literal, if as many are labelled or it has
#: this share of its node's pages; weight of the parent's share in labels.
SUPPORT, SHARE, PRIOR = 5, 0.01, 8.0
#: Depths after which rows are written.
EVERY = 4
#: Sibling branches are alike below this many standard errors.
ALIKE = 1.96
REJECT = 0.5


def host_path(url: Column) -> tuple[Column, Column]:
    both = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, both, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, both, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its action; rules are a short list."""
    if len(rules) > 500:
        raise ValueError("more than 500 rules: join them as a table instead")
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones win
        at, _, rest = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def wild(x: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(x, r"(\.[A-Za-z]{1,5})?$", 0))


def templates(pages: DataFrame) -> DataFrame:
    """``pages`` (host, path, bad, ...) with ``t``, the list of template
    segments; ``bad`` is null where a page has no label."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = pages.withColumn("s", segments).withColumn("t", F.array().cast("array<string>"))
    # No segment can have enough pages deeper than the SUPPORT deepest pages of a host.
    deep = rows.groupBy("host", F.size("s").alias("d")).agg(F.count("*").alias("c"))
    deep = deep.withColumn("c", F.sum("c").over(Window.partitionBy("host").orderBy(F.desc("d"))))
    most = deep.where(F.col("c") >= SUPPORT).agg(F.max("d")).first()[0] or 0
    for d in range(most):
        rows = rows.withColumn("x", F.get("s", F.lit(d)))
        counts = rows.where("x is not null").groupBy("host", "t", "x").agg(F.count("*").alias("c"), F.count("bad").alias("m"))
        total = counts.groupBy("host", "t").agg(F.sum("c").alias("all"))
        keep = counts.where(F.col("c") >= SUPPORT).join(total, ["host", "t"]).where((F.col("m") >= SUPPORT) | (F.col("c") >= SHARE * F.col("all"))).select(F.col("host").alias("_h"), F.col("t").alias("_t"), F.col("x").alias("_x"))
        keep = broadcast_up_to(checkpoint(keep), 100_000)
        rows = rows.join(keep, (F.col("host") == F.col("_h")) & (F.col("t") == F.col("_t")) & (F.col("x") == F.col("_x")), "left")
        now = F.when(F.col("x").isNull(), F.col("t")).otherwise(F.concat("t", F.array(F.coalesce("_x", wild(F.col("x"))))))
        rows = rows.withColumn("t", now).drop("_h", "_t", "_x", "x")
        if (d + 1) % EVERY == 0 and d + 1 < most:
            rows = checkpoint(rows)
    rest = F.array_join(F.transform(F.slice("s", most + 1, F.greatest(F.size("s") - most, F.lit(0))), wild), "/")
    return rows.withColumn("t", F.when(F.size("s") > most, F.concat("t", F.array(rest))).otherwise(F.col("t"))).drop("s")


def differ(m, b, n, c) -> Column:
    """Whether ``b`` of ``m`` and ``c`` of ``n`` are different shares."""
    pooled = (b + c) / (m + n)
    return F.abs(b / m - c / n) > ALIKE * F.sqrt(pooled * (1 - pooled) * (1 / m + 1 / n))


def groups(nodes: DataFrame) -> DataFrame:
    """``host, parent, m, b, gm, gb``: labelled and bad pages of the group that
    siblings with ``b`` bad ones of ``m`` belong to. Siblings of equal counts
    are one entry of a parent's list, which is short however many there are."""
    row = F.struct((F.col("b") / F.col("m")).alias("rate"), "m", "b", "k")
    lists = nodes.where("m > 0").groupBy("host", "parent", "m", "b").agg(F.count("*").cast("double").alias("k"))
    lists = lists.groupBy("host", "parent").agg(F.sort_array(F.collect_list(row)).alias("l"))
    none = F.lit(0.0)

    def state(m, b, low_m, low_b, starts):
        return F.struct(m.alias("m"), b.alias("b"), low_m.alias("low_m"), low_b.alias("low_b"), starts.alias("starts"))

    def step(s, x):
        new = (s["m"] == 0) | differ(x["m"], x["b"], s["m"], s["b"]) | differ(x["m"], x["b"], s["low_m"], s["low_b"])
        m, b = x["k"] * x["m"], x["k"] * x["b"]
        start = F.array(F.struct(x["rate"].alias("rate"), x["m"].alias("m")))
        opened = state(m, b, x["m"], x["b"], F.concat(s["starts"], start))
        return F.when(new, opened).otherwise(state(s["m"] + m, s["b"] + b, s["low_m"], s["low_b"], s["starts"]))

    first = state(none, none, none, none, F.array().cast("array<struct<rate:double,m:double>>"))
    lists = lists.withColumn("starts", F.aggregate("l", first, step, lambda s: s["starts"]))
    each = lists.select("host", "parent", "starts", F.explode("l").alias("x"))
    each = each.select("host", "parent", "x.m", "x.b", "x.k", F.size(F.filter("starts", lambda s: s <= F.struct(F.col("x.rate").alias("rate"), F.col("x.m").alias("m")))).alias("g"))
    total = each.groupBy("host", "parent", "g").agg(F.sum(F.col("k") * F.col("m")).alias("gm"), F.sum(F.col("k") * F.col("b")).alias("gb"))
    return each.join(total, ["host", "parent", "g"]).select("host", "parent", "m", "b", "gm", "gb")


def purity(leaves: DataFrame) -> DataFrame:
    """``host, t, share``: the smoothed share of bad pages of every template.

    ``leaves``: host, t, m (labelled pages), b (bad ones among them).
    """
    leaves = checkpoint(leaves)
    whole = leaves.agg(F.sum("m").alias("m"), F.sum("b").alias("b"), F.max(F.size("t")).alias("d")).first()
    base = (whole.b or 0.0) / whole.m if whole.m else 0.0

    def smooth(m, b, parent):
        return (b + PRIOR * parent) / (m + PRIOR)

    level = leaves.groupBy("host").agg(F.sum("m").alias("m"), F.sum("b").alias("b"))
    level = level.select("host", F.array().cast("array<string>").alias("t"), smooth(F.col("m"), F.col("b"), F.lit(base)).alias("share"))
    levels = [level]
    for d in range(1, (whole.d or 0) + 1):
        nodes = leaves.where(F.size("t") >= d).groupBy("host", F.slice("t", 1, d).alias("t")).agg(F.sum("m").alias("m"), F.sum("b").alias("b"))
        nodes = nodes.withColumn("parent", F.slice("t", 1, d - 1) if d > 1 else F.array().cast("array<string>"))
        nodes = checkpoint(nodes)
        merged = broadcast_up_to(checkpoint(groups(nodes)), 100_000)
        # Branches without labels say nothing: they have their parent's share.
        nodes = nodes.join(merged, ["host", "parent", "m", "b"], "left").fillna(0.0, ["gm", "gb"])
        above = level.select("host", F.col("t").alias("parent"), F.col("share").alias("up"))
        level = checkpoint(nodes.join(above, ["host", "parent"]).select("host", "t", smooth(F.col("gm"), F.col("gb"), F.col("up")).alias("share")))
        levels.append(level)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, share`` of all pages.

    ``labels``: doc_id, quality, toxic. A page's document is the last number
    of its path; it is bad if its quality is 0 or it is toxic.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("doc", F.regexp_extract("path", r"([0-9]+)(?:\.[A-Za-z]+)?/?$", 1).try_cast("long"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")).where("bad is not null")
    judged = rows.where("doc is not null").join(known, "doc", "left")
    rows = checkpoint(judged.unionByName(rows.where("doc is null").withColumn("bad", F.lit(None).cast("int"))))
    rows = checkpoint(templates(rows))
    share = purity(rows.groupBy("host", "t").agg(F.count("bad").cast("double").alias("m"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("b")))
    share = share.select(F.col("host").alias("_h"), F.col("t").alias("_t"), "share")
    out = rows.join(broadcast_up_to(checkpoint(share), 100_000), (F.col("host") == F.col("_h")) & (F.col("t") == F.col("_t")), "left")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("share") >= REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("t", "/")).alias("template"), "share")


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
