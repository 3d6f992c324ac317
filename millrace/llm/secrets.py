"""Secret scan: candidates in texts, and a random forest against false alarms.

A candidate is a run of 12 or more letters, digits and ``_ + / -`` with a digit
or eight capitals in it, or what is assigned to a secret's name: any quoted
value of 4 to 200 characters, whatever its signs, or one of 6 to 200 without quotes that
has a digit. The forest sees how long a candidate is, how its characters change
class, how much of it is words, the document's path, and the words and signs
around it. It is trained on labelled findings: a table of them, before all
else, and those that formats decide (known key forms and values named as
secrets are secrets; numbers, UUIDs, dates and digests without such a name, and
made-up values, are not). What decides a format's label, the secret's name and the
marks of made-up values, is no feature, so the forest has to find other reasons
and judges every candidate by them, also against the format.

The dictionary is the corpus's own: whole words of all texts, by the number of
documents that they are in. Everything is built-in functions and
MLlib; training takes at most ``LABELLED`` findings, in the order of a hash.

Edge cases: null and empty texts have no candidates; a null path is one of its
own; equal rows have equal findings, each its own rows; without findings of
both kinds every candidate keeps its label (not a secret without
one); an empty table gives an empty result; other columns are kept by
``redact`` only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_up_to, checkpoint, table

_RUN = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*(?:[0-9]|[A-Z]{8}))[A-Za-z0-9_+/\-]{12,}={0,2}"
_NAME = r"(?i:pass(?:word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private)"
#: Group 1 is the name before an assigned value, if there is one.
CANDIDATE = rf"(?:({_NAME}[A-Za-z_]{{0,16}}[\"']?\s{{0,3}}[:=]\s{{0,3}})(?:[\"'][^\s\"']{{4,200}}(?=[\"'])|(?=[^\s\"',;]*[0-9])[^\s\"',;]{{6,200}}))|{_RUN}"
#: Its value: what follows the name, without the quote.
_OPENING = r"^[\"']"
#: Findings of a training set at most, trees and their depth, score of a secret.
LABELLED, TREES, DEPTH, SECRET = 20_000, 20, 6, 0.5
#: Characters before and after a candidate that are looked at.
BEFORE, AFTER = 32, 16
#: A word is in the dictionary that is in so many documents, or one in so many; buckets for paths and for words around.
OFTEN, RARE, BUCKETS = 3, 20_000, 64
#: Letters' runs of candidates, at most, that are broadcast to the texts.
WANTED = 200_000
NAMES = r"(?i)(pass(word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private)"
#: Made-up values: within the candidate itself, and as a whole word right before it.
MADE_UP = r"(?i)example|sample|dummy|placeholder|x{6,}|(?<![A-Za-z0-9])(test|fake)(?![A-Za-z0-9])"
MADE_UP_BESIDE = r"(?i)(?<![\w@.+\-])(example|sample|dummy|placeholder|test|fake)[\s\"':=]{1,3}$"
#: Words that decide labels, hence no feature.
LABEL_WORDS = NAMES + "|example|sample|dummy|placeholder|test|fake|xxxxxx"
MASK = "[SECRET]"


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """One row per candidate: ``doc_id, text_hash, path, nth, start`` (characters
    of the text before it), ``candidate, before, context, after``; ``context``
    is what is before the candidate without the name it is assigned to."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(path).alias("path"), "text", F.xxhash64("text").alias("text_hash"))
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("found") > 0)
    rows = rows.withColumn("between", F.split("text", CANDIDATE, -1)).withColumn("name", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(1)))
    rows = rows.withColumn("found", F.zip_with("found", "name", parts))
    # Characters up to each candidate: sums over what lies between and what was found before.
    each = F.transform(
        "found",
        lambda c, i: F.struct(
            i.cast("long").alias("nth"),
            (F.char_length(F.get("between", i)) + F.when(i > 0, F.char_length(F.get("found", i - 1)["value"])).otherwise(0) + F.char_length(c["head"])).cast("long").alias("step"),
            c["value"].alias("candidate"),
            F.right(F.concat(F.get("between", i), c["head"]), F.lit(BEFORE)).alias("before"),
            F.right(F.get("between", i), F.lit(BEFORE)).alias("context"),
            F.left(F.get("between", i + 1), F.lit(AFTER)).alias("after"),
        ),
    )
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "text_hash", "path", "row", F.inline(each))
    so_far = Window.partitionBy("row").orderBy("nth")
    return rows.withColumn("start", F.sum("step").over(so_far)).drop("row", "step")


def parts(match: Column, name: Column) -> Column:
    """What a match holds before its value (name, sign and quote) and the value."""
    rest = F.substr(match, F.char_length(name) + 1)
    quote = F.when(name != "", F.regexp_extract(rest, _OPENING, 0)).otherwise(F.lit(""))
    return F.struct(F.concat(name, quote).alias("head"), F.substr(rest, F.char_length(quote) + 1).alias("value"))


def kinds(c: Column) -> Column:
    """Runs of characters of one class, as one letter each."""
    for pattern, letter in (("[0-9]+", "9"), ("[A-Z]+", "A"), ("[a-z]+", "a")):
        c = F.regexp_replace(c, pattern, letter)
    return c


def decided(c: Column, before: Column) -> tuple[Column, Column]:
    """Whether a candidate has a key's form or a secret's name, and whether it
    is made up: by its own words, or by the word beside it if it has neither."""
    named = F.regexp_like(before, F.lit(NAMES + r"[A-Za-z_]*[\"']?\s*[:=]\s*[\"']?$"))
    key = F.regexp_like(c, F.lit(r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^sk[-_](live|test)?[-_]?[A-Za-z0-9]{20,}$|^xox[abpr]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_\-]{35}$"))
    # The "test" of sk_test_ belongs to the form.
    own = F.regexp_like(F.regexp_replace(c, r"^sk[-_](live|test)[-_]", ""), F.lit(MADE_UP))
    return key | named, own | (F.regexp_like(before, F.lit(MADE_UP_BESIDE)) & ~(key | named))


def by_format(c: Column, before: Column) -> Column:
    """1 or 0 where the format decides, else null."""
    plain = F.regexp_like(c, F.lit(r"^[0-9+/_-]+=*$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$|^[A-Za-z]+[0-9]{1,4}$|^[0-9]{1,4}[A-Za-z]+$"))
    secret, made_up = decided(c, before)
    return F.when(made_up, 0).when(secret, 1).when(plain, 0)


def dictionary(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``run``: whole words that are in enough of all documents, of those in ``wanted``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z0-9])[a-z]{3,}(?![a-z0-9])"), F.lit(0)))
    least = max(OFTEN, docs.count() // RARE)
    each, few = docs.select(F.explode(words).alias("run")), wanted.limit(WANTED + 1).count() <= WANTED
    if few:  # else every word is counted, in parts, before it meets the others
        each = each.join(F.broadcast(wanted), "run", "left_semi")
    often = each.groupBy("run").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("run")
    return often if few else often.join(wanted, "run", "left_semi")


def features(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` with a vector ``x`` and a label from its format."""
    c = F.col("candidate")
    n = F.char_length(c).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / n

    rows = found.withColumn("id", F.monotonically_increasing_id())
    rows = rows.withColumn("runs", F.array_distinct(F.regexp_extract_all(F.lower("candidate"), F.lit(r"[a-z]{3,}"), F.lit(0))))
    rows = checkpoint(rows)
    runs = checkpoint(rows.select(F.explode("runs").alias("run")).distinct())
    often = checkpoint(dictionary(docs, runs))
    known = rows.select("id", F.explode("runs").alias("run")).join(broadcast_up_to(often, 200_000), "run")
    covered = known.groupBy("id").agg(F.sum(F.char_length("run")).cast("double").alias("covered"))
    rows = rows.join(covered, "id", "left").fillna(0.0, ["covered"])
    values = {
        "n": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "changes": F.char_length(kinds(c)) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        "repeats": share(r"(.)\1"),
        "hex": F.regexp_like(c, F.lit("^[0-9a-fA-F]+$")).cast("double"),
        "longest_letters": F.array_max(F.transform(F.split(c, "[^A-Za-z]"), lambda x: F.char_length(x))) / n,
        "words": F.least(F.col("covered") / n, F.lit(1.0)),
        "assigned": F.regexp_like("before", F.lit(r"[:=]\s*[\"']?$")).cast("double"),
        "quoted": F.regexp_like("before", F.lit(r"[\"']$")).cast("double"),
        "path_depth": F.size(F.split(F.coalesce("path", F.lit("")), "/")).cast("double"),
        "path_test": F.regexp_like(F.coalesce("path", F.lit("")), F.lit(r"(?i)(test|example|fixture|mock|doc|sample)")).cast("double"),
    }
    rows = rows.withColumns({f"f_{k}": F.coalesce(v, F.lit(0.0)) for k, v in values.items()})
    # Two words on each side; those that may have decided the label are passed over.
    around = [F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]{3,}"), F.lit(0)) for c in ("context", "after")]
    before, after = (F.filter(w, lambda x: ~F.regexp_like(x, F.lit(LABEL_WORDS))) for w in around)
    near = F.concat(F.slice(F.reverse(before), 1, 2), F.transform(F.slice(after, 1, 2), lambda x: F.concat(F.lit("> "), x)))
    rows = rows.withColumn("near", F.concat(F.array(F.lit("")), near))
    rows = rows.withColumn("folder", F.array(F.regexp_replace(F.coalesce("path", F.lit("")), r"[0-9]+", "0")))
    for column, out in (("near", "h_near"), ("folder", "h_folder")):
        rows = HashingTF(inputCol=column, outputCol=out, numFeatures=BUCKETS, binary=True).transform(rows)
    rows = VectorAssembler(inputCols=[*(f"f_{k}" for k in values), "h_near", "h_folder"], outputCol="x").transform(rows)
    return rows.withColumn("label", by_format(c, F.col("before")).cast("double")).select(*found.columns, "x", "label")


def train(found: DataFrame, most: int = LABELLED):
    """The forest of labelled findings (``x``, ``label``), or None if they are
    all of one kind; half of the sample at most is of one kind."""
    parts = []
    for kind in (0.0, 1.0):
        parts.append(found.where(F.col("label") == kind).select("x", "label", F.xxhash64("candidate", "before").alias("o")).orderBy("o").limit(most // 2))
    sample = checkpoint(reduce(DataFrame.unionByName, parts).select("x", "label"))
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11, cacheNodeIds=False).fit(sample)


def scan(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None, formats: bool = True, most: int = LABELLED) -> DataFrame:
    """All candidates with ``score`` and ``secret``.

    ``labelled``: findings (doc_id, nth, label) that go before formats' labels,
    or are the only ones, if ``formats`` is false.
    """
    found = features(candidates(docs, path), docs.select("text"))
    if labelled is not None:
        known = labelled.select("doc_id", "nth", F.col("label").cast("double").alias("_label"))
        found = found.join(known, ["doc_id", "nth"], "left").withColumn("label", F.coalesce("_label", "label") if formats else F.col("_label")).drop("_label")
    found = checkpoint(found)
    model = train(found, most)
    if model is None:
        score = F.coalesce("label", F.lit(0.0))
        out = found
    else:
        out, score = model.transform(found), vector_to_array("probability")[1]
    return out.withColumn("score", score).withColumn("secret", F.col("score") >= SECRET).select(*[c for c in found.columns if c not in ("x", "label")], "score", "secret")


def redact(docs: DataFrame, path: str = "source", **more) -> DataFrame:
    """``docs`` with every secret replaced by a mask (and ``n_chars`` counted
    again, if it is a column); no document is dropped."""
    bad = scan(docs, path, **more).where("secret").select("doc_id", "text_hash", "nth").distinct()
    bad = checkpoint(bad.groupBy("doc_id", "text_hash").agg(F.collect_list("nth").alias("_nths")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "_nths"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    rows = rows.join(broadcast_up_to(bad, 200_000), F.col("row.doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h")), "left")
    between, found = F.split("text", CANDIDATE, -1), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    found = F.zip_with(found, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(1)), parts)
    marked = F.transform(found, lambda c, i: F.concat(c["head"], F.when(F.array_contains("_nths", i.cast("long")), F.lit(MASK)).otherwise(c["value"])))
    whole = F.array_join(F.zip_with(between, marked, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    masked = F.when(F.col("_nths").isNull(), F.col("text")).otherwise(whole)
    new = {"text": masked}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_nths").isNull(), F.col("row.n_chars")).otherwise(F.char_length(masked)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "nth", "start", F.char_length("candidate").cast("long").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "secret")
