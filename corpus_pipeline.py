"""A training corpus from ``documents``: toxic documents go, of near duplicates
one stays, secrets are masked, sources are mixed to target weights, and what is
left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again before the next. All but the last return the columns of
``documents``. A table without rows passes through; what a stage does with
nulls, repeated rows and further columns is said in its operator's docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, mixing, pieces, secrets, toxicity
from millrace.llm.common import remove, shared_dir, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model rejects; texts that are null
    or empty are clean, labels without a document count for nothing."""
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document of least
    id; of repeated rows one. Rows without id or without words stay."""
    return jaccard_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted again."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, from never
    to three times; a null source is one of its own."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row with their byte spans; null texts have none."""
    out = pieces.encode(docs, pieces.default_model(), decoded=False)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends")


STAGES = [
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: No SQL: the forest, the ordinal model and the draws of the mix are not queries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Their tables are in the shared folder;
    each goes as soon as the next is written, the last one stays."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
