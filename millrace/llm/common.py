"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text: runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local folder is set if driver and tasks are
    one process; on a cluster that is an error, as no folder is known to be shared.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named is None:
        wanted = sc.getConf().get("spark.checkpoint.dir")
        if not wanted and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="millrace-"))
        named = sc.getCheckpointDir()
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Delete what was written under ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Tables of one run in the shared folder, removed as soon as they have served."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4()}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and go on from what was written."""
        path, self.n = f"{self.folder}/{self.n}", self.n + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._millrace_path = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Remove tables that nothing will read any more, and let Spark's
        cleaner remove the shuffle files of the plans that made them."""
        for df in kept:
            remove(self.spark, df._millrace_path)
        gc.collect()
        self.spark._jvm.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: later reads
    neither recompute it nor depend on an executor that may be lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if ``df`` (already written, so cheap to count) has at
    most ``rows`` rows; otherwise leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the values of ``cols`` alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]
