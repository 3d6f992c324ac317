"""Reading and writing tables, fitted operators and versions of features."""

from __future__ import annotations

import json
import tempfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.temporal import stamp

FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json", "orc": "orc", "txt": "text"}


def _format(path: str) -> str:
    return FORMATS.get(path.rstrip("/*").rsplit(".", 1)[-1].lower(), "csv")


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table by its ending; csv has a header and, without a schema, its types
    are inferred. Local times become times of the session's zone."""
    kind = _format(path)
    reader = spark.read.format(kind).options(**options)
    if kind == "csv":
        reader = reader.option("header", True)
        reader = reader if schema else reader.option("inferSchema", True)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df.withColumns({f.name: stamp(f.name) for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.format(_format(path)).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. If
    the session names none, a local folder serves where they are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite", kind: str | None = None) -> dict:
    """Writes and says what was written, and how."""
    kind = kind or _format(path)
    w = df.write.mode(mode).format(kind)
    if kind == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
    return {"path": path, "format": kind, "partition_by": partition_by or []}


def fingerprint(df: DataFrame) -> str:
    """Content and schema of a table, whatever the order of its rows."""
    r = df.agg(F.count("*").alias("n"), F.expr("bit_xor(x)").alias("x"), F.sum(F.pmod("x", F.lit(1 << 31))).alias("s")).first() if df.columns else None
    return f"{r['n']}-{r['x']}-{r['s']}" if r else "0"


def table_hash(df: DataFrame) -> str:
    return f"{fingerprint(df.select(F.xxhash64(*df.columns).alias('x')))}-{abs(hash(df.schema.simpleString())) % 10**6}"


class Cache:
    """Persisted results by plan and parameters; least recently used go first."""

    def __init__(self, most: int = 100):
        self.most, self.held, self.hits, self.misses = most, {}, 0, 0

    def get(self, df: DataFrame, name: str, make) -> DataFrame:
        key = (df.semanticHash(), name)
        if key in self.held:
            self.hits += 1
            self.held[key] = self.held.pop(key)
            return self.held[key]
        self.misses += 1
        self.held[key] = make(df).persist()
        while len(self.held) > self.most:
            self.held.pop(next(iter(self.held))).unpersist()
        return self.held[key]

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()


class FeatureStore:
    """Feature tables as Parquet, appended by time of writing, and their
    definitions as JSON rows beside them; reads are as-of joins."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/*")

    def register(self, name: str, entity: str, columns: dict[str, str], description: str = "") -> None:
        row = json.dumps({"name": name, "entity": entity, "columns": columns, "description": description, "at": datetime.now(timezone.utc).isoformat()})
        self.spark.createDataFrame([(name, row)], "name string, definition string").coalesce(1).write.mode("append").parquet(f"{self.path}/_definitions")

    def definitions(self) -> dict[str, dict]:
        """The last definition of every name."""
        rows = self.spark.read.parquet(f"{self.path}/_definitions").groupBy("name").agg(F.max_by("definition", F.get_json_object("definition", "$.at")).alias("d")).collect()
        return {r["name"]: json.loads(r["d"]) for r in rows}

    def materialize(self, name: str, df: DataFrame, time: str | None = None) -> int:
        at = stamp(time) if time else F.current_timestamp()
        df.withColumns({"event_timestamp": at, "_written": F.current_timestamp()}).write.mode("append").parquet(f"{self.path}/{name}")
        return df.count()

    def history(self, name: str, entities: DataFrame, time: str) -> DataFrame:
        """Values as they were at each entity row's time."""
        from millrace.operators.relational import as_of

        d = self.definitions()[name]
        return as_of(entities, self.spark.read.parquet(f"{self.path}/{name}"), [d["entity"]], time, "event_timestamp", list(d["columns"]))

    def latest(self, name: str, entities: DataFrame | None = None) -> DataFrame:
        d = self.definitions()[name]
        cols = [c for c in d["columns"]]
        df = self.spark.read.parquet(f"{self.path}/{name}")
        out = df.groupBy(d["entity"]).agg(F.max_by(F.struct(*cols), F.struct("event_timestamp", "_written")).alias("v")).select(d["entity"], "v.*")
        return entities.select(d["entity"]).distinct().join(out, d["entity"], "left") if entities is not None else out


def latest_version(df: DataFrame, key: list[str], time: str) -> DataFrame:
    """The last row of every key."""
    w = Window.partitionBy(*key).orderBy(F.desc(time))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def save_operator(operator, path: str, spark: SparkSession) -> None:
    """Parameters and plain state as a JSON file, fitted tables as Parquet."""
    plain, tables = {}, {}
    for k, v in vars(operator).items():
        if isinstance(v, DataFrame):
            tables[k] = v
        elif isinstance(v, dict) and v and all(isinstance(x, DataFrame) for x in v.values()):
            tables |= {f"{k}|{n}": x for n, x in v.items()}
        else:
            plain[k] = v
    spark.createDataFrame([(type(operator).__module__, type(operator).__name__, json.dumps(plain, default=str))], "module string, name string, state string").coalesce(1).write.mode("overwrite").json(f"{path}/operator")
    for k, v in tables.items():
        v.write.mode("overwrite").parquet(f"{path}/{k.replace('|', '__')}")
    spark.createDataFrame([(k,) for k in tables] or [("",)], "k string").coalesce(1).write.mode("overwrite").json(f"{path}/tables")


def load_operator(path: str, spark: SparkSession):
    import importlib

    row = spark.read.json(f"{path}/operator").first()
    cls = getattr(importlib.import_module(row["module"]), row["name"])
    out = cls.__new__(cls)
    vars(out).update(json.loads(row["state"]))
    for r in spark.read.json(f"{path}/tables").collect():
        if r["k"]:
            name, _, part = r["k"].partition("|")
            df = spark.read.parquet(f"{path}/{r['k'].replace('|', '__')}")
            if part:
                vars(out).setdefault(name, {})
                vars(out)[name] = {**(vars(out)[name] or {}), part: df}
            else:
                setattr(out, name, df)
    return out


def export_names(spark: SparkSession, operator, path: str) -> None:
    """The names of the columns that a fitted operator adds, in order, as a table."""
    write(spark.createDataFrame(list(enumerate(operator.new_columns)), "position long, name string").coalesce(1), path)


def export_importance(spark: SparkSession, selector, path: str) -> None:
    """A fitted selector's scores and whether it keeps the column, best first, as a table."""
    rows = sorted(((c, float(v), c in selector.kept) for c, v in selector.scores.items()), key=lambda r: (-r[1], r[0]))
    write(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position long, name string, score double, kept boolean").coalesce(1), path)
