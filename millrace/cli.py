"""Command line: analyze, generate, select, contract, validate, run.

    python -m millrace.cli analyze data.parquet
    python -m millrace.cli generate data.csv --target y -o out.parquet
    python -m millrace.cli select data.parquet --target y --k 10 -o out.parquet
    python -m millrace.cli contract data.parquet -o contract.json
    python -m millrace.cli validate data.parquet --contract contract.json
    python -m millrace.cli run data.parquet --spec features.yaml -o out.parquet
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from millrace.operators import profiling, selection
from millrace.plans import dsl
from millrace.plans.auto import AutoFeatures
from millrace.sources import io


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("command", choices=["analyze", "generate", "select", "contract", "validate", "run"])
    p.add_argument("data")
    p.add_argument("-o", "--out")
    p.add_argument("--target")
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--method", default="f_regression")
    p.add_argument("--contract")
    p.add_argument("--spec")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = io.read(spark, a.data)
    if a.command == "analyze":
        issues = profiling.quality(df, a.target)
        print(json.dumps({"types": profiling.infer_types(df), "issues": issues, "score": profiling.quality_score(issues), "suggestions": profiling.suggest(df)}, indent=1, default=str))
        return 0
    if a.command == "validate":
        found = profiling.check_contract(df, profiling.Contract.from_json(Path(a.contract).read_text()))
        print(json.dumps(found, indent=1, default=str))
        return int(bool(found))
    if not a.out:
        p.error(f"{a.command} needs --out")
    if a.command == "contract":
        Path(a.out).write_text(profiling.make_contract(df, a.data).to_json())
    elif a.command == "generate":
        io.write(AutoFeatures(a.target).fit_transform(df), a.out)
    elif a.command == "select":
        io.write(selection.Statistical(None, a.method, k=a.k).fit(df, a.target).transform(df), a.out)
    else:
        io.write(dsl.apply(df, dsl.parse(Path(a.spec).read_text())), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
