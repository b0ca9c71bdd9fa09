"""Readers and writers.  Paths may be local, ``hdfs://`` or ``s3a://``: they
are all the same ``spark.read`` / ``df.write`` call."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "run string, fmt string, tables array<struct<kind:string,path:string>>"
FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".orc": "orc"}


def read_table(spark: SparkSession, uri: str, schema=None, header: bool = True) -> DataFrame:
    """Choose the reader by extension; unknown extensions raise."""
    ext = os.path.splitext(uri.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported file type {ext!r} for {uri}")
    reader = spark.read.format(FORMATS[ext])
    if schema is not None:
        reader = reader.schema(schema)
    if FORMATS[ext] == "csv":
        reader = reader.option("header", header)
    return reader.load(uri)


def scan_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with header; pass a schema in production (inference scans the data)."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def sink(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite ``path`` with ``df`` (CSV gets a header)."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def sink_csv(df: DataFrame, path: str) -> None:
    sink(df, path, "csv")


def publish(outputs: dict[str, DataFrame], base: str, fmt: str = "parquet") -> dict[str, str]:
    """Writes several tables that appear together: each goes to a folder of
    this run below ``base``, and one row appended to the manifest, after all of
    them are complete, makes the run the current one.  If a write fails,
    readers keep the set of the last complete run.  Returns kind -> path."""
    spark = next(iter(outputs.values())).sparkSession
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    paths = {kind: f"{base}/runs/{run}/{kind}" for kind in outputs}
    for kind, df in outputs.items():
        sink(df, paths[kind], fmt)
    row = [(run, fmt, [(k, p) for k, p in paths.items()])]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{base}/manifest")
    return paths


def current(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables of the last complete run below ``base``."""
    last = spark.read.schema(MANIFEST).parquet(f"{base}/manifest").orderBy(F.desc("run")).limit(1).collect()   # one row per run
    if not last:
        raise ValueError(f"no complete run below {base}")
    return {t["kind"]: read_format(spark, t["path"], last[0]["fmt"]) for t in last[0]["tables"]}


def read_format(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.option("header", True).option("inferSchema", True) if fmt == "csv" else reader).load(path)


def sink_results4(metrics: DataFrame, forecasts: DataFrame, comparisons: DataFrame,
                  elasticity: DataFrame, base: str, fmt: str = "parquet") -> dict[str, str]:
    """The four named outputs of the forecast job, published as one set."""
    return publish({"metrics": metrics, "forecasts": forecasts, "comparisons": comparisons, "elasticity": elasticity}, base, fmt)


def sink_split(train: DataFrame, test: DataFrame, base: str, fmt: str = "parquet") -> tuple[str, str]:
    """Both parts of a split, published as one set."""
    out = publish({"train": train, "test": test}, base, fmt)
    return out["train"], out["test"]


def check_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail before any action when required columns are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
