"""Helpers shared by the operators: scratch tables in the cluster's shared
folder, block counts, exact gapless numbering and a skew-proof lookup join."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  A folder of our own is
    chosen only where the session names none and driver and executors share a
    machine (tests); on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the
    lineage and survives the loss of any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` of text the table makes (never
    fewer than the shuffle partitions, so that blocks spread over the cluster)."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("b")).first()["b"] or 0
    return max(math.ceil(total / block_bytes), shuffle_parts(docs.sparkSession))


def block_of(n: int, key, text):
    """Block number of a row: a hash of its key and text, so that neither null
    nor repeated keys nor any other attribute of the rows make a block large;
    only rows equal in both share one."""
    return F.pmod(F.xxhash64(key, text), F.lit(n)).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def gapless_index(df: DataFrame, groups: list[str], order: list[str], name: str,
                  rows_per_bucket: int = 8192) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each group (null is a group), in the
    order of a hash of ``order``.  Groups are cut into ranges of that hash,
    the ranges counted, and rows numbered inside a range; no task ever holds a
    whole group.  ``df`` is read twice: pass a scratch table or a cheap plan."""
    n = df.count()
    buckets = max(math.ceil(n / rows_per_bucket), shuffle_parts(df.sparkSession))
    h, b, bb, base = (free_name(df, x) for x in ("__h", "__b", "__bb", "__base"))
    gs = [free_name(df, f"__g{i}") for i in range(len(groups))]
    keyed = df.withColumn(h, F.xxhash64(*[F.col(c) for c in order])).withColumn(
        b, F.shiftright(F.shiftrightunsigned(F.col(h), 32) * F.lit(buckets), 32))
    sizes = keyed.groupBy(*groups, b).agg(F.count(F.lit(1)).alias(base))
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*[F.col(g).alias(x) for g, x in zip(groups, gs)], F.col(b).alias(bb),
                         F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    on = F.col(b) == F.col(bb)
    for g, x in zip(groups, gs):
        on = on & F.col(g).eqNullSafe(F.col(x))
    inside = Window.partitionBy(*groups, b).orderBy(h, *order)
    return (keyed.join(bases, on)
            .withColumn(name, F.col(base) + F.row_number().over(inside) - 1)
            .select(*df.columns, name))


def lookup(big: DataFrame, small: DataFrame, key: str, count: str, total: int, heavy: int = 1000) -> DataFrame:
    """``big`` left-joined with ``small`` (one row per key, ``count`` = rows of
    ``big`` with that key).  Keys with more than ``total / heavy`` rows, of
    which there can be at most ``heavy``, are broadcast; of the others no key
    holds enough rows to burden a shuffle task."""
    cut = max(1, total // heavy)
    vals = [c for c in small.columns if c not in (key, count)]
    hot = small.filter(F.col(count) > cut).select(F.col(key).alias("__k"), *vals)
    cold = small.filter(F.col(count) <= cut).select(F.col(key).alias("__k"), *vals)
    first = big.join(F.broadcast(hot), F.col(key) == F.col("__k"), "left")
    done = first.filter(F.col("__k").isNotNull()).drop("__k")
    rest = first.filter(F.col("__k").isNull()).select(*big.columns)
    return done.unionByName(rest.join(cold, F.col(key) == F.col("__k"), "left").drop("__k"))
