"""Session helpers.

Library code never creates its own session: every job takes the caller's
``SparkSession``.  The helpers here exist for tests, the bench and ad-hoc use.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Configuration a cluster job wants as well: AQE re-plans joins and coalesces
# partitions from runtime statistics and splits skewed shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files are removed once nothing references them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "partnerlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that folder is set by the platform (a shared filesystem);
    we only pick a folder of our own when the session has none, which is
    the local/test case.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint folder
        return current or ""
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="partnerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint).  The parent is persisted
    (memory, spilling to disk) while the checkpoint is written, otherwise the
    write would recompute it a second time; it is released afterwards."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return kept.checkpoint(eager=True)
    finally:
        kept.unpersist()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder: like
    ``cut_lineage`` for many narrow rows, which take a fraction of the room."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``stored``, dealt by ``keys`` into ``parts`` buckets: joins, groupings and
    windows by them find the rows in place.  Written where they are made, in
    compressed columns, rows take a fraction of what a shuffle of them writes."""
    spark, name = df.sparkSession, f"partnerlens_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    (df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, *keys).saveAsTable(name))
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")         # the name only; the files are read through the plan
    return out


def tasks_at_once(spark: SparkSession) -> int:
    """Tasks the cluster runs side by side, whatever the size of the input."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Spark Connect: the server does not tell
        return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cores(default: int = 8) -> int:
    try:
        return int(os.environ.get("BENCH_CPUS", default))
    except ValueError:
        return default
