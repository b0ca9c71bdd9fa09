"""Op 10: rendezvous hashing of record keys over weighted shards.

Every (record key, shard) pair gets a hash score; a record goes to the shard
with the highest score, weighted as ``-weight / ln(u)`` with u uniform in
(0, 1).  The choice needs the key and the shard list only, and one more shard
takes rows only into itself.  DataFrame expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from partnerlens.llm.common import gapless_index, scratch


def score(key: Column, shard: int, weight: float) -> Column:
    """Score of one record on one shard: XXH64 of (key, shard), mapped to
    u = (53 high bits + 1/2) / 2**53, weighted."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(-float(weight)) / F.log(u)


def best(key: Column, weights: dict[int, float]) -> Column:
    """struct(score, -shard) of the winning shard; ties go to the smaller shard."""
    return F.array_max(F.array(*[F.struct(score(key, s, w).alias("s"), F.lit(-s).alias("n"))
                                 for s, w in sorted(weights.items()) if w > 0]))


def assign_shards(docs: DataFrame, weights: dict[int, float], grown: tuple[int, float] | None = None,
                  key: str = "doc_id", shard: str = "shard", grown_shard: str = "grown_shard") -> DataFrame:
    """Adds the shard of every row (and with ``grown`` = (number, weight) of a
    further shard, the shard it would have then).  A null key is a key of its
    own; rows with equal keys share a shard.  Shards of weight zero or less
    take nothing."""
    if not any(w > 0 for w in weights.values()):
        raise ValueError("no shard has a positive weight")
    won = best(F.col(key), weights)
    out = docs.withColumn("__won", won).withColumn(shard, -F.col("__won.n"))
    if grown is not None:
        new = score(F.col(key), grown[0], grown[1])
        out = out.withColumn(grown_shard, F.when(new > F.col("__won.s"), F.lit(grown[0])).otherwise(F.col(shard)))
    return out.drop("__won")


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Rows of ``documents`` over ``shards`` equal shards under the law `key`:
    doc_id, size (UTF-8 bytes of the text, null as none, plus 16), text_crc32,
    law, shard, slot (0, 1, ... inside the shard, by hash of the id) and
    grown_shard (with one more shard).  An empty table gives no rows; rows
    that repeat an id share its shard and get slots of their own."""
    rows = docs.select(F.col("doc_id"),
                       (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
                       F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    put = assign_shards(rows, {s: 1.0 for s in range(shards)}, (shards, 1.0))
    put = scratch(put.withColumn("law", F.lit("key")), "shards")
    return (gapless_index(put, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
            .select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int").alias("shard"),
                    F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard")))
