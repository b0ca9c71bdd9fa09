"""Deterministic splits and exact ranks that survive skewed groups.

Splits hash a row key with md5 (``fn_hash_pct``) so that the DuckDB oracle
can repeat them; ``randomSplit`` would not be repeatable there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partnerlens.functions.scalar import fn_hash_key, fn_hash_pct
from partnerlens.session import cut_lineage, stored, stored_by

TEST_PCT = 20      # fixed value: 80/20 splits
SEED = 42          # fixed value: split seed
HEAVY_ROWS = 1 << 20   # rows of a stratum beyond which its ranks are taken in salted parts


def split_random(df: DataFrame, key: str, test_pct: int = TEST_PCT,
                 seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Row-wise 80/20 split on a hash of ``key`` (20 % on average)."""
    h = fn_hash_pct(key, seed)
    return df.filter(h >= test_pct), df.filter(h < test_pct)


def rank_within(df: DataFrame, part_cols: list[str], order_key: Column | str,
                tiebreak: str, out: str = "rn", salt_bits: int = 8,
                bucket: Column | None = None) -> DataFrame:
    """Exact 1-based rank of each row inside ``part_cols`` by
    (``order_key``, ``tiebreak``), without putting a whole group in one task.

    ``order_key`` must be a non-negative 32-bit integer (e.g. ``fn_hash_key``)
    unless ``bucket`` -- any expression non-decreasing in the key -- is given.
    Rows are split into 2**salt_bits sub-groups by the key's top bits, whose
    order agrees with the key order.  Sub-group sizes are counted (partial
    aggregation), their prefix sums taken over the small count table, and the
    final rank is offset + row_number inside the sub-group.  A group holding a
    third of all rows is spread over 2**salt_bits tasks.
    """
    k = F.col(order_key) if isinstance(order_key, str) else order_key
    d = df.withColumn("_ok", k)
    d = d.withColumn("_sb", bucket if bucket is not None else F.shiftright(F.col("_ok"), 32 - salt_bits))
    counts = d.groupBy(*part_cols, "_sb").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*part_cols).orderBy("_sb")       # <= 2**salt_bits rows per group
    offsets = counts.select(*part_cols, "_sb",
                            F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                       F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy(*part_cols)).alias("_n"))
    inner = Window.partitionBy(*part_cols, "_sb").orderBy("_ok", tiebreak)
    mine = [F.col(f"_o{i}") for i in range(len(part_cols) + 1)]
    offsets = offsets.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*part_cols, "_sb"])], "_off", "_n")
    same = [F.col(c).eqNullSafe(o) for c, o in zip([*part_cols, "_sb"], mine)]      # a null group is a group
    return (d.join(offsets, same).drop(*[f"_o{i}" for i in range(len(mine))])
            .withColumn(out, F.col("_off") + F.row_number().over(inner))
            .withColumnRenamed("_n", f"{out}_n")
            .drop("_ok", "_sb", "_off"))


def rank_within_once(df: DataFrame, part_cols: list[str], order_key: Column, tiebreak: str, keep: list[str],
                     out: str = "rn", salt_bits: int = 8, parts: int = 0) -> DataFrame:
    """The ranks of ``rank_within`` for rows that are dear to make: (part_cols,
    keep, out).  ``df`` is made and shuffled once; its rows are numbered inside
    their sub-groups, and only the numbers and ``keep`` are stored, read again to
    count the sub-groups and moved up by what lies before.  With ``parts`` the
    rows are dealt as a table of that many buckets instead of shuffled."""
    d = df.withColumn("_ok", order_key).withColumn("_sb", F.shiftright(F.col("_ok"), 32 - salt_bits).cast("int"))
    if parts:
        d = stored_by(d.select(*dict.fromkeys([*part_cols, "_sb", "_ok", tiebreak, *keep])), parts, *part_cols, "_sb")
    inner = Window.partitionBy(*part_cols, "_sb").orderBy("_ok", tiebreak)
    numbered = stored(d.withColumn("_at", F.row_number().over(inner)).select(*part_cols, "_sb", "_at", *keep))
    before = Window.partitionBy(*part_cols).orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.groupBy(*part_cols, "_sb").agg(F.count(F.lit(1)).alias("_cnt"))
               .select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*part_cols, "_sb"])],
                       F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off")))
    same = [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate([*part_cols, "_sb"])]       # a null group is a group
    return numbered.join(offsets, same).select(*part_cols, *keep, (F.col("_off") + F.col("_at")).alias(out))


def split_stratified(df: DataFrame, key: str, strata: str, test_pct: int = TEST_PCT,
                     seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """80/20 inside every stratum: rows ranked by a hash of ``key``; the
    first ceil(0.8 n) are train.  A stratum of one row stays in train."""
    r = flag_stratified(df, key, strata, test_pct, seed, "_train")
    return r.filter("_train").drop("_train"), r.filter("not _train").drop("_train")


def flag_stratified(df: DataFrame, key: str, strata: str, test_pct: int = TEST_PCT,
                    seed: int = SEED, out: str = "is_train") -> DataFrame:
    """``split_stratified`` as one table with a boolean ``is_train`` column.

    Strata are counted first, on the narrow stratum column.  Those of up to
    ``HEAVY_ROWS`` rows are ranked and counted by one window, so that the whole
    rows are made and shuffled once; only the others (at most rows /
    HEAVY_ROWS) take the salted ranks of ``rank_within``, which need a count of
    their parts as well."""
    heavy = [r[0] for r in df.groupBy(strata).agg(F.count(F.lit(1)).alias("_cnt"))
             .filter(F.col("_cnt") > HEAVY_ROWS).select(strata).collect()]      # bounded as said
    is_heavy = F.lit(False)
    for v in heavy:         # null is a stratum, too
        is_heavy = is_heavy | F.col(strata).eqNullSafe(F.lit(v))
    whole = Window.partitionBy(strata)
    ranked = (df.filter(~is_heavy).withColumn("_ok", fn_hash_key(key, seed))
              .withColumn("_rk", F.row_number().over(whole.orderBy("_ok", key)).cast("long"))
              .withColumn("_rk_n", F.count(F.lit(1)).over(whole)).drop("_ok"))
    if heavy:
        salted = rank_within(df.filter(is_heavy), [strata], fn_hash_key(key, seed), key, "_rk")
        ranked = ranked.unionByName(salted.select(*ranked.columns))
    return (ranked.withColumn(out, F.col("_rk") <= F.ceil(F.col("_rk_n") * (100 - test_pct) / 100))
            .drop("_rk", "_rk_n"))


def global_row_number(df: DataFrame, order_key: Column | str, tiebreak: str, out: str = "rn") -> DataFrame:
    """Exact global 1-based row number by (order_key, tiebreak) without a
    single-partition window: rows are dealt into key ranges with sampled
    bounds (so neither sparse nor crowded keys make one large), the ranges are
    written once and counted, and rows are numbered inside their range."""
    k = F.col(order_key) if isinstance(order_key, str) else order_key
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.withColumn("_ok", k).repartitionByRange(parts, "_ok", tiebreak)
                        .withColumn("_sb", F.spark_partition_id()))
    sizes = dealt.groupBy("_sb").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)      # one row per range
    offsets = sizes.select("_sb", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("_sb").orderBy("_ok", tiebreak)
    return (dealt.join(offsets, "_sb").withColumn(out, F.col("_off") + F.row_number().over(inner))
            .drop("_ok", "_sb", "_off"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows chosen by a seeded hash order (repeatable); bounded top-n."""
    return df.withColumn("_h", fn_hash_key(key, seed)).orderBy("_h", key).limit(n).drop("_h")
