"""Ranking, top-n and slot pivots over bounded candidate sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def topn_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n: int,
                   out: str = "rank", salt_buckets: int | None = None,
                   salt_key: str | None = None) -> DataFrame:
    """Rows ranked 1..n inside each group by ``order`` (a full ordering).

    With ``salt_buckets`` the ranking runs twice: first inside
    (group, hash(salt_key) mod buckets), keeping n rows per sub-group, then
    inside the group over at most n x buckets survivors -- exact, and no task
    holds more than a sub-group of a hot key.
    """
    if salt_buckets:
        salt = F.pmod(F.xxhash64(F.col(salt_key)), F.lit(salt_buckets))
        w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
              .filter(F.col("_r1") <= n).drop("_salt", "_r1"))
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def slots(ranked: DataFrame, group_cols: list[str], value_col: str, n: int = 3,
          prefix: str = "Scheme_", rank_col: str = "rank", pad: str | None = None) -> DataFrame:
    """Ranked values -> columns prefix1..prefixn, missing slots -> ``pad``."""
    aggs = [F.max(F.when(F.col(rank_col) == i, F.col(value_col))).alias(f"{prefix}{i}")
            for i in range(1, n + 1)]
    out = ranked.groupBy(*group_cols).agg(*aggs)
    if pad is not None:
        out = out.withColumns({f"{prefix}{i}": F.coalesce(F.col(f"{prefix}{i}"), F.lit(pad))
                               for i in range(1, n + 1)})
    return out


def ranked_arrays(ranked: DataFrame, group_cols: list[str], cols: dict[str, str],
                  rank_col: str = "rank") -> DataFrame:
    """Collect a bounded ranked set per group into arrays ordered by rank:
    ``cols`` maps output array name -> source column."""
    s = F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"),
                                             *[F.col(c).alias(f"v{i}") for i, c in enumerate(cols.values())])))
    g = ranked.groupBy(*group_cols).agg(s.alias("_s"))
    def field(i):
        return lambda x: x[f"v{i}"]
    return g.select(*group_cols, *[F.transform("_s", field(i)).alias(name) for i, name in enumerate(cols)])
