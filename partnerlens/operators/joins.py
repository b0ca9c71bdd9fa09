"""Joins that do not depend on how often a key occurs, and rows dealt for fine groups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

GROUP_ROWS = 1 << 19    # rows of a task that holds nearly all of them as groups of their own


def heavy_join(big: DataFrame, small: DataFrame, key: str, count: str, total, heavy: int = 1000) -> DataFrame:
    """``big`` inner-joined with ``small`` (one row per key).  ``count`` in
    ``small`` says how often a key occurs and ``total`` is the sum of these
    counts: keys with more than ``total / heavy`` occurrences, of which there
    can be at most ``heavy``, are broadcast, the others shuffled."""
    often = F.col(count) * heavy > total
    hot = small.filter(often).drop(count)
    cold = small.filter(~often).drop(count)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti")
    return big.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def dealt_by_group(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` (about ``rows``) dealt by ``keys``, for a grouping by them that
    merges few rows: about ``GROUP_ROWS`` a task, however many there are.
    Grouped where they were joined, nearly all rows would be held beside the
    join's own, in as few tasks as the session has; a named number of partitions
    is kept.
    Rows of a group that occurs often meet in one task, which holds one sum for
    them.  Few rows stay where they are."""
    n = math.ceil(rows / GROUP_ROWS)
    return df if n <= 8 else df.repartition(n, *keys)
