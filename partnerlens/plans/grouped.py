"""Models of a user's own per group: the surface that the reference offers by
its loop over product-region groups, as one grouped job.

``fit_groups`` hands every group to a Python function as a pandas frame.  No
group is lost and none ends the job: a group on which the function fails, or
whose result does not fit the schema, comes back as one row with the reason in
``error``; so does a group of more than ``max_rows`` rows, which is never sent
to a task (its size is counted first, by partial and final aggregation)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

MAX_ROWS = 1_000_000


def fit_groups(df: DataFrame, keys: list[str], fn: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str,
               order: list[str] | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """``keys``, the columns of ``schema`` and ``error`` (null if all went well).

    ``fn(key, rows)`` returns the group's result rows without keys, of any
    number; none at all is reported as an error.  ``rows`` come sorted by
    ``order``.  Null keys are groups.  The groups above ``max_rows``, of which
    there are at most count / max_rows, are the only rows broadcast."""
    result = T.StructType.fromDDL(schema)
    clash = {c.lower() for c in result.names} & {*(k.lower() for k in keys), "error"}
    if clash:
        raise ValueError(f"result columns are called like keys or error: {sorted(clash)}")
    key_fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    whole = T.StructType([*key_fields, *[T.StructField(f.name, f.dataType) for f in result], T.StructField("error", T.StringType())])
    names, n_keys = result.names, len(keys)

    def one(key, table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        target = to_arrow_schema(whole)

        def rows(columns: list, n: int, error: str | None):
            head = [pa.array([k.as_py()] * n, target.field(i).type) for i, k in enumerate(key)]
            return pa.Table.from_arrays([*head, *columns, pa.array([error] * n, pa.string())], schema=target)
        try:
            frame = table.to_pandas()
            if order:
                frame = frame.sort_values(order, kind="stable", ignore_index=True)
            got = fn(tuple(k.as_py() for k in key), frame)
            if len(got) == 0:
                raise ValueError("the function returned no rows")
            return rows([pa.Array.from_pandas(got[c], type=target.field(n_keys + i).type) for i, c in enumerate(names)], len(got), None)
        except Exception as e:  # reported as the group's row
            empty = [pa.nulls(1, target.field(n_keys + i).type) for i in range(len(names))]
            return rows(empty, 1, f"{type(e).__name__}: {e}")

    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > max_rows)
    large = large.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__rows")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    fitted = df.join(F.broadcast(large), same, "left_anti").groupBy(*keys).applyInArrow(one, whole)
    refused = large.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)],
                           *[F.lit(None).cast(f.dataType).alias(f.name) for f in result],
                           F.format_string("group of %d rows, at most %d are fitted", "__rows", F.lit(max_rows)).alias("error"))
    return fitted.unionByName(refused)
