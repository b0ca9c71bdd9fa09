"""Projection, filter and cleaning operators (DataFrame -> DataFrame)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from partnerlens.functions.scalar import nan_to_null

SALES_COLUMNS = ["Partner_id", "Product_id", "Date", "Price", "Demand",
                 "Discount", "Geography", "Competitor_Price"]

# Renames applied by the reference before modelling.
SALES_RENAMES = {"MRP": "Price", "Sales_Quantity_Last_Period": "Demand",
                 "Discount_Applied": "Discount", "Partner_ID": "Partner_id"}


def coerce_date_dropna(df: DataFrame, col: str = "Date") -> DataFrame:
    """Parse ``col`` to a timestamp (unparsable -> NULL) and drop NULL dates."""
    dtype = df.schema[col].dataType
    if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        df = df.withColumn(col, F.try_to_timestamp(F.col(col).cast("string")))
    return df.filter(F.col(col).isNotNull())


def onehot_decode(df: DataFrame, flags: list[str], out: str = "Product_id",
                  all_zero: str = "null") -> DataFrame:
    """Name of the first flag column holding the row maximum.

    ``all_zero='first'`` reproduces ``idxmax`` on an all-zero row (first
    column); the default gives NULL so that such rows drop out later.
    """
    if not flags:
        raise ValueError("no product flag columns")
    g = F.greatest(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in flags]) \
        if len(flags) > 1 else F.coalesce(F.col(flags[0]).cast("double"), F.lit(0.0))
    pick = F.coalesce(*[F.when(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) == g, F.lit(f))
                        for f in flags])
    if all_zero != "first":
        pick = F.when(g > 0, pick)
    return df.withColumn(out, pick)


def project_dropany(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).na.drop("any")


def rename_cols(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    mapping = mapping or SALES_RENAMES
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def filter_positive(df: DataFrame, cols: tuple[str, ...] = ("Price", "Demand")) -> DataFrame:
    cond = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in cols])
    return df.filter(cond)


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def existing_cols(df: DataFrame, candidates: list[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in candidates if c in have]


def infer_meta_cols(df: DataFrame, threshold: int = 10, approx: bool = False) -> list[str]:
    """Columns with more than ``threshold`` distinct values (one pass)."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    row = df.agg(*[fn(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] > threshold]


CATALOG_MOST = 10_000   # one-hot columns are plan nodes; beyond this a table belongs in long form


def catalog_of(df: DataFrame, col: str, most: int = CATALOG_MOST) -> list:
    """The distinct non-null values of ``col``, sorted.  At most ``most`` + 1 of
    them reach the driver; more than ``most`` is an error, not a cut list."""
    found = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values: keep the table in long form")
    return sorted(found)


def onehot_encode(df: DataFrame, cols: list[str], values: dict[str, list] | None = None,
                  drop: bool = True) -> DataFrame:
    """0/1 column ``<col>_<value>`` per value.  Values are the (small)
    distinct lists of the encoded columns; pass them to avoid the probe."""
    values = dict(values or {})
    for c in cols:
        if c not in values:
            values[c] = catalog_of(df, c)
    new = [F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for c in cols for v in values[c]]
    if not new:
        raise ValueError("one-hot encoding produced no columns")
    keep = [x for x in df.columns if not (drop and x in cols)]
    return df.select(*keep, *new)


def replace_zero(df: DataFrame, col: str = "Sales_Value_Last_Period", value: float = 1.0) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) == 0, F.lit(value)).otherwise(F.col(col)))


def coerce_int0(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(0)) for c in cols})


def binarize(df: DataFrame, cols: list[str], as_bool: bool = False) -> DataFrame:
    if as_bool:
        return df.withColumns({c: F.col(c) > 0 for c in cols})
    return df.withColumns({c: (F.col(c) > 0).cast("int") for c in cols})


def filter_has_product(long_df: DataFrame, product: str | None = None,
                       flag: str = "Has_Product") -> DataFrame:
    """Rows of partners holding a product, all products in one pass."""
    out = long_df.filter(F.col(flag) == 1) if flag in long_df.columns else long_df
    return out.filter(F.col("Product_id") == product) if product is not None else out


def purchased_list(df: DataFrame, flags: list[str]) -> DataFrame:
    arr = F.filter(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in flags]), lambda x: x.isNotNull())
    return df.withColumn("Purchased", arr).withColumn("has_purchase", F.size("Purchased") > 0)


def drop_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def toggle_purchased(candidates: DataFrame, owned: DataFrame, include_purchased: bool,
                     keys: tuple[str, str] = ("Partner_id", "Product_id")) -> DataFrame:
    """Keep or remove candidates the partner already holds (left-anti join)."""
    if include_purchased:
        return candidates
    return candidates.join(owned.select(*keys).distinct(), list(keys), "left_anti")


def profile_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column min, max and NULL count, one aggregate pass, long output."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"),
                 F.count_if(F.col(c).isNull()).cast("bigint").alias(f"{c}__nulls")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__min`, `{c}__max`, `{c}__nulls`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column, min_value, max_value, null_count)")


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def key_lookup(df: DataFrame, conds: dict[str, object]) -> DataFrame:
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in conds.items()])
    return df.filter(cond)


def ensure_found(df: DataFrame, what: str) -> DataFrame:
    """Raise when a lookup is empty (the reference's not-found path)."""
    if df.isEmpty():
        raise LookupError(f"{what}: not found")
    return df


def nan_to_null_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: nan_to_null(c) for c in cols})


def clean_sales(df: DataFrame, product_flags: list[str] | None = None,
                all_zero: str = "null") -> DataFrame:
    """The reference's initial cleaning as one plan: date coercion,
    product decoding (wide input only), 8-column projection with NULL rows
    dropped, renames and the positivity filter."""
    df = rename_cols(df)
    # positivity on the raw columns first: a plain comparison reaches the
    # parquet scan (pushed filter); NaN passes it and is dropped below
    df = filter_positive(df, tuple(c for c in ("Price", "Demand") if c in df.columns))
    df = coerce_date_dropna(df, "Date")
    if product_flags:
        df = onehot_decode(df, existing_cols(df, product_flags), "Product_id", all_zero)
    df = nan_to_null_cols(df, [c for c in ("Price", "Demand", "Discount", "Competitor_Price")
                               if c in df.columns and isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))])
    df = project_dropany(df, SALES_COLUMNS)
    return filter_positive(df)


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
