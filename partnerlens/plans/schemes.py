"""Product -> scheme ranking and the final partner x product x scheme mapping.

The reference writes a list of partner ids per product.  That list grows
with the data (a popular product is held by a large share of partners), so
it is never collected into one row here: ``partner_lists`` gives it in chunks
of bounded length, and ``product_partner_schemes`` in long form, one row per
(product, partner).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from partnerlens.functions.scalar import FILL_NOT_AVAILABLE, PAD_NO_SCHEME_AVAILABLE, fn_hash_key, fn_split_schemes
from partnerlens.operators.ranking import slots, topn_per_group
from partnerlens.operators.split import rank_within_once

TOP_N = 3
LIST_CHUNK = 1000    # partners in one list of partner_lists


def melt_products(wide: DataFrame, id_cols: list[str], product_cols: list[str]) -> DataFrame:
    """Wide 0/1 product flags -> (ids..., Product_id) rows where the flag is 1."""
    return (wide.unpivot(id_cols, product_cols, "Product_id", "Has_Product")
            .filter(F.col("Has_Product") == 1).drop("Has_Product"))


def scheme_weights(rows: DataFrame, weight: str = "Sales_Quantity_Last_Period") -> DataFrame:
    """Per (product, scheme) the summed weight; multi-scheme cells ('A, B')
    count for each scheme; NULL scheme or non-numeric weight rows skipped."""
    w = F.col(weight).cast("string").try_cast("double")
    return (rows.filter(F.col("Scheme_Type").isNotNull())
            .withColumn("_w", w).filter(F.col("_w").isNotNull())
            .withColumn("Scheme", F.explode(fn_split_schemes("Scheme_Type")))
            .groupBy("Product_id", "Scheme").agg(F.sum("_w").alias("weight")))


def scheme_rank_simple(rows: DataFrame, n: int = TOP_N, pad: str = PAD_NO_SCHEME_AVAILABLE) -> DataFrame:
    """Per product held by at least one partner: the n schemes with the
    largest summed quantity (ties by name), padded; plus the partner count."""
    top = topn_per_group(scheme_weights(rows), ["Product_id"],
                         [F.col("weight").desc(), F.col("Scheme").asc()], n)
    s = slots(top, ["Product_id"], "Scheme", n)
    held = (rows.filter(F.col("Partner_id").isNotNull()).groupBy("Product_id")
            .agg(F.count_distinct("Partner_id").alias("n_partners")))
    return (held.join(s, "Product_id", "left")
            .select("Product_id", "n_partners",
                    *[F.coalesce(F.col(f"Scheme_{i}"), F.lit(pad)).alias(f"Scheme_{i}") for i in range(1, n + 1)]))


def scheme_rank_value(rows: DataFrame, n: int = TOP_N) -> DataFrame:
    """Per product: the n schemes with the largest summed sales value -- the
    optimum of max sum(c_i x_i) s.t. 0 <= x_i <= 1, sum x_i <= n; missing
    slots NULL."""
    by_scheme = rows.groupBy("Product_id", "Scheme_Type").agg(F.sum("Sales_Value_Last_Period").alias("value"))
    top = topn_per_group(by_scheme, ["Product_id"], [F.col("value").desc(), F.col("Scheme_Type").asc()], n)
    s = slots(top, ["Product_id"], "Scheme_Type", n)
    held = rows.groupBy("Product_id").agg(F.count_distinct("Partner_id").alias("n_partners"))
    return held.join(s, "Product_id", "left").select("Product_id", "n_partners",
                                                     *[f"Scheme_{i}" for i in range(1, n + 1)])


def partner_lists(rows: DataFrame, key: str = "row_key", size: int = LIST_CHUNK) -> DataFrame:
    """(Product_id, chunk, n_partners, Partner_ids): the partners of every
    record of a product, repeats kept, as lists of ``size`` (the last one may
    be shorter).  Records are numbered by an exact rank in the order of a hash
    of ``key``, so a product holding most records is spread over many tasks
    and no list exceeds ``size``.  Records without partner are left out; those
    without product are a group of their own."""
    held = rows.filter(F.col("Partner_id").isNotNull()).select("Product_id", "Partner_id", key)
    ranked = rank_within_once(held, ["Product_id"], fn_hash_key(key), key, ["Partner_id"], "_rk")
    entry = F.struct(F.col("_rk").alias("at"), F.col("Partner_id").alias("p"))
    return (ranked.withColumn("chunk", F.floor((F.col("_rk") - 1) / size).cast("int"))
            .groupBy("Product_id", "chunk").agg(F.array_sort(F.collect_list(entry)).alias("_a"))
            .select("Product_id", "chunk", F.size("_a").alias("n_partners"),
                    F.transform("_a", lambda x: x["p"]).alias("Partner_ids")))


def product_partner_schemes(rows: DataFrame, scheme_map: DataFrame) -> DataFrame:
    """join_partners_schemes in long form: (Product_id, Partner_id, Scheme_1..n)."""
    members = rows.select("Product_id", "Partner_id").distinct()
    return members.join(scheme_map.drop("n_partners"), "Product_id", "left")


# ------------------------------------------------------------ list columns

# an element of a list literal: quoted either way, None, or a bare number
LIST_ITEM = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,\[\]\s'"]+"""


def parse_list_col(df: DataFrame, col: str, elem_type: str = "string") -> DataFrame:
    """Python-literal list text ("['A', 'B']", "[0.3, None]") -> array, with
    quotes of either kind, backslash escapes and None as NULL; anything that
    does not start as a list -> NULL.  Text is never evaluated."""
    txt = F.trim(F.col(col))
    items = F.regexp_extract_all(txt, F.lit(LIST_ITEM), F.lit(0))

    def value(x):
        quoted = x.startswith("'") | x.startswith('"')
        inner = F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), r"\\(.)", "$1")
        return F.when(quoted, inner).when(x != "None", x).try_cast(elem_type)
    return df.withColumn(col, F.when(txt.startswith("["), F.transform(items, value)))


def list_to_text(arr_col: str, quote: bool = True):
    """Array -> Python-literal text, as the reference writes list columns."""
    def quoted(x):
        return F.concat(F.lit("'"), F.regexp_replace(x, r"([\\\\'])", r"\\$1"), F.lit("'"))

    f = (lambda x: F.coalesce(quoted(x), F.lit("None"))) if quote else (lambda x: F.coalesce(x.cast("string"), F.lit("None")))
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(F.col(arr_col), f)), F.lit("]"))


def zip_arrays(recs: DataFrame, items: str = "Recommended_Products",
               scores: str = "Similarity_Scores", id_col: str = "Partner_id") -> DataFrame:
    """(id, items[], scores[]) -> one row per position, stopping at the shorter."""
    z = recs.select(id_col, F.posexplode(F.arrays_zip(F.col(items).alias("p"), F.col(scores).alias("s")))
                    .alias("pos", "z"))
    return (z.select(id_col, "pos", F.col("z.p").alias("Product_id"), F.col("z.s").alias("Similarity_Scores"))
            .filter(F.col("Product_id").isNotNull() & F.col("Similarity_Scores").isNotNull()))


def join_scheme_lookup(pairs: DataFrame, scheme_map: DataFrame, n: int = TOP_N,
                       fill: str = FILL_NOT_AVAILABLE, order_col: str | None = None) -> DataFrame:
    """Per product the first scheme row (by ``order_col`` when the mapping
    has several rows for a product), missing schemes/products -> ``fill``."""
    cols = [f"Scheme_{i}" for i in range(1, n + 1)]
    if order_col:
        first = (scheme_map.groupBy("Product_id")
                 .agg(F.min_by(F.struct(*cols), order_col).alias("_s"))
                 .select("Product_id", *[F.col(f"_s.{c}").alias(c) for c in cols]))
    else:
        first = scheme_map.select("Product_id", *cols).dropDuplicates(["Product_id"])
    return (pairs.join(first, "Product_id", "left")
            .withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in cols}))


def final_mapping(recs: DataFrame, scheme_map: DataFrame, n: int = TOP_N) -> DataFrame:
    """One row per partner x recommended product with its score and schemes."""
    pairs = zip_arrays(recs)
    return (join_scheme_lookup(pairs, scheme_map, n)
            .select("Partner_id", "Product_id", "Similarity_Scores", *[f"Scheme_{i}" for i in range(1, n + 1)]))


def multilabel_binarize(pairs: DataFrame, row: str, label: str) -> DataFrame:
    """(row, label, flag) for every row value and label: 1 where the pair
    occurs.  Few row values (a handful of schemes) against many labels: each
    label carries the set of its rows, against the list of all rows."""
    every = pairs.agg(F.sort_array(F.collect_set(row))).scalar()
    held = pairs.groupBy(label).agg(F.collect_set(row).alias("_rows")).withColumn("_all", every)
    return (held.select(label, "_rows", F.explode("_all").alias(row))
            .select(row, label, F.array_contains("_rows", F.col(row)).cast("int").alias("flag")))
