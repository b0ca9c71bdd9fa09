"""Registered queries: scheme ranking, mapping, list columns, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from partnerlens.functions.scalar import hash_key_sql
from partnerlens.operators.clean import catalog_of
from partnerlens.operators.joins import dealt_by_group
from partnerlens.plans import recommend as rc
from partnerlens.plans import schemes as sc
from partnerlens.plans.q_recommend import KNN_PRODUCTS_SQL, jaccard_products_cte
from partnerlens.plans.registry import finalize, register, sql_final
from partnerlens.sources.bindings import PURCHASES_SQL, purchases, stockist_long, stockist_long_sql
from partnerlens.sources.tables import table


def scheme_rows(spark, d):
    """Rows of the indirect approach: one record per sale line with the
    partner (customer), product (brand), scheme and sales."""
    return stockist_long(spark, d, partner="customer")


ROWS_SQL = stockist_long_sql(False, "customer", "srows")

SIMPLE_SQL_CTE = ROWS_SQL + """,
sw AS (SELECT Product_id, unnest(string_split(Scheme_Type, ', ')) AS Scheme, Sales_Quantity_Last_Period AS q
       FROM srows WHERE Scheme_Type IS NOT NULL AND Sales_Quantity_Last_Period IS NOT NULL),
swt AS (SELECT Product_id, Scheme, sum(q) AS weight FROM sw GROUP BY Product_id, Scheme),
stop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Product_id ORDER BY weight DESC, Scheme) AS r
         FROM swt) x WHERE r <= 3),
ssl AS (SELECT Product_id, max(CASE WHEN r = 1 THEN Scheme END) AS s1, max(CASE WHEN r = 2 THEN Scheme END) AS s2,
               max(CASE WHEN r = 3 THEN Scheme END) AS s3 FROM stop GROUP BY Product_id),
sheld AS (SELECT Product_id, count(DISTINCT Partner_id) AS n_partners FROM srows WHERE Partner_id IS NOT NULL
          GROUP BY Product_id),
smap AS (SELECT h.Product_id, h.n_partners, coalesce(s.s1, 'No Scheme Available') AS Scheme_1,
                coalesce(s.s2, 'No Scheme Available') AS Scheme_2, coalesce(s.s3, 'No Scheme Available') AS Scheme_3
         FROM sheld h LEFT JOIN ssl s ON h.Product_id = s.Product_id)"""

MAP_COLS = [("Product_id", "text"), ("n_partners", "int"), ("Scheme_1", "text"), ("Scheme_2", "text"),
            ("Scheme_3", "text")]


@register("scheme_rank_simple", sql_final("WITH" + SIMPLE_SQL_CTE + "\nSELECT * FROM smap", MAP_COLS))
def q_scheme_rank_simple(spark, d):
    """Per product: partner count and the 3 schemes with the largest summed quantity, padded."""
    return finalize(sc.scheme_rank_simple(scheme_rows(spark, d)))


@register("agg_weighted_counter", sql_final("WITH" + SIMPLE_SQL_CTE + "\nSELECT Product_id, Scheme, weight FROM swt",
                                            [("Product_id", "text"), ("Scheme", "text"), ("weight", "double")]))
def q_weighted_counter(spark, d):
    """Per product, scheme weight = summed quantity after splitting multi-scheme cells."""
    return finalize(sc.scheme_weights(scheme_rows(spark, d)))


VALUE_SQL_CTE = ROWS_SQL + """,
vg AS (SELECT Partner_id, Product_id, Scheme_Type, sum(Sales_Value_Last_Period) AS v, sum(Sales_Quantity_Last_Period) AS q
       FROM srows GROUP BY Partner_id, Product_id, Scheme_Type),
vs AS (SELECT Product_id, Scheme_Type, sum(v) AS value FROM vg GROUP BY Product_id, Scheme_Type),
vtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Product_id ORDER BY value DESC, Scheme_Type) AS r
         FROM vs) x WHERE r <= 3),
vheld AS (SELECT Product_id, count(DISTINCT Partner_id) AS n_partners FROM srows GROUP BY Product_id),
vmap AS (SELECT h.Product_id, h.n_partners, max(CASE WHEN r = 1 THEN Scheme_Type END) AS Scheme_1,
                max(CASE WHEN r = 2 THEN Scheme_Type END) AS Scheme_2, max(CASE WHEN r = 3 THEN Scheme_Type END) AS Scheme_3
         FROM vheld h LEFT JOIN vtop t ON h.Product_id = t.Product_id GROUP BY h.Product_id, h.n_partners)"""


@register("scheme_rank_value", sql_final("WITH" + VALUE_SQL_CTE + "\nSELECT * FROM vmap", MAP_COLS))
def q_scheme_rank_value(spark, d):
    """Per product: the 3 schemes with the largest summed sales value (the bounded LP optimum)."""
    return finalize(sc.scheme_rank_value(scheme_rows(spark, d)))


@register("agg_scheme_sales", sql_final("WITH" + VALUE_SQL_CTE + "\nSELECT Product_id, Scheme_Type, value FROM vs",
                                        [("Product_id", "text"), ("Scheme_Type", "text"), ("value", "double")]))
def q_agg_scheme_sales(spark, d):
    """Summed sales value by scheme within product."""
    r = scheme_rows(spark, d)
    return finalize(r.groupBy("Product_id", "Scheme_Type").agg(F.sum("Sales_Value_Last_Period").alias("value")))


@register("agg_partner_product_scheme", sql_final(
    "WITH" + VALUE_SQL_CTE + "\nSELECT Partner_id, Product_id, Scheme_Type, v AS Sales_Value_Last_Period, q AS Sales_Quantity_Last_Period FROM vg",
    [("Partner_id", "int"), ("Product_id", "text"), ("Scheme_Type", "text"), ("Sales_Value_Last_Period", "double"),
     ("Sales_Quantity_Last_Period", "double")]))
def q_agg_pps(spark, d):
    """Summed sales value and quantity by partner, product and scheme."""
    keys = ["Partner_id", "Product_id", "Scheme_Type"]
    values = ["Sales_Value_Last_Period", "Sales_Quantity_Last_Period"]
    r = dealt_by_group(scheme_rows(spark, d).select(*keys, *values), table(spark, d, "lineitem").count(), *keys)
    return finalize(r.groupBy(*keys)
                    .agg(F.sum("Sales_Value_Last_Period").alias("Sales_Value_Last_Period"),
                         F.sum("Sales_Quantity_Last_Period").alias("Sales_Quantity_Last_Period")))


@register("agg_list_partners", sql_final("WITH" + ROWS_SQL + f""",
rk AS (SELECT Product_id, Partner_id, row_number() OVER (PARTITION BY Product_id
              ORDER BY {hash_key_sql('row_key')}, row_key) - 1 AS pos FROM srows WHERE Partner_id IS NOT NULL)
SELECT Product_id, pos // {sc.LIST_CHUNK} AS chunk, count(*) AS n_partners,
       string_agg(CAST(Partner_id AS VARCHAR), ', ' ORDER BY pos) AS Partner_ids
FROM rk GROUP BY Product_id, pos // {sc.LIST_CHUNK}""",
    [("Product_id", "text"), ("chunk", "int"), ("n_partners", "int"), ("Partner_ids", "text")]))
def q_agg_list_partners(spark, d):
    """Partners of all records of every product, repeats kept, in lists of bounded length."""
    return finalize(sc.partner_lists(scheme_rows(spark, d)))


@register("join_partners_schemes", sql_final("WITH" + SIMPLE_SQL_CTE + """
SELECT m.Product_id, m.Partner_id, s.Scheme_1, s.Scheme_2, s.Scheme_3
FROM (SELECT DISTINCT Product_id, Partner_id FROM srows) m LEFT JOIN smap s ON m.Product_id = s.Product_id""",
    [("Product_id", "text"), ("Partner_id", "int"), ("Scheme_1", "text"), ("Scheme_2", "text"), ("Scheme_3", "text")]))
def q_join_partners_schemes(spark, d):
    """Partner membership per product joined to its scheme triple, in long form."""
    rows = scheme_rows(spark, d)
    return finalize(sc.product_partner_schemes(rows, sc.scheme_rank_simple(rows)))


FINAL_SQL = KNN_PRODUCTS_SQL + "," + SIMPLE_SQL_CTE + """
SELECT t.Partner_id, t.Product_id, t.score AS Similarity_Scores,
       coalesce(m.Scheme_1, 'Not Available') AS Scheme_1, coalesce(m.Scheme_2, 'Not Available') AS Scheme_2,
       coalesce(m.Scheme_3, 'Not Available') AS Scheme_3
FROM top t LEFT JOIN smap m ON t.Product_id = m.Product_id"""


@register("final_mapping", sql_final(FINAL_SQL, [
    ("Partner_id", "int"), ("Product_id", "text"), ("Similarity_Scores", "double"),
    ("Scheme_1", "text"), ("Scheme_2", "text"), ("Scheme_3", "text")]))
def q_final_mapping(spark, d):
    """One row per partner x recommended product with score and the product's 3 schemes."""
    recs = rc.rec_products_knn(purchases(spark, d))
    return finalize(sc.final_mapping(recs, sc.scheme_rank_simple(scheme_rows(spark, d))))


@register("final_mapping_item", sql_final(jaccard_products_cte(True) + "," + VALUE_SQL_CTE + """
SELECT t.Partner_id, t.Product_id, t.score AS Similarity_Scores,
       coalesce(m.Scheme_1, 'Not Available') AS Scheme_1, coalesce(m.Scheme_2, 'Not Available') AS Scheme_2,
       coalesce(m.Scheme_3, 'Not Available') AS Scheme_3
FROM best t LEFT JOIN vmap m ON t.Product_id = m.Product_id""", [
    ("Partner_id", "int"), ("Product_id", "text"), ("Similarity_Scores", "double"),
    ("Scheme_1", "text"), ("Scheme_2", "text"), ("Scheme_3", "text")]))
def q_final_mapping_item(spark, d):
    """The same mapping by the other route: item-based recommendations on the value ranking of schemes."""
    recs = rc.rec_products_jaccard(purchases(spark, d), include_purchased=True)
    return finalize(sc.final_mapping(recs, sc.scheme_rank_value(scheme_rows(spark, d))))


@register("zip_arrays", sql_final(KNN_PRODUCTS_SQL + """
SELECT Partner_id, r - 1 AS pos, Product_id, score AS Similarity_Scores FROM top""",
    [("Partner_id", "int"), ("pos", "int"), ("Product_id", "text"), ("Similarity_Scores", "double")]))
def q_zip_arrays(spark, d):
    """Recommended products paired position-wise with their scores."""
    return finalize(sc.zip_arrays(rc.rec_products_knn(purchases(spark, d))))


@register("parse_list_col", sql_final(KNN_PRODUCTS_SQL + """
SELECT p.Partner_id, coalesce(r.n, 0) AS n_items, coalesce(r.items, '') AS Recommended_Products
FROM (SELECT DISTINCT Partner_id FROM purchases) p
LEFT JOIN (SELECT Partner_id, count(*) AS n, string_agg(Product_id, ', ' ORDER BY r) AS items FROM top
           GROUP BY Partner_id) r ON p.Partner_id = r.Partner_id""",
    [("Partner_id", "int"), ("n_items", "int"), ("Recommended_Products", "text")]))
def q_parse_list_col(spark, d):
    """Round trip of the list column through its Python-literal text form."""
    recs = rc.rec_products_knn(purchases(spark, d))
    txt = recs.select("Partner_id", sc.list_to_text("Recommended_Products").alias("Recommended_Products"))
    back = sc.parse_list_col(txt, "Recommended_Products")
    return finalize(back.select("Partner_id", F.size("Recommended_Products").alias("n_items"),
                                "Recommended_Products"))


@register("melt_products", sql_final("WITH" + PURCHASES_SQL + "\nSELECT Partner_id, Product_id FROM purchases",
                                     [("Partner_id", "int"), ("Product_id", "text")]))
def q_melt_products(spark, d):
    """Wide 0/1 product flags (pivot of the binding) melted back to (partner, product)."""
    p = purchases(spark, d)
    products = catalog_of(p, "Product_id")
    wide = (p.groupBy("Partner_id").pivot("Product_id", products).agg(F.lit(1)).na.fill(0, products))
    return finalize(sc.melt_products(wide, ["Partner_id"], products))


@register("multilabel_binarize", sql_final("WITH" + stockist_long_sql() + """,
pairs AS (SELECT DISTINCT Scheme_Type, Product_id FROM stockist)
SELECT s.Scheme_Type, p.Product_id, CASE WHEN x.Product_id IS NULL THEN 0 ELSE 1 END AS flag
FROM (SELECT DISTINCT Scheme_Type FROM pairs) s CROSS JOIN (SELECT DISTINCT Product_id FROM pairs) p
LEFT JOIN pairs x ON x.Scheme_Type = s.Scheme_Type AND x.Product_id = p.Product_id""",
    [("Scheme_Type", "text"), ("Product_id", "text"), ("flag", "int")]))
def q_multilabel_binarize(spark, d):
    """Scheme x product 0/1 matrix in long form, zeros included."""
    pairs = stockist_long(spark, d).select("Scheme_Type", "Product_id").distinct()
    return finalize(sc.multilabel_binarize(pairs, "Scheme_Type", "Product_id"))


@register("agg_set_products", sql_final("WITH" + stockist_long_sql() + """
SELECT Scheme_Type, string_agg(Product_id, ', ' ORDER BY Product_id) AS products, count(*) AS n_products
FROM (SELECT DISTINCT Scheme_Type, Product_id FROM stockist) x GROUP BY Scheme_Type""",
    [("Scheme_Type", "text"), ("products", "text"), ("n_products", "int")]))
def q_agg_set_products(spark, d):
    """Set of products per scheme (bounded by the product catalog)."""
    r = stockist_long(spark, d).select("Scheme_Type", "Product_id").distinct()
    g = r.groupBy("Scheme_Type").agg(F.sort_array(F.collect_set("Product_id")).alias("products"))
    return finalize(g.withColumn("n_products", F.size("products")))
