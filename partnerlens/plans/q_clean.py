"""Registered queries: cleaning, reshaping and the small grouped operators,
each on the bound driver tables with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from partnerlens.functions.scalar import (fn_engagement, fn_engagement_dropped, fn_engagement_geo, fn_label_class, hash_key_sql,
                                          hash_pct_sql)
from partnerlens.operators.clean import binarize, catalog_of, coerce_int0, onehot_decode, profile_columns, purchased_list
from partnerlens.operators.ranking import topn_per_group
from partnerlens.operators.split import sample_rows, split_random
from partnerlens.plans import discount as dd
from partnerlens.plans import recommend as rc
from partnerlens.plans.q_discount import ELASTICITY_SQL, MONTH_TEXT, PANEL_SQL, panel_of
from partnerlens.plans.q_recommend import strat_split_sql
from partnerlens.plans.registry import finalize, register, sql_final
from partnerlens.sources.bindings import (FEEDBACK_SQL, ROW_KEY_SQL, feedback, row_key, stockist_long,
                                          stockist_long_sql)
from partnerlens.sources.tables import table

ENG_SQL = "WITH" + stockist_long_sql() + """,
eng AS (SELECT *, ln(1 + Sales_Value_Last_Period) * (Feedback_Score + Growth_Percentage) AS Engagement_Score
        FROM stockist),""" + strat_split_sql("eng")


@register("coerce_date_dropna", sql_final("""
SELECT o_orderkey, strftime(d, '%Y-%m-%d %H:%M:%S') AS Date FROM (
  SELECT o_orderkey, try_strptime(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority
                                       ELSE strftime(o_orderdate, '%Y-%m-%d') END, '%Y-%m-%d') AS d FROM orders) x
WHERE d IS NOT NULL""", [("o_orderkey", "int"), ("Date", "text")]))
def q_coerce_date_dropna(spark, d):
    """Date text parsed leniently (unparsable -> NULL -> row dropped); orders in status 'P'
    carry their priority text in place of a date."""
    from partnerlens.operators.clean import coerce_date_dropna
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Date"))
    out = coerce_date_dropna(o, "Date")
    return finalize(out.withColumn("Date", F.date_format("Date", "yyyy-MM-dd HH:mm:ss")))


@register("onehot_decode", sql_final("""
SELECT """ + ROW_KEY_SQL + """ AS row_key, p.p_type AS Product_id
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""", [("row_key", "text"), ("Product_id", "text")]))
def q_onehot_decode(spark, d):
    """Product name recovered from wide 0/1 product flags (flags built from the part type)."""
    li = table(spark, d, "lineitem")
    part = table(spark, d, "part").select("p_partkey", "p_type")
    types = catalog_of(part, "p_type")
    wide = (li.join(part, li.l_partkey == part.p_partkey)
            .select(row_key().alias("row_key"), *[(F.col("p_type") == t).cast("int").alias(t) for t in types]))
    return finalize(onehot_decode(wide, types).select("row_key", "Product_id"))


@register("filter_positive", sql_final("WITH" + PANEL_SQL + """
SELECT Product_id, Geography, count(*) AS n_rows, sum(Demand) AS demand FROM clean GROUP BY Product_id, Geography""",
    [("Product_id", "text"), ("Geography", "text"), ("n_rows", "int"), ("demand", "double")]))
def q_filter_positive(spark, d):
    """Rows kept by projection, NULL drop, renames and the Price > 0 AND Demand > 0 filter, per group."""
    from partnerlens.operators.clean import clean_sales
    from partnerlens.sources.bindings import dated_sales
    c = clean_sales(dated_sales(spark, d))
    return finalize(c.groupBy("Product_id", "Geography").agg(F.count(F.lit(1)).alias("n_rows"),
                                                             F.sum("Demand").alias("demand")))


@register("profile_columns", sql_final("WITH" + PANEL_SQL + """
SELECT 'Demand' AS "column", min(Demand) AS min_value, max(Demand) AS max_value,
       count(*) - count(Demand) AS null_count FROM panel
UNION ALL SELECT 'Price', min(Price), max(Price), count(*) - count(Price) FROM panel
UNION ALL SELECT 'Log_Demand', min(Log_Demand), max(Log_Demand), count(*) - count(Log_Demand) FROM panel""",
    [("column", "text"), ("min_value", "double"), ("max_value", "double"), ("null_count", "int")]))
def q_profile_columns(spark, d):
    """Min, max and NULL count of model columns over all groups in one pass."""
    return finalize(profile_columns(panel_of(spark, d), ["Demand", "Price", "Log_Demand"]))


@register("preview", sql_final("WITH" + PANEL_SQL + f"""
SELECT Product_id, Geography, {MONTH_TEXT.format(m='mi')} AS YearMonth, Demand FROM panel
ORDER BY Product_id, Geography, mi LIMIT 5""",
    [("Product_id", "text"), ("Geography", "text"), ("YearMonth", "text"), ("Demand", "double")]))
def q_preview(spark, d):
    """First rows of the panel in key order (the limit is the feature)."""
    p = panel_of(spark, d).orderBy("Product_id", "Geography", "YearMonth").limit(5)
    return finalize(p.select("Product_id", "Geography", "YearMonth", "Demand"))


@register("key_lookup", sql_final("WITH e AS (" + ELASTICITY_SQL + """)
SELECT * FROM e WHERE product = (SELECT min(product) FROM e) AND region = (SELECT max(region) FROM e)""",
    [("product", "text"), ("region", "text"), ("price_elasticity", "double")]))
def q_key_lookup(spark, d):
    """Elasticity row of one product-region (first product, last region by name)."""
    e = finalize(dd.elasticity(panel_of(spark, d)))
    return e.filter((F.col("product") == e.agg(F.min("product")).scalar())
                    & (F.col("region") == e.agg(F.max("region")).scalar()))


@register("infer_meta_cols", sql_final("WITH" + stockist_long_sql() + """
SELECT 'Partner_id' AS "column", count(DISTINCT Partner_id) AS n_distinct FROM stockist
UNION ALL SELECT 'Geography', count(DISTINCT Geography) FROM stockist
UNION ALL SELECT 'Stockist_Type', count(DISTINCT Stockist_Type) FROM stockist
UNION ALL SELECT 'Scheme_Type', count(DISTINCT Scheme_Type) FROM stockist
UNION ALL SELECT 'Product_id', count(DISTINCT Product_id) FROM stockist""",
    [("column", "text"), ("n_distinct", "int")]))
def q_infer_meta_cols(spark, d):
    """Distinct counts per column in one aggregate pass (metadata = more than 10 values)."""
    s = stockist_long(spark, d)
    cols = ["Partner_id", "Geography", "Stockist_Type", "Scheme_Type", "Product_id"]
    row = s.agg(*[F.count_distinct(c).alias(c) for c in cols])
    out = row.selectExpr("stack(5, " + ", ".join(f"'{c}', `{c}`" for c in cols) + ") AS (column, n_distinct)")
    return finalize(out)


@register("agg_user_features", sql_final("WITH" + stockist_long_sql() + """,
n AS (SELECT Partner_id, count(*) AS n_p FROM stockist GROUP BY Partner_id),
d AS (SELECT Partner_id, 'Geography_' || Geography AS dummy FROM stockist
      UNION ALL SELECT Partner_id, 'Stockist_Type_' || Stockist_Type FROM stockist)
SELECT d.Partner_id, dummy, count(*) / n.n_p AS mean_value FROM d JOIN n ON d.Partner_id = n.Partner_id
GROUP BY d.Partner_id, dummy, n.n_p""", [("Partner_id", "int"), ("dummy", "text"), ("mean_value", "double")]))
def q_agg_user_features(spark, d):
    """One-hot Geography / Stockist_Type per row, mean per partner (long form, zero cells omitted)."""
    s = stockist_long(spark, d)
    n = s.groupBy("Partner_id").agg(F.count(F.lit(1)).alias("n_p"))
    dm = s.select("Partner_id", F.explode(F.array(F.concat(F.lit("Geography_"), "Geography"),
                                                  F.concat(F.lit("Stockist_Type_"), "Stockist_Type"))).alias("dummy"))
    out = (dm.groupBy("Partner_id", "dummy").agg(F.count(F.lit(1)).alias("c")).join(n, "Partner_id")
           .select("Partner_id", "dummy", (F.col("c") / F.col("n_p")).alias("mean_value")))
    return finalize(out)


@register("pivot_engagement", sql_final(ENG_SQL + """,
parts AS (SELECT DISTINCT Partner_id FROM train), sch AS (SELECT DISTINCT Scheme_Type FROM train),
s AS (SELECT Partner_id, Scheme_Type, sum(Engagement_Score) AS v FROM train GROUP BY Partner_id, Scheme_Type)
SELECT p.Partner_id, c.Scheme_Type, coalesce(s.v, 0.0) AS engagement
FROM parts p CROSS JOIN sch c LEFT JOIN s ON s.Partner_id = p.Partner_id AND s.Scheme_Type = c.Scheme_Type""",
    [("Partner_id", "int"), ("Scheme_Type", "text"), ("engagement", "double")]))
def q_pivot_engagement(spark, d):
    """Partner x scheme engagement sums over the train split, missing cells 0 (long form)."""
    train, _ = rc.user_split(stockist_long(spark, d))
    schemes = train.select("Scheme_Type").distinct().agg(F.sort_array(F.collect_list("Scheme_Type"))).scalar()
    cells = (train.select("Partner_id").distinct().withColumn("_s", schemes)
             .select("Partner_id", F.explode("_s").alias("Scheme_Type")))
    s = train.groupBy("Partner_id", "Scheme_Type").agg(F.sum("Engagement_Score").alias("v"))
    out = cells.join(s, ["Partner_id", "Scheme_Type"], "left").select(
        "Partner_id", "Scheme_Type", F.coalesce("v", F.lit(0.0)).alias("engagement"))
    return finalize(out)


@register("minmax_scale", sql_final(ENG_SQL + """,
s AS (SELECT Partner_id, Scheme_Type, sum(Engagement_Score) AS v FROM train GROUP BY Partner_id, Scheme_Type),
b AS (SELECT Scheme_Type, min(v) AS lo, max(v) AS hi FROM s GROUP BY Scheme_Type)
SELECT s.Partner_id, s.Scheme_Type, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.0 END AS scaled
FROM s JOIN b ON s.Scheme_Type = b.Scheme_Type""",
    [("Partner_id", "int"), ("Scheme_Type", "text"), ("scaled", "double")]))
def q_minmax_scale(spark, d):
    """Each scheme column of the engagement matrix scaled to [0, 1]; constant column -> 0."""
    train, _ = rc.user_split(stockist_long(spark, d))
    s = train.groupBy("Partner_id", "Scheme_Type").agg(F.sum("Engagement_Score").alias("v"))
    b = s.groupBy("Scheme_Type").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    out = s.join(b, "Scheme_Type").select(
        "Partner_id", "Scheme_Type",
        F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        .otherwise(F.lit(0.0)).alias("scaled"))
    return finalize(out)


@register("value_counts", sql_final(ENG_SQL + """,
c AS (SELECT Partner_id, Scheme_Type, count(*) AS cnt FROM train GROUP BY Partner_id, Scheme_Type)
SELECT Partner_id, Scheme_Type, cnt,
       row_number() OVER (PARTITION BY Partner_id ORDER BY cnt DESC, Scheme_Type) AS rank FROM c""",
    [("Partner_id", "int"), ("Scheme_Type", "text"), ("cnt", "int"), ("rank", "int")]))
def q_value_counts(spark, d):
    """Scheme frequency per partner, ranked descending (ties by name)."""
    train, _ = rc.user_split(stockist_long(spark, d))
    c = train.groupBy("Partner_id", "Scheme_Type").agg(F.count(F.lit(1)).alias("cnt"))
    order = Window.partitionBy("Partner_id").orderBy(F.col("cnt").desc(), "Scheme_Type")
    return finalize(c.withColumn("rank", F.row_number().over(order)))


@register("topn_per_group", sql_final(ENG_SQL + """,
c AS (SELECT Partner_id, Scheme_Type, count(*) AS cnt FROM train GROUP BY Partner_id, Scheme_Type)
SELECT Partner_id, Scheme_Type, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY Partner_id ORDER BY cnt DESC, Scheme_Type) AS rank FROM c) x
WHERE rank <= 3""", [("Partner_id", "int"), ("Scheme_Type", "text"), ("rank", "int")]))
def q_topn_per_group(spark, d):
    """Three most used schemes per partner."""
    train, _ = rc.user_split(stockist_long(spark, d))
    return finalize(rc.top_schemes_by_count(train).select("Partner_id", "Scheme_Type", "rank"))


@register("first_product", sql_final(ENG_SQL + """
SELECT Partner_id, arg_min(Product_id, row_key) AS Product_id FROM train GROUP BY Partner_id""",
    [("Partner_id", "int"), ("Product_id", "text")]))
def q_first_product(spark, d):
    """First product of each partner in line order (explicit order key)."""
    train, _ = rc.user_split(stockist_long(spark, d))
    return finalize(rc.first_product(train))


@register("agg_list_availed", sql_final(ENG_SQL + """
SELECT Partner_id, string_agg(DISTINCT Scheme_Type, ', ' ORDER BY Scheme_Type) AS Availed_Schemes
FROM test GROUP BY Partner_id""", [("Partner_id", "int"), ("Availed_Schemes", "text")]))
def q_agg_list_availed(spark, d):
    """Schemes availed per test partner (a set bounded by the scheme catalog)."""
    _, test = rc.user_split(stockist_long(spark, d))
    return finalize(test.groupBy("Partner_id").agg(F.sort_array(F.collect_set("Scheme_Type")).alias("Availed_Schemes")))


@register("split_stratified", sql_final(ENG_SQL + """
SELECT Partner_id, count(*) AS n_train, (SELECT count(*) FROM test t WHERE t.Partner_id = r.Partner_id) AS n_test
FROM train r GROUP BY Partner_id""", [("Partner_id", "int"), ("n_train", "int"), ("n_test", "int")]))
def q_split_stratified(spark, d):
    """80/20 inside every partner: train and test sizes per partner."""
    train, test = rc.user_split(stockist_long(spark, d))
    t = test.groupBy("Partner_id").agg(F.count(F.lit(1)).alias("n_test"))
    out = (train.groupBy("Partner_id").agg(F.count(F.lit(1)).alias("n_train")).join(t, "Partner_id", "left")
           .select("Partner_id", "n_train", F.coalesce("n_test", F.lit(0)).alias("n_test")))
    return finalize(out)


@register("split_random", sql_final("WITH" + stockist_long_sql() + f"""
SELECT Scheme_Type, sum(CASE WHEN {hash_pct_sql('row_key')} >= 20 THEN 1 ELSE 0 END) AS n_train,
       sum(CASE WHEN {hash_pct_sql('row_key')} < 20 THEN 1 ELSE 0 END) AS n_test
FROM stockist GROUP BY Scheme_Type""", [("Scheme_Type", "text"), ("n_train", "int"), ("n_test", "int")]))
def q_split_random(spark, d):
    """Deterministic 80/20 row split (md5 of the line identity, seed 42): sizes per scheme."""
    s = stockist_long(spark, d)
    tr, te = split_random(s, "row_key")
    a = tr.groupBy("Scheme_Type").agg(F.count(F.lit(1)).alias("n_train"))
    b = te.groupBy("Scheme_Type").agg(F.count(F.lit(1)).alias("n_test"))
    return finalize(a.join(b, "Scheme_Type", "full").fillna(0, ["n_train", "n_test"]))


@register("sample_rows", sql_final("WITH" + FEEDBACK_SQL + f"""
SELECT Feedback_ID, Sentiment FROM feedback ORDER BY {hash_key_sql('Feedback_ID')}, Feedback_ID LIMIT 3""",
    [("Feedback_ID", "int"), ("Sentiment", "text")]))
def q_sample_rows(spark, d):
    """Three feedback rows drawn by a seeded hash order (sampling is the feature)."""
    return finalize(sample_rows(feedback(spark, d), "Feedback_ID", 3).select("Feedback_ID", "Sentiment"))


@register("fn_engagement", sql_final("WITH" + stockist_long_sql() + """
SELECT Partner_id, Scheme_Type, sum(ln(1 + Sales_Value_Last_Period) * (Feedback_Score + Growth_Percentage)) AS engagement
FROM stockist GROUP BY Partner_id, Scheme_Type""",
    [("Partner_id", "int"), ("Scheme_Type", "text"), ("engagement", "double")]))
def q_fn_engagement(spark, d):
    """log1p(sales) x (feedback + growth), summed per partner and scheme."""
    s = stockist_long(spark, d)
    e = fn_engagement("Sales_Value_Last_Period", "Feedback_Score", "Growth_Percentage")
    return finalize(s.groupBy("Partner_id", "Scheme_Type").agg(F.sum(e).alias("engagement")))


@register("agg_price_bounds", sql_final("WITH" + PANEL_SQL + """
SELECT Product_id, Geography, min(Price) AS min_price, max(Price) AS max_price FROM panel
GROUP BY Product_id, Geography""",
    [("Product_id", "text"), ("Geography", "text"), ("min_price", "double"), ("max_price", "double")]))
def q_agg_price_bounds(spark, d):
    """Observed monthly price range of every product-region in one aggregate."""
    p = panel_of(spark, d)
    return finalize(p.groupBy("Product_id", "Geography").agg(F.min("Price").alias("min_price"),
                                                             F.max("Price").alias("max_price")))


# fixed values: the regions and order priorities of the tables
SCHEMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _region_dummies(spark, d):
    """Sale lines with a 0/1 column per region."""
    return stockist_long(spark, d).withColumns({r: (F.col("Geography") == r).cast("int") for r in REGIONS})


def _engagement_sql(expr: str) -> str:
    return sql_final("WITH" + stockist_long_sql() + f"""
SELECT Partner_id, Scheme_Type, sum({expr}) AS engagement FROM stockist GROUP BY Partner_id, Scheme_Type""",
                     [("Partner_id", "int"), ("Scheme_Type", "text"), ("engagement", "double")])


KEPT = REGIONS[:3]
KEPT_SQL = "CAST(Geography IN ('AFRICA', 'AMERICA', 'ASIA') AS INTEGER)"


@register("fn_engagement_geo", _engagement_sql("ln(1 + Sales_Value_Last_Period) * (Feedback_Score + 5.0)"))
def q_fn_engagement_geo(spark, d):
    """log1p(sales) x (feedback + 5 x region dummies), summed per partner and scheme."""
    e = fn_engagement_geo("Sales_Value_Last_Period", "Feedback_Score", list(REGIONS))
    return finalize(_region_dummies(spark, d).groupBy("Partner_id", "Scheme_Type").agg(F.sum(e).alias("engagement")))


@register("fn_engagement_dropped", _engagement_sql(f"ln(1 + Sales_Value_Last_Period) * (Feedback_Score + 1.0 * {KEPT_SQL})"))
def q_fn_engagement_dropped(spark, d):
    """Engagement with two regions' dummies dropped, additive form."""
    e = fn_engagement_dropped("Sales_Value_Last_Period", "Feedback_Score", list(KEPT))
    return finalize(_region_dummies(spark, d).groupBy("Partner_id", "Scheme_Type").agg(F.sum(e).alias("engagement")))


@register("fn_engagement_dropped_product", _engagement_sql(f"ln(1 + Sales_Value_Last_Period) * Feedback_Score * {KEPT_SQL}"))
def q_fn_engagement_dropped_product(spark, d):
    """Engagement with two regions' dummies dropped, product form."""
    e = fn_engagement_dropped("Sales_Value_Last_Period", "Feedback_Score", list(KEPT), "product")
    return finalize(_region_dummies(spark, d).groupBy("Partner_id", "Scheme_Type").agg(F.sum(e).alias("engagement")))


@register("purchased_list", sql_final("WITH" + stockist_long_sql(True, "customer") + """
SELECT Partner_id, string_agg(DISTINCT Scheme_Type, ', ' ORDER BY Scheme_Type) AS Purchased,
       true AS has_purchase FROM stockist GROUP BY Partner_id""",
    [("Partner_id", "int"), ("Purchased", "text"), ("has_purchase", "int")]))
def q_purchased_list(spark, d):
    """Names of the non-zero count columns per partner (counts as text, coerced, made 0/1, listed)."""
    rows = stockist_long(spark, d, purchase_only=True, partner="customer")
    wide = rows.groupBy("Partner_id").pivot("Scheme_Type", SCHEMES).agg(F.count(F.lit(1)).cast("string"))
    flags = binarize(coerce_int0(wide, SCHEMES), SCHEMES)
    return finalize(purchased_list(flags, SCHEMES).select("Partner_id", "Purchased", "has_purchase"))


@register("fn_label_class", sql_final("""
SELECT doc_id, CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS label FROM labels""",
    [("doc_id", "int"), ("label", "text")]))
def q_fn_label_class(spark, d):
    """Label of a numeric class."""
    labels = table(spark, d, "labels")
    return finalize(labels.select("doc_id", fn_label_class("quality", 1).alias("label")))
