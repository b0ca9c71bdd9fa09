"""Registered queries: similarity kernels and recommenders."""

from __future__ import annotations

from pyspark.sql import functions as F

from partnerlens.functions.scalar import hash_key_sql, hash_pct_sql
from partnerlens.operators.split import split_random
from partnerlens.plans import recommend as rc
from partnerlens.plans.registry import finalize, fixed_text_sql, register, sql_final
from partnerlens.sources.bindings import PURCHASES_SQL, purchases, stockist_long, stockist_long_sql

# --------------------------------------------------------------- SQL parts

def cosine_sql(vec: str, out: str, query: str | None = None, exclude_self: bool = True) -> str:
    """CTEs computing ``out``(qid, cid, sim) for all query x candidate pairs
    from long vectors ``vec``(id, dim, val) -- the brute-force reference the
    Spark kernel must equal."""
    query = query or vec
    neq = "AND q.id <> c.id" if exclude_self else ""
    neq_d = "AND a.id <> b.id" if exclude_self else ""
    return f"""
{out}_qn AS (SELECT id, sum(val * val) AS nn FROM {query} GROUP BY id),
{out}_cn AS (SELECT id, sum(val * val) AS nn FROM {vec} GROUP BY id),
{out}_dot AS (SELECT a.id AS qid, b.id AS cid, sum(a.val * b.val) AS dot
              FROM {query} a JOIN {vec} b ON a.dim = b.dim {neq_d} GROUP BY a.id, b.id),
{out} AS (
  SELECT q.id AS qid, c.id AS cid,
         CASE WHEN q.nn * c.nn > 0 THEN coalesce(d.dot, 0) / sqrt(q.nn * c.nn) ELSE 0.0 END AS sim
  FROM {out}_qn q JOIN {out}_cn c ON TRUE {neq}
  LEFT JOIN {out}_dot d ON d.qid = q.id AND d.cid = c.id
)"""


def topk_sql(pairs: str, out: str, k: int) -> str:
    return f"""
{out} AS (
  SELECT qid, cid, sim, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 12) DESC, cid) AS rank FROM {pairs}) r
  WHERE rank <= {k}
)"""


def jaccard_all_sql(pairs: str, set_col: str, elem_col: str, out: str) -> str:
    """All ordered pairs of distinct sets with their Jaccard (zeros included)."""
    return f"""
{out}_d AS (SELECT DISTINCT CAST({set_col} AS VARCHAR) AS s, CAST({elem_col} AS VARCHAR) AS e FROM {pairs}),
{out}_n AS (SELECT s, count(*) AS n FROM {out}_d GROUP BY s),
{out}_co AS (SELECT a.s AS a, b.s AS b, count(*) AS inter FROM {out}_d a JOIN {out}_d b
             ON a.e = b.e AND a.s <> b.s GROUP BY a.s, b.s),
{out} AS (
  SELECT x.s AS a, y.s AS b,
         coalesce(co.inter / (x.n + y.n - co.inter), 0.0) AS sim
  FROM {out}_n x JOIN {out}_n y ON x.s <> y.s
  LEFT JOIN {out}_co co ON co.a = x.s AND co.b = y.s
)"""


def strat_split_sql(src: str) -> str:
    return f"""
rk AS (
  SELECT *, row_number() OVER (PARTITION BY Partner_id ORDER BY {hash_key_sql('row_key')}, row_key) AS rn,
         count(*) OVER (PARTITION BY Partner_id) AS n_p
  FROM {src}
),
train AS (SELECT * FROM rk WHERE rn <= ceil(n_p * 80 / 100.0)),
test AS (SELECT * FROM rk WHERE rn > ceil(n_p * 80 / 100.0))"""


def arr_text_sql(expr: str, order: str) -> str:
    return f"string_agg(CAST({expr} AS VARCHAR), ', ' ORDER BY {order})"


def arr_fixed_sql(expr: str, order: str) -> str:
    return f"string_agg({fixed_text_sql(expr)}, ', ' ORDER BY {order})"


# ---------------------------------------------------------- direct: user

USER_BASED_TAIL = """,
eng AS (SELECT *, ln(1 + Sales_Value_Last_Period) * (Feedback_Score + Growth_Percentage) AS Engagement_Score
        FROM stockist),""" + strat_split_sql("eng") + """,
m AS (SELECT Partner_id AS id, Scheme_Type AS dim, sum(Engagement_Score) AS val FROM train GROUP BY Partner_id, Scheme_Type),
""" + cosine_sql("m", "sims").lstrip() + "," + topk_sql("sims", "nn", 1) + """,
cnt AS (SELECT Partner_id, Scheme_Type, count(*) AS cnt FROM train GROUP BY Partner_id, Scheme_Type),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Partner_id ORDER BY cnt DESC, Scheme_Type) AS r
        FROM cnt) x WHERE r <= 3),
sl AS (SELECT Partner_id, max(CASE WHEN r = 1 THEN Scheme_Type END) AS s1,
              max(CASE WHEN r = 2 THEN Scheme_Type END) AS s2, max(CASE WHEN r = 3 THEN Scheme_Type END) AS s3
       FROM top GROUP BY Partner_id),
fp AS (SELECT Partner_id, arg_min(Product_id, row_key) AS Product_id FROM train GROUP BY Partner_id),
tp AS (SELECT DISTINCT Partner_id FROM test),
ub AS (
SELECT tp.Partner_id, fp.Product_id, nn.sim AS Similarity_Score,
       coalesce(sl.s1, 'No Scheme') AS Scheme_1, coalesce(sl.s2, 'No Scheme') AS Scheme_2,
       coalesce(sl.s3, 'No Scheme') AS Scheme_3
FROM tp JOIN nn ON tp.Partner_id = nn.qid
JOIN fp ON fp.Partner_id = tp.Partner_id
LEFT JOIN sl ON sl.Partner_id = nn.cid)"""
USER_BASED_CTE = "WITH" + stockist_long_sql() + USER_BASED_TAIL
USER_BASED_CUSTOMERS_CTE = "WITH" + stockist_long_sql(partner="customer") + USER_BASED_TAIL
USER_BASED_SQL = USER_BASED_CTE + "\nSELECT * FROM ub"

USER_COLS = [("Partner_id", "int"), ("Product_id", "text"), ("Similarity_Score", "double"),
             ("Scheme_1", "text"), ("Scheme_2", "text"), ("Scheme_3", "text")]


@register("rec_user_based", sql_final(USER_BASED_SQL, USER_COLS))
def q_rec_user_based(spark, d):
    """Direct user-based scheme recommendation for every test partner (dense supplier binding)."""
    return finalize(rc.rec_user_based(stockist_long(spark, d)))


@register("nearest_neighbor", sql_final("WITH" + stockist_long_sql() + """,
eng AS (SELECT *, ln(1 + Sales_Value_Last_Period) * (Feedback_Score + Growth_Percentage) AS Engagement_Score
        FROM stockist),""" + strat_split_sql("eng") + """,
m AS (SELECT Partner_id AS id, Scheme_Type AS dim, sum(Engagement_Score) AS val FROM train GROUP BY Partner_id, Scheme_Type),
""" + cosine_sql("m", "sims").lstrip() + "," + topk_sql("sims", "nn", 1) + """
SELECT qid AS Partner_id, cid AS Neighbour_id, sim AS Similarity_Score FROM nn""",
    [("Partner_id", "int"), ("Neighbour_id", "int"), ("Similarity_Score", "double")]))
def q_nearest_neighbor(spark, d):
    """Rank-1 cosine neighbour of every partner on the engagement-by-scheme matrix."""
    from partnerlens.operators.similarity import cosine_topk
    train, _ = rc.user_split(stockist_long(spark, d))
    nn = cosine_topk(rc.scheme_matrix(train), 1)
    return finalize(nn.select(F.col("qid").alias("Partner_id"), F.col("cid").alias("Neighbour_id"),
                              F.col("sim").alias("Similarity_Score")))


COSINE_PAIRS_SQL = "WITH" + PURCHASES_SQL + """,
v AS (SELECT Partner_id AS id, Product_id AS dim, CAST(1 AS DOUBLE) AS val FROM purchases),
""" + cosine_sql("v", "sims").lstrip() + "," + topk_sql("sims", "nn", 5) + """
SELECT qid, cid, sim, rank FROM nn"""


@register("cosine_pairs", sql_final(COSINE_PAIRS_SQL, [("qid", "int"), ("cid", "int"), ("sim", "double"),
                                                       ("rank", "int")]))
def q_cosine_pairs(spark, d):
    """Exact 5 nearest partners by cosine on product flags, for every partner (sparse binding)."""
    from partnerlens.operators.similarity import cosine_topk
    return finalize(cosine_topk(rc.product_vectors(purchases(spark, d)), 5))


# ---------------------------------------------------------- direct: item

def _item_based_sql(partner: str, by: str) -> str:
    return "WITH" + stockist_long_sql(partner=partner) + f""",
train AS (SELECT * FROM stockist WHERE {hash_pct_sql('row_key')} >= 20),
test AS (SELECT * FROM stockist WHERE {hash_pct_sql('row_key')} < 20),
""" + jaccard_all_sql("train", "Scheme_Type", by, "jac").lstrip() + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM jac) x
        WHERE r <= 3),
ps AS (SELECT a AS Scheme_Type, avg(sim) AS Similarity_Scores,
              max(CASE WHEN r = 1 THEN b END) AS Scheme_1, max(CASE WHEN r = 2 THEN b END) AS Scheme_2,
              max(CASE WHEN r = 3 THEN b END) AS Scheme_3 FROM top GROUP BY a),
pst AS (SELECT DISTINCT Product_id, Scheme_Type FROM test),
rec AS (SELECT pst.Product_id, ps.* FROM pst JOIN ps ON pst.Scheme_Type = ps.Scheme_Type)
SELECT t.Partner_id, t.Product_id, rec.Similarity_Scores, rec.Scheme_1, rec.Scheme_2, rec.Scheme_3
FROM (SELECT DISTINCT Partner_id, Product_id FROM test) t JOIN rec ON t.Product_id = rec.Product_id"""


ITEM_COLS = [("Partner_id", "int"), ("Product_id", "text"), ("Similarity_Scores", "double"),
             ("Scheme_1", "text"), ("Scheme_2", "text"), ("Scheme_3", "text")]


@register("rec_item_based", sql_final(_item_based_sql("supplier", "Product_id"), ITEM_COLS))
def q_rec_item_based(spark, d):
    """Direct item-based (scheme Jaccard) recommendations joined back to test partners."""
    return finalize(rc.rec_item_based(stockist_long(spark, d)).drop("Scheme_Type"))


@register("rec_item_based_partners", sql_final(_item_based_sql("customer", "Partner_id"), ITEM_COLS))
def q_rec_item_based_partners(spark, d):
    """Item-based recommendations with schemes compared by the partners that use them, so that scores differ."""
    rows = stockist_long(spark, d, partner="customer")
    return finalize(rc.rec_item_based(rows, by="Partner_id").drop("Scheme_Type"))


def _scheme_users(spark, d):
    """Sale lines with the partner as the item of a scheme: schemes are alike when the same partners use them."""
    return stockist_long(spark, d, partner="customer").withColumn("Product_id", F.col("Partner_id"))


@register("jaccard_schemes", sql_final("WITH" + stockist_long_sql(partner="customer") + f""",
train AS (SELECT * FROM stockist WHERE {hash_pct_sql('row_key')} >= 20),
""" + jaccard_all_sql("train", "Scheme_Type", "Partner_id", "jac").lstrip() + """
SELECT a, b, sim AS jaccard FROM jac WHERE sim > 0""", [("a", "text"), ("b", "text"), ("jaccard", "double")]))
def q_jaccard_schemes(spark, d):
    """Scheme x scheme Jaccard on the partners that use each scheme (train split)."""
    train, _ = split_random(_scheme_users(spark, d), "row_key")
    return finalize(rc.scheme_similarity(train).select("a", "b", "jaccard"))


SIMILAR_SCHEMES_SQL = "WITH" + stockist_long_sql(partner="customer") + f""",
train AS (SELECT * FROM stockist WHERE {hash_pct_sql('row_key')} >= 20),
""" + jaccard_all_sql("train", "Scheme_Type", "Partner_id", "jac").lstrip() + """
SELECT a AS scheme, b AS similar_scheme, sim, r AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM jac) x WHERE r <= 3"""


@register("similar_schemes", sql_final(SIMILAR_SCHEMES_SQL, [
    ("scheme", "text"), ("similar_scheme", "text"), ("sim", "double"), ("rank", "int")]))
def q_similar_schemes(spark, d):
    """Top-3 most similar schemes for every scheme (self excluded, zero similarities filled by name)."""
    train, _ = split_random(_scheme_users(spark, d), "row_key")
    top = rc.similar_schemes(train)
    return finalize(top.select(F.col("a").alias("scheme"), F.col("b").alias("similar_scheme"), "sim", "rank"))


# ------------------------------------------------------- indirect: kNN

KNN_PRODUCTS_SQL = "WITH" + PURCHASES_SQL + """,
v AS (SELECT Partner_id AS id, Product_id AS dim, CAST(1 AS DOUBLE) AS val FROM purchases),
""" + cosine_sql("v", "sims").lstrip() + "," + topk_sql("sims", "nn", 5) + """,
cand AS (SELECT n.qid AS Partner_id, p.Product_id, sum(n.sim) AS score
         FROM nn n JOIN purchases p ON p.Partner_id = n.cid GROUP BY n.qid, p.Product_id HAVING sum(n.sim) > 0),
cand2 AS (SELECT * FROM cand c WHERE NOT EXISTS (
          SELECT 1 FROM purchases p WHERE p.Partner_id = c.Partner_id AND p.Product_id = c.Product_id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Partner_id ORDER BY round(score, 9) DESC, Product_id) AS r
        FROM cand2) x WHERE r <= 3),
recs AS (SELECT Partner_id, """ + arr_text_sql("Product_id", "r") + """ AS Recommended_Products,
                """ + arr_fixed_sql("score", "r") + """ AS Similarity_Scores FROM top GROUP BY Partner_id),
recs_all AS (
  SELECT p.Partner_id, coalesce(r.Recommended_Products, '') AS Recommended_Products,
         coalesce(r.Similarity_Scores, '') AS Similarity_Scores
  FROM (SELECT DISTINCT Partner_id FROM purchases) p LEFT JOIN recs r ON p.Partner_id = r.Partner_id)"""


@register("rec_products_knn", sql_final(KNN_PRODUCTS_SQL + "\nSELECT * FROM recs_all", [
    ("Partner_id", "int"), ("Recommended_Products", "text"), ("Similarity_Scores", "text")]))
def q_rec_products_knn(spark, d):
    """Indirect user-based product recommendations (5 nearest partners) with scores, all partners."""
    return finalize(rc.rec_products_knn(purchases(spark, d)))


TOGGLE_SQL = "WITH" + PURCHASES_SQL + f""",
parts AS (SELECT DISTINCT Partner_id FROM purchases),
trp AS (SELECT Partner_id FROM parts WHERE {hash_pct_sql('Partner_id')} >= 20),
tep AS (SELECT Partner_id FROM parts WHERE {hash_pct_sql('Partner_id')} < 20),
vtr AS (SELECT Partner_id AS id, Product_id AS dim, CAST(1 AS DOUBLE) AS val FROM purchases WHERE Partner_id IN (SELECT Partner_id FROM trp)),
vte AS (SELECT Partner_id AS id, Product_id AS dim, CAST(1 AS DOUBLE) AS val FROM purchases WHERE Partner_id IN (SELECT Partner_id FROM tep)),
""" + cosine_sql("vtr", "sims", query="vte", exclude_self=False).lstrip() + "," + topk_sql("sims", "nn", 5) + """,
cand AS (SELECT n.qid AS Partner_id, v.dim AS Product_id, min(n.rank) AS first_rank
         FROM nn n JOIN vtr v ON v.id = n.cid GROUP BY n.qid, v.dim),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Partner_id ORDER BY first_rank, Product_id) AS r
        FROM cand) x WHERE r <= 3),
recs AS (SELECT Partner_id, """ + arr_text_sql("Product_id", "r") + """ AS Recommended_Products FROM top GROUP BY Partner_id),
tog AS (SELECT t.Partner_id, coalesce(r.Recommended_Products, '') AS Recommended_Products
        FROM tep t LEFT JOIN recs r ON t.Partner_id = r.Partner_id)"""
TOGGLE_CTE = TOGGLE_SQL
TOGGLE_SQL = TOGGLE_CTE + "\nSELECT * FROM tog"


@register("rec_products_knn_toggle", sql_final(TOGGLE_SQL, [("Partner_id", "int"), ("Recommended_Products", "text")]))
def q_rec_products_knn_toggle(spark, d):
    """Test partners vs train partners: neighbours' products in neighbour order, de-duplicated, first 3."""
    return finalize(rc.rec_products_knn_toggle(purchases(spark, d)))


def jaccard_products_cte(include_purchased: bool) -> str:
    excl = "" if include_purchased else """
    AND NOT EXISTS (SELECT 1 FROM test t2 WHERE t2.Partner_id = t.Partner_id AND t2.Product_id = s.b)"""
    return "WITH" + PURCHASES_SQL + f""",
parts AS (SELECT DISTINCT Partner_id FROM purchases),
train AS (SELECT * FROM purchases WHERE {hash_pct_sql('Partner_id')} >= 20),
test AS (SELECT * FROM purchases WHERE {hash_pct_sql('Partner_id')} < 20),
""" + jaccard_all_sql("train", "Product_id", "Partner_id", "jac").lstrip() + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM jac) x WHERE r <= 3),
cand AS (SELECT t.Partner_id, s.b AS Product_id, max(s.sim) AS score
         FROM test t JOIN top s ON s.a = t.Product_id""" + excl + """
         GROUP BY t.Partner_id, s.b),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Partner_id ORDER BY round(score, 9) DESC, Product_id) AS r
         FROM cand) x WHERE r <= 3),
recs AS (SELECT Partner_id, """ + arr_text_sql("Product_id", "r") + """ AS Recommended_Products,
                """ + arr_fixed_sql("score", "r") + """ AS Similarity_Scores FROM best GROUP BY Partner_id),
jrec AS (SELECT t.Partner_id, coalesce(r.Recommended_Products, '') AS Recommended_Products,
       coalesce(r.Similarity_Scores, '') AS Similarity_Scores
FROM (SELECT DISTINCT Partner_id FROM test) t LEFT JOIN recs r ON t.Partner_id = r.Partner_id)"""


def _jaccard_products_sql(include_purchased: bool) -> str:
    return jaccard_products_cte(include_purchased) + "\nSELECT * FROM jrec"


REC_COLS3 = [("Partner_id", "int"), ("Recommended_Products", "text"), ("Similarity_Scores", "text")]


@register("rec_products_jaccard", sql_final(_jaccard_products_sql(True), REC_COLS3))
def q_rec_products_jaccard(spark, d):
    """Indirect item-based product recommendations (product Jaccard), purchased products allowed."""
    return finalize(rc.rec_products_jaccard(purchases(spark, d), include_purchased=True))


@register("toggle_purchased", sql_final(_jaccard_products_sql(False), REC_COLS3))
def q_toggle_purchased(spark, d):
    """Same recommender with already purchased products excluded (left-anti join)."""
    return finalize(rc.rec_products_jaccard(purchases(spark, d), include_purchased=False))


@register("jaccard_products", sql_final("WITH" + PURCHASES_SQL + f""",
train AS (SELECT * FROM purchases WHERE {hash_pct_sql('Partner_id')} >= 20),
""" + jaccard_all_sql("train", "Product_id", "Partner_id", "jac").lstrip() + """
SELECT a, b, sim AS jaccard FROM jac WHERE sim > 0""", [("a", "text"), ("b", "text"), ("jaccard", "double")]))
def q_jaccard_products(spark, d):
    """Product x product Jaccard on the partners holding them (train partners)."""
    p = purchases(spark, d)
    train_p, _ = split_random(p.select("Partner_id").distinct(), "Partner_id")
    train = p.join(train_p, "Partner_id", "left_semi")
    return finalize(rc.product_similarity(train).select("a", "b", "jaccard"))


@register("similar_products", sql_final("WITH" + PURCHASES_SQL + f""",
train AS (SELECT * FROM purchases WHERE {hash_pct_sql('Partner_id')} >= 20),
""" + jaccard_all_sql("train", "Product_id", "Partner_id", "jac").lstrip() + """
SELECT a AS product, b AS similar_product, sim, r AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM jac) x WHERE r <= 3""",
    [("product", "text"), ("similar_product", "text"), ("sim", "double"), ("rank", "int")]))
def q_similar_products(spark, d):
    """Top-3 most similar products of every product (self removed by id)."""
    p = purchases(spark, d)
    train_p, _ = split_random(p.select("Partner_id").distinct(), "Partner_id")
    top = rc.similar_products(p.join(train_p, "Partner_id", "left_semi"))
    return finalize(top.select(F.col("a").alias("product"), F.col("b").alias("similar_product"), "sim", "rank"))
