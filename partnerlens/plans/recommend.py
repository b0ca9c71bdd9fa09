"""Scheme and product recommenders (direct and indirect approaches).

All partners are handled by one plan; the reference's per-partner Python
loops become a kNN/co-occurrence job plus window rankings over bounded
candidate sets (a partner's schemes, a product's neighbours).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from partnerlens.functions.scalar import PAD_NO_SCHEME, fn_engagement
from partnerlens.operators.ranking import ranked_arrays, slots, topn_per_group
from partnerlens.operators.similarity import cosine_topk, jaccard_pairs, topn_similar
from partnerlens.operators.split import flag_stratified, split_random
from partnerlens.session import stored, stored_by

TOP_N = 3           # fixed value: recommendations per partner / product
KNN_NEIGHBOURS = 5  # fixed value: neighbours used by the product recommender
SCORE_DIGITS = 9    # summed similarities are ranked after rounding, so that equal
                    # sums added in a different order still tie (then name order)


# ------------------------------------------------------------ direct, user

def engagement_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("Engagement_Score", fn_engagement("Sales_Value_Last_Period", "Feedback_Score",
                                                             "Growth_Percentage"))


def scheme_matrix(train: DataFrame, value: str = "Engagement_Score") -> DataFrame:
    """Long partner x scheme matrix: sum of engagement (missing cells = 0)."""
    return (train.groupBy("Partner_id", "Scheme_Type")
            .agg(F.sum(value).alias("val"))
            .select(F.col("Partner_id").alias("id"), F.col("Scheme_Type").alias("dim"), "val"))


def top_schemes_by_count(train: DataFrame, n: int = TOP_N) -> DataFrame:
    """value_counts per partner -> ranked (Partner_id, Scheme_Type, rank)."""
    counts = train.groupBy("Partner_id", "Scheme_Type").agg(F.count(F.lit(1)).alias("cnt"))
    return topn_per_group(counts, ["Partner_id"], [F.col("cnt").desc(), F.col("Scheme_Type").asc()], n)


def first_product(train: DataFrame, order_key: str = "row_key") -> DataFrame:
    """First product of each partner in record order (order key explicit)."""
    return train.groupBy("Partner_id").agg(F.min_by("Product_id", order_key).alias("Product_id"))


def rec_user_based(rows: DataFrame, n: int = TOP_N, pad: str = PAD_NO_SCHEME) -> DataFrame:
    """Per test partner: own first product, the nearest partner's cosine
    similarity (engagement by scheme) and that partner's n most used schemes."""
    train, test = user_split(rows)
    return rec_user_based_split(train, test, n, pad)


USER_COLUMNS = ["row_key", "Partner_id", "Product_id", "Scheme_Type", "Sales_Value_Last_Period", "Feedback_Score", "Growth_Percentage"]


def user_split(rows: DataFrame, parts: int = 0) -> tuple[DataFrame, DataFrame]:
    """Engagement rows split 80/20 inside every partner.  The narrow rows are
    stored once in the shared checkpoint folder: the matrix, the
    neighbours' schemes, first products and test partners all read them.
    ``parts``: rows are dealt by partner into so many buckets first (0: shuffled)."""
    narrow = engagement_rows(rows).select("row_key", "Partner_id", "Product_id", "Scheme_Type",
                                          "Engagement_Score")
    flagged = stored(flag_stratified(stored_by(narrow, parts, "Partner_id") if parts else narrow, "row_key", "Partner_id"))
    return (flagged.filter(F.col("is_train")).drop("is_train"),
            flagged.filter(~F.col("is_train")).drop("is_train"))


def rec_user_based_split(train: DataFrame, test: DataFrame, n: int = TOP_N,
                         pad: str = PAD_NO_SCHEME) -> DataFrame:
    """``rec_user_based`` on an existing split (rows carry Engagement_Score)."""
    nn = (cosine_topk(scheme_matrix(train), 1)
          .select(F.col("qid").alias("Partner_id"), F.col("cid").alias("Neighbour_id"),
                  F.col("sim").alias("Similarity_Score")))
    schemes = slots(top_schemes_by_count(train, n), ["Partner_id"], "Scheme_Type", n, pad=pad) \
        .withColumnRenamed("Partner_id", "Neighbour_id")
    test_partners = test.select("Partner_id").distinct()
    return (test_partners.join(nn, "Partner_id")
            .join(first_product(train), "Partner_id")
            .join(schemes, "Neighbour_id", "left")
            .select("Partner_id", "Product_id", "Similarity_Score",
                    *[F.coalesce(F.col(f"Scheme_{i}"), F.lit(pad)).alias(f"Scheme_{i}") for i in range(1, n + 1)]))


# ------------------------------------------------------------ direct, item

def scheme_similarity(train: DataFrame, by: str = "Product_id") -> DataFrame:
    """Scheme x scheme Jaccard over the products each scheme covers (or the
    values of ``by``, such as the partners that use it)."""
    return jaccard_pairs(train, "Scheme_Type", by)


def similar_schemes(train: DataFrame, n: int = TOP_N, by: str = "Product_id") -> DataFrame:
    """Top-n similar schemes per scheme (a, b, sim, rank), zeros included."""
    universe = train.select(F.col("Scheme_Type").alias("item")).distinct()
    return topn_similar(scheme_similarity(train, by), universe, n)


def rec_item_based(rows: DataFrame, n: int = TOP_N, by: str = "Product_id") -> DataFrame:
    """Per (partner, product) of the test split: for each scheme used with
    the product in test, the n most similar schemes and their mean Jaccard
    (over products, or over ``by``: where every scheme covers every product,
    the partners that use a scheme tell schemes apart)."""
    train, test = split_random(rows, "row_key")
    top = similar_schemes(train, n, by)
    per_scheme = (top.groupBy("a")
                  .agg(F.avg("sim").alias("Similarity_Scores"),
                       *[F.max(F.when(F.col("rank") == i, F.col("b"))).alias(f"Scheme_{i}")
                         for i in range(1, n + 1)])
                  .withColumnRenamed("a", "Scheme_Type"))
    prod_scheme = test.select("Product_id", "Scheme_Type").distinct()
    rec = prod_scheme.join(per_scheme, "Scheme_Type")          # unknown schemes skipped
    return (test.select("Partner_id", "Product_id").distinct()
            .join(rec, "Product_id")                             # inner, many-to-many
            .select("Partner_id", "Product_id", "Similarity_Scores",
                    *[f"Scheme_{i}" for i in range(1, n + 1)], "Scheme_Type"))


# --------------------------------------------------------- indirect, kNN

def product_vectors(purchases: DataFrame) -> DataFrame:
    return purchases.select(F.col("Partner_id").alias("id"), F.col("Product_id").alias("dim"),
                            F.lit(1.0).alias("val"))


def rec_products_knn(purchases: DataFrame, k: int = KNN_NEIGHBOURS, n: int = TOP_N,
                     include_purchased: bool = False) -> DataFrame:
    """Per partner: k nearest partners (cosine on product flags); product
    score = sum of neighbour similarity over neighbours holding it; own
    products removed; n best products with positive score, with scores."""
    nn = cosine_topk(product_vectors(purchases), k)
    cand = (nn.join(purchases.select(F.col("Partner_id").alias("cid"), "Product_id"), "cid")
            .groupBy(F.col("qid").alias("Partner_id"), "Product_id")
            .agg(F.sum("sim").alias("score"))
            .filter(F.col("score") > 0))
    if not include_purchased:
        cand = cand.join(purchases.select("Partner_id", "Product_id"), ["Partner_id", "Product_id"], "left_anti")
    top = topn_per_group(cand, ["Partner_id"], [F.round("score", SCORE_DIGITS).desc(), F.col("Product_id").asc()], n)
    recs = ranked_arrays(top, ["Partner_id"], {"Recommended_Products": "Product_id",
                                               "Similarity_Scores": "score"})
    partners = purchases.select("Partner_id").distinct()
    return (partners.join(recs, "Partner_id", "left")
            .select("Partner_id",
                    F.coalesce("Recommended_Products", F.array().cast("array<string>")).alias("Recommended_Products"),
                    F.coalesce("Similarity_Scores", F.array().cast("array<double>")).alias("Similarity_Scores")))


def rec_products_knn_toggle(purchases: DataFrame, k: int = KNN_NEIGHBOURS, n: int = TOP_N,
                            include_purchased: bool = True) -> DataFrame:
    """Test partners against train partners only: products of the k nearest
    train partners in neighbour order (name order inside a neighbour),
    repeats dropped keeping the first, cut to n; purchased ones optional."""
    partners = purchases.select("Partner_id").distinct()
    train_p, test_p = split_random(partners, "Partner_id")
    train = purchases.join(train_p, "Partner_id", "left_semi")
    test = purchases.join(test_p, "Partner_id", "left_semi")
    nn = cosine_topk(product_vectors(train), k, query=product_vectors(test), exclude_self=False)
    cand = (nn.join(train.select(F.col("Partner_id").alias("cid"), "Product_id"), "cid")
            .groupBy(F.col("qid").alias("Partner_id"), "Product_id")
            .agg(F.min("rank").alias("first_rank")))
    if not include_purchased:
        cand = cand.join(test.select("Partner_id", "Product_id"), ["Partner_id", "Product_id"], "left_anti")
    top = topn_per_group(cand, ["Partner_id"], [F.col("first_rank").asc(), F.col("Product_id").asc()], n)
    recs = ranked_arrays(top, ["Partner_id"], {"Recommended_Products": "Product_id"})
    return (test_p.join(recs, "Partner_id", "left")
            .select("Partner_id", F.coalesce("Recommended_Products", F.array().cast("array<string>"))
                    .alias("Recommended_Products")))


# ----------------------------------------------------- indirect, Jaccard

def product_similarity(train: DataFrame) -> DataFrame:
    """Product x product Jaccard over the partners holding them."""
    return jaccard_pairs(train, "Product_id", "Partner_id")


def similar_products(train: DataFrame, n: int = TOP_N) -> DataFrame:
    universe = train.select(F.col("Product_id").alias("item")).distinct()
    return topn_similar(product_similarity(train), universe, n)


def rec_products_jaccard(purchases: DataFrame, n: int = TOP_N, include_purchased: bool = True) -> DataFrame:
    """Per test partner: union of the n most similar products of each
    purchased product, ranked by the best similarity that brought it in,
    first n with aligned scores."""
    partners = purchases.select("Partner_id").distinct()
    train_p, test_p = split_random(partners, "Partner_id")
    train = purchases.join(train_p, "Partner_id", "left_semi")
    test = purchases.join(test_p, "Partner_id", "left_semi")
    top = similar_products(train, n).select(F.col("a").alias("Bought"), F.col("b").alias("Product_id"), "sim")
    cand = (test.select("Partner_id", F.col("Product_id").alias("Bought"))
            .join(top, "Bought")
            .groupBy("Partner_id", "Product_id").agg(F.max("sim").alias("score")))
    if not include_purchased:
        cand = cand.join(test.select("Partner_id", "Product_id"), ["Partner_id", "Product_id"], "left_anti")
    best = topn_per_group(cand, ["Partner_id"], [F.round("score", SCORE_DIGITS).desc(), F.col("Product_id").asc()], n)
    recs = ranked_arrays(best, ["Partner_id"], {"Recommended_Products": "Product_id",
                                                "Similarity_Scores": "score"})
    return (test_p.join(recs, "Partner_id", "left")
            .select("Partner_id",
                    F.coalesce("Recommended_Products", F.array().cast("array<string>")).alias("Recommended_Products"),
                    F.coalesce("Similarity_Scores", F.array().cast("array<double>")).alias("Similarity_Scores")))
