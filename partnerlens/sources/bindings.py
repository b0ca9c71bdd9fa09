"""Binding of the driver's TPC-H-like tables to the reference's columns.

The reference ships no input data; its jobs read a channel-partner sales
sheet.  Every job here reads the driver's tables through one of the
bindings below, and each binding has an SQL twin (``*_SQL``) that the
DuckDB oracle queries use, so both sides see the same rows.

Binding (fixed; shared by Spark and SQL):

  Partner_id (dense)      l_suppkey
  Partner_id (sparse)     o_custkey, purchase := l_returnflag = 'N' (not returned)
  Scheme_Type             o_orderpriority
  Product_id              p_brand (recommenders), p_type (time series)
  Geography               r_name via customer -> nation -> region
  Stockist_Type           c_mktsegment
  Sales_Value_Last_Period l_extendedprice
  Sales_Quantity          l_quantity
  MRP / Price             l_extendedprice / l_quantity
  Competitor_Price        p_retailprice * (1 + l_tax)
  Discount_Applied        l_discount * 100
  Feedback_Score          1 + l_tax * 50
  Growth_Percentage       (l_linenumber - 4) * 5
  Date                    o_orderdate
  row key                 text of the whole line (order, line number, part, supplier,
                          amounts in cents, flags, ship date): (l_orderkey,
                          l_linenumber) alone repeats in the driver's data
  Feedback_Text/Sentiment documents.text / labels.quality (1 -> Positive)
  Feedback partner        1 + doc_id mod (number of suppliers)
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from partnerlens.session import stored_by
from partnerlens.sources.tables import table

LINES_PART = 1 << 21    # lines of a bucket


def _geo(spark: SparkSession, d: str) -> DataFrame:
    """customer -> region name.  nation (25 rows) and region (5 rows) are
    broadcast by the planner's own size check (autoBroadcastJoinThreshold on
    file statistics, re-checked by AQE on runtime sizes); no hint needed."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    return (table(spark, d, "customer")
            .select("c_custkey", "c_nationkey", "c_mktsegment")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("c_custkey", "c_mktsegment", "r_name"))


def row_key():
    """Identity of a sale line, identical in Spark and DuckDB text form."""
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").cast("string")
    return F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                       F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                       cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"),
                       F.col("l_returnflag"), F.col("l_linestatus"), F.date_format("l_shipdate", "yyyy-MM-dd"))


ROW_KEY_SQL = ("concat_ws('|', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR), "
               "CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR), "
               "CAST(CAST(round(l.l_quantity * 100) AS BIGINT) AS VARCHAR), "
               "CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS VARCHAR), "
               "CAST(CAST(round(l.l_discount * 100) AS BIGINT) AS VARCHAR), "
               "CAST(CAST(round(l.l_tax * 100) AS BIGINT) AS VARCHAR), "
               "l.l_returnflag, l.l_linestatus, strftime(l.l_shipdate, '%Y-%m-%d'))")


def _lines(spark: SparkSession, d: str, purchase_only: bool = False) -> DataFrame:
    """Sale lines with their order and its customer.  Orders meet their
    customers before the lines, which are many times more, so that lines are
    shuffled for their order and their part only."""
    li = table(spark, d, "lineitem")
    if purchase_only:
        li = li.filter(F.col("l_returnflag") == "N")
    orders = (table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
              .join(_geo(spark, d), F.col("o_custkey") == F.col("c_custkey")))
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def dated_sales(spark: SparkSession, d: str) -> DataFrame:
    """I1 in long form: one row per sale line, product = part type."""
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    return (_lines(spark, d)
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_suppkey").alias("Partner_id"),
                    F.col("p_type").alias("Product_id"),
                    F.col("o_orderdate").alias("Date"),
                    F.try_divide("l_extendedprice", "l_quantity").alias("Price"),
                    F.col("l_quantity").alias("Demand"),
                    (F.col("l_discount") * 100).alias("Discount"),
                    F.col("r_name").alias("Geography"),
                    (F.col("p_retailprice") * (1 + F.col("l_tax"))).alias("Competitor_Price")))


DATED_SALES_SQL = """
dated_sales AS (
  SELECT l.l_suppkey AS Partner_id, p.p_type AS Product_id, o.o_orderdate AS Date,
         l.l_extendedprice / l.l_quantity AS Price, l.l_quantity AS Demand,
         l.l_discount * 100 AS Discount, r.r_name AS Geography,
         p.p_retailprice * (1 + l.l_tax) AS Competitor_Price
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


def stockist_long(spark: SparkSession, d: str, purchase_only: bool = False,
                  partner: str = "supplier") -> DataFrame:
    """I3: one record per sale line with partner, product (brand), scheme.

    ``partner='supplier'`` is the dense binding (every supplier uses every
    scheme); ``partner='customer'`` with ``purchase_only`` the sparse one.
    """
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return _stockist(_lines(spark, d, purchase_only).join(part, F.col("l_partkey") == F.col("p_partkey")), partner)


def _stockist(lines: DataFrame, partner: str) -> DataFrame:
    pid = F.col("l_suppkey") if partner == "supplier" else F.col("o_custkey")
    return (lines.select(row_key().alias("row_key"),
                    pid.alias("Partner_id"),
                    F.col("p_brand").alias("Product_id"),
                    F.col("o_orderpriority").alias("Scheme_Type"),
                    F.col("l_extendedprice").alias("Sales_Value_Last_Period"),
                    F.col("l_quantity").alias("Sales_Quantity_Last_Period"),
                    F.try_divide("l_extendedprice", "l_quantity").alias("MRP"),
                    (F.col("l_discount") * 100).alias("Discount_Applied"),
                    (1 + F.col("l_tax") * 50).alias("Feedback_Score"),
                    ((F.col("l_linenumber") - 4) * 5).cast("double").alias("Growth_Percentage"),
                    F.col("r_name").alias("Geography"),
                    F.col("c_mktsegment").alias("Stockist_Type")))


LINES_OF = {        # columns of a line that a column of stockist_long is made of
    "row_key": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "Sales_Value_Last_Period": ("l_extendedprice",), "Sales_Quantity_Last_Period": ("l_quantity",),
    "MRP": ("l_extendedprice", "l_quantity"), "Discount_Applied": ("l_discount",), "Feedback_Score": ("l_tax",),
    "Growth_Percentage": ("l_linenumber",)}
OTHERS_OF = {"Product_id": "p_brand", "Scheme_Type": "o_orderpriority", "Geography": "r_name", "Stockist_Type": "c_mktsegment"}


def stockist_dealt(spark: SparkSession, d: str, columns: list[str], purchase_only: bool = False,
                   partner: str = "supplier") -> tuple[DataFrame, int]:
    """(rows, parts): these columns of ``stockist_long``.  From ``LINES_PART`` lines
    on, lines meet their order and their part in tables dealt by key
    (``stored_by``), of ``parts`` buckets; below, parts is 0."""
    li = table(spark, d, "lineitem")
    if purchase_only:
        li = li.filter(F.col("l_returnflag") == "N")
    parts = math.ceil(li.count() / LINES_PART)
    if parts < 2:
        return stockist_long(spark, d, purchase_only, partner).select(*columns), 0
    own = {x for c in columns for x in LINES_OF.get(c, ())}
    other = {OTHERS_OF[c] for c in columns if c in OTHERS_OF}
    if "Partner_id" in columns:
        (own if partner == "supplier" else other).add("l_suppkey" if partner == "supplier" else "o_custkey")
    keys = ["l_orderkey", "l_partkey"]
    lines = stored_by(li.dropna(subset=keys).select(*keys, *sorted(own - set(keys))), parts, "l_orderkey")
    orders = (table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
              .join(_geo(spark, d), F.col("o_custkey") == F.col("c_custkey")))
    from_order = sorted(other - {"p_brand"})
    orders = stored_by(orders.select("o_orderkey", *from_order), parts, "o_orderkey")
    placed = stored_by(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                       .select("l_partkey", *sorted(own - {"l_partkey"}), *from_order), parts, "l_partkey")
    part = stored_by(table(spark, d, "part").select("p_partkey", *sorted(other & {"p_brand"})), parts, "p_partkey")
    found = placed.join(part, F.col("l_partkey") == F.col("p_partkey"))
    # what the columns asked for do not need is not read
    absent = [x for v in LINES_OF.values() for x in v] + [*OTHERS_OF.values(), "l_suppkey", "o_custkey"]
    kinds = {f.name: f.dataType for t in ("lineitem", "orders", "part", "region", "customer")
             for f in table(spark, d, t).schema.fields}
    found = found.withColumns({x: F.lit(None).cast(kinds[x]) for x in dict.fromkeys(absent) if x not in found.columns})
    return _stockist(found, partner).select(*columns), parts


def stockist_long_sql(purchase_only: bool = False, partner: str = "supplier",
                      name: str = "stockist") -> str:
    pid = "l.l_suppkey" if partner == "supplier" else "o.o_custkey"
    where = "WHERE l.l_returnflag = 'N'" if purchase_only else ""
    return f"""
{name} AS (
  SELECT {ROW_KEY_SQL} AS row_key, {pid} AS Partner_id,
         p.p_brand AS Product_id, o.o_orderpriority AS Scheme_Type,
         l.l_extendedprice AS Sales_Value_Last_Period,
         l.l_quantity AS Sales_Quantity_Last_Period,
         l.l_extendedprice / l.l_quantity AS MRP,
         l.l_discount * 100 AS Discount_Applied,
         1 + l.l_tax * 50 AS Feedback_Score,
         CAST((l.l_linenumber - 4) * 5 AS DOUBLE) AS Growth_Percentage,
         r.r_name AS Geography, c.c_mktsegment AS Stockist_Type
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  {where}
)"""


def purchases(spark: SparkSession, d: str) -> DataFrame:
    """Sparse partner x product binary relation (distinct pairs)."""
    return (stockist_long(spark, d, purchase_only=True, partner="customer")
            .select("Partner_id", "Product_id").distinct())


PURCHASES_SQL = stockist_long_sql(True, "customer", "purchase_rows") + """,
purchases AS (SELECT DISTINCT Partner_id, Product_id FROM purchase_rows)"""


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """I5: all feedback texts with a bound partner; Sentiment is null where
    nobody labelled the text."""
    n_sup = table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    docs = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id", "left")
            .select(F.col("doc_id").alias("Feedback_ID"),
                    F.col("text").alias("Feedback_Text"),
                    F.when(F.col("quality") == 1, "Positive").when(F.col("quality").isNotNull(), "Negative").alias("Sentiment"),
                    (F.pmod(F.col("doc_id"), n_sup) + 1).alias("Partner_id")))


FEEDBACK_SQL = """
feedback AS (
  SELECT d.doc_id AS Feedback_ID, d.text AS Feedback_Text,
         CASE WHEN lb.quality = 1 THEN 'Positive' WHEN lb.quality IS NOT NULL THEN 'Negative' END AS Sentiment,
         (d.doc_id % (SELECT count(*) FROM supplier)) + 1 AS Partner_id
  FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id
)"""
