"""Registered queries: cleaning, panel, elasticity, forecasts, simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from partnerlens.operators.clean import clean_sales
from partnerlens.plans import discount as dd
from partnerlens.plans.registry import finalize, register, sql_final
from partnerlens.session import cut_lineage
from partnerlens.sources.bindings import DATED_SALES_SQL, dated_sales


def panel_of(spark, d):
    """The monthly panel, materialised once in the shared checkpoint folder:
    it is the only part of these jobs that reads the sales facts, and every
    later step (split, grid, fit, forecasts, buckets) reads it several times."""
    return cut_lineage(dd.monthly_panel(clean_sales(dated_sales(spark, d))))


# ------------------------------------------------------------------ SQL twin
# Months are an integer index (year * 12 + month - 1) on the SQL side.

PANEL_SQL = DATED_SALES_SQL + """,
clean AS (
  SELECT * FROM dated_sales
  WHERE Partner_id IS NOT NULL AND Product_id IS NOT NULL AND Date IS NOT NULL
    AND Price IS NOT NULL AND Demand IS NOT NULL AND Discount IS NOT NULL
    AND Geography IS NOT NULL AND Competitor_Price IS NOT NULL
    AND Price > 0 AND Demand > 0
),
panel AS (
  SELECT Product_id, Geography, year(Date) * 12 + month(Date) - 1 AS mi,
         sum(Demand) AS Demand, avg(Price) AS Price,
         avg(Competitor_Price) AS Competitor_Price, avg(Discount) AS Discount,
         ln(1 + sum(Demand)) AS Log_Demand, ln(1 + avg(Price)) AS Log_Price,
         ln(1 + avg(Competitor_Price)) AS Log_Competitor_Price
  FROM clean GROUP BY Product_id, Geography, year(Date) * 12 + month(Date) - 1
)"""

MONTH_TEXT = "strftime(make_date(CAST({m} // 12 AS INTEGER), CAST({m} % 12 + 1 AS INTEGER), 1), '%Y-%m-%d')"

FIT_SQL = PANEL_SQL + """,
cut AS (
  SELECT min(mi) AS cut FROM (
    SELECT mi, row_number() OVER (ORDER BY mi) - 1 AS i, count(*) OVER () AS n
    FROM (SELECT DISTINCT mi FROM panel) m) r
  WHERE i >= floor(n * 0.8)
),
train AS (SELECT p.* FROM panel p, cut WHERE p.mi < cut.cut),
test AS (SELECT p.* FROM panel p, cut WHERE p.mi >= cut.cut),
bounds AS (
  SELECT Product_id, Geography, min(mi) AS m0, max(mi) AS T, max(mi) - min(mi) + 1 AS n_grid
  FROM train t
  WHERE EXISTS (SELECT 1 FROM test s WHERE s.Product_id = t.Product_id AND s.Geography = t.Geography)
  GROUP BY Product_id, Geography
  HAVING max(mi) - min(mi) + 1 >= 24
),
grid0 AS (SELECT Product_id, Geography, T, unnest(generate_series(m0, T)) AS mi FROM bounds),
grid1 AS (
  SELECT g.Product_id, g.Geography, g.T, g.mi, t.Log_Demand AS y,
         last_value(t.Log_Price IGNORE NULLS) OVER w AS p,
         last_value(t.Log_Competitor_Price IGNORE NULLS) OVER w AS c
  FROM grid0 g LEFT JOIN train t
    ON g.Product_id = t.Product_id AND g.Geography = t.Geography AND g.mi = t.mi
  WINDOW w AS (PARTITION BY g.Product_id, g.Geography ORDER BY g.mi
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
grid2 AS (
  SELECT *,
    (y - lag(y, 1) OVER w) - (lag(y, 12) OVER w - lag(y, 13) OVER w) AS zy,
    (p - lag(p, 1) OVER w) - (lag(p, 12) OVER w - lag(p, 13) OVER w) AS zp,
    (c - lag(c, 1) OVER w) - (lag(c, 12) OVER w - lag(c, 13) OVER w) AS zc
  FROM grid1 WINDOW w AS (PARTITION BY Product_id, Geography ORDER BY mi)
),
sums AS (
  SELECT Product_id, Geography, sum(zy * zp) AS syp, sum(zy * zc) AS syc,
         sum(zp * zp) AS spp, sum(zc * zc) AS scc, sum(zp * zc) AS spc
  FROM grid2 WHERE zy IS NOT NULL AND zp IS NOT NULL AND zc IS NOT NULL
  GROUP BY Product_id, Geography
),
coef0 AS (
  SELECT b.Product_id, b.Geography, b.T, b.n_grid, s.*,
         s.spp * s.scc - s.spc * s.spc AS det
  FROM bounds b LEFT JOIN sums s ON b.Product_id = s.Product_id AND b.Geography = s.Geography
),
coef1 AS (
  SELECT Product_id, Geography, T, n_grid,
    CASE WHEN det > 1e-12 * spp * scc THEN (syp * scc - syc * spc) / det END AS beta_p,
    CASE WHEN det > 1e-12 * spp * scc THEN (syc * spp - syp * spc) / det END AS beta_c
  FROM coef0
),
resid AS (
  SELECT g.Product_id, g.Geography, g.mi, g.p, g.c,
         g.y - k.beta_p * g.p - k.beta_c * g.c AS u
  FROM grid1 g JOIN coef1 k ON g.Product_id = k.Product_id AND g.Geography = k.Geography
),
coef AS (
  SELECT k.*, t.u_T - t.u_T12 AS s_T, t.p_T, t.c_T
  FROM coef1 k LEFT JOIN (
    SELECT r.Product_id, r.Geography,
           max(CASE WHEN r.mi = k2.T THEN r.u END) AS u_T,
           max(CASE WHEN r.mi = k2.T - 12 THEN r.u END) AS u_T12,
           max(CASE WHEN r.mi = k2.T THEN r.p END) AS p_T,
           max(CASE WHEN r.mi = k2.T THEN r.c END) AS c_T
    FROM resid r JOIN coef1 k2 ON r.Product_id = k2.Product_id AND r.Geography = k2.Geography
    GROUP BY r.Product_id, r.Geography) t
  ON k.Product_id = t.Product_id AND k.Geography = t.Geography
)"""


def _predict_sql(targets: str, p: str, c: str) -> str:
    """SQL fragment: log-scale prediction for rows of ``targets`` (which has
    Product_id, Geography, mi and the exogenous columns)."""
    return f"""
  SELECT x.*, k.beta_p, k.T, (x.mi - k.T) AS h,
         k.beta_p * x.{p} + k.beta_c * x.{c} + r.u
           + CAST(ceil((x.mi - k.T) / 12.0) AS BIGINT) * k.s_T AS yhat
  FROM {targets} x
  JOIN coef k ON x.Product_id = k.Product_id AND x.Geography = k.Geography AND k.beta_p IS NOT NULL
  LEFT JOIN resid r ON r.Product_id = x.Product_id AND r.Geography = x.Geography
       AND r.mi = k.T + (x.mi - k.T) - 12 * CAST(ceil((x.mi - k.T) / 12.0) AS BIGINT)"""


COMPARISONS_SQL = FIT_SQL + f""",
pred AS ({_predict_sql('test', 'Log_Price', 'Log_Competitor_Price')}),
comparisons AS (
  SELECT Product_id AS product, Geography AS region, beta_p AS elasticity,
         {MONTH_TEXT.format(m='mi')} AS date,
         exp(Log_Demand) - 1 AS actual, exp(yhat) - 1 AS predicted
  FROM pred
)"""

FUTURE_SQL = FIT_SQL + f""",
fut AS (
  SELECT Product_id, Geography, p_T, c_T, unnest(generate_series(T + 1, T + 12)) AS mi
  FROM coef
),
pred AS ({_predict_sql('fut', 'p_T', 'c_T')})"""

COMPARE_COLS = [("product", "text"), ("region", "text"), ("elasticity", "double"),
                ("date", "text"), ("actual", "double"), ("predicted", "double")]


@register("clean_sales", sql_final(
    "WITH" + PANEL_SQL + "\nSELECT Partner_id, Product_id, strftime(Date, '%Y-%m-%d %H:%M:%S') AS Date, Price, Demand,"
    " Discount, Geography, Competitor_Price FROM clean",
    [("Partner_id", "int"), ("Product_id", "text"), ("Date", "text"), ("Price", "double"),
     ("Demand", "double"), ("Discount", "double"), ("Geography", "text"), ("Competitor_Price", "double")]))
def q_clean_sales(spark, d):
    """Initial cleaning of dated sales (date coercion, projection, NULL drop, positivity)."""
    df = clean_sales(dated_sales(spark, d))
    return finalize(df.withColumn("Date", F.date_format("Date", "yyyy-MM-dd HH:mm:ss")))


@register("monthly_panel", sql_final(
    "WITH" + PANEL_SQL + f"\nSELECT Product_id, Geography, {MONTH_TEXT.format(m='mi')} AS YearMonth, Demand, Price,"
    " Competitor_Price, Discount, Log_Demand, Log_Price, Log_Competitor_Price FROM panel",
    [("Product_id", "text"), ("Geography", "text"), ("YearMonth", "text"), ("Demand", "double"),
     ("Price", "double"), ("Competitor_Price", "double"), ("Discount", "double"),
     ("Log_Demand", "double"), ("Log_Price", "double"), ("Log_Competitor_Price", "double")]))
def q_monthly_panel(spark, d):
    """Monthly (product, region) panel with log1p columns."""
    return finalize(panel_of(spark, d))


@register("split_temporal", sql_final(
    "WITH" + PANEL_SQL + """,
cut AS (
  SELECT min(mi) AS cut FROM (
    SELECT mi, row_number() OVER (ORDER BY mi) - 1 AS i, count(*) OVER () AS n
    FROM (SELECT DISTINCT mi FROM panel) m) r
  WHERE i >= floor(n * 0.8))
SELECT Product_id, Geography, """ + MONTH_TEXT.format(m="mi") + """ AS YearMonth,
       CASE WHEN mi >= cut.cut THEN 'test' ELSE 'train' END AS part
FROM panel, cut""",
    [("Product_id", "text"), ("Geography", "text"), ("YearMonth", "text"), ("part", "text")]))
def q_split_temporal(spark, d):
    """Temporal 80/20 split of the panel by distinct month."""
    p = panel_of(spark, d)
    cut = dd.split_month(p)
    return finalize(p.select("Product_id", "Geography", "YearMonth",
                             F.when(F.col("YearMonth") >= cut, "test").otherwise("train").alias("part")))


@register("train_grid", sql_final(
    "WITH" + FIT_SQL + f"\nSELECT Product_id, Geography, {MONTH_TEXT.format(m='mi')} AS YearMonth,"
    " y AS Log_Demand, p AS Log_Price, c AS Log_Competitor_Price, zy, zp, zc FROM grid2",
    [("Product_id", "text"), ("Geography", "text"), ("YearMonth", "text"), ("Log_Demand", "double"),
     ("Log_Price", "double"), ("Log_Competitor_Price", "double"), ("zy", "double"), ("zp", "double"),
     ("zc", "double")]))
def q_train_grid(spark, d):
    """Dense monthly train grid per group (densify_months), forward-filled
    exogenous values (ffill_exog) and seasonal differences (seasonal_diff)."""
    p = panel_of(spark, d)
    train, test = dd.split_temporal(p)
    bounds = (train.groupBy(*dd.KEYS).agg(F.min("YearMonth").alias("m0"), F.max("YearMonth").alias("T"))
              .join(test.select(*dd.KEYS).distinct(), dd.KEYS, "left_semi")
              .filter(F.months_between("T", "m0") + 1 >= dd.MIN_GRID_MONTHS))
    grid = (dd.densify_months(bounds, "m0", "T")
            .join(train.select(*dd.KEYS, "YearMonth", "Log_Demand", "Log_Price", "Log_Competitor_Price"),
                  dd.KEYS + ["YearMonth"], "left"))
    grid = dd.ffill(grid, ["Log_Price", "Log_Competitor_Price"])
    z = dd.seasonal_diff(grid, {"Log_Demand": "zy", "Log_Price": "zp", "Log_Competitor_Price": "zc"})
    return finalize(z)


ELASTICITY_SQL = sql_final(
    "WITH" + FIT_SQL + "\nSELECT Product_id AS product, Geography AS region, beta_p AS price_elasticity FROM coef",
    [("product", "text"), ("region", "text"), ("price_elasticity", "double")])


@register("elasticity", ELASTICITY_SQL)
def q_elasticity(spark, d):
    """Price elasticity per product-region (regression core of the seasonal model)."""
    return finalize(dd.elasticity(panel_of(spark, d)))


@register("last_row", sql_final(
    "WITH" + FIT_SQL + f"\nSELECT Product_id, Geography, {MONTH_TEXT.format(m='T')} AS last_month, p_T AS Log_Price,"
    " c_T AS Log_Competitor_Price FROM coef",
    [("Product_id", "text"), ("Geography", "text"), ("last_month", "text"), ("Log_Price", "double"),
     ("Log_Competitor_Price", "double")]))
def q_last_row(spark, d):
    """Latest train observation per fitted group (exogenous values held for forecasts)."""
    f = dd.fit(panel_of(spark, d))
    return finalize(f.coef.select("Product_id", "Geography", F.date_format("T", "yyyy-MM-dd").alias("last_month"),
                                  F.col("p_T").alias("Log_Price"), F.col("c_T").alias("Log_Competitor_Price")))


@register("actual_vs_predicted", sql_final("WITH" + COMPARISONS_SQL + "\nSELECT * FROM comparisons", COMPARE_COLS))
def q_actual_vs_predicted(spark, d):
    """Actual vs predicted demand for every test month of every fitted group."""
    return finalize(dd.forecast_eval(panel_of(spark, d)))


METRICS_SQL = sql_final(
    "WITH" + COMPARISONS_SQL + """
SELECT product, region, avg(abs(actual - predicted)) AS mae,
       sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
       avg(abs((actual - predicted) / actual)) * 100 AS mape
FROM comparisons WHERE predicted IS NOT NULL GROUP BY product, region""",
    [("product", "text"), ("region", "text"), ("mae", "double"), ("rmse", "double"), ("mape", "double")])


@register("agg_forecast_error", METRICS_SQL)
def q_forecast_error(spark, d):
    """MAE, RMSE, MAPE per product-region on the held-out months."""
    return finalize(dd.forecast_metrics(dd.forecast_eval(panel_of(spark, d))))


@register("forecast_future", sql_final(
    "WITH" + FUTURE_SQL + f"\nSELECT Product_id AS product, Geography AS region, {MONTH_TEXT.format(m='mi')} AS date,"
    " exp(yhat) - 1 AS forecast FROM pred",
    [("product", "text"), ("region", "text"), ("date", "text"), ("forecast", "double")]))
def q_forecast_future(spark, d):
    """Twelve monthly forecasts after the train end, exogenous held at the last value."""
    return finalize(dd.forecast_future(panel_of(spark, d)))


FUTURE_ALL_SQL = FIT_SQL + f""",
fut AS (
  SELECT l.Product_id, l.Geography, l.p_T, l.c_T, unnest(generate_series(l.E + 1, l.E + 12)) AS mi
  FROM (SELECT Product_id, Geography, max(mi) AS E, arg_max(Log_Price, mi) AS p_T, arg_max(Log_Competitor_Price, mi) AS c_T
        FROM panel GROUP BY Product_id, Geography) l
  JOIN coef k ON k.Product_id = l.Product_id AND k.Geography = l.Geography
),
pred AS ({_predict_sql('fut', 'p_T', 'c_T')})"""


@register("forecast_future_all", sql_final(
    "WITH" + FUTURE_ALL_SQL + f"\nSELECT Product_id AS product, Geography AS region, {MONTH_TEXT.format(m='mi')} AS date,"
    " exp(yhat) - 1 AS forecast FROM pred",
    [("product", "text"), ("region", "text"), ("date", "text"), ("forecast", "double")]))
def q_forecast_future_all(spark, d):
    """Twelve monthly forecasts after the last known month."""
    return finalize(dd.forecast_future(panel_of(spark, d), after="all"))


@register("forecast_pipeline", sql_final(
    "WITH" + COMPARISONS_SQL + """,
m AS (
  SELECT product, region, avg(abs(actual - predicted)) AS mae,
         sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
         avg(abs((actual - predicted) / actual)) * 100 AS mape, count(*) AS n_test
  FROM comparisons WHERE predicted IS NOT NULL GROUP BY product, region)
SELECT k.Product_id AS product, k.Geography AS region, k.beta_p AS elasticity, m.mae, m.rmse, m.mape,
       coalesce(m.n_test, 0) AS n_test
FROM coef k LEFT JOIN m ON k.Product_id = m.product AND k.Geography = m.region""",
    [("product", "text"), ("region", "text"), ("elasticity", "double"), ("mae", "double"),
     ("rmse", "double"), ("mape", "double"), ("n_test", "int")]))
def q_forecast_pipeline(spark, d):
    """One row per fitted group: elasticity and hold-out error (one plan, no group loop)."""
    p = panel_of(spark, d)
    f = dd.fit(p)
    comp = dd.forecast_eval(p, f=f)
    m = (dd.forecast_metrics(comp)
         .join(comp.filter(F.col("predicted").isNotNull()).groupBy("product", "region")
               .agg(F.count(F.lit(1)).alias("n_test")), ["product", "region"]))
    el = f.coef.select(F.col("Product_id").alias("product"), F.col("Geography").alias("region"),
                       F.col("beta_p").alias("elasticity"))
    out = (el.join(m, ["product", "region"], "left")
           .select("product", "region", "elasticity", "mae", "rmse", "mape",
                   F.coalesce("n_test", F.lit(0)).alias("n_test")))
    return finalize(out)


@register("shap_linear", sql_final(
    "WITH" + FIT_SQL + """,
means AS (SELECT Product_id, Geography, avg(Log_Price) AS mp, avg(Log_Competitor_Price) AS mc
          FROM train GROUP BY Product_id, Geography),
per AS (
  SELECT t.Product_id, t.Geography, count(*) AS n,
         avg(abs(k.beta_p * (t.Log_Price - m.mp))) AS Log_Price,
         avg(abs(k.beta_c * (t.Log_Competitor_Price - m.mc))) AS Log_Competitor_Price
  FROM test t
  JOIN coef k ON t.Product_id = k.Product_id AND t.Geography = k.Geography AND k.beta_p IS NOT NULL
  JOIN means m ON t.Product_id = m.Product_id AND t.Geography = m.Geography
  GROUP BY t.Product_id, t.Geography HAVING count(*) >= 2)
SELECT Product_id AS product, Geography AS region, 'Log_Price' AS Feature, Log_Price AS Mean_Abs_SHAP FROM per
UNION ALL
SELECT Product_id, Geography, 'Log_Competitor_Price', Log_Competitor_Price FROM per""",
    [("product", "text"), ("region", "text"), ("Feature", "text"), ("Mean_Abs_SHAP", "double")]))
def q_shap_linear(spark, d):
    """Mean |SHAP| of log price and log competitor price per group (closed form)."""
    return finalize(dd.shap_linear(panel_of(spark, d)))


# ------------------------------------------------------------------ simulation

BUCKETS_SQL = FIT_SQL + """,
el AS (SELECT Product_id, Geography, beta_p AS e FROM coef),
pb0 AS (
  SELECT p.*, min(Price) OVER w AS pmin, max(Price) OVER w AS pmax
  FROM panel p WINDOW w AS (PARTITION BY Product_id, Geography)
),
pb AS (
  SELECT *, CAST(CASE WHEN pmax = pmin THEN 1
         ELSE least(4, greatest(1, ceil((Price - pmin) / (pmax - pmin) * 4))) END AS INTEGER) AS bucket
  FROM pb0
),
pb2 AS (
  SELECT *, pmin + (bucket - 1) * ((pmax - pmin) / 4) AS bucket_lo,
         CASE WHEN bucket = 4 THEN pmax ELSE pmin + bucket * ((pmax - pmin) / 4) END AS bucket_hi
  FROM pb
),
stats AS (
  SELECT Product_id, Geography, bucket, bucket_lo, bucket_hi, avg(Demand) AS avg_demand,
         (min(Price) + max(Price)) / 2 AS price_midpoint
  FROM pb2 WHERE EXISTS (SELECT 1 FROM el WHERE el.Product_id = pb2.Product_id AND el.Geography = pb2.Geography)
  GROUP BY Product_id, Geography, bucket, bucket_lo, bucket_hi
),
cents AS (
  SELECT s.*, CAST(round(bucket_lo * 100) AS BIGINT) AS clo, CAST(round(bucket_hi * 100) AS BIGINT) AS chi
  FROM stats s
),
sim AS (
  SELECT c.Product_id AS product, c.Geography AS region, c.bucket,
         CAST(clo // 100 AS VARCHAR) || '.' || lpad(CAST(clo % 100 AS VARCHAR), 2, '0') || '-' ||
         CAST(chi // 100 AS VARCHAR) || '.' || lpad(CAST(chi % 100 AS VARCHAR), 2, '0') AS price_bucket,
         c.price_midpoint, d.discount_pct, c.avg_demand AS original_avg_demand,
         c.avg_demand * exp(coalesce(el.e, -0.2) * ln(1 - least(greatest(d.discount_pct, 0), 50) / 100.0)) AS predicted_demand,
         coalesce(el.e, -0.2) AS elasticity_used
  FROM cents c JOIN el ON c.Product_id = el.Product_id AND c.Geography = el.Geography
  CROSS JOIN (SELECT unnest(generate_series(0, 50, 5)) AS discount_pct) d
),
sim2 AS (
  SELECT *, (predicted_demand - original_avg_demand) / original_avg_demand * 100 AS demand_change_pct,
         price_midpoint * (1 - discount_pct / 100.0) * predicted_demand AS revenue
  FROM sim
)"""

SIM_COLS = [("product", "text"), ("region", "text"), ("bucket", "int"), ("price_bucket", "text"),
            ("price_midpoint", "double"), ("discount_pct", "int"), ("original_avg_demand", "double"),
            ("predicted_demand", "double"), ("demand_change_pct", "double"), ("elasticity_used", "double")]


def simulation_of(spark, d):
    p = panel_of(spark, d)
    return dd.discount_simulation(p, dd.elasticity(p))


@register("price_buckets", sql_final(
    "WITH" + BUCKETS_SQL + f"\nSELECT Product_id, Geography, {MONTH_TEXT.format(m='mi')} AS YearMonth, Price, bucket,"
    " bucket_lo, bucket_hi FROM pb2",
    [("Product_id", "text"), ("Geography", "text"), ("YearMonth", "text"), ("Price", "double"),
     ("bucket", "int"), ("bucket_lo", "double"), ("bucket_hi", "double")]))
def q_price_buckets(spark, d):
    """Four equal-width, right-closed price buckets per product-region."""
    b = dd.price_buckets(panel_of(spark, d))
    return finalize(b.select("Product_id", "Geography", "YearMonth", "Price", "bucket", "bucket_lo", "bucket_hi"))


@register("agg_bucket_stats", sql_final(
    "WITH" + BUCKETS_SQL + "\nSELECT Product_id, Geography, bucket, avg(Demand) AS avg_demand,"
    " (min(Price) + max(Price)) / 2 AS price_midpoint FROM pb2 GROUP BY Product_id, Geography, bucket",
    [("Product_id", "text"), ("Geography", "text"), ("bucket", "int"), ("avg_demand", "double"),
     ("price_midpoint", "double")]))
def q_bucket_stats(spark, d):
    """Mean demand and price midpoint per price bucket (all groups)."""
    s = dd.bucket_stats(panel_of(spark, d))
    return finalize(s.select("Product_id", "Geography", "bucket", "avg_demand", "price_midpoint"))


@register("discount_simulation", sql_final(
    "WITH" + BUCKETS_SQL + "\nSELECT product, region, bucket, price_bucket, price_midpoint, discount_pct,"
    " original_avg_demand, predicted_demand, demand_change_pct, elasticity_used FROM sim2", SIM_COLS))
def q_discount_simulation(spark, d):
    """Bucket x discount scenarios with predicted demand for every product-region."""
    return finalize(simulation_of(spark, d))


OPTIMAL_INNER = "WITH" + BUCKETS_SQL + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product, region, bucket ORDER BY revenue DESC, discount_pct ASC) AS rn
  FROM sim2)
SELECT product, region, price_bucket, price_midpoint, discount_pct AS optimal_discount_pct,
       predicted_demand AS optimal_demand, revenue AS max_revenue
FROM ranked WHERE rn = 1"""
OPTIMAL_COLS = [("product", "text"), ("region", "text"), ("price_bucket", "text"), ("price_midpoint", "double"),
                ("optimal_discount_pct", "int"), ("optimal_demand", "double"), ("max_revenue", "double")]
OPTIMAL_SQL = sql_final(OPTIMAL_INNER, OPTIMAL_COLS)


@register("optimal_discounts", OPTIMAL_SQL)
def q_optimal_discounts(spark, d):
    """Revenue-maximising discount per price bucket for every product-region (flagship)."""
    return finalize(dd.optimal_discounts(simulation_of(spark, d)))


STRESS = 8
STRESS_SQL = sql_final(OPTIMAL_INNER.replace(
    "el AS (SELECT Product_id, Geography, beta_p AS e FROM coef)",
    f"el AS (SELECT Product_id, Geography, CASE WHEN Geography <> 'ASIA' THEN beta_p * {STRESS} END AS e FROM coef)"),
    OPTIMAL_COLS, digits=2)


@register("optimal_discounts_stress", STRESS_SQL)
def q_optimal_discounts_stress(spark, d):
    """Optimal discounts of a market that answers prices eight times as strongly, with no elasticity known for one
    region (the default is used there): optima from 0 to 50 percent."""
    p = panel_of(spark, d)
    el = dd.elasticity(p).withColumn(
        "price_elasticity", F.when(F.col("region") != "ASIA", F.col("price_elasticity") * STRESS))
    return finalize(dd.optimal_discounts(dd.discount_simulation(p, el)), digits=2)


# ------------------------------------------------------- building blocks

@register("agg_monthly", sql_final(
    "WITH" + PANEL_SQL + f"\nSELECT Product_id, Geography, {MONTH_TEXT.format(m='mi')} AS YearMonth, Demand, Price,"
    " Competitor_Price, Discount FROM panel",
    [("Product_id", "text"), ("Geography", "text"), ("YearMonth", "text"), ("Demand", "double"),
     ("Price", "double"), ("Competitor_Price", "double"), ("Discount", "double")]))
def q_agg_monthly(spark, d):
    """Monthly sums of demand and means of price, competitor price and discount per product-region."""
    return finalize(panel_of(spark, d).select("Product_id", "Geography", "YearMonth", "Demand", "Price",
                                              "Competitor_Price", "Discount"))


def _grid(spark, d):
    p = panel_of(spark, d)
    train, test = dd.split_temporal(p)
    bounds = (train.groupBy(*dd.KEYS).agg(F.min("YearMonth").alias("m0"), F.max("YearMonth").alias("T"))
              .join(test.select(*dd.KEYS).distinct(), dd.KEYS, "left_semi")
              .filter(F.months_between("T", "m0") + 1 >= dd.MIN_GRID_MONTHS))
    obs = train.select(*dd.KEYS, "YearMonth", "Log_Demand", "Log_Price", "Log_Competitor_Price")
    return dd.densify_months(bounds, "m0", "T").join(obs, dd.KEYS + ["YearMonth"], "left")


@register("densify_months", sql_final(
    "WITH" + FIT_SQL + f"\nSELECT Product_id, Geography, {MONTH_TEXT.format(m='mi')} AS YearMonth,"
    " CAST(y IS NOT NULL AS INTEGER) AS observed FROM grid1",
    [("Product_id", "text"), ("Geography", "text"), ("YearMonth", "text"), ("observed", "int")]))
def q_densify_months(spark, d):
    """Regular monthly grid of every fitted group between its first and last train month."""
    g = _grid(spark, d)
    return finalize(g.select(*dd.KEYS, "YearMonth", F.col("Log_Demand").isNotNull().cast("int").alias("observed")))


@register("ffill_exog", sql_final(
    "WITH" + FIT_SQL + f"\nSELECT Product_id, Geography, {MONTH_TEXT.format(m='mi')} AS YearMonth,"
    " p AS Log_Price, c AS Log_Competitor_Price FROM grid1",
    [("Product_id", "text"), ("Geography", "text"), ("YearMonth", "text"), ("Log_Price", "double"),
     ("Log_Competitor_Price", "double")]))
def q_ffill_exog(spark, d):
    """Exogenous log prices forward-filled over the monthly grid."""
    g = dd.ffill(_grid(spark, d), ["Log_Price", "Log_Competitor_Price"])
    return finalize(g.select(*dd.KEYS, "YearMonth", "Log_Price", "Log_Competitor_Price"))


@register("seasonal_diff", sql_final(
    "WITH" + FIT_SQL + f"\nSELECT Product_id, Geography, {MONTH_TEXT.format(m='mi')} AS YearMonth, zy, zp, zc"
    " FROM grid2 WHERE zy IS NOT NULL AND zp IS NOT NULL AND zc IS NOT NULL",
    [("Product_id", "text"), ("Geography", "text"), ("YearMonth", "text"), ("zy", "double"), ("zp", "double"),
     ("zc", "double")]))
def q_seasonal_diff(spark, d):
    """First difference minus its 12-month lag for demand and both prices (rows used by the fit)."""
    g = dd.ffill(_grid(spark, d), ["Log_Price", "Log_Competitor_Price"])
    z = dd.seasonal_diff(g, {"Log_Demand": "zy", "Log_Price": "zp", "Log_Competitor_Price": "zc"})
    z = z.filter(F.col("zy").isNotNull() & F.col("zp").isNotNull() & F.col("zc").isNotNull())
    return finalize(z.select(*dd.KEYS, "YearMonth", "zy", "zp", "zc"))


@register("forecast_eval", sql_final(
    "WITH" + COMPARISONS_SQL + """,
m AS (SELECT product, region, avg(abs(actual - predicted)) AS mae,
             sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
             avg(abs((actual - predicted) / actual)) * 100 AS mape
      FROM comparisons WHERE predicted IS NOT NULL GROUP BY product, region)
SELECT c.product, c.region, c.date, c.actual, c.predicted, m.mae, m.rmse, m.mape
FROM comparisons c LEFT JOIN m ON c.product = m.product AND c.region = m.region""",
    [("product", "text"), ("region", "text"), ("date", "text"), ("actual", "double"), ("predicted", "double"),
     ("mae", "double"), ("rmse", "double"), ("mape", "double")]))
def q_forecast_eval(spark, d):
    """Held-out actual vs predicted rows with their group's MAE / RMSE / MAPE attached."""
    comp = dd.forecast_eval(panel_of(spark, d))
    out = comp.join(dd.forecast_metrics(comp), ["product", "region"], "left").select(
        "product", "region", "date", "actual", "predicted", "mae", "rmse", "mape")
    return finalize(out)


@register("cross_scenarios", sql_final(
    "WITH" + BUCKETS_SQL + "\nSELECT product, region, bucket, discount_pct FROM sim",
    [("product", "text"), ("region", "text"), ("bucket", "int"), ("discount_pct", "int")]))
def q_cross_scenarios(spark, d):
    """Every price bucket paired with the 11 discount rates (an explode of a fixed array, no cross join)."""
    return finalize(simulation_of(spark, d).select("product", "region", "bucket", "discount_pct"))


@register("argmax_per_group", sql_final(
    "WITH" + BUCKETS_SQL + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY product, region, bucket ORDER BY revenue DESC, discount_pct ASC)
           AS rn FROM sim2)
SELECT product, region, bucket, discount_pct AS best_discount_pct, revenue AS max_revenue FROM ranked WHERE rn = 1""",
    [("product", "text"), ("region", "text"), ("bucket", "int"), ("best_discount_pct", "int"),
     ("max_revenue", "double")]))
def q_argmax_per_group(spark, d):
    """Row with the highest revenue per bucket, first (smallest discount) on ties, via max_by."""
    sim = simulation_of(spark, d).withColumn("revenue", F.col("price_midpoint") * (1 - F.col("discount_pct") / 100)
                                             * F.col("predicted_demand"))
    best = F.max_by(F.struct("discount_pct", "revenue"), F.struct(F.col("revenue"), -F.col("discount_pct")))
    out = sim.groupBy("product", "region", "bucket").agg(best.alias("b")).select(
        "product", "region", "bucket", F.col("b.discount_pct").alias("best_discount_pct"),
        F.col("b.revenue").alias("max_revenue"))
    return finalize(out)
