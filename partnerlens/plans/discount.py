"""Elasticity, forecast and discount jobs over every product x region.

The reference loops over product-region groups in Python and fits one
SARIMAX(1,1,1)(0,1,1,12) per group.  Here every group is handled by the same
grouped plan: the monthly panel is a partial+final hash aggregate, the time
grid and its lags are windows partitioned by (product, region) whose size
is bounded by the calendar (months), and the regression is one more
aggregate.  The model is the regression core of the reference's model with
the ARMA terms set to zero, i.e. regression with ARIMA(0,1,0)(0,1,0,12)
errors:

    z(v)_t = (v_t - v_{t-1}) - (v_{t-12} - v_{t-13})      v in {y, p, c}
    [b_p, b_c] = argmin sum (z(y) - b_p z(p) - b_c z(c))^2  (2x2 normal equations)
    u_t = y_t - b_p p_t - b_c c_t,  s_T = u_T - u_{T-12},  k = ceil(h / 12)
    yhat_{T+h} = b_p p_{T+h} + b_c c_{T+h} + u_{T+h-12k} + k s_T

Forecasts need no recursion, so any horizon is a join on month.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from partnerlens.functions.scalar import (DISCOUNT_MAX, DISCOUNT_MIN, DISCOUNT_STEP,
                                          N_PRICE_BUCKETS, fn_change_pct, fn_date_text,
                                          fn_default_elasticity, fn_demand_response,
                                          fn_exp_inverse, fn_month, fn_price_bucket_label,
                                          fn_revenue)
from partnerlens.session import cut_lineage
from partnerlens.sources.io import sink_results4

KEYS = ["Product_id", "Geography"]
MIN_GRID_MONTHS = 24          # fixed value: groups with fewer grid months are skipped
TEST_SIZE = 0.2               # fixed value: share of latest months held out
FORECAST_STEPS = 12           # fixed value: months forecast after the train end
DET_REL_TOL = 1e-12           # relative determinant below which a group has no solution


def monthly_panel(sales: DataFrame) -> DataFrame:
    """(product, region, month): total demand, mean price, mean competitor
    price, mean discount, and log1p of demand, price and competitor price."""
    return (sales.withColumn("YearMonth", fn_month("Date"))
            .groupBy(*KEYS, "YearMonth")
            .agg(F.sum("Demand").alias("Demand"), F.avg("Price").alias("Price"),
                 F.avg("Competitor_Price").alias("Competitor_Price"),
                 F.avg("Discount").alias("Discount"))
            .withColumns({"Log_Demand": F.log1p("Demand"), "Log_Price": F.log1p("Price"),
                          "Log_Competitor_Price": F.log1p("Competitor_Price")})
            .na.drop("any"))


def split_month(panel: DataFrame, test_size: float = TEST_SIZE) -> Column:
    """First test month: distinct months sorted, the first int(n*(1-test))
    are train.  A scalar subquery over the (calendar-bounded) month list."""
    months = panel.select("YearMonth").distinct()
    w = Window.orderBy("YearMonth")          # bounded: one row per calendar month
    ranked = months.select("YearMonth", (F.row_number().over(w) - 1).alias("i"),
                           F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    return (ranked.filter(F.col("i") >= F.floor(F.col("n") * (1 - test_size)))
            .agg(F.min("YearMonth")).scalar())


def split_temporal(panel: DataFrame, test_size: float = TEST_SIZE) -> tuple[DataFrame, DataFrame]:
    cut = split_month(panel, test_size)
    return panel.filter(F.col("YearMonth") < cut), panel.filter(F.col("YearMonth") >= cut)


@dataclass
class Fit:
    coef: DataFrame      # keys, beta_p, beta_c, T (last train month), s_T, p_T, c_T, n_grid
    resid: DataFrame     # keys, YearMonth, u  (train grid)
    train: DataFrame
    test: DataFrame
    grid: DataFrame | None = None   # keys, YearMonth, Log_Price, Log_Competitor_Price, u  (train grid)


def densify_months(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """Regular monthly grid between two month columns of each group."""
    return bounds.select(*KEYS, F.explode(F.sequence(F.col(start), F.col(end),
                                                     F.expr("INTERVAL 1 MONTH"))).alias("YearMonth"))


def ffill(df: DataFrame, cols: list[str], order: str = "YearMonth") -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def seasonal_diff(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """z = first difference minus its 12-month lag, over the dense grid."""
    w = Window.partitionBy(*KEYS).orderBy("YearMonth")
    return df.withColumns({
        out: (F.col(c) - F.lag(c, 1).over(w)) - (F.lag(c, 12).over(w) - F.lag(c, 13).over(w))
        for c, out in cols.items()})


def fit(panel: DataFrame, test_size: float = TEST_SIZE,
        min_months: int = MIN_GRID_MONTHS) -> Fit:
    train, test = split_temporal(panel, test_size)
    bounds = (train.groupBy(*KEYS).agg(F.min("YearMonth").alias("m0"), F.max("YearMonth").alias("T"))
              .join(test.select(*KEYS).distinct(), KEYS, "left_semi")
              .withColumn("n_grid", (F.months_between("T", "m0") + 1).cast("int"))
              .filter(F.col("n_grid") >= min_months))
    grid = (densify_months(bounds, "m0", "T")
            .join(train.select(*KEYS, "YearMonth", "Log_Demand", "Log_Price", "Log_Competitor_Price"),
                  KEYS + ["YearMonth"], "left"))
    grid = ffill(grid, ["Log_Price", "Log_Competitor_Price"])
    z = seasonal_diff(grid, {"Log_Demand": "zy", "Log_Price": "zp", "Log_Competitor_Price": "zc"})
    sums = (z.filter(F.col("zy").isNotNull() & F.col("zp").isNotNull() & F.col("zc").isNotNull())
            .groupBy(*KEYS)
            .agg(F.sum(F.col("zy") * F.col("zp")).alias("syp"), F.sum(F.col("zy") * F.col("zc")).alias("syc"),
                 F.sum(F.col("zp") * F.col("zp")).alias("spp"), F.sum(F.col("zc") * F.col("zc")).alias("scc"),
                 F.sum(F.col("zp") * F.col("zc")).alias("spc")))
    det = F.col("spp") * F.col("scc") - F.col("spc") * F.col("spc")
    ok = det > F.lit(DET_REL_TOL) * F.col("spp") * F.col("scc")
    coef = (bounds.join(sums, KEYS, "left")
            .withColumn("det", det)
            .withColumn("beta_p", F.when(ok, (F.col("syp") * F.col("scc") - F.col("syc") * F.col("spc")) / F.col("det")))
            .withColumn("beta_c", F.when(ok, (F.col("syc") * F.col("spp") - F.col("syp") * F.col("spc")) / F.col("det"))))
    resid = (grid.join(coef.select(*KEYS, "beta_p", "beta_c"), KEYS)
             .select(*KEYS, "YearMonth", "Log_Price", "Log_Competitor_Price",
                     (F.col("Log_Demand") - F.col("beta_p") * F.col("Log_Price")
                      - F.col("beta_c") * F.col("Log_Competitor_Price")).alias("u")))
    tail = (resid.join(coef.select(*KEYS, "T"), KEYS)
            .groupBy(*KEYS)
            .agg(F.max(F.when(F.col("YearMonth") == F.col("T"), F.col("u"))).alias("u_T"),
                 F.max(F.when(F.col("YearMonth") == F.add_months("T", -12), F.col("u"))).alias("u_T12"),
                 F.max(F.when(F.col("YearMonth") == F.col("T"), F.col("Log_Price"))).alias("p_T"),
                 F.max(F.when(F.col("YearMonth") == F.col("T"), F.col("Log_Competitor_Price"))).alias("c_T")))
    coef = (coef.join(tail, KEYS, "left")
            .withColumn("s_T", F.col("u_T") - F.col("u_T12"))
            .select(*KEYS, "beta_p", "beta_c", "T", "s_T", "p_T", "c_T", "n_grid"))
    return Fit(coef=coef, resid=resid.select(*KEYS, "YearMonth", "u"), train=train, test=test, grid=resid)


def _predict(f: Fit, targets: DataFrame, p: str, c: str) -> DataFrame:
    """Log-scale prediction for target months after the train end."""
    coef = f.coef.filter(F.col("beta_p").isNotNull()).select(*KEYS, "beta_p", "beta_c", "T", "s_T")
    t = (targets.join(coef, KEYS)
         .withColumn("h", F.months_between("YearMonth", "T").cast("int"))
         .withColumn("k", F.ceil(F.col("h") / 12).cast("int"))
         .withColumn("base", F.expr("add_months(T, h - 12 * k)")))
    base = f.resid.withColumnsRenamed({"YearMonth": "base", "u": "u_base"})
    return (t.join(base, KEYS + ["base"], "left")
            .withColumn("yhat", F.col("beta_p") * F.col(p) + F.col("beta_c") * F.col(c)
                        + F.col("u_base") + F.col("k") * F.col("s_T")))


def elasticity(panel: DataFrame, **kw) -> DataFrame:
    """product, region, price_elasticity (NULL when the group has no solution)."""
    f = fit(panel, **kw)
    return f.coef.select(F.col("Product_id").alias("product"), F.col("Geography").alias("region"),
                         F.col("beta_p").alias("price_elasticity"))


def forecast_eval(panel: DataFrame, parity: bool = False, f: Fit | None = None, **kw) -> DataFrame:
    """Comparison rows: product, region, elasticity, date, actual, predicted
    for every test month of every fitted group (joined by month, not step)."""
    f = f or fit(panel, **kw)
    pred = _predict(f, f.test.select(*KEYS, "YearMonth", "Log_Demand", "Log_Price", "Log_Competitor_Price"),
                    "Log_Price", "Log_Competitor_Price")
    return pred.select(F.col("Product_id").alias("product"), F.col("Geography").alias("region"),
                       F.col("beta_p").alias("elasticity"), fn_date_text("YearMonth").alias("date"),
                       fn_exp_inverse("Log_Demand", parity).alias("actual"),
                       fn_exp_inverse("yhat", parity).alias("predicted"))


def forecast_metrics(comparisons: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE (%) per product-region."""
    e = F.col("actual") - F.col("predicted")
    return (comparisons.filter(F.col("predicted").isNotNull())
            .groupBy("product", "region")
            .agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                 (F.avg(F.abs(F.try_divide(e, F.col("actual")))) * 100).alias("mape")))


def forecast_future(panel: DataFrame, steps: int = FORECAST_STEPS, parity: bool = False,
                    f: Fit | None = None, after: str = "train", **kw) -> DataFrame:
    """``steps`` monthly forecasts after the train end (``after='train'``) or
    after the last known month (``'all'``), exogenous values held at that
    month's; the coefficients come from the train months either way."""
    if after not in ("train", "all"):
        raise ValueError("after must be 'train' or 'all'")
    f = f or fit(panel, **kw)
    start = f.coef.select(*KEYS, F.col("T").alias("_from"), "p_T", "c_T")
    if after == "all":
        last = panel.groupBy(*KEYS).agg(F.max("YearMonth").alias("_from"), F.max_by("Log_Price", "YearMonth").alias("p_T"),
                                        F.max_by("Log_Competitor_Price", "YearMonth").alias("c_T"))
        start = last.join(f.coef.select(*KEYS), KEYS)
    months = (start
              .select(*KEYS, "p_T", "c_T",
                      F.explode(F.sequence(F.add_months("_from", 1), F.add_months("_from", steps),
                                           F.expr("INTERVAL 1 MONTH"))).alias("YearMonth")))
    pred = _predict(f, months, "p_T", "c_T")
    return pred.select(F.col("Product_id").alias("product"), F.col("Geography").alias("region"),
                       fn_date_text("YearMonth").alias("date"),
                       fn_exp_inverse("yhat", parity).alias("forecast"))


def shap_linear(panel: DataFrame, min_test_rows: int = 2, f: Fit | None = None, **kw) -> DataFrame:
    """Mean |SHAP| of the exogenous features per product-region.  The model
    is linear in them, so phi_j = beta_j * (x_j - mean_train(x_j))."""
    f = f or fit(panel, **kw)
    means = f.train.groupBy(*KEYS).agg(F.avg("Log_Price").alias("mp"), F.avg("Log_Competitor_Price").alias("mc"))
    t = (f.test.join(f.coef.filter(F.col("beta_p").isNotNull()).select(*KEYS, "beta_p", "beta_c"), KEYS)
         .join(means, KEYS))
    per = (t.groupBy(*KEYS)
           .agg(F.count(F.lit(1)).alias("n"),
                F.avg(F.abs(F.col("beta_p") * (F.col("Log_Price") - F.col("mp")))).alias("Log_Price"),
                F.avg(F.abs(F.col("beta_c") * (F.col("Log_Competitor_Price") - F.col("mc")))).alias("Log_Competitor_Price"))
           .filter(F.col("n") >= min_test_rows))
    return (per.unpivot([*KEYS], ["Log_Price", "Log_Competitor_Price"], "Feature", "Mean_Abs_SHAP")
            .withColumnsRenamed({"Product_id": "product", "Geography": "region"}))


def forecast_run(sales: DataFrame, base: str, fmt: str = "parquet", **kw) -> dict[str, str]:
    """The forecast job with its four outputs (metrics, forecasts, comparisons,
    elasticity), published as one set below ``base``.  The panel, the fit and
    the comparisons, which several outputs read, are materialised once."""
    panel = cut_lineage(monthly_panel(sales))
    f = fit(panel, **kw)
    f = Fit(coef=cut_lineage(f.coef), resid=cut_lineage(f.resid), train=f.train, test=f.test)
    comparisons = cut_lineage(forecast_eval(panel, f=f))
    el = f.coef.select(F.col("Product_id").alias("product"), F.col("Geography").alias("region"),
                       F.col("beta_p").alias("price_elasticity"))
    return sink_results4(forecast_metrics(comparisons), forecast_future(panel, f=f), comparisons, el, base, fmt)


# --------------------------------------------------------------- simulation

def price_buckets(panel: DataFrame, n_buckets: int = N_PRICE_BUCKETS) -> DataFrame:
    """Equal-width price buckets per product-region, right-closed with the
    lowest price included; a single observed price gives one bucket."""
    w = Window.partitionBy(*KEYS)
    lo, hi = F.min("Price").over(w), F.max("Price").over(w)
    b = (panel.withColumn("pmin", lo).withColumn("pmax", hi)
         .withColumn("bucket", F.when(F.col("pmax") == F.col("pmin"), F.lit(1)).otherwise(
             F.least(F.lit(n_buckets), F.greatest(F.lit(1), F.ceil(
                 (F.col("Price") - F.col("pmin")) / (F.col("pmax") - F.col("pmin")) * n_buckets)))).cast("int")))
    width = (F.col("pmax") - F.col("pmin")) / n_buckets
    return b.withColumns({"bucket_lo": F.col("pmin") + (F.col("bucket") - 1) * width,
                          "bucket_hi": F.when(F.col("bucket") == n_buckets, F.col("pmax"))
                          .otherwise(F.col("pmin") + F.col("bucket") * width)})


def bucket_stats(panel: DataFrame, n_buckets: int = N_PRICE_BUCKETS) -> DataFrame:
    return (price_buckets(panel, n_buckets)
            .groupBy(*KEYS, "bucket", "bucket_lo", "bucket_hi")
            .agg(F.avg("Demand").alias("avg_demand"),
                 ((F.min("Price") + F.max("Price")) / 2).alias("price_midpoint")))


def discount_simulation(panel: DataFrame, elasticity_df: DataFrame) -> DataFrame:
    """Bucket x discount (0..50 step 5) scenarios for every product-region
    present in the elasticity table; a missing elasticity uses the default
    and ``elasticity_used`` reports the value actually used."""
    el = elasticity_df.select(F.col("product").alias("Product_id"), F.col("region").alias("Geography"),
                              "price_elasticity")
    stats = bucket_stats(panel.join(el.select(*KEYS), KEYS, "left_semi")).join(el, KEYS)
    discounts = F.sequence(F.lit(DISCOUNT_MIN), F.lit(DISCOUNT_MAX), F.lit(DISCOUNT_STEP))
    sc = stats.withColumn("discount_pct", F.explode(discounts))
    pred = fn_demand_response("avg_demand", "price_elasticity", "discount_pct")
    return sc.select(F.col("Product_id").alias("product"), F.col("Geography").alias("region"),
                     "bucket", fn_price_bucket_label("bucket_lo", "bucket_hi").alias("price_bucket"),
                     "price_midpoint", "discount_pct", F.col("avg_demand").alias("original_avg_demand"),
                     pred.alias("predicted_demand"),
                     fn_change_pct(pred, F.col("avg_demand")).alias("demand_change_pct"),
                     fn_default_elasticity("price_elasticity").alias("elasticity_used"))


def optimal_discounts(simulation: DataFrame) -> DataFrame:
    """Revenue-maximising scenario per product, region and bucket; ties go
    to the smaller discount (the reference's first occurrence)."""
    rev = simulation.withColumn("revenue", fn_revenue("price_midpoint", "discount_pct", "predicted_demand"))
    best = F.max_by(F.struct("discount_pct", "predicted_demand", "revenue"),
                    F.struct(F.col("revenue"), -F.col("discount_pct")))
    return (rev.groupBy("product", "region", "bucket", "price_bucket", "price_midpoint")
            .agg(best.alias("b"))
            .select("product", "region", "price_bucket", "price_midpoint",
                    F.col("b.discount_pct").alias("optimal_discount_pct"),
                    F.col("b.predicted_demand").alias("optimal_demand"),
                    F.col("b.revenue").alias("max_revenue")))
