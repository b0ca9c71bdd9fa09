"""Seasonal ARMA terms: elimination, recovery of coefficients, forecasts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partnerlens.plans import arma, discount as dd


def made(name, n, phi, theta, seasonal, seed, noise=0.1, bp=-1.5, bc=0.7):
    """n months of a panel whose errors follow the model."""
    r = np.random.default_rng(seed)
    burn = 50
    e = r.normal(0, noise, n + burn)
    w = np.zeros(n + burn)
    for t in range(14, n + burn):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1] + seasonal * e[t - 12] + theta * seasonal * e[t - 13]
    u = np.zeros(n + burn)
    for t in range(14, n + burn):
        u[t] = u[t - 1] + u[t - 12] - u[t - 13] + w[t]
    u = u[burn:]
    p, c = r.normal(2, 0.3, n), r.normal(2, 0.3, n)
    return pd.DataFrame({"Product_id": name, "Geography": "g", "YearMonth": pd.date_range("1900-01-01", periods=n, freq="MS").date,
                         "Demand": 1.0, "Price": 1.0, "Competitor_Price": 1.0, "Discount": 0.0,
                         "Log_Demand": 5 + bp * p + bc * c + u, "Log_Price": p, "Log_Competitor_Price": c})


TRUE = {"a": (0.5, 0.3, -0.5), "b": (0.0, -0.6, -0.6), "c": (-0.4, 0.0, 0.4)}


@pytest.fixture(scope="module")
def panel(spark):
    parts = [made(k, 700, *v, seed=i) for i, (k, v) in enumerate(TRUE.items())]
    short = made("short", 40, 0, -0.5, -0.5, seed=9)
    short["YearMonth"] = parts[0]["YearMonth"].to_numpy()[535:575]   # 25 train months, 12 of them differenced
    return spark.createDataFrame(pd.concat([*parts, short])).cache()


@pytest.fixture(scope="module")
def fitted(panel):
    return arma.fit_arma(panel)


def test_elimination_equals_least_squares(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 5))
    y = x @ [1, -2, 0.5, 0, 3] + r.normal(size=80)
    rows = [("p", "g", *map(float, a), float(b)) for a, b in zip(x, y)]
    flat = [("q", "g", 1.0, 1.0, *map(float, a[2:]), float(b)) for a, b in zip(x, y)]   # two equal columns
    xs = [f"v{i}" for i in range(5)]
    df = spark.createDataFrame(rows + flat, ["Product_id", "Geography", *xs, "y"])
    got = {r["Product_id"]: r for r in arma.regress(df, xs, "y").collect()}
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose([got["p"][f"x{i}"] for i in range(5)], want)
    assert got["q"]["x0"] is None and got["q"]["n_rows"] == 80
    assert arma.regress(df.limit(0), xs, "y").count() == 0


def test_coefficients_are_recovered(fitted):
    got = {r["Product_id"]: r for r in fitted.coef.collect()}
    for k, (phi, theta, seasonal) in TRUE.items():
        r = got[k]
        assert abs(r["beta_p"] + 1.5) < 0.05 and abs(r["beta_c"] - 0.7) < 0.05
        assert abs(r["phi"] - phi) < 0.2 and abs(r["theta"] - theta) < 0.2 and abs(r["seasonal"] - seasonal) < 0.2, (k, r)


def test_forecasts_equal_the_recursion(panel, fitted):
    """The closed sums against the model run month by month."""
    rows = panel.filter("Product_id = 'a'").orderBy("YearMonth").toPandas()
    k = fitted.coef.filter("Product_id = 'a'").first()
    n = int((rows["YearMonth"] <= k["T"]).sum())
    u = (rows["Log_Demand"] - k["beta_p"] * rows["Log_Price"] - k["beta_c"] * rows["Log_Competitor_Price"]).tolist()[:n]
    w = [0.0] * 13 + [u[t] - u[t - 1] - u[t - 12] + u[t - 13] for t in range(13, n)]
    e = [0.0] * 13
    th, se, phi = k["theta"], k["seasonal"], k["phi"]
    for t in range(13, len(rows)):
        known = phi * w[t - 1] + th * e[t - 1] + se * e[t - 12] + th * se * e[t - 13]
        if t < n:
            e.append(w[t] - known)
        else:
            e.append(0.0)
            w.append(known)
            u.append(u[t - 1] + u[t - 12] - u[t - 13] + known)
    want = [np.expm1(k["beta_p"] * p + k["beta_c"] * c + x)
            for p, c, x in zip(rows["Log_Price"][n:], rows["Log_Competitor_Price"][n:], u[n:])]
    got = [r["predicted"] for r in arma.forecast_eval(fitted).filter("product = 'a'").orderBy("date").collect()]
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-6)


def by_product(comparisons):
    e = F.avg(F.abs(F.log1p("actual") - F.log1p("predicted"))).alias("e")
    return {r["product"]: r["e"] for r in comparisons.groupBy("product").agg(e).collect()}


def test_held_out_errors_fall(spark):
    """Mean over 40 groups of 96 months, the length of a usual panel."""
    many = spark.createDataFrame(pd.concat([made(f"g{i:02}", 96, 0.0, -0.6, -0.6, seed=100 + i) for i in range(40)])).cache()
    plain, full = by_product(dd.forecast_eval(many)), by_product(arma.forecast_eval(arma.fit_arma(many)))
    assert plain.keys() == full.keys() and len(full) == 40
    assert np.mean(list(full.values())) < 0.8 * np.mean(list(plain.values()))


def test_short_groups_keep_the_plain_forecast(panel, fitted):
    plain, full = dd.forecast_eval(panel), arma.forecast_eval(fitted)
    assert set(by_product(full)) == {"a", "b", "c", "short"}
    one = {r["date"]: r["predicted"] for r in plain.filter("product = 'short'").collect()}
    two = {r["date"]: r["predicted"] for r in full.filter("product = 'short'").collect()}
    assert one and one.keys() == two.keys() and all(np.isclose(one[d], two[d]) for d in one)
    assert arma.forecast_future(fitted).filter("forecast is not null").count() == 4 * 12


def test_run_publishes_the_four_outputs(spark, panel, tmp_path, monkeypatch):
    monkeypatch.setattr(dd, "monthly_panel", lambda sales: sales)
    paths = arma.forecast_run(panel, str(tmp_path / "run"))
    assert len(paths) == 4 and all(spark.read.parquet(p).count() > 0 for p in paths.values())
