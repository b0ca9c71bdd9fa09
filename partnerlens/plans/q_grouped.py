"""Registered query: the grouped hook with a least-squares solver."""

from __future__ import annotations

import numpy as np
import pandas as pd

from partnerlens.plans import discount as dd
from partnerlens.plans.grouped import fit_groups
from partnerlens.plans.q_discount import PANEL_SQL, panel_of
from partnerlens.plans.registry import finalize, register, sql_final


def price_line(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Least squares of log demand on log price; fails below two prices."""
    x, y = rows["Log_Price"].to_numpy(), rows["Log_Demand"].to_numpy()
    if len(np.unique(x)) < 2:
        raise ValueError("fewer than two prices")
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    return pd.DataFrame({"slope": [slope], "intercept": [y.mean() - slope * x.mean()], "n_months": [len(x)]})


@register("grouped_model", sql_final(
    "WITH" + PANEL_SQL + """
SELECT Product_id, Geography,
       CASE WHEN count(DISTINCT Log_Price) > 1 THEN regr_slope(Log_Demand, Log_Price) END AS slope,
       CASE WHEN count(DISTINCT Log_Price) > 1 THEN regr_intercept(Log_Demand, Log_Price) END AS intercept,
       CASE WHEN count(DISTINCT Log_Price) > 1 THEN count(*) END AS n_months,
       CASE WHEN count(DISTINCT Log_Price) < 2 THEN 'ValueError: fewer than two prices' END AS error
FROM panel GROUP BY Product_id, Geography""",
    [("Product_id", "text"), ("Geography", "text"), ("slope", "double"), ("intercept", "double"), ("n_months", "int"),
     ("error", "text")]))
def q_grouped_model(spark, d):
    """A user's own solver per product-region, every group in one grouped job."""
    return finalize(fit_groups(panel_of(spark, d), dd.KEYS, price_line, "slope double, intercept double, n_months long",
                               order=["YearMonth"]))
