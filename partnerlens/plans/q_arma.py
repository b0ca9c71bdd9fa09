"""Registered queries: the demand model with its seasonal ARMA terms."""

from __future__ import annotations

from partnerlens.plans import arma, discount as dd
from partnerlens.plans.q_discount import COMPARE_COLS, FIT_SQL, MONTH_TEXT, panel_of
from partnerlens.plans.registry import finalize, register, sql_final

# ------------------------------------------------------------------ SQL twin

BY = "Product_id, Geography"


def _regress_sql(name: str, rows: str, xs: list[str], y: str) -> str:
    """CTE ``name``: least squares of y on xs per group, x0 .. and n_rows."""
    sums = ", ".join(f"sum({e}) AS {c}" for c, e in arma.products(xs, y).items())
    inner = f"SELECT {BY}, count(*) AS n_rows, {sums} FROM {rows} WHERE {y} IS NOT NULL GROUP BY {BY}"
    for step in arma.elimination(len(xs)):
        inner = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in step.items())} FROM ({inner}) q"
    return f"{name} AS ({inner})"


def _same(a: str, b: str) -> str:
    return f"{a}.Product_id = {b}.Product_id AND {a}.Geography = {b}.Geography"


_LAGS = ", ".join(f"coalesce(lag(w, {j}) OVER o, 0) AS l{j}" for j in arma.LONG_AR)
_ROUGH = "g.w" + "".join(f" - coalesce(k.x{i}, 0) * g.{x}" for i, x in enumerate(arma.FIRST))
_STATE = ["ws", "es", "sse", *arma.TERMS]


def _recursion_sql(x: str) -> str:
    """List y with (1 + theta L)(1 + Theta L^12) y = x, x an expression of the month number i (from 1)."""
    before = lambda k: f"coalesce(y[CASE WHEN len(y) >= {k} THEN len(y) - {k - 1} END], 0)"
    return (f"list_reduce(list_transform(range(1, n + 1), lambda i: [{x}]), lambda y, x: list_append(y, coalesce(x[1]"
            f" - theta * {before(1)} - seasonal * {before(12)} - theta * seasonal * {before(13)}, 0)), CAST([] AS DOUBLE[]))")


def _at(xs: str, k: int) -> str:
    return f"coalesce({xs}[CASE WHEN i > {k} THEN i - {k} END], 0)"


def _moved_sql(state: str, terms: str) -> str:
    """``state`` with the solution added to its terms, and its innovations."""
    ok = f"(k.n_rows >= {arma.MIN_ROWS} AND k.x0 IS NOT NULL)"
    new = [f"s.{t} + CASE WHEN {ok} THEN k.x{i} ELSE 0 END" for i, t in enumerate(arma.TERMS)]
    new = [x if i < 2 else f"least(greatest({x}, -{arma.BOUND}), {arma.BOUND})" for i, x in enumerate(new)]
    moved = (f"SELECT s.Product_id, s.Geography, s.n, s.w0, s.zp, s.zc, {', '.join(f'{x} AS {t}' for x, t in zip(new, arma.TERMS))}"
             f" FROM {state} s LEFT JOIN {terms} k ON {_same('s', 'k')}")
    ws = f"SELECT *, list_transform(range(1, n + 1), lambda i: w0[i] - dp * zp[i] - dc * zc[i]) AS ws FROM ({moved}) q"
    es = f"SELECT *, {_recursion_sql('ws[i] - phi * ' + _at('ws', 1))} AS es FROM ({ws}) q"
    return f"SELECT *, list_sum(list_transform(es, lambda e: e * e)) AS sse FROM ({es}) q"


def _refine_sql(k: int) -> str:
    """CTEs of the k-th Gauss-Newton step: st{k} from st{k-1}."""
    slopes = {"d_dp": f"coalesce(zp[i], 0) - phi * {_at('zp', 1)}", "d_dc": f"coalesce(zc[i], 0) - phi * {_at('zc', 1)}",
              "d_phi": _at("ws", 1), "d_theta": f"{_at('es', 1)} + seasonal * {_at('es', 13)}",
              "d_seasonal": f"{_at('es', 12)} + theta * {_at('es', 13)}"}
    lists = ", ".join(f"{_recursion_sql(x)} AS {c}" for c, x in slopes.items())
    each = ", ".join(f"unnest({c}) AS {c}" for c in slopes)
    best = ", ".join(f"CASE WHEN m.sse < s.sse THEN m.{c} ELSE s.{c} END AS {c}" for c in _STATE)
    return f"""
slope{k} AS (SELECT {BY}, ws, es, {lists} FROM st{k - 1}),
row{k} AS (SELECT {BY}, CASE WHEN w IS NOT NULL THEN e END AS e, {", ".join(slopes)}
           FROM (SELECT {BY}, unnest(ws) AS w, unnest(es) AS e, {each} FROM slope{k}) q),
{_regress_sql(f"gn{k}", f"row{k}", list(slopes), "e")},
moved{k} AS ({_moved_sql(f"st{k - 1}", f"gn{k}")}),
st{k} AS (SELECT s.Product_id, s.Geography, s.n, s.w0, s.zp, s.zc, {best}
          FROM st{k - 1} s JOIN moved{k} m ON {_same("s", "m")}),"""


ARMA_SQL = FIT_SQL + f""",
w0 AS (
  SELECT *, (u - lag(u, 1) OVER o) - (lag(u, 12) OVER o - lag(u, 13) OVER o) AS w,
    (p - lag(p, 1) OVER o) - (lag(p, 12) OVER o - lag(p, 13) OVER o) AS zp,
    (c - lag(c, 1) OVER o) - (lag(c, 12) OVER o - lag(c, 13) OVER o) AS zc
  FROM resid WINDOW o AS (PARTITION BY {BY} ORDER BY mi)
),
w1 AS (SELECT *, {_LAGS} FROM w0 WINDOW o AS (PARTITION BY {BY} ORDER BY mi)),
{_regress_sql("long_ar", "w1", arma.FIRST, "w")},
rough AS (SELECT g.*, {_ROUGH} AS e FROM w1 g LEFT JOIN long_ar k ON {_same("g", "k")}),
inn AS (
  SELECT {BY}, w, zp, zc, l1 AS w1, coalesce(lag(e, 1) OVER o, 0) AS e1, coalesce(lag(e, 12) OVER o, 0) AS e12
  FROM rough WINDOW o AS (PARTITION BY {BY} ORDER BY mi)
),
{_regress_sql("second", "inn", arma.SECOND, "w")},
start AS (
  SELECT {BY}, count(*) AS n, list(w ORDER BY mi) AS w0, list(zp ORDER BY mi) AS zp, list(zc ORDER BY mi) AS zc,
    {", ".join(f"0.0::DOUBLE AS {t}" for t in arma.TERMS)}
  FROM w0 GROUP BY {BY}
),
st0 AS ({_moved_sql("start", "second")}),{"".join(_refine_sql(k + 1) for k in range(arma.REFINE))}
acoef AS (
  SELECT k.Product_id, k.Geography, k.T, k.beta_p + s.dp AS beta_p, k.beta_c + s.dc AS beta_c, k.p_T, k.c_T,
    s.n, s.dp, s.dc, s.phi, s.theta, s.seasonal, s.es, coalesce(s.ws[s.n], 0) AS w_T
  FROM coef k JOIN st{arma.REFINE} s ON {_same("k", "s")}
),
months AS (
  SELECT g.Product_id, g.Geography, g.mi, k.T, g.u - k.dp * g.p - k.dc * g.c AS u
  FROM w0 g JOIN acoef k ON {_same("g", "k")}
),
ends AS (
  SELECT {BY}, max(CASE WHEN mi = T THEN u END) - max(CASE WHEN mi = T - 12 THEN u END) AS s_T
  FROM months GROUP BY {BY}
),
known AS (
  SELECT {BY}, j, CASE WHEN j = 1 THEN theta * es[n] ELSE 0 END
    + CASE WHEN j <= 12 THEN seasonal * coalesce(es[n - 12 + j], 0) ELSE 0 END + theta * seasonal * coalesce(es[n - 13 + j], 0) AS m
  FROM (SELECT *, unnest(generate_series(1, 13)) AS j FROM acoef) q
),
shock AS (
  SELECT k.Product_id, k.Geography, h.h, any_value(pow(k.phi, h.h) * k.w_T) + sum(pow(k.phi, h.h - m.j) * m.m) AS w
  FROM acoef k JOIN known m ON {_same("k", "m")}
  JOIN (SELECT unnest(generate_series(1, (SELECT max(mi) - min(mi) + 12 FROM panel))) AS h) h ON m.j <= h.h
  GROUP BY k.Product_id, k.Geography, h.h
),
lift AS (
  SELECT a.Product_id, a.Geography, h.h, sum(((h.h - a.h) // 12 + 1) * a.w) AS up
  FROM shock a JOIN (SELECT DISTINCT h FROM shock) h ON a.h <= h.h
  GROUP BY a.Product_id, a.Geography, h.h
)"""


def _predict_sql(targets: str, p: str, c: str) -> str:
    years = "CAST(ceil((x.mi - k.T) / 12.0) AS BIGINT)"
    return f"""
  SELECT x.*, k.beta_p, k.beta_p * x.{p} + k.beta_c * x.{c} + r.u + {years} * n.s_T + s.up AS yhat
  FROM {targets} x JOIN acoef k ON {_same("x", "k")} AND k.beta_p IS NOT NULL
  JOIN ends n ON {_same("x", "n")}
  JOIN lift s ON {_same("x", "s")} AND s.h = x.mi - k.T
  LEFT JOIN months r ON {_same("x", "r")} AND r.mi = x.mi - 12 * {years}"""


EVAL_SQL = ARMA_SQL + f""",
pred AS ({_predict_sql("test", "Log_Price", "Log_Competitor_Price")})
SELECT Product_id AS product, Geography AS region, beta_p AS elasticity, {MONTH_TEXT.format(m="mi")} AS date,
       exp(Log_Demand) - 1 AS actual, exp(yhat) - 1 AS predicted FROM pred"""

FUTURE_SQL = ARMA_SQL + f""",
fut AS (SELECT {BY}, p_T, c_T, unnest(generate_series(T + 1, T + 12)) AS mi FROM coef),
pred AS ({_predict_sql("fut", "p_T", "c_T")})
SELECT Product_id AS product, Geography AS region, {MONTH_TEXT.format(m="mi")} AS date, exp(yhat) - 1 AS forecast FROM pred"""


@register("elasticity_arma", sql_final(
    "WITH" + ARMA_SQL + "\nSELECT Product_id AS product, Geography AS region, beta_p AS price_elasticity,"
    " phi AS ar, theta AS ma, seasonal AS seasonal_ma FROM acoef",
    [("product", "text"), ("region", "text"), ("price_elasticity", "double"), ("ar", "double"), ("ma", "double"),
     ("seasonal_ma", "double")]))
def q_elasticity_arma(spark, d):
    """Price elasticity per product-region with the seasonal ARMA terms fitted."""
    return finalize(arma.elasticity(arma.fit_arma(panel_of(spark, d))))


@register("forecast_eval_arma", sql_final("WITH" + EVAL_SQL, COMPARE_COLS))
def q_forecast_eval_arma(spark, d):
    """Actual vs predicted demand on the test months, with ARMA terms."""
    return finalize(arma.forecast_eval(arma.fit_arma(panel_of(spark, d))))


@register("forecast_error_arma", sql_final(
    f"""WITH e AS ({"WITH" + EVAL_SQL})
SELECT product, region, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
       avg(abs((actual - predicted) / actual)) * 100 AS mape
FROM e WHERE predicted IS NOT NULL GROUP BY product, region""",
    [("product", "text"), ("region", "text"), ("mae", "double"), ("rmse", "double"), ("mape", "double")]))
def q_forecast_error_arma(spark, d):
    """MAE, RMSE and MAPE per product-region of the forecasts with ARMA terms."""
    return finalize(dd.forecast_metrics(arma.forecast_eval(arma.fit_arma(panel_of(spark, d)))))


@register("forecast_future_arma", sql_final(
    "WITH" + FUTURE_SQL,
    [("product", "text"), ("region", "text"), ("date", "text"), ("forecast", "double")]))
def q_forecast_future_arma(spark, d):
    """Twelve monthly forecasts after the train end, with ARMA terms."""
    return finalize(arma.forecast_future(arma.fit_arma(panel_of(spark, d))))
