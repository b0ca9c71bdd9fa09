"""Seasonal ARMA terms of the demand model, over every product x region at once.

The errors of the price regression follow ARIMA(1,1,1)(0,1,1,12):

    w_t = (1-L)(1-L^12) u_t,   w_t = phi w_{t-1} + (1 + theta L)(1 + Theta L^12) e_t

and are fitted by Hannan and Rissanen's two regressions.  First w on its own
lags (LONG_AR) gives rough innovations; then w on the differenced prices,
w_{t-1}, e_{t-1} and e_{t-12} gives phi, theta, Theta and the correction of
the price coefficients.  Both are sums of products per group (one partial and
final aggregate) followed by an elimination in column expressions.  Values
before the first month and in gaps of the calendar count as 0.

Then REFINE Gauss-Newton steps on the squared innovations follow (the third
regression of the method): the innovations on their derivatives by the price
coefficients, phi, theta and Theta, all got by the model's own recursion.  A
step that does not lower a group's squared innovations is not taken.

The recursion runs over a group's months, lists as long as the calendar, and
forecasts are closed sums over the horizon:

    w_{T+h} = phi^h w_T + sum_j phi^{h-j} m_j,   m_j the part of known innovations
    u_{T+h} = (forecast without ARMA terms) + sum_j (floor((h-j) / 12) + 1) w_{T+j}

A group with fewer than MIN_ROWS differenced months, or whose equations have no
solution, keeps ARMA terms of 0, i.e. the forecast of ``discount.fit``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from partnerlens.functions.scalar import fn_date_text, fn_exp_inverse
from partnerlens.plans import discount as dd
from partnerlens.session import cut_lineage
from partnerlens.sources.io import sink_results4

KEYS = dd.KEYS
LONG_AR = (1, 2, 3, 12, 13, 24)
MIN_ROWS = 30
REFINE = 2                    # Gauss-Newton steps
BOUND = 0.95                  # phi, theta and Theta are kept within +-BOUND
PIVOT_TOL = 1e-9              # relative pivot below which equations have no solution

FIRST = [f"l{j}" for j in LONG_AR]
SECOND = ["zp", "zc", "w1", "e1", "e12"]
TERMS = ["dp", "dc", "phi", "theta", "seasonal"]   # dp, dc: corrections of the price coefficients
THIRD = [f"d_{t}" for t in TERMS]


def products(xs: list[str], y: str) -> dict[str, str]:
    """Name -> expression summed for the normal equations of y on xs."""
    out = {f"a{i}_{j}": f"{x} * {xs[j]}" for i, x in enumerate(xs) for j in range(i, len(xs))}
    return out | {f"a{i}_{len(xs)}": f"{x} * {y}" for i, x in enumerate(xs)}


def elimination(n: int) -> list[dict[str, str]]:
    """Steps (name -> expression over the names so far) that turn the upper
    half of a symmetric system, a0_0 .. a{n-1}_{n}, into its solution x0 ..;
    every x is NULL if a pivot vanishes."""
    name = lambda i, j, k: f"a{i}_{j}" if k == 0 else f"s{k}_{i}_{j}"
    steps = []
    for k in range(n - 1):  # step k takes column k out of the rows below
        p = name(k, k, k)
        steps.append({name(i, j, k + 1): f"CASE WHEN {p} > {PIVOT_TOL} * a{k}_{k} THEN {name(i, j, k)}"
                                         f" - {name(k, i, k)} * {name(k, j, k)} / {p} END"
                      for i in range(k + 1, n) for j in range(i, n + 1)})
    for i in range(n - 1, -1, -1):
        known = "".join(f" - {name(i, j, i)} * x{j}" for j in range(i + 1, n))
        p = name(i, i, i)
        steps.append({f"x{i}": f"CASE WHEN {p} > {PIVOT_TOL} * a{i}_{i} THEN ({name(i, n, i)}{known}) / {p} END"})
    return steps


def solve(sums: DataFrame, n: int) -> DataFrame:
    """``sums`` (keys, n_rows, a0_0 ..) with the solution x0 .. x{n-1}."""
    for step in elimination(n):
        sums = sums.withColumns({c: F.expr(e) for c, e in step.items()})
    return sums.select(*KEYS, "n_rows", *[f"x{i}" for i in range(n)])


def regress(rows: DataFrame, xs: list[str], y: str) -> DataFrame:
    """Least squares of y on xs per group; NULL where there is no solution."""
    sums = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"),
                                   *[F.sum(F.expr(e)).alias(c) for c, e in products(xs, y).items()])
    return solve(sums, len(xs))


@dataclass
class ArmaFit:
    coef: DataFrame      # keys, beta_p, beta_c, phi, theta, seasonal, T, s_T, p_T, c_T, w_T, m (list of 13)
    resid: DataFrame     # keys, YearMonth, u  (train grid)
    train: DataFrame
    test: DataFrame


def _recursion(x: str) -> str:
    """y with (1 + theta L)(1 + Theta L^12) y = x, for x an expression of the
    month number t; 0 where x is NULL and before the first month."""
    return ("aggregate(sequence(0, n - 1), CAST(array() AS array<double>), (y, t) -> array_append(y, coalesce("
            f"{x} - theta * coalesce(get(y, t - 1), 0D) - seasonal * coalesce(get(y, t - 12), 0D)"
            " - theta * seasonal * coalesce(get(y, t - 13), 0D), 0D)))")


def _before(xs: str, k: int) -> str:
    return f"coalesce(get({xs}, t - {k}), 0D)"


def _innovations(state: DataFrame) -> DataFrame:
    """Adds ws (errors of the price regression, differenced), es and sse."""
    return (state.withColumn("ws", F.expr("transform(sequence(0, n - 1), t -> w0[t] - dp * zp[t] - dc * zc[t])"))
            .withColumn("es", F.expr(_recursion(f"ws[t] - phi * {_before('ws', 1)}")))
            .withColumn("sse", F.expr("aggregate(es, 0D, (s, e) -> s + e * e)")))


def _bounded(found, old: str, i: int):
    """A term after a step, kept within its bound; as it was without a solution."""
    new = F.col(old) + F.when(found, F.col(f"x{i}")).otherwise(0.0)
    return new if old in ("dp", "dc") else F.least(F.greatest(new, F.lit(-BOUND)), F.lit(BOUND))


def _step(state: DataFrame, terms: DataFrame) -> DataFrame:
    """``state`` with the solution of a regression added to its terms."""
    found = F.coalesce((F.col("n_rows") >= MIN_ROWS) & F.col("x0").isNotNull(), F.lit(False))
    return (state.join(terms, KEYS, "left")
            .withColumns({f"to_{t}": _bounded(found, t, i) for i, t in enumerate(TERMS)})
            .drop(*TERMS, "n_rows", *[f"x{i}" for i in range(len(TERMS))])
            .withColumnsRenamed({f"to_{t}": t for t in TERMS}))


def refine(state: DataFrame) -> DataFrame:
    """One Gauss-Newton step; groups whose squared innovations do not fall stay."""
    slopes = state.withColumns({
        "d_dp": F.expr(_recursion(f"coalesce(zp[t], 0D) - phi * {_before('zp', 1)}")),
        "d_dc": F.expr(_recursion(f"coalesce(zc[t], 0D) - phi * {_before('zc', 1)}")),
        "d_phi": F.expr(_recursion(_before("ws", 1))),
        "d_theta": F.expr(_recursion(f"{_before('es', 1)} + seasonal * {_before('es', 13)}")),
        "d_seasonal": F.expr(_recursion(f"{_before('es', 12)} + theta * {_before('es', 13)}"))})
    rows = (slopes.select(*KEYS, F.explode(F.arrays_zip("ws", "es", *THIRD)).alias("r")).select(*KEYS, "r.*")
            .filter(F.col("ws").isNotNull()))
    old = [F.col(t).alias(f"old_{t}") for t in [*TERMS, "ws", "es", "sse"]]
    moved = _innovations(_step(state.select("*", *old).drop("ws", "es", "sse"), regress(rows, THIRD, "es")))
    better = F.col("sse") < F.col("old_sse")
    return moved.select(*KEYS, "n", "w0", "zp", "zc",
                        *[F.when(better, F.col(t)).otherwise(F.col(f"old_{t}")).alias(t) for t in [*TERMS, "ws", "es", "sse"]])


def fit_arma(panel: DataFrame, f: dd.Fit | None = None, **kw) -> ArmaFit:
    """The regression of ``discount.fit`` with its ARMA terms."""
    f = f or dd.fit(panel, **kw)
    w = Window.partitionBy(*KEYS).orderBy("YearMonth")
    grid = dd.seasonal_diff(f.grid, {"u": "w", "Log_Price": "zp", "Log_Competitor_Price": "zc"})
    grid = cut_lineage(grid.withColumns({f"l{j}": F.coalesce(F.lag("w", j).over(w), F.lit(0.0)) for j in LONG_AR}))
    rough = F.col("w")
    for i, x in enumerate(FIRST):
        rough = rough - F.coalesce(F.col(f"x{i}"), F.lit(0.0)) * F.col(x)
    long_ar = regress(grid.filter(F.col("w").isNotNull()), FIRST, "w")
    inn = grid.join(long_ar.drop("n_rows"), KEYS, "left").withColumn("e", rough)
    inn = inn.withColumns({"w1": F.col("l1"), "e1": F.coalesce(F.lag("e", 1).over(w), F.lit(0.0)),
                           "e12": F.coalesce(F.lag("e", 12).over(w), F.lit(0.0))})
    # a group's months in order: lists as long as the calendar
    months = F.array_sort(F.collect_list(F.struct("YearMonth", "w", "zp", "zc")))
    state = (grid.groupBy(*KEYS).agg(months.alias("r"))
             .select(*KEYS, F.size("r").alias("n"), F.col("r.w").alias("w0"), F.col("r.zp").alias("zp"), F.col("r.zc").alias("zc"),
                     *[F.lit(0.0).alias(t) for t in TERMS]))
    state = cut_lineage(_innovations(_step(state, regress(inn.filter(F.col("w").isNotNull()), SECOND, "w"))))
    for _ in range(REFINE):
        state = cut_lineage(refine(state))
    coef = f.coef.join(state.select(*KEYS, "n", *TERMS, "ws", "es"), KEYS)
    resid = cut_lineage(grid.join(state.select(*KEYS, "dp", "dc"), KEYS).select(*KEYS, "YearMonth", (
        F.col("u") - F.col("dp") * F.col("Log_Price") - F.col("dc") * F.col("Log_Competitor_Price")).alias("u")))
    tail = (resid.join(f.coef.select(*KEYS, "T"), KEYS).groupBy(*KEYS)
            .agg((F.max(F.when(F.col("YearMonth") == F.col("T"), F.col("u")))
                  - F.max(F.when(F.col("YearMonth") == F.add_months("T", -12), F.col("u")))).alias("s")))
    known = F.expr("transform(sequence(1, 13), j -> (CASE WHEN j = 1 THEN theta * es[n - 1] ELSE 0D END)"
                   " + (CASE WHEN j <= 12 THEN seasonal * coalesce(get(es, n - 13 + j), 0D) ELSE 0D END)"
                   " + theta * seasonal * coalesce(get(es, n - 14 + j), 0D))")
    out = coef.join(tail, KEYS).select(
        *KEYS, (F.col("beta_p") + F.col("dp")).alias("beta_p"), (F.col("beta_c") + F.col("dc")).alias("beta_c"), "phi", "theta",
        "seasonal", "T", F.col("s").alias("s_T"), "p_T", "c_T", F.expr("coalesce(ws[n - 1], 0D)").alias("w_T"), known.alias("m"))
    return ArmaFit(coef=cut_lineage(out), resid=resid, train=f.train, test=f.test)


def _predict(f: ArmaFit, targets: DataFrame, p: str, c: str) -> DataFrame:
    """Log-scale prediction for target months after the train end."""
    plain = dd._predict(dd.Fit(coef=f.coef, resid=f.resid, train=f.train, test=f.test), targets, p, c)
    more = F.expr("aggregate(sequence(1, h), 0D, (s, j) -> s + (floor((h - j) / 12) + 1) * (pow(phi, j) * w_T"
                  " + aggregate(sequence(1, least(j, 13)), 0D, (v, i) -> v + pow(phi, j - i) * m[i - 1])))")
    return (plain.join(f.coef.select(*KEYS, "phi", "w_T", "m"), KEYS)
            .withColumn("yhat", F.col("yhat") + more))


def _named(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.col("Product_id").alias("product"), F.col("Geography").alias("region"), *cols)


def elasticity(f: ArmaFit) -> DataFrame:
    """product, region, price_elasticity and the three ARMA terms (NULL
    elasticity when the price regression has no solution)."""
    return _named(f.coef, F.col("beta_p").alias("price_elasticity"), F.col("phi").alias("ar"),
                  F.col("theta").alias("ma"), F.col("seasonal").alias("seasonal_ma"))


def forecast_eval(f: ArmaFit, parity: bool = False) -> DataFrame:
    """Comparison rows of every test month, as ``discount.forecast_eval``."""
    t = f.test.select(*KEYS, "YearMonth", "Log_Demand", "Log_Price", "Log_Competitor_Price")
    return _named(_predict(f, t, "Log_Price", "Log_Competitor_Price"), F.col("beta_p").alias("elasticity"),
                  fn_date_text("YearMonth").alias("date"), fn_exp_inverse("Log_Demand", parity).alias("actual"),
                  fn_exp_inverse("yhat", parity).alias("predicted"))


def forecast_future(f: ArmaFit, steps: int = dd.FORECAST_STEPS, parity: bool = False) -> DataFrame:
    """``steps`` monthly forecasts after the train end, prices held."""
    months = f.coef.select(*KEYS, "p_T", "c_T", F.explode(F.sequence(
        F.add_months("T", 1), F.add_months("T", steps), F.expr("INTERVAL 1 MONTH"))).alias("YearMonth"))
    return _named(_predict(f, months, "p_T", "c_T"), fn_date_text("YearMonth").alias("date"),
                  fn_exp_inverse("yhat", parity).alias("forecast"))


def forecast_run(sales: DataFrame, base: str, fmt: str = "parquet", **kw) -> dict[str, str]:
    """``discount.forecast_run`` with the ARMA terms: metrics, forecasts,
    comparisons and elasticity, published as one set below ``base``."""
    panel = cut_lineage(dd.monthly_panel(sales))
    f = fit_arma(panel, **kw)
    comparisons = cut_lineage(forecast_eval(f))
    return sink_results4(dd.forecast_metrics(comparisons), forecast_future(f), comparisons, elasticity(f), base, fmt)
