"""Registry of named queries: each id maps to a Spark job over the tables of
a scale-factor folder and, where the semantics are SQL-expressible, the
equivalent DuckDB SQL over the same tables.

Output convention (both sides): integral columns BIGINT, floating columns
DOUBLE rounded to ``DIGITS`` decimals, everything else VARCHAR (dates as
``yyyy-MM-dd``, arrays as ``', '``-joined text).  Rounding happens only here,
at the output edge.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from partnerlens.functions.scalar import fn_fixed_text as fixed_text

DIGITS = 6


@dataclass
class Query:
    qid: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}

_MODULES = ("q_discount", "q_clean", "q_schemes", "q_recommend", "q_evaluate",
            "q_explain", "q_sentiment", "q_arma", "q_grouped")


def register(qid: str, sql: str | None = None):
    def deco(fn):
        if qid in REGISTRY:
            raise ValueError(f"duplicate query id {qid}")
        REGISTRY[qid] = Query(qid, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    for m in _MODULES:
        importlib.import_module(f"partnerlens.plans.{m}")
    return REGISTRY


# ------------------------------------------------------------------ output

def finalize(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Cast every column to BIGINT / DOUBLE(rounded) / VARCHAR."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            out.append(c.cast("bigint").alias(f.name))
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            out.append(F.round(c.cast("double"), digits).alias(f.name))
        elif isinstance(t, T.DateType):
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif isinstance(t, T.ArrayType):
            et = t.elementType
            if isinstance(et, (T.FloatType, T.DoubleType)):
                out.append(F.concat_ws(", ", F.transform(c, lambda x: fixed_text(x, digits))).alias(f.name))
            else:
                out.append(F.concat_ws(", ", F.transform(c, lambda x: x.cast("string"))).alias(f.name))
        else:
            out.append(c.cast("string").alias(f.name))
    return df.select(*out)


def fixed_text_sql(x: str, digits: int = DIGITS) -> str:
    scale = 10 ** digits
    m = f"CAST(round(abs({x}) * {scale}) AS BIGINT)"
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST({m} // {scale} AS VARCHAR) || '.' || "
            f"lpad(CAST({m} % {scale} AS VARCHAR), {digits}, '0'))")


def sql_final(inner: str, cols: list[tuple[str, str]], digits: int = DIGITS) -> str:
    """Wrap an SQL query so its output follows the same convention.
    ``cols``: (name, kind) with kind in {'int', 'double', 'text'}."""
    sel = []
    for name, kind in cols:
        q = f'"{name}"'
        if kind == "int":
            sel.append(f"CAST({q} AS BIGINT) AS {q}")
        elif kind == "double":
            sel.append(f"round(CAST({q} AS DOUBLE), {digits}) AS {q}")
        else:
            sel.append(f"CAST({q} AS VARCHAR) AS {q}")
    return f"SELECT {', '.join(sel)}\nFROM (\n{inner}\n) AS _q"
