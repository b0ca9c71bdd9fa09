"""The grouped hook: failing, large, empty and null groups."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from partnerlens.plans.grouped import fit_groups


def total(key, rows):
    if key[0] == "fails":
        raise RuntimeError("no convergence")
    if key[0] == "empty":
        return pd.DataFrame({"total": [], "first": []})
    if key[0] == "wrong":
        return pd.DataFrame({"total": ["text"], "first": [1]})
    if key[0] == "missing":
        return pd.DataFrame({"total": [1.0]})
    return pd.DataFrame({"total": [float(rows["v"].sum())] * 2, "first": [rows["v"].iloc[0], None]})


def test_no_group_is_lost_and_none_ends_the_job(spark):
    rows = [(g, 1, v) for g in ("a", "fails", "empty", "wrong", "missing", None) for v in (3, 1, 2)]
    df = spark.createDataFrame(rows, "g string, h int, v int").unionByName(
        spark.range(500).select(F.lit("large").alias("g"), F.lit(1).alias("h"), F.col("id").cast("int").alias("v")))
    out = fit_groups(df, ["g", "h"], total, "total double, first long", order=["v"], max_rows=100)
    assert out.columns == ["g", "h", "total", "first", "error"]
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], []).append((r["total"], r["first"], r["error"]))
    assert got["a"] == got[None] == [(6.0, 1, None), (6.0, None, None)]
    assert got["fails"] == [(None, None, "RuntimeError: no convergence")]
    assert got["large"] == [(None, None, "group of 500 rows, at most 100 are fitted")]
    assert all(len(got[g]) == 1 and got[g][0][:2] == (None, None) and got[g][0][2] for g in ("empty", "wrong", "missing"))
    assert len(got) == 7
    assert fit_groups(df.limit(0), ["g", "h"], total, "total double, first long").count() == 0


def test_clashing_result_columns(spark):
    df = spark.createDataFrame([("a", 1)], "g string, v int")
    with pytest.raises(ValueError):
        fit_groups(df, ["g"], total, "G double")
    with pytest.raises(ValueError):
        fit_groups(df, ["g"], total, "error string")
