"""Readers, writers and the small column operators."""

import pytest
from pyspark.sql import functions as F

from partnerlens.functions.scalar import fn_label_class, fn_pad3
from partnerlens.operators.clean import (binarize, coerce_int0, drop_cols, existing_cols, normalize_names,
                                         purchased_list)
from partnerlens.sources.io import check_columns, current, read_table, scan_csv, sink, sink_csv, sink_results4, sink_split


def test_csv_round_trip_and_dispatch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "id int, s string, x double")
    sink_csv(df, str(tmp_path / "t.csv"))
    back = scan_csv(spark, str(tmp_path / "t.csv"), schema="id int, s string, x double")
    assert sorted(map(tuple, back.collect())) == [(1, "a", 2.5), (2, "b", None)]
    sink(df, str(tmp_path / "t.json"), "json")
    assert read_table(spark, str(tmp_path / "t.json")).count() == 2
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "t.xlsx"))


def test_results4_and_split_sinks(spark, tmp_path):
    df = spark.range(3)
    out = sink_results4(df, df, df, df, str(tmp_path / "run"))
    assert set(out) == {"metrics", "forecasts", "comparisons", "elasticity"}
    assert all(x.count() == 3 for x in current(spark, str(tmp_path / "run")).values())
    sink_split(df, df.limit(1), str(tmp_path / "split"), "csv")
    assert current(spark, str(tmp_path / "split"))["test"].count() == 1


def test_a_failing_write_leaves_the_last_set(spark, tmp_path):
    base = str(tmp_path / "run")
    old, new = spark.range(3), spark.range(5)
    sink_results4(old, old, old, old, base)

    def broken(batches):
        raise RuntimeError("third write fails")
        yield from batches
    with pytest.raises(Exception, match="third write fails"):
        sink_results4(new, new, new.mapInPandas(broken, "id long"), new, base)
    assert {k: x.count() for k, x in current(spark, base).items()} == dict.fromkeys(
        ("metrics", "forecasts", "comparisons", "elasticity"), 3)
    sink_results4(new, new, new, new, base)
    assert all(x.count() == 5 for x in current(spark, base).values())


def test_forecast_run_computes_its_parent_once(spark, tmp_path):
    from partnerlens.operators.clean import clean_sales
    from partnerlens.plans import discount as dd
    from partnerlens.sources.bindings import dated_sales
    from tests.conftest import SF_SMALL
    sales = clean_sales(dated_sales(spark, SF_SMALL))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b
    dd.forecast_run(sales.mapInPandas(counted, sales.schema), str(tmp_path / "run"))
    assert read.value == sales.count()
    got = current(spark, str(tmp_path / "run"))
    f = dd.fit(dd.monthly_panel(sales))
    assert got["elasticity"].count() == f.coef.count() > 0
    assert got["comparisons"].count() == dd.forecast_eval(dd.monthly_panel(sales), f=f).count()


def test_check_columns(spark):
    df = spark.createDataFrame([(1, "x")], "Feedback_ID int, Feedback_Text string")
    assert check_columns(df, ["Feedback_Text"]) is df
    with pytest.raises(ValueError, match="Sentiment"):
        check_columns(df, ["Feedback_Text", "Sentiment"])


def test_small_column_operators(spark):
    df = spark.createDataFrame([(" Partner_ID ", "3", "x", 1, 0, 2)],
                               "name string, q string, junk string, A int, B int, C int")
    n = normalize_names(df.withColumnRenamed("name", " Mixed Case "))
    assert n.columns[0] == "mixed case"
    assert coerce_int0(df, ["q", "junk"]).select("q", "junk").first() == (3, 0)
    assert binarize(df, ["C"]).first().C == 1
    p = purchased_list(df, ["A", "B"]).first()
    assert p.Purchased == ["A"] and p.has_purchase
    assert drop_cols(df, ["junk", "nope"]).columns == ["name", "q", "A", "B", "C"]
    assert existing_cols(df, ["B", "Z", "A"]) == ["B", "A"]


def test_label_class_and_pad(spark):
    df = spark.createDataFrame([(2, ["x"]), (0, [])], "c int, arr array<string>")
    r = df.select(fn_label_class("c").alias("l"), *fn_pad3(F.col("arr"), "No Scheme")).collect()
    assert r[0].l == "Positive" and r[1].l == "Negative"
    assert list(r[0])[1:] == ["x", "No Scheme", "No Scheme"]
