"""Tables dealt by key give what shuffled rows give."""

import datetime as dt

from partnerlens.plans import explain as ex
from partnerlens.session import stored_by
from partnerlens.sources import bindings


def _tables(spark, d):
    day = dt.datetime(2020, 1, 2)
    made = {
        "region": ([(0, "ASIA"), (1, "AFRICA")], "r_regionkey int, r_name string"),
        "nation": ([(i, i % 2) for i in range(4)], "n_nationkey int, n_regionkey int"),
        "customer": ([(i, i % 5 if i else None, f"SEG{i % 3}") for i in range(12)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": ([(i, f"Brand#{(i or 0) % 4}", "t", 3.0) for i in (*range(9), 3, None)], "p_partkey long, p_brand string, p_type string, p_retailprice double"),
        "orders": ([(i, (i or 0) % 14, day, f"{(i or 0) % 3}-P") for i in (*range(25), 7, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i % 29 if i % 31 else None, i % 11, i % 6 if i % 17 else None, i % 4, 1.0 + i % 5, 10.0 * i if i % 13 else None, 0.01 * (i % 7),
                       0.01 * (i % 9), "NRA"[i % 3], "O", day + dt.timedelta(days=i % 50)) for i in [*range(160), 40, 41]],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                     "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def test_lines_dealt_by_order_and_part_are_the_same_lines(spark, tmp_path, monkeypatch):
    d = str(tmp_path)
    _tables(spark, d)
    monkeypatch.setattr(bindings, "LINES_PART", 20)
    for columns, bought, partner in ((bindings.stockist_long(spark, d).columns, False, "supplier"), (["Partner_id", "Product_id", "MRP"], True, "customer"),
                                     (["row_key", "Feedback_Score"], False, "supplier")):
        plain = bindings.stockist_long(spark, d, bought, partner).select(*columns)
        rows, parts = bindings.stockist_dealt(spark, d, columns, bought, partner)
        assert parts > 1 and rows.columns == columns
        assert rows.count() > 20 and sorted(map(str, rows.collect())) == sorted(map(str, plain.collect()))


def test_tables_dealt_by_key_meet_without_a_shuffle(spark):
    a = stored_by(spark.range(100).selectExpr("id % 7 AS k", "id AS v"), 3, "k")
    names = {t.name for t in spark.catalog.listTables()}
    joined = a.join(stored_by(spark.range(7).selectExpr("id AS k"), 3, "k").hint("merge"), "k").groupBy("k").count()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r["count"] for r in joined.collect()} == {i: 15 if i < 2 else 14 for i in range(7)} and not any(x.startswith("partnerlens_") for x in names)


def test_shuffle_column_and_importance_of_dealt_rows(spark, tmp_path):
    rows = [(f"k{i}", None if i % 11 == 0 else f"v{i % 37}") for i in range(300)] + [("k5", "v5")]
    df = spark.createDataFrame(rows, "row_key string, c string")
    plain, dealt = (sorted((r.rep, r.row_key, r.c or "", r.shuffled or "") for r in ex.shuffle_column(df, "c", repeats=2, parts=n).collect()) for n in (0, 2))
    assert len(dealt) == 602 and dealt == plain
    d = str(tmp_path)
    _tables(spark, d)
    lines = bindings.stockist_long(spark, d).select(*ex.PREPARED)
    plain, dealt = ({r.Feature: round(r.Importance, 9) for r in ex.pfi_shuffle(lines, repeats=2, parts=n).collect()} for n in (0, 2))
    assert dealt == plain and len(dealt) == 5
