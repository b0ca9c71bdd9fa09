"""Every registered query against its DuckDB twin on the smallest tables,
plus the contract of ``__spark_entry__``."""

import pytest

from partnerlens.plans.registry import load_all
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

REG = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("qid", sorted(q for q in REG if REG[q].sql))
def test_query_matches_sql(spark, con, qid):
    q = REG[qid]
    df = q.fn(spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    con.execute(f"CREATE OR REPLACE VIEW oracle_{qid} AS {q.sql}")      # the driver reads it through a view
    res = con.execute(f"SELECT * FROM oracle_{qid}")
    verdict = compare(rows, df.columns, res.fetchall(), [d[0] for d in res.description])
    assert verdict.startswith("ok"), f"{qid}: {verdict}"


@pytest.mark.parametrize("qid", sorted(q for q in REG if not REG[q].sql))
def test_query_without_sql_runs(spark, qid):
    df = REG[qid].fn(spark, SF_SMALL)
    assert df.count() >= 0


def test_entry_contract(spark):
    import __spark_entry__ as e
    out = e.entry(spark)
    assert out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "optimal_discounts" in e.queries()
