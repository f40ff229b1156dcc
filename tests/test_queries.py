import pytest

import __spark_entry__ as entry
from gridmill import catalog_queries as C
from gridmill import record_queries, summary_queries  # noqa: F401  they add their queries
from tests.oracle import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(C.QUERIES))
def test_query_equals_its_sql(spark, name):
    columns, rows = spark_rows(entry.queries()[name](spark, SF))
    want_columns, want = sql_rows(C.ORACLES[name], SF)
    assert columns == want_columns
    assert len(rows) == len(want)
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_missing_months_of_every_customer(spark):
    held = {}
    for r in spark.read.parquet(f"{SF}/orders.parquet").where("o_orderdate is not null").collect():
        held.setdefault(r.o_custkey, set()).add(r.o_orderdate.year * 12 + r.o_orderdate.month - 1)
    want = {(k, m) for k, months in held.items() for m in range(min(months), max(months)) if m not in months}
    got = [(r.o_custkey, r.month.year * 12 + r.month.month - 1) for r in C.missing_months(spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(k % 10 for k, _ in got)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_exchange_once_and_read_what_they_need(spark):
    p = plan(C.hourly_master(spark, SF))
    assert p.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in p
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in p and "In(event_type" in p
    p = plan(C.dedupe_first(spark, SF))
    assert p.count("WindowGroupLimit") == 2
    for name in ("resample_hourly_point", "run_islands", "failure_streaks", "coverage", "missing_days", "fingerprint_fill"):
        assert "SinglePartition" not in plan(C.QUERIES[name](spark, SF)), name
