"""Medications are derived with one shuffle of their lines by order."""

import pytest

from casebook.sources.bindings import Bindings


@pytest.fixture
def joined_by_sort(spark):
    """Plans as for tables too large to broadcast, decided before the run."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_medications_shuffle_lines_by_order_once(spark, joined_by_sort, tmp_path):
    tables = {
        "customer": "1 AS c_custkey", "part": "1 AS p_partkey, 'a' AS p_name", "orders": "1 AS o_orderkey, 1 AS o_custkey",
        "lineitem": "1 AS l_orderkey, 1 AS l_linenumber, 1 AS l_partkey, 1 AS l_suppkey, DATE'2024-01-01' AS l_shipdate,"
        " 1.0 AS l_extendedprice, 1.0 AS l_quantity, 'A' AS l_returnflag, 'F' AS l_linestatus",
    }
    for name, row in tables.items():
        spark.sql(f"SELECT {row}").write.parquet(f"{tmp_path}/{name}.parquet")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    medications = Bindings(spark, str(tmp_path)).medications
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert [r.id for r in medications.collect()] == [901]
    by_order = [x for x in _plan(medications).splitlines() if "hashpartitioning(l_orderkey" in x]
    assert len(by_order) == 1 and "l_linenumber" not in by_order[0].split("[plan_id")[0]
