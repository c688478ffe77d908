"""Leaves that are reached from first nodes."""

import datetime

from arborweft.operators import bindings


def test_a_single_order_is_no_reachable_leaf(spark, tmp_path):
    rows = [(k, 1 if k < 8 else 2, datetime.date(2020, 1, k)) for k in range(1, 9)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r["id"] for r in bindings.queries()["leaf_nodes"](spark, str(tmp_path)).collect()] == ["ord::7"]
