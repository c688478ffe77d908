"""Resolution against the functions of all orders, and counts of all customers."""

from arborweft.operators import bindings

SF = "/root/testdata/sf0.001"


def test_functions_of_all_orders_are_found(spark, tmp_path):
    spark.createDataFrame([(1, 1), (2, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    q = bindings.queries()
    typed = {r["k"]: r["target_id"] for r in q["resolve_typed_call"](spark, str(tmp_path)).collect()}
    assert typed == {1: "f1::pkg::T1::function:m1", 2: "f2::pkg::T1::function:m2"}
    untyped = {r["k"]: r["target_id"] for r in q["resolve_untyped_call"](spark, str(tmp_path)).collect()}
    assert untyped == {1: "f1::pkg::T1::function:m1", 2: "f2::pkg::T1::function:m2"}


def test_every_customer_of_a_nation_counts(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet").where("c_nationkey % 5 <> 0").count()
    values = [r["value"] for r in bindings.queries()["metadata_update"](spark, SF).collect()]
    assert sum(int(v[1:]) for v in values if v != "old") == customers
    assert "old" in values
