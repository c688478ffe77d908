"""Queries that answer for all of their input, on tables made to show it."""

import datetime

from arborweft.operators import bindings


def test_callers_more_than_four_hops_away_count(spark, tmp_path):
    day = lambda k: datetime.date(2020, 1, k)
    rows = [(k, 1, day(k)) for k in range(1, 9)] + [(k, 2, day(k)) for k in range(11, 13)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    got = bindings.queries()["callers_transitive"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("ord::12", 1), ("ord::8", 7)]
