"""Long parallel lists of interfaces."""

import time

from arborweft.functions.filters import PackageFilter
from arborweft.operators import resolve


def _edges(spark, rows, classes):
    nodes = spark.createDataFrame([(i, "Class", {k: v for k, v in (("interfaces_fqn", f), ("interfaces", s)) if v is not None}) for i, f, s in rows], "id string, kind string, metadata map<string,string>")
    index = spark.createDataFrame(classes, "fqn string, id string")
    return sorted((r["src"], r["dst"]) for r in resolve.resolve_implements(nodes, index, PackageFilter()).collect())


def test_places_of_repeated_missing_and_short_lists(spark):
    classes = [("p.A", "a"), ("p.B", "b"), ("p.C", "c")]
    rows = [("1", "x.A, x.B ,x.A", "A,B,C"), ("2", "x.A,,x.B", "A"), ("3", "x.A", None), ("4", None, "B,C"), ("5", "x.A", "A,B"), ("5", "x.A", "C")]
    assert _edges(spark, rows, classes) == [("1", "a"), ("1", "a"), ("1", "b"), ("2", "a"), ("4", "b"), ("4", "c"), ("5", "a"), ("5", "c")]


def test_a_long_list_takes_time_in_proportion(spark):
    n = 40_000
    own = [f"N{k}" for k in range(n)]
    began = time.time()
    got = _edges(spark, [("1", ",".join(f"x.{k}" for k in own), ",".join(own))], [(f"p.{k}", k) for k in own[:50]])
    assert got == sorted(("1", k) for k in own[:50])
    assert time.time() - began < 20
