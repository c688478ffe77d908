"""Paths without an upper bound end by themselves or are refused."""

import pytest

from arborweft.operators import paths
from arborweft.plans.catalogue import CATALOGUE
from arborweft.plans.cypher import Graph, cypher


@pytest.fixture(scope="module")
def chain(spark):
    nodes = spark.createDataFrame([(f"f{k}", "Function", f"f{k}") for k in range(7)], "id string, node_type string, name string")
    edges = spark.createDataFrame([(k, f"f{k}", f"f{k + 1}", "CALLS") for k in range(6)], "edge_id long, src string, dst string, type string")
    return Graph(nodes, edges)


def test_impact_counts_callers_beyond_the_cap(chain):
    assert cypher(chain, CATALOGUE["impact"], {"name": "f6"}, cap=3).collect()[0]["callers"] == 6


def test_trails_without_a_cap_run_to_their_end(spark):
    edges = spark.createDataFrame([(k, f"f{k}", f"f{k + 1}", "CALLS") for k in range(80)], "edge_id long, src string, dst string, type string")
    nodes = spark.createDataFrame([(f"f{k}", "Function", f"f{k}") for k in range(81)], "id string, node_type string, name string")
    longest = cypher(Graph(nodes, edges), "MATCH p = (a {id: 'f0'})-[:CALLS*]->(b) RETURN max(length(p)) AS n")
    assert longest.collect()[0]["n"] == 80


def test_trails_beyond_the_cap_are_refused(spark, chain):
    seeds = spark.createDataFrame([("f0",)], "id string")
    with pytest.raises(ValueError, match="more than 3 hops"):
        paths.expand(chain.edges, seeds, cap=3)
    assert paths.expand(chain.edges, seeds, cap=6).count() == 6
