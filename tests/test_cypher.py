"""The Cypher subset on a small graph."""

import pytest

from arborweft.plans.cypher import CypherError, Graph, cypher
from arborweft.plans.parser import parse


@pytest.fixture(scope="module")
def g(spark):
    nodes = [("a", "Function", "main", "x/A.java", 1), ("b", "Function", "b", "x/A.java", 5), ("c", "Function", "c", "y/B.java", 3), ("d", "Function", "d", "y/B.java", 9), ("K", "Class", "K", "x/A.java", 1), ("J", "JS", "j", "j.js", 1)]
    edges = [(1, "a", "b", "CALLS"), (2, "b", "c", "CALLS"), (3, "c", "a", "CALLS"), (4, "c", "d", "CALLS"), (5, "K", "a", "CONTAINS"), (6, "K", "b", "CONTAINS"), (7, "a", "b", "CALLS")]
    return Graph(
        spark.createDataFrame(nodes, "id string, node_type string, name string, file_path string, start_line long"),
        spark.createDataFrame(edges, "edge_id long, src string, dst string, type string"),
    )


def rows(g, text, **params):
    return sorted((tuple(r) for r in cypher(g, text, params).collect()), key=repr)


CASES = [
    ("MATCH (n:Js) RETURN n.id AS id", [("J",)]),
    ("MATCH (n) WHERE n.name = 'main' RETURN labels(n) AS l", [(["Node", "Function"],)]),
    ("MATCH (f {name: 'main'})-[:CALLS]->(x) RETURN x.id AS id", [("b",), ("b",)]),  # edges are a bag
    ("MATCH (f:Function {name: 'main'})-[:CALLS*]->(x) RETURN DISTINCT x.id AS id", [("a",), ("b",), ("c",), ("d",)]),
    ("MATCH (a)-[r1:CALLS]->(b)-[r2:CALLS]->(a) RETURN count(*) AS n", [(0,)]),
    ("MATCH p = (f {name: 'main'})-[:CALLS*1..2]->(x) RETURN length(p) AS d, count(*) AS n", [(1, 2), (2, 2)]),
    ("MATCH p = (a {id: 'b'})-[:CALLS*2..2]->(x) RETURN [n IN nodes(p) | n.name] AS names", [(["b", "c", "d"],), (["b", "c", "main"],)]),
    ("MATCH (f:Function) WHERE NOT (f)-[:CALLS]->() RETURN f.id AS id", [("d",)]),
    ("MATCH (f:Function) WHERE NOT ()-[:CONTAINS]->(f) AND f.name <> 'd' RETURN f.id AS id", [("c",)]),
    ("MATCH (f:Function) OPTIONAL MATCH (k:Class)-[:CONTAINS]->(f) RETURN f.id AS id, k.name AS k", [("a", "K"), ("b", "K"), ("c", None), ("d", None)]),
    ("MATCH (k:Class)-[:CONTAINS]->(f) RETURN k.name AS k, collect(f.name) AS fs, count(f) AS n", [("K", ["b", "main"], 2)]),
    ("MATCH (f:Function) WITH f.file_path AS p, count(*) AS n WHERE n > 1 RETURN p AS p, n + 1 AS m ORDER BY p", [("x/A.java", 3), ("y/B.java", 3)]),
    ("MATCH (a)<-[:CALLS]-(b) WHERE a.id = $id RETURN b.id AS id", [("b",)]),
    ("MATCH (a {id: 'a'})-[r]-(b) RETURN type(r) AS t, b.id AS id", [("CALLS", "b"), ("CALLS", "b"), ("CALLS", "c"), ("CONTAINS", "K")]),
    ("UNWIND range(1, 3) AS i RETURN i * 2 AS x", [(2,), (4,), (6,)]),
    ("RETURN 1 AS one, 'x' AS s", [(1, "x")]),
    ("MATCH (n) RETURN n.`name` AS name ORDER BY n.start_line DESC, name LIMIT 2", [("b",), ("d",)]),
    ("MATCH (n:Function) RETURN n.nothing AS x, n.name IN ['b', 'c'] AS y, n.name STARTS WITH 'm' AS z LIMIT 0", []),
    ("MATCH (a:Function), (b:Class) WHERE a.name = 'main' RETURN a.id AS a, b.id AS b", [("a", "K")]),
    ("MATCH (k:Class) MATCH (k)-[:CONTAINS]->(f)-[:CALLS]->(x) RETURN DISTINCT x.id AS id", [("b",), ("c",)]),
    ("MATCH p = (f {name: 'main'})-[:CALLS*]->(x) RETURN x.id AS id, min(length(p)) AS d", [("a", 3), ("b", 1), ("c", 2), ("d", 3)]),
    ("MATCH (s {id: 'b'}) CALL apoc.path.expandConfig(s, {relationshipFilter: 'CALLS>', maxLevel: 1}) YIELD path RETURN length(path) AS d", [(0,), (1,)]),
    ("CALL { MATCH (n:Function) RETURN count(n) AS n } RETURN n AS n", [(4,)]),
    ("MATCH (n:Function) RETURN CASE WHEN n.start_line > 4 THEN 'late' ELSE 'early' END AS w, count(*) AS n", [("early", 2), ("late", 2)]),
    ("MATCH (n:Function) WHERE n.name =~ '[a-c]' OR n.file_path CONTAINS 'B' RETURN count(DISTINCT n) AS n", [(3,)]),
    ("MATCH (a)-[:CALLS*2..3]->(b {id: 'd'}) RETURN DISTINCT a.id AS id", [("a",), ("b",)]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_query(g, text, want):
    assert rows(g, text, id="c") == sorted(want, key=repr)


@pytest.mark.parametrize("text", ["MATCH (n", "FOO", "MATCH (n) RETURN m.x AS x", "CALL other.thing(1) YIELD x RETURN x", "MATCH (n) RETURN mystery(n) AS x"])
def test_errors(g, text):
    with pytest.raises(CypherError):
        cypher(g, text)


def test_parser_reads_comments_and_quotes():
    assert len(parse("// c\nMATCH (n:A|B {x: \"it's\"})-[r:R*..4]->() WHERE n.y IS NOT NULL RETURN *")) == 2


def test_projects_stay_apart(spark):
    both = lambda rows: [(*r, p) for r in rows for p in ("p1", "p2")]
    nodes = spark.createDataFrame(both([("A", "Class", "a"), ("B", "Class", "b")]), "id string, node_type string, name string, project_path string")
    edges = spark.createDataFrame([(1, "A", "B", "CALLS", "p1"), (2, "A", "B", "CALLS", "p2"), (3, "B", "A", "CALLS", "p2")], "edge_id long, src string, dst string, type string, project_path string")
    g = Graph(nodes, edges)
    assert rows(g, "MATCH (a:Class {project_path: 'p1'})-[:CALLS]->(b) RETURN a.id AS a, b.id AS b, b.project_path AS p") == [("A", "B", "p1")]
    assert rows(g, "MATCH (a {project_path: 'p1'})-[:CALLS*]->(b) RETURN DISTINCT b.id AS b") == [("B",)]
    assert rows(g, "MATCH p = (a {project_path: 'p2', id: 'A'})-[r:CALLS*2..2]->(b) RETURN [n IN nodes(p) | n.project_path] AS ps") == [(["p2"] * 3,)]
    assert rows(g, "MATCH (a)-[:CALLS]->(b) RETURN a AS a, count(DISTINCT b) AS n ORDER BY n")[0][0].asDict().keys() >= {"id", "node_type"}
    assert "_gid" not in cypher(g, "MATCH (a) RETURN a AS a, collect(a) AS l").schema.simpleString()
    assert rows(g, "MATCH (a)-[r:CALLS]->(b) WHERE a.project_path = 'p1' RETURN startNode(r) AS s, endNode(r) AS e") == [("A", "B")]
    assert rows(g, "MATCH (n:Class) WHERE NOT ()-[:CALLS]->(n) RETURN n.project_path AS p, n.id AS id") == [("p1", "A")]


def test_undirected_paths_do_not_turn_back(spark):
    nodes = spark.createDataFrame([(x, "X") for x in "abc"], "id string, node_type string")
    edges = spark.createDataFrame([(1, "a", "b", "R"), (2, "b", "c", "R")], "edge_id long, src string, dst string, type string")
    got = rows(Graph(nodes, edges), "MATCH (x)-[:R*]-(y) RETURN DISTINCT x.id AS x, y.id AS y")
    assert got == sorted((x, y) for x in "abc" for y in "abc" if x != y)
    zero = rows(Graph(nodes, edges), "MATCH (x)-[:R*0..1]->(y) RETURN x.id AS x, count(DISTINCT y) AS n")
    assert zero == [("a", 2), ("b", 2), ("c", 1)]
