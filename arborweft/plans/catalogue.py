"""The documented graph questions as named Cypher texts, and driver queries that run such texts on the projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.operators.projection import SQL, gedges, gnodes
from arborweft.operators.projection import trans as trans_edges
from arborweft.plans.cypher import Graph, cypher

#: Questions about a code graph, by name; each takes the parameters its text mentions.
CATALOGUE = {
    "function_by_name": "MATCH (f:Function {name: $name}) RETURN f.id AS id, f.file_path AS file_path, f.start_line AS start_line",
    "class_by_name": "MATCH (c:Class {name: $name}) RETURN c.id AS id, c.file_path AS file_path",
    "methods_of_class": "MATCH (c:Class {name: $name})-[:DEFINES|CONTAINS]->(m:Function) RETURN m.name AS name, m.id AS id ORDER BY name",
    "class_defines": "MATCH (c:Class {name: $name})-[:DEFINES]->(m:Function) RETURN m.name AS name",
    "direct_callees": "MATCH (f:Function {name: $name})-[:CALLS]->(g:Function) RETURN DISTINCT g.name AS name, g.id AS id",
    "callees_by_id": "MATCH (f:Function {id: $id})-[:CALLS]->(g) RETURN g.id AS id, g.name AS name",
    "direct_callers": "MATCH (g:Function)-[:CALLS]->(f:Function {name: $name}) RETURN DISTINCT g.name AS name, g.id AS id",
    "callers_transitive": "MATCH (g:Function)-[:CALLS*]->(f:Function {name: $name}) RETURN DISTINCT g.id AS id",
    "transitive_calls": "MATCH p = (f:Function {name: $name})-[:CALLS*1..5]->(g:Function) RETURN g.name AS name, length(p) AS depth ORDER BY depth, name",
    "call_paths": "MATCH p = (f:Function {name: $name})-[:CALLS*1..10]->(g:Function) RETURN [n IN nodes(p) | n.name] AS path, length(p) AS depth ORDER BY depth",
    "edges_from_main": "MATCH (m:Function {name: 'main'})-[:CALLS*0..15]->(a:Function) WITH DISTINCT a MATCH (a)-[:CALLS]->(b:Function) RETURN a.name AS caller, b.name AS callee",
    "leaf_functions": "MATCH (f:Function {name: $name})-[:CALLS*]->(leaf:Function) WHERE NOT (leaf)-[:CALLS]->() RETURN DISTINCT leaf.name AS name",
    "leaf_functions_counted": "MATCH (f:Function {name: $name})-[:CALLS*]->(leaf:Function) WITH DISTINCT leaf OPTIONAL MATCH (leaf)-[:CALLS]->(next) WITH leaf, count(next) AS outgoing WHERE outgoing = 0 RETURN leaf.name AS name ORDER BY name",
    "impact": "MATCH (caller:Function)-[:CALLS*]->(f:Function {name: $name}) RETURN count(DISTINCT caller) AS callers",
    "hierarchy": "MATCH (c:Class)-[r:EXTENDS|IMPLEMENTS]->(p) RETURN c.name AS class, type(r) AS relation, p.name AS parent ORDER BY class",
    "implementors": "MATCH (c:Class)-[:IMPLEMENTS]->(i:Interface {name: $name}) RETURN c.name AS name",
    "superclasses": "MATCH p = (c:Class {name: $name})-[:EXTENDS*]->(a:Class) RETURN a.name AS name, length(p) AS depth ORDER BY depth",
    "signature": "MATCH (f:Function {name: $name})-[:HAS_PARAM|DEFINES]->(p:Parameter) RETURN p.name AS name",
    "js_module": "MATCH (m:JS)-[:CONTAINS]->(x) RETURN m.name AS module, x.name AS name, labels(x) AS labels",
    "object_methods": "MATCH (o:Module)-[:DEFINES]->(f:Function) RETURN o.name AS object, collect(f.name) AS methods",
    "jsp_includes": "MATCH (j:Jsp)-[r:INCLUDES_JS|INCLUDES_CSS|INCLUDES_JSP]->(t) RETURN j.name AS page, type(r) AS relation, t.name AS target",
    "jsp_transitive": "MATCH p = (j:Jsp {name: $name})-[:INCLUDES_JSP*1..15]->(f:Jsp) RETURN f.id AS id, min(length(p)) AS depth ORDER BY depth, id",
    "jsp_imports": "MATCH (j:Jsp)-[:IMPORTS]->(c:Class) RETURN j.name AS page, c.name AS class",
    "orphan_pages": "MATCH (j:Jsp) WHERE NOT ()-[:INCLUDES_JSP]->(j) RETURN j.id AS id",
    "servlets": "MATCH (w:WebXml)-[:CONFIGURES]->(s:Servlet)-[:IMPLEMENTED_BY]->(c:Class) RETURN s.name AS servlet, s.url_pattern AS url, c.name AS class",
    "servlet_by_url": "MATCH (s:Servlet) WHERE s.url_pattern CONTAINS $url RETURN s.name AS name",
    "portlets": "MATCH (x:PortletXml)-[:CONFIGURES]->(p:Portlet)-[:IMPLEMENTED_BY]->(c:Class) OPTIONAL MATCH (c)-[:CONTAINS]->(m:Function) RETURN p.name AS portlet, c.name AS class, collect(m.name) AS methods",
    "four_hops": "MATCH (p:Portlet)-[:IMPLEMENTED_BY]->(c:Class) MATCH (c)-[:CONTAINS]->(m:Function)-[:CALLS]->(s:Function)-[:CALLS]->(d:Function) RETURN p.name AS portlet, m.name AS method, s.name AS service, d.name AS dao",
    "filters": "MATCH (f:Filter)-[:IMPLEMENTED_BY]->(c:Class) RETURN f.name AS filter, c.name AS class",
    "counts_by_label": "MATCH (n) RETURN labels(n) AS labels, count(*) AS n ORDER BY n DESC",
    "counts_by_language": "MATCH (n) WHERE n.language IS NOT NULL RETURN n.language AS language, n.node_type AS kind, count(n) AS n ORDER BY n DESC, language, kind",
    "counts_by_relation": "MATCH ()-[r]->() RETURN type(r) AS relation, count(r) AS n ORDER BY n DESC",
    "locate": "MATCH (n) WHERE n.file_path ENDS WITH $file AND n.start_line >= $from AND n.end_line <= $to RETURN n.id AS id, n.name AS name, n.start_line AS line ORDER BY line",
    "rust_types": "MATCH (m:Module)-[:CONTAINS]->(t) WHERE m.language = 'rust' AND t.node_type IN ['Class', 'Type', 'Trait'] RETURN m.name AS module, t.node_type AS kind, t.name AS name",
    "module_hotspots": "MATCH (m:Module)-[:CONTAINS]->(f:Function) RETURN m.name AS module, count(f) AS functions ORDER BY functions DESC, module LIMIT 20",
    "struct_methods": "MATCH (s:Class)-[:CONTAINS]->(m:Function) RETURN s.name AS struct, collect(m.name) AS methods ORDER BY struct",
    "shared_names": "MATCH (a:Class), (b:Class) WHERE a.name = b.name AND a.project_path < b.project_path RETURN DISTINCT a.name AS name",
    "project_functions": "MATCH (f:Function {project_path: $project}) RETURN f.name AS name, f.file_path AS file_path",
    "project_count": "MATCH (n {project_path: $project}) RETURN count(n) AS n",
    "dead_relations": "MATCH (a)-[r:RENDERS|DEPENDS_ON|NOTIFIES]->(b) RETURN a.id AS src, type(r) AS relation, b.id AS dst",
    "submodule": "MATCH (start:Function {name: $name}) CALL apoc.path.expandConfig(start, {relationshipFilter: 'CALLS>', maxLevel: 10}) YIELD path RETURN [n IN nodes(path) | n.name] AS names, length(path) AS depth",
    "class_relations": "MATCH (a:Class)-[r]->(b:Class) RETURN type(r) AS relation, count(*) AS n",
}


def ask(graph: Graph, question: str, /, **params) -> DataFrame:
    """One of the catalogue's questions."""
    return cypher(graph, CATALOGUE[question], params)


def projected(spark: SparkSession, sf_dir: str, *relations: str) -> Graph:
    nodes = gnodes(spark, sf_dir).withColumnRenamed("kind", "node_type")
    return Graph(nodes, gedges(spark, sf_dir, *relations).withColumnRenamed("relation", "type"))


def _flat(df: DataFrame) -> DataFrame:
    """Lists as joined strings and integers as longs, for comparison."""
    out = df
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            out = out.withColumn(name, F.array_join(name, ","))
        elif kind == "int":
            out = out.withColumn(name, F.col(name).cast("long"))
    return out


#: name: (relations of the projection, Cypher, SQL over the projection, whether it recurses)
_DRIVER: dict[str, tuple[tuple[str, ...], str, str, bool]] = {
    "cypher_label_props": (("CONTAINS",), "MATCH (n:Class {grp: 'nation::7'}) RETURN n.id AS id, n.name AS name", "SELECT id, name FROM gnodes WHERE kind = 'Class' AND grp = 'nation::7'", False),
    "cypher_reverse_hop": (
        ("CONTAINS",),
        "MATCH (c:Class)<-[:CONTAINS]-(n:Module) WHERE n.name STARTS WITH 'N' AND NOT c.name ENDS WITH '1' RETURN c.id AS class, n.name AS nation",
        "SELECT c.id AS class, n.name AS nation FROM contains_ e JOIN gnodes n ON n.id = e.src JOIN gnodes c ON c.id = e.dst WHERE n.kind = 'Module' AND c.kind = 'Class' AND starts_with(n.name, 'N') AND NOT ends_with(c.name, '1')",
        False,
    ),
    "cypher_alternatives_type": (
        ("CONTAINS", "DEFINES", "USES"),
        "MATCH (a)-[r:DEFINES|USES]->(b:Type) WHERE b.name CONTAINS 'a' RETURN type(r) AS relation, count(*) AS n",
        "SELECT relation, count(*) AS n FROM gedges e JOIN gnodes b ON b.id = e.dst WHERE relation IN ('DEFINES', 'USES') AND contains(b.name, 'a') GROUP BY relation",
        False,
    ),
    "cypher_chain": (
        ("CONTAINS",),
        "MATCH (r:Package)-[:CONTAINS]->(n:Module)-[:CONTAINS]->(c:Class)-[:CONTAINS]->(o:Function) RETURN r.name AS region, o.name AS priority, count(*) AS n ORDER BY n DESC, region",
        "SELECT r.name AS region, o.name AS priority, count(*) AS n FROM gnodes o JOIN gnodes c ON c.id = o.grp JOIN gnodes n ON n.id = c.grp JOIN gnodes r ON r.id = n.grp WHERE o.kind = 'Function' GROUP BY ALL",
        False,
    ),
    "cypher_optional_collect": (
        ("CONTAINS",),
        "MATCH (n:Module) OPTIONAL MATCH (n)-[:CONTAINS]->(c:Class) WHERE c.name CONTAINS 'BUILDING' WITH n, collect(c.name) AS names, count(c) AS k RETURN n.id AS id, k AS n, names AS names",
        "SELECT n.id, count(c.id) AS n, coalesce(string_agg(c.name, ',' ORDER BY c.name), '') AS names FROM gnodes n LEFT JOIN gnodes c ON c.grp = n.id AND c.kind = 'Class' AND contains(c.name, 'BUILDING') WHERE n.kind = 'Module' GROUP BY n.id",
        False,
    ),
    "cypher_not_exists": (
        ("CONTAINS", "CALLS"),
        "MATCH (o:Function) WHERE NOT (o)-[:CALLS]->() AND EXISTS((:Class)-[:CONTAINS]->(o)) RETURN o.id AS id",
        "SELECT id FROM gnodes WHERE kind = 'Function' AND id NOT IN (SELECT src FROM calls)",
        False,
    ),
    "cypher_exists_in_or": (
        ("CALLS",),
        "MATCH (o:Function) WHERE o.name = '1-URGENT' OR NOT (o)-[:CALLS]->() RETURN count(*) AS n",
        "SELECT count(*) AS n FROM gnodes WHERE kind = 'Function' AND (name = '1-URGENT' OR id NOT IN (SELECT src FROM calls))",
        False,
    ),
    "cypher_varlen_depth": (
        ("CALLS",),
        "MATCH p = (a:Function {name: '1-URGENT'})-[:CALLS*1..4]->(b:Function) RETURN length(p) AS depth, count(*) AS n, count(DISTINCT b) AS ends",
        ", p AS (SELECT c.src, c.dst, 1 AS depth FROM calls c JOIN gnodes g ON g.id = c.src AND g.name = '1-URGENT' UNION ALL SELECT p.src, c.dst, depth + 1 FROM p JOIN calls c ON c.src = p.dst WHERE depth < 4) SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n, count(DISTINCT dst) AS ends FROM p GROUP BY depth",
        True,
    ),
    "cypher_path_names": (
        ("CONTAINS",),
        "MATCH p = (r:Package {name: 'ASIA'})-[:CONTAINS*1..2]->(c) RETURN [n IN nodes(p) | n.name] AS names, length(p) AS depth",
        "SELECT r.name || ',' || n.name AS names, CAST(1 AS BIGINT) AS depth FROM gnodes r JOIN gnodes n ON n.grp = r.id AND n.kind = 'Module' WHERE r.name = 'ASIA' UNION ALL SELECT r.name || ',' || n.name || ',' || c.name, 2 FROM gnodes r JOIN gnodes n ON n.grp = r.id AND n.kind = 'Module' JOIN gnodes c ON c.grp = n.id AND c.kind = 'Class' WHERE r.name = 'ASIA'",
        False,
    ),
    "cypher_distinct_reachable": (
        ("CONTAINS",),
        "MATCH (r:Package)-[:CONTAINS*]->(x) RETURN DISTINCT r.id AS region, x.node_type AS kind",
        ", p AS (SELECT src AS start, dst FROM contains_ WHERE src LIKE 'region::%' UNION SELECT start, c.dst FROM p JOIN contains_ c ON c.src = p.dst) SELECT DISTINCT start AS region, kind FROM p JOIN gnodes ON id = dst",
        True,
    ),
    "cypher_min_length": (
        ("CONTAINS", "USES"),
        "MATCH p = (r:Package {name: 'ASIA'})-[:CONTAINS|USES*]->(x:Type) RETURN x.id AS id, min(length(p)) AS depth",
        "SELECT DISTINCT u.dst AS id, CAST(4 AS BIGINT) AS depth FROM uses u JOIN gnodes o ON o.id = u.src JOIN gnodes c ON c.id = o.grp JOIN gnodes n ON n.id = c.grp JOIN gnodes r ON r.id = n.grp WHERE r.name = 'ASIA'",
        False,
    ),
    "cypher_multi_match_where": (
        ("CONTAINS", "DEFINES", "USES"),
        "MATCH (s:Interface)-[:DEFINES]->(p:Type) WHERE s.name ENDS WITH '7' MATCH (o:Function)-[:USES]->(p) RETURN s.id AS supplier, count(DISTINCT o) AS orders",
        "SELECT s.id AS supplier, count(DISTINCT u.src) AS orders FROM gnodes s JOIN defines d ON d.src = s.id JOIN uses u ON u.dst = d.dst WHERE s.kind = 'Interface' AND ends_with(s.name, '7') GROUP BY s.id",
        False,
    ),
    "cypher_with_having": (
        ("CONTAINS",),
        "MATCH (c:Class)-[:CONTAINS]->(o:Function) WITH c, count(o) AS n WHERE n >= 15 RETURN c.id AS id, n AS n ORDER BY n DESC, id",
        "SELECT grp AS id, count(*) AS n FROM gnodes WHERE kind = 'Function' GROUP BY grp HAVING count(*) >= 15",
        False,
    ),
    "cypher_case_unwind": (
        ("CONTAINS",),
        "UNWIND ['ASIA', 'EUROPE', 'NOWHERE'] AS name MATCH (r:Package) WHERE r.name = name RETURN r.id AS id, CASE WHEN name = 'ASIA' THEN 'a' ELSE 'other' END AS tag, size(range(1, 3)) AS k",
        "SELECT id, CASE WHEN name = 'ASIA' THEN 'a' ELSE 'other' END AS tag, CAST(3 AS BIGINT) AS k FROM gnodes WHERE kind = 'Package' AND name IN ('ASIA', 'EUROPE')",
        False,
    ),
    "cypher_order_limit": (
        ("CONTAINS",),
        "MATCH (n) WHERE n.node_type IN ['Package', 'Module'] RETURN n.id AS id, n.grp AS grp ORDER BY n.grp DESC, n.id LIMIT 12",
        "SELECT id, grp FROM gnodes WHERE kind IN ('Package', 'Module') ORDER BY grp DESC NULLS FIRST, id LIMIT 12",
        False,
    ),
    "cypher_apoc_expand": (
        ("CALLS",),
        "MATCH (s:Function) WHERE s.id = 'ord::1' OR s.id = 'ord::2' CALL apoc.path.expandConfig(s, {relationshipFilter: 'CALLS>', maxLevel: 3}) YIELD path RETURN s.id AS start, length(path) AS depth, last(nodes(path)).id AS reached",
        ", p AS (SELECT id AS start, id AS reached, 0 AS depth FROM gnodes WHERE id IN ('ord::1', 'ord::2') UNION ALL SELECT start, c.dst, depth + 1 FROM p JOIN calls c ON c.src = p.reached WHERE depth < 3) SELECT start, CAST(depth AS BIGINT) AS depth, reached FROM p",
        True,
    ),
    "cypher_impact": (
        ("CALLS",),
        "MATCH (c:Function)-[:CALLS*]->(f:Function {name: '1-URGENT'}) RETURN f.id AS id, count(DISTINCT c) AS callers",
        ", p AS (SELECT c.src, c.dst AS id FROM calls c JOIN gnodes g ON g.id = c.dst AND g.name = '1-URGENT' UNION SELECT c.src, p.id FROM p JOIN calls c ON c.dst = p.src) SELECT id, count(DISTINCT src) AS callers FROM p GROUP BY id",
        True,
    ),
    "cypher_zero_hops": (
        ("CALLS",),
        "MATCH (f:Function {name: '2-HIGH'})-[:CALLS*0..3]->(x) RETURN x.name AS name, count(DISTINCT x) AS n",
        ", p AS (SELECT id, 0 AS depth FROM gnodes WHERE kind = 'Function' AND name = '2-HIGH' UNION ALL SELECT c.dst, depth + 1 FROM p JOIN calls c ON c.src = p.id WHERE depth < 3) SELECT name, count(DISTINCT p.id) AS n FROM p JOIN gnodes g ON g.id = p.id GROUP BY name",
        True,
    ),
    "cypher_undirected": (
        ("CALLS",),
        "MATCH (a:Function {name: '3-MEDIUM'})-[:CALLS*1..2]-(b) RETURN DISTINCT a.id AS a, b.id AS b",
        ", u AS (SELECT src AS x, dst AS y, src || dst AS e FROM calls UNION ALL SELECT dst, src, src || dst FROM calls), s AS (SELECT id FROM gnodes WHERE name = '3-MEDIUM') SELECT s.id AS a, u.y AS b FROM s JOIN u ON u.x = s.id UNION SELECT s.id, v.y FROM s JOIN u ON u.x = s.id JOIN u v ON v.x = u.y AND v.e <> u.e",
        False,
    ),
    "cypher_calls_to": (
        ("CALLS",),
        "MATCH (c:Function)-[:CALLS]->(f:Function) WHERE f.name = '5-LOW' RETURN c.id AS caller, f.id AS callee",
        "SELECT c.src AS caller, c.dst AS callee FROM calls c JOIN gnodes g ON g.id = c.dst WHERE g.name = '5-LOW'",
        False,
    ),
    "cypher_subquery_literals": (("CONTAINS",), "CALL { MATCH (n:Module) RETURN count(n) AS modules } RETURN modules AS modules, 1 AS one, 'x' AS word", "SELECT count(*) AS modules, CAST(1 AS BIGINT) AS one, 'x' AS word FROM gnodes WHERE kind = 'Module'", False),
}
_TRANS = (
    "MATCH p = (a)-[:NEXT*1..3]->(b) RETURN length(p) AS depth, count(*) AS n, count(DISTINCT p) AS trails",
    """, p AS (SELECT src, dst, 1 AS depth, [src || '>' || dst] AS es FROM trans
    UNION ALL SELECT p.src, t.dst, depth + 1, list_append(es, t.src || '>' || t.dst) FROM p JOIN trans t ON t.src = p.dst
    WHERE depth < 3 AND NOT list_contains(es, t.src || '>' || t.dst)) SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n, count(*) AS trails FROM p GROUP BY depth""",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name, (relations, text, _, _) in _DRIVER.items():
        found[name] = lambda s, d, relations=relations, text=text: _flat(cypher(projected(s, d, *relations), text))

    def trails(s: SparkSession, d: str) -> DataFrame:
        edges = trans_edges(s, d).withColumn("type", F.lit("NEXT"))
        nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().select("id", F.lit("Event").alias("node_type"))
        return _flat(cypher(Graph(nodes, edges), _TRANS[0]))

    return found | {"cypher_trails_cyclic": trails}


def oracle_sql() -> dict[str, str]:
    found = {name: f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{sql}" for name, (_, _, sql, recursive) in _DRIVER.items()}
    return found | {"cypher_trails_cyclic": f"WITH RECURSIVE {SQL}{_TRANS[1]}"}
