"""Further operators as driver queries: filters, names, pages and descriptors, the stored graph, projects in Cypher, the service."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweft.functions import names as N
from arborweft.functions.filters import PackageFilter, parse_include
from arborweft.functions.scratch import shared_folder
from arborweft.operators import markup, merge, resolve
from arborweft.operators.bindings import _resolved, long, op
from arborweft.operators.projection import gedges, gnodes, table
from arborweft.operators.store import GraphStore
from arborweft.plans.cypher import Graph, cypher
from arborweft.schema import EDGES, LOCATION, METADATA, NODES
from arborweft.sources import registry, udtf


def _text(c) -> F.Column:
    return F.col(c).cast("string")


# filters and names
@op("package_filter_default", "SELECT c_custkey, c_custkey % 2 = 0 AS plain, false AS named, true AS phantom FROM customer", graph=False)
def _(s, d):
    ref = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_mktsegment", F.lit("."), "c_name"))
    default = PackageFilter()
    return table(s, d, "customer").select(
        "c_custkey", default.accepts_reference(ref).alias("plain"), default.should_process(F.col("c_mktsegment")).alias("named"), default.should_create_phantom(F.col("c_mktsegment")).alias("phantom")
    )


@op(
    "include_lists",
    "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS service, c_mktsegment IN ('BUILDING', 'MACHINERY', '') AS line, false AS phantom FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer)",
    graph=False,
)
def _(s, d):
    # the command line keeps the empty part of a list, which matches only the empty package
    text, segment = " BUILDING, ,MACH*", F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_mktsegment"))
    service, line = PackageFilter(parse_include(text, service=True), create_phantoms=False), PackageFilter(parse_include(text))
    return table(s, d, "customer").select(
        "c_custkey", service.should_process(segment).alias("service"), line.should_process(segment).alias("line"), service.should_create_phantom(segment).alias("phantom")
    )


@op("class_names", r"SELECT p_partkey, regexp_matches(w, '^\p{Lu}') AS looks FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN lower(p_name) WHEN 2 THEN 'Élan' ELSE '9x' END AS w FROM part)", graph=False)
def _(s, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.lower("p_name")).when(k == 2, "Élan").otherwise("9x")
    return table(s, d, "part").select("p_partkey", N.looks_like_class(name).alias("looks"))


@op("qualifiers", "SELECT id, CASE WHEN contains(id, '::') THEN regexp_extract(id, '(?s)^(.*)::', 1) END AS qualifier FROM (SELECT CASE WHEN kind = 'Module' THEN name WHEN kind = 'Class' THEN grp || '::' || id ELSE id END AS id FROM gnodes)")
def _(s, d):
    made = F.when(F.col("kind") == "Module", F.col("name")).when(F.col("kind") == "Class", F.concat("grp", F.lit("::"), "id")).otherwise(F.col("id"))
    return gnodes(s, d).select(made.alias("id")).select("id", N.qualifier_of(F.col("id")).alias("qualifier"))


@op(
    "path_functions",
    "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'a/n' || s_nationkey || '.jsp' WHEN 1 THEN '/b/n' || s_nationkey || '.jspf.jsp' ELSE 'c.jsp.jsp' END AS path, CASE s_suppkey % 3 WHEN 0 THEN 'n' || s_nationkey WHEN 1 THEN 'n' || s_nationkey ELSE 'c' END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN '/b' ELSE '' END AS folder FROM supplier",
    graph=False,
)
def _(s, d):
    k, n = F.col("s_suppkey") % 3, _text("s_nationkey")
    raw = F.when(k == 0, F.concat(F.lit("x\\..\\a\\.\\n"), n, F.lit(".jsp"))).when(k == 1, F.concat(F.lit("/b//q/../n"), n, F.lit(".jspf.jsp"))).otherwise("c.jsp.jsp")
    rows = table(s, d, "supplier").select("s_suppkey", N.normal_path(N.forward_slashes(raw)).alias("path"))
    return rows.select("s_suppkey", "path", N.strip_suffixes(N.file_name(F.col("path")), ".jsp", ".jspf").alias("name"), N.parent(F.col("path")).alias("folder"))


@op(
    "portlet_modes",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'help' ELSE 'view' END AS mode FROM events",
    graph=False,
)
def _(s, d):
    method = F.when(F.col("event_type") == "click", "doEditItem").when(F.col("event_type") == "view", "showHELP").otherwise("doView")
    return table(s, d, "events").select("event_id", N.portlet_mode(method).alias("mode"))


@op("relation_priority", "SELECT src, dst, relation, CAST(CASE relation WHEN 'CALLS' THEN 1 ELSE 4 END AS INT) AS priority FROM gedges WHERE relation IN ('CALLS', 'CONTAINS')")
def _(s, d):
    return gedges(s, d, "CALLS", "CONTAINS").select("src", "dst", "relation", N.relation_priority(F.col("relation")).alias("priority"))


@op("languages", "SELECT * FROM (VALUES ('python', 'py', false), ('javascript', 'js', true), ('javascript', 'jsx', true), ('javascript', 'ts', true), ('javascript', 'tsx', true), ('html', 'html', false), ('html', 'htm', false), ('xml', 'xml', true), ('xml', 'portlet.xml', true), ('xml', 'web.xml', true), ('jsp', 'jsp', true), ('jspx', 'jspx', true), ('jspf', 'jspf', true), ('java', 'java', true), ('rust', 'rs', true)) t(language, key, special)", graph=False)
def _(s, d):
    special = [n for n in registry.supported_languages() if registry.has_specialized_extractor(n)]
    return registry.language_table(s).select("language", "key", F.col("language").isin(special).alias("special"))


@op("callee_names", "SELECT event_id, CASE event_type WHEN 'click' THEN 'go' WHEN 'view' THEN 'obj.run' WHEN 'error' THEN 'T::make' WHEN 'signup' THEN 'find' END AS callee FROM events", graph=False)
def _(s, d):
    t = F.col("event_type")
    call = F.when(t == "click", "go(1, f(2))").when(t == "view", "obj.run (x)").when(t == "error", "T::make()").when(t == "signup", 'this.find("a(b")').otherwise("x + 1")
    language = F.when(t == "error", "rust").when(t == "signup", "java").otherwise("javascript")
    return table(s, d, "events").select("event_id", N.callee_name(language, call).alias("callee"))


# merge and resolution
@op(
    "merge_rules",
    """, v AS (SELECT c_nationkey AS k, c_custkey AS ord, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/resources/js/a.js' WHEN 2 THEN 'x/src/a.js' ELSE '/srv/a.js' END AS path, CAST(c_custkey % 3 AS INT) AS line FROM customer),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS n FROM v),
    f AS (SELECT k, n, ord, path, line FROM o WHERE n = 1
      UNION ALL SELECT f.k, o.n, CASE WHEN keep THEN f.ord ELSE o.ord END, CASE WHEN keep THEN f.path ELSE o.path END, CASE WHEN keep THEN f.line ELSE o.line END
      FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1, LATERAL (SELECT (f.path <> '' AND o.path = '') OR (f.path = 'x/src/a.js' AND (o.path LIKE '/res%' OR o.path LIKE '/srv%')) OR (f.line > 0 AND o.line = 0) AS keep))
    SELECT CAST(k AS VARCHAR) AS id, max_by(ord, n) AS ord, max_by(path, n) AS file_path FROM f GROUP BY k""",
    recursive=True,
)
def _(s, d):
    k = F.col("c_custkey") % 4
    path = F.when(k == 0, "").when(k == 1, "/resources/js/a.js").when(k == 2, "x/src/a.js").otherwise("/srv/a.js")
    place = F.struct((F.col("c_custkey") % 3).cast("int").alias("start_line"))
    rows = table(s, d, "customer").select(_text("c_nationkey").alias("id"), path.alias("file_path"), place.alias("location"), F.col("c_custkey").alias("at"), F.col("c_custkey").alias("ord"))
    return merge.merge_nodes(rows, ["at"]).select("id", "ord", "file_path")


@op(
    "resolve_imports",
    """, i AS (SELECT 'imp::' || o_orderkey AS id, 'mod::' || (o_orderkey % 9) AS m, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment || '.' || c_name ELSE c_name END AS ref FROM orders JOIN customer ON c_custkey = o_custkey),
    one AS (SELECT name, min(id) AS id FROM gnodes WHERE kind = 'Class' GROUP BY name), simple AS (SELECT split_part(name, '.', 2) AS s, min(name || '|' || id) AS m FROM gnodes WHERE kind = 'Class' GROUP BY 1),
    hit AS (SELECT i.id, i.m, coalesce(one.id, CASE WHEN NOT contains(ref, '.') THEN split_part(simple.m, '|', 2) END) AS dst FROM i LEFT JOIN one ON one.name = ref LEFT JOIN simple ON simple.s = ref WHERE NOT contains(ref, '.') OR ref LIKE 'BUILDING.%')
    SELECT m AS src, dst, 'Imports' AS relation FROM hit WHERE dst IS NOT NULL UNION ALL SELECT id, dst, 'References' FROM hit WHERE dst IS NOT NULL""",
)
def _(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ref = F.when(F.col("o_orderkey") % 2 == 0, F.concat("c_mktsegment", F.lit("."), "c_name")).otherwise(F.col("c_name"))
    meta = F.create_map(F.lit("module_id"), F.concat(F.lit("mod::"), (F.col("o_orderkey") % 9).cast("string")), F.lit("import_path"), ref)
    imports = o.select(F.concat(F.lit("imp::"), _text("o_orderkey")).alias("id"), F.lit("Import").alias("kind"), F.lit("").alias("name"), meta.alias("metadata"))
    classes = gnodes(s, d).where("kind = 'Class'").groupBy(F.col("name").alias("fqn")).agg(F.min("id").alias("id"))
    return resolve.resolve_imports(imports, classes, PackageFilter(["BUILDING"])).select("src", "dst", "relation")


@op(
    "extract_java_interfaces",
    """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)
    SELECT 'com.n' || n || '.I' || k AS src, 'f' || k || '.java::com.n' || n || '::I' || k || '::function:act' AS dst, 'Contains' AS relation FROM s
    UNION ALL SELECT 'com.n' || n || '.C' || k, 'com.n' || n || '.I' || k, 'Implements' FROM s""",
    graph=False,
)
def _(s, d):
    text = "package com.n%3$s;\npublic interface I%1$s {\n  void act(int n);\n}\nclass C%1$s implements I%1$s { }\n"
    return _resolved(s, d, ".java", text, "Contains", "Implements").where("src LIKE '%.I%' OR relation = 'Implements'")


@op("extract_renders", "SELECT 'p.V' || s_suppkey AS src, 'jsp::' || CASE m WHEN 'view' THEN '/v' ELSE 'e' END || s_suppkey || '.jsp' AS dst, m AS mode FROM supplier, (VALUES ('view'), ('edit')) t(m)", graph=False)
def _(s, d):
    from arborweft.operators.extract import read_records
    from arborweft.operators.parsers.java import read_renders

    k = _text("s_suppkey")
    text = F.concat(F.lit("package p; class V"), k, F.lit(' extends G { void doView() { dispatch("/v'), k, F.lit('.jsp"); } void doEdit() { dispatch("e'), k, F.lit('.jsp"); } }'))
    files = table(s, d, "supplier").select(F.concat(F.lit("V"), k, F.lit(".java")).alias("path"), text.alias("text"), F.lit("1").alias("seq"), F.lit("java").alias("language"))
    rows = read_records(files, {"java": read_renders}).where("rec = 'edge'")
    return rows.select("src", "dst", F.col("metadata")["mode"].alias("mode"))


# pages and descriptors
def _site(s, d) -> tuple[DataFrame, DataFrame]:
    """A page for each supplier, in the web folder of its nation, and all files: every third page's targets are there."""
    k, n = F.col("s_suppkey"), _text("s_nationkey")
    root = F.concat(F.lit("n"), n, F.when(k % 2 == 0, "/webapp").otherwise("/site"))
    text = F.concat(
        F.lit('<jsp:include flush="true" page="/top.jsp"></jsp:include><%@ include file="part'), k.cast("string"), F.lit('.jspf" %>'),
        F.lit("<script defer src='js/a.js'></script><script src=\"<c:url value=\"/js/b.js\"/>\"></script><script src='x.py'></script>"),
        F.lit('<link href="css/s.css?v=2" rel="stylesheet"/><%@ page language="java" import="p.Bean" %>'),
    )
    rows = table(s, d, "supplier").select(k.alias("k"), root.alias("root"), F.concat(root, F.lit("/d/p"), k.cast("string"), F.lit(".jsp")).alias("path"), text.alias("text"), F.lit("1").alias("seq"))
    there = F.array(F.concat("root", F.lit("/top.jsp")), F.concat("root", F.lit("/d/part"), F.col("k").cast("string"), F.lit(".jspf")), F.concat("root", F.lit("/js/b.js")), F.concat("root", F.lit("/d/js/a.js")))
    files = rows.select("path").union(rows.where("k % 3 = 0").select(F.explode(there))).union(rows.select(F.concat("root", F.lit("/WEB-INF/web.xml")))).distinct()
    return rows, files


_SITE = """WITH s AS (SELECT s_suppkey AS k, 'n' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '/webapp' ELSE '/site' END AS root FROM supplier),
full_ AS (SELECT DISTINCT root FROM s WHERE k % 3 = 0), p AS (SELECT k, s.root, s.root || '/d/p' || k || '.jsp' AS path, full_.root IS NOT NULL AS f, k % 3 = 0 AS own FROM s LEFT JOIN full_ ON full_.root = s.root)"""


@op(
    "extract_jsp",
    _SITE
    + """ SELECT 'jsp::' || path AS src, 'jsp::' || CASE WHEN f THEN root || '/top.jsp' ELSE '/top.jsp' END AS dst, 'IncludesJsp' AS relation, NULL AS position FROM p
    UNION ALL SELECT 'jsp::' || path, 'jsp::' || CASE WHEN own THEN root || '/d/part' || k || '.jspf' ELSE 'part' || k || '.jspf' END, 'IncludesJsp', NULL FROM p
    UNION ALL SELECT 'jsp::' || path, CASE WHEN f THEN root || '/d/js/a.js' ELSE 'js/a.js' END || '::module', 'IncludesJs', '0' FROM p
    UNION ALL SELECT 'jsp::' || path, CASE WHEN f THEN root || '/js/b.js' ELSE '/js/b.js' END || '::module', 'IncludesJs', '1' FROM p
    UNION ALL SELECT 'jsp::' || path, 'css::css/s.css', 'IncludesCss', '0' FROM p UNION ALL SELECT 'jsp::' || path, 'p.Bean', 'Imports', NULL FROM p""",
    graph=False,
)
def _(s, d):
    pages, files = _site(s, d)
    _, edges = markup.extract_jsp(pages, files)
    return edges.select("src", "dst", "relation", F.col("metadata")["position"].alias("position"))


@op("webapp_roots", _SITE + " SELECT path, root FROM p", graph=False)
def _(s, d):
    pages, files = _site(s, d)
    return markup.webapp_roots(pages, files).select("path", "root")


@op(
    "web_filters",
    """SELECT 'filter::F' || s_suppkey AS src, 'c.F' || s_suppkey AS dst, 'ImplementedBy' AS relation, NULL AS place, NULL AS url FROM supplier
    UNION ALL SELECT 'filter::F' || s_suppkey, 'servlet::FilterChain', 'Filters', CAST(i AS VARCHAR), CASE i WHEN 0 THEN '/*' WHEN 1 THEN '/a' ELSE '/b' || s_suppkey END FROM supplier, range(3) t(i)""",
    graph=False,
)
def _(s, d):
    k = _text("s_suppkey")
    mapping = lambda *urls: F.concat(F.lit("<filter-mapping><filter-name>F"), k, F.lit("</filter-name>"), *(F.concat(F.lit("<url-pattern>"), u, F.lit("</url-pattern>")) for u in urls), F.lit("</filter-mapping>"))
    text = F.concat(
        F.lit("<web-app><filter><filter-name>F"), k, F.lit("</filter-name><filter-class>c.F"), k, F.lit("</filter-class></filter><filter><filter-name>none</filter-name></filter>"),
        mapping(F.lit("/*"), F.lit("/a")), F.lit("<filter-mapping><filter-name>lost</filter-name><url-pattern>/x</url-pattern></filter-mapping>"), mapping(F.concat(F.lit("/b"), k)), F.lit("</web-app>"),
    )
    _, edges = markup.extract_web_xml(table(s, d, "supplier").select(F.concat(k, F.lit("/web.xml")).alias("path"), text.alias("text"), F.lit(1).alias("seq")))
    m = F.col("metadata")
    return edges.where("relation IN ('Filters', 'ImplementedBy')").select("src", "dst", "relation", m["order"].alias("place"), m["urlPattern"].alias("url"))


# the stored graph
def _node_rows(rows: DataFrame) -> DataFrame:
    """id, kind, name as rows of the node table."""
    return rows.select("id", "kind", "name", F.lit("").alias("file_path"), F.lit(None).cast(LOCATION).alias("location"), F.create_map().cast(METADATA).alias("metadata"))


def _edge_rows(rows: DataFrame) -> DataFrame:
    return rows.select("src", "dst", F.lit("Calls").alias("relation"), F.create_map().cast(METADATA).alias("metadata"))


def _scratch_store(s) -> GraphStore:
    return GraphStore(s, f"{shared_folder(s)}/graph-{uuid.uuid4().hex}")


@op(
    "store_round_trip",
    """, n AS (SELECT count(*) AS n FROM gnodes WHERE kind = 'Function'), e AS (SELECT count(*) AS n FROM calls)
    SELECT 'a' AS project, 'added twice' AS step, 2 * n.n AS nodes, 2 * e.n AS edges FROM n, e UNION ALL SELECT 'a', 'cleared, no edges', n.n, 0 FROM n
    UNION ALL SELECT 'b', 'beside it', n.n, e.n FROM n, e UNION ALL SELECT 'b', 'other deleted', n.n, e.n FROM n, e UNION ALL SELECT 'a', 'deleted', 0, 0 UNION ALL SELECT 'c', 'all replaced', n.n, e.n FROM n, e UNION ALL SELECT 'b', 'all replaced', 0, 0""",
)
def _(s, d):
    nodes, edges, store, out = _node_rows(gnodes(s, d).where("kind = 'Function'")), _edge_rows(gedges(s, d, "CALLS")), _scratch_store(s), []

    def note(project: str, step: str) -> None:
        mine = F.col("project_path") == project
        out.append((project, step, store.nodes().where(mine).count(), store.edges().where(mine).select("edge_id").distinct().count()))

    assert store.test_connection()
    store.export(nodes, edges, "a", "A")
    store.export(nodes, edges, "a", "A")
    store.export(nodes, edges, "b", "B")
    note("a", "added twice")
    store.export(nodes, edges.where("false"), "a", "A", clear=True)
    note("a", "cleared, no edges")
    note("b", "beside it")
    store.delete_project("a")
    note("a", "deleted")
    note("b", "other deleted")
    store.export(nodes, edges, "c", "C", full=True)
    note("c", "all replaced")
    note("b", "all replaced")
    store.clear()
    return s.createDataFrame(out, "project string, step string, nodes long, edges long")


@op(
    "cypher_projects",
    "SELECT a.name AS caller, b.name AS callee, p.project AS project, count(*) AS n FROM calls c JOIN gnodes a ON a.id = c.src JOIN gnodes b ON b.id = c.dst, (VALUES ('p1')) p(project) GROUP BY ALL",
)
def _(s, d):
    # the same ids in two projects: an edge stays in its own
    n, e = gnodes(s, d).where("kind = 'Function'").withColumnRenamed("kind", "node_type"), gedges(s, d, "CALLS").withColumnRenamed("relation", "type")
    both = lambda df: df.withColumn("project_path", F.explode(F.array(F.lit("p1"), F.lit("p2"))))
    text = "MATCH (a:Function {project_path: 'p1'})-[:CALLS]->(b) RETURN a.name AS caller, b.name AS callee, b.project_path AS project, count(*) AS n"
    return cypher(Graph(both(n), both(e)), text)


@op("cypher_metadata_null", "SELECT id, 'n' || grp AS value FROM gnodes WHERE grp IS NOT NULL AND kind = 'Module' UNION ALL SELECT id, NULL FROM gnodes WHERE kind = 'Package'")
def _(s, d):
    n = gnodes(s, d).where("kind IN ('Module', 'Package')")
    meta = F.when(F.col("grp").isNotNull(), F.create_map(F.lit("url-pattern"), F.concat(F.lit("n"), "grp"))).otherwise(F.create_map().cast(METADATA))
    nodes = n.select("id", F.col("kind").alias("node_type"), "grp", meta.alias("metadata"))
    g = Graph(nodes, gedges(s, d, "CONTAINS").withColumnRenamed("relation", "type"))
    some = cypher(g, "MATCH (n:Module) WHERE n.grp IS NOT NULL RETURN n.id AS id, n.metadata.`url-pattern` AS value")
    return some.unionByName(cypher(g, "MATCH (n) WHERE n.grp IS NULL RETURN n.id AS id, n.metadata.`url-pattern` AS value"))


# services and SQL
@op("service_protocol", "SELECT * FROM (VALUES ('initialize', '2024-11-05'), ('tools/list', 'list_projects,add_project,remove_project'), ('nope', '-32601'), ('tools/call', '-32601'), ('notification', 'none'), ('outside', 'error')) t(method, answer)", graph=False)
def _(s, d):
    from arborweft.service import Service

    service = Service(s, _scratch_store(s), d)
    ask = lambda method, **params: json.loads(json.dumps(service.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))["result"]
    outside = ask("tools/call", name="add_project", arguments={"project_path": "../x"})
    rows = [
        ("initialize", ask("initialize")["protocolVersion"]),
        ("tools/list", ",".join(t["name"] for t in ask("tools/list")["tools"])),
        ("nope", str(ask("nope")["error"]["code"])),
        ("tools/call", str(ask("tools/call", name="other")["error"]["code"])),
        ("notification", "none" if service.handle({"method": "initialize"}) is None else "some"),
        ("outside", "error" if outside["isError"] else "fine"),
    ]
    return s.createDataFrame(rows, "method string, answer string")


@op("extract_source_udtf", "SELECT s_suppkey AS k, 'S' || s_suppkey AS id, 'Class' AS kind FROM supplier UNION ALL SELECT s_suppkey, 'S' || s_suppkey || '.java::S' || s_suppkey || '::function:run', 'Function' FROM supplier", graph=False)
def _(s, d):
    udtf.register(s)
    name = f"suppliers_{uuid.uuid4().hex}"
    table(s, d, "supplier").createOrReplaceTempView(name)
    rows = s.sql(f"SELECT s_suppkey AS k, r.id, r.kind FROM {name}, LATERAL extract_source('java', concat('S', s_suppkey, '.java'), concat('class S', s_suppkey, ' {{ void run() {{ }} }}')) r WHERE r.rec = 'node'")
    return rows.where("kind IN ('Class', 'Function')")


@op("stored_schemas", f"SELECT * FROM (VALUES {', '.join(repr(('nodes', f.name)) for f in NODES)}, {', '.join(repr(('edges', f.name)) for f in EDGES)}) t(what, name)", graph=False)
def _(s, d):
    store = _scratch_store(s)
    store.export(_node_rows(gnodes(s, d).where("kind = 'Package'")), _edge_rows(gedges(s, d, "CALLS")).limit(0), "p", "P")
    read = [("nodes", s.read.parquet(f"{store.path}/nodes"))]
    rows = [(w, c) for w, df in read for c in df.columns] + [("edges", c) for c in store.edges().columns]
    store.clear()
    return s.createDataFrame(rows, "what string, name string")


@op("analysis_report", "SELECT count(*) AS processed, (SELECT count(*) FROM nation) AS unsupported, CAST(0 AS BIGINT) AS errors FROM supplier", graph=False)
def _(s, d):
    from arborweft.operators.analysis import analyze_texts

    java = table(s, d, "supplier").select(F.concat(F.lit("S"), _text("s_suppkey"), F.lit(".java")).alias("path"), F.concat(F.lit("class S"), _text("s_suppkey"), F.lit(" {}")).alias("text"))
    other = table(s, d, "nation").select(F.concat(F.lit("n"), _text("n_nationkey"), F.lit(".txt")).alias("path"), F.lit("x").alias("text"))
    files = registry.detect_language(java.union(other)).withColumn("supported", F.col("language").isNotNull()).withColumn("read_error", F.lit(None).cast("string"))
    graph = analyze_texts(files)
    return graph.counts().select(long("processed").alias("processed"), long("unsupported").alias("unsupported"), long("errors").alias("errors"))
