"""Every operator as a driver query over the graph projection of the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborweft.functions import names as N
from arborweft.functions.filters import PackageFilter
from arborweft.operators import merge, paths, resolve, store
from arborweft.operators.projection import SQL, gedges, gnodes, table, trans
from arborweft.sources import registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def op(name: str, sql: str | None, graph: bool = True, recursive: bool = False):
    """Register a query; sql may use the projections of the graph."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            head = "WITH RECURSIVE " if recursive else "WITH "
            ORACLE[name] = f"{head}{SQL}{sql}" if graph else sql
        return f

    return put


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


@op("node_scan_by_label", "SELECT id, name, grp FROM gnodes WHERE kind = 'Class'")
def _(s, d):
    return gnodes(s, d).where("kind = 'Class'").select("id", "name", "grp")


@op("node_scan_by_props", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7", graph=False)
def _(s, d):
    return table(s, d, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 7)).select("c_custkey", "c_name")


@op("labels_of", ", x AS (SELECT 'Node,' || kind AS labels FROM gnodes) SELECT labels, count(*) AS n FROM x GROUP BY labels")
def _(s, d):
    labels = F.array_join(F.array(F.lit("Node"), F.col("kind")), ",").alias("labels")
    return gnodes(s, d).select(labels).groupBy("labels").agg(F.count("*").alias("n"))


@op("string_predicates", "SELECT p_partkey, contains(p_name, 'a') AS has, starts_with(p_name, 'P') AS begins, ends_with(p_name, '1') AS ends FROM part", graph=False)
def _(s, d):
    c = F.col("p_name")
    return table(s, d, "part").select("p_partkey", c.contains("a").alias("has"), c.startswith("P").alias("begins"), c.endswith("1").alias("ends"))


@op("in_list", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, 5, 8)", graph=False)
def _(s, d):
    return table(s, d, "nation").where(F.col("n_nationkey").isin(1, 3, 5, 8)).select("n_nationkey", "n_name")


@op(
    "null_and_defaults",
    "SELECT id, coalesce(grp, '') AS grp, coalesce(nullif(kind, 'Type'), 'unknown') AS language, grp IS NULL AS missing FROM gnodes WHERE kind IN ('Type', 'Package', 'Module')",
)
def _(s, d):
    rows = gnodes(s, d).where(F.col("kind").isin("Type", "Package", "Module"))
    return rows.select("id", F.coalesce("grp", F.lit("")).alias("grp"), F.coalesce(F.nullif("kind", F.lit("Type")), F.lit("unknown")).alias("language"), F.col("grp").isNull().alias("missing"))


@op("hop_one", "SELECT n.name AS nation, c.id AS customer FROM gnodes n JOIN contains_ e ON e.src = n.id JOIN gnodes c ON c.id = e.dst WHERE n.kind = 'Module' AND c.kind = 'Class'")
def _(s, d):
    n, e = gnodes(s, d), gedges(s, d, "CONTAINS")
    a = n.where("kind = 'Module'").select(F.col("id").alias("src"), F.col("name").alias("nation"))
    b = n.where("kind = 'Class'").select(F.col("id").alias("dst"))
    return e.join(a, "src").join(b, "dst").select("nation", F.col("dst").alias("customer"))


@op("hop_alternatives", "SELECT relation, count(*) AS n FROM gedges WHERE relation IN ('CONTAINS', 'DEFINES') GROUP BY relation")
def _(s, d):
    return gedges(s, d, "CONTAINS", "DEFINES").groupBy("relation").agg(F.count("*").alias("n"))


@op(
    "hop_chain",
    "SELECT r.src AS region, count(*) AS n FROM contains_ r JOIN contains_ m ON m.src = r.dst JOIN contains_ o ON o.src = m.dst WHERE r.src LIKE 'region::%' GROUP BY r.src",
)
def _(s, d):
    e = gedges(s, d, "CONTAINS").select("src", "dst", "edge_id")
    a, b, c = (e.select(*(F.col(x).alias(f"{x}{i}") for x in e.columns)) for i in range(3))
    out = a.where(F.startswith("src0", F.lit("region::"))).join(b, F.col("dst0") == F.col("src1")).join(c, F.col("dst1") == F.col("src2"))
    return out.where("edge_id0 != edge_id1 AND edge_id1 != edge_id2").groupBy(F.col("src0").alias("region")).agg(F.count("*").alias("n"))


@op("multi_match", "SELECT x.dst AS part, count(*) AS pairs FROM defines x JOIN uses u ON u.dst = x.dst GROUP BY x.dst")
def _(s, d):
    # both clauses share the part: counts on each side are enough, so no pair is built
    a = gedges(s, d, "DEFINES").groupBy("dst").agg(F.count("*").alias("a"))
    b = gedges(s, d, "USES").groupBy("dst").agg(F.count("*").alias("b"))
    return a.join(b, "dst").select(F.col("dst").alias("part"), (F.col("a") * F.col("b")).alias("pairs"))


@op(
    "optional_match_collect",
    "SELECT c.id, count(o.id) AS n, coalesce(string_agg(o.name, ',' ORDER BY o.name), '') AS priorities FROM gnodes c LEFT JOIN gnodes o ON o.grp = c.id AND o.kind = 'Function' WHERE c.kind = 'Class' GROUP BY c.id",
)
def _(s, d):
    n = gnodes(s, d)
    o = n.where("kind = 'Function'").groupBy(F.col("grp").alias("id")).agg(F.count("*").alias("k"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("p"))
    return n.where("kind = 'Class'").select("id").join(o, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("n"), F.coalesce("p", F.lit("")).alias("priorities"))


_URGENT = "SELECT 1 FROM gnodes o WHERE o.grp = c.id AND o.name = '1-URGENT'"


@op("anti_pattern", f"SELECT c.id FROM gnodes c WHERE c.kind = 'Class' AND NOT EXISTS ({_URGENT})")
def _(s, d):
    n = gnodes(s, d)
    urgent = n.where("kind = 'Function' AND name = '1-URGENT'").select(F.col("grp").alias("id"))
    return n.where("kind = 'Class'").select("id").join(urgent, "id", "left_anti")


@op("semi_pattern", "SELECT id FROM gnodes p WHERE kind = 'Type' AND EXISTS (SELECT 1 FROM uses u WHERE u.dst = p.id)")
def _(s, d):
    return gnodes(s, d).where("kind = 'Type'").select("id").join(gedges(s, d, "USES").select(F.col("dst").alias("id")), "id", "left_semi")


@op(
    "leaf_nodes",
    ", p AS (SELECT dst FROM calls WHERE src NOT IN (SELECT dst FROM calls) UNION SELECT c.dst FROM p JOIN calls c ON c.src = p.dst) SELECT dst AS id FROM p WHERE dst NOT IN (SELECT src FROM calls)",
    recursive=True,
)
def _(s, d):
    e = gedges(s, d, "CALLS")
    first = e.select(F.col("src").alias("id")).join(e.select(F.col("dst").alias("id")), "id", "left_anti").distinct()
    return paths.leaves(paths.reachable(e, first, per_start=False).select("id").distinct(), e)


@op("out_degree", "SELECT id, count(c.src) AS degree FROM gnodes o LEFT JOIN calls c ON c.src = o.id WHERE kind = 'Function' GROUP BY id")
def _(s, d):
    return paths.degrees(gnodes(s, d).where("kind = 'Function'"), gedges(s, d, "CALLS"))


@op("in_degree", "SELECT id, count(u.dst) AS degree FROM gnodes o LEFT JOIN uses u ON u.dst = o.id WHERE kind = 'Type' GROUP BY id")
def _(s, d):
    return paths.degrees(gnodes(s, d).where("kind = 'Type'"), gedges(s, d, "USES"), "dst")


@op(
    "varlen_1_5",
    ", p AS (SELECT src, dst, 1 AS depth FROM calls UNION ALL SELECT p.src, c.dst, depth + 1 FROM p JOIN calls c ON c.src = p.dst WHERE depth < 5) SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM p GROUP BY depth",
    recursive=True,
)
def _(s, d):
    e = gedges(s, d, "CALLS")
    out = paths.expand(e, e.select(F.col("src").alias("id")).distinct(), 1, 5, nodes=False)
    return out.groupBy(long("depth").alias("depth")).agg(F.count("*").alias("n"))


@op(
    "varlen_trails_cyclic",
    """, p AS (SELECT src, dst, 1 AS depth, [src || '>' || dst] AS es FROM trans
    UNION ALL SELECT p.src, t.dst, depth + 1, list_append(es, t.src || '>' || t.dst) FROM p JOIN trans t ON t.src = p.dst
    WHERE depth < 3 AND NOT list_contains(es, t.src || '>' || t.dst)) SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM p GROUP BY depth""",
    recursive=True,
)
def _(s, d):
    e = trans(s, d)
    out = paths.expand(e, e.select(F.col("src").alias("id")).distinct(), 1, 3, nodes=False)
    return out.groupBy(long("depth").alias("depth")).agg(F.count("*").alias("n"))


@op(
    "varlen_path_names",
    """, first AS (SELECT min(src) AS id FROM calls WHERE src NOT IN (SELECT dst FROM calls)),
    p AS (SELECT id, 0 AS depth, (SELECT name FROM gnodes g WHERE g.id = first.id) AS names FROM first
    UNION ALL SELECT c.dst, depth + 1, names || '>' || g.name FROM p JOIN calls c ON c.src = p.id JOIN gnodes g ON g.id = c.dst WHERE depth < 5)
    SELECT id, CAST(depth AS BIGINT) AS depth, names FROM p WHERE depth > 0""",
    recursive=True,
)
def _(s, d):
    e = gedges(s, d, "CALLS")
    first = e.select(F.col("src").alias("id")).join(e.select(F.col("dst").alias("id")), "id", "left_anti").agg(F.min("id").alias("id"))
    out = paths.expand(e, first, 1, 5).select(F.col("end").alias("id"), long("depth").alias("depth"), F.posexplode("node_ids").alias("pos", "nid"))
    name = gnodes(s, d).where("kind = 'Function'").select(F.col("id").alias("nid"), "name")
    named = out.join(name, "nid").groupBy("id", "depth").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("p"))
    return named.select("id", "depth", F.array_join(F.transform("p", lambda x: x["name"]), ">").alias("names"))


_CONTAINED = ", p AS (SELECT src AS start, dst, 1 AS depth FROM contains_ WHERE src LIKE 'region::%' UNION ALL SELECT start, c.dst, depth + 1 FROM p JOIN contains_ c ON c.src = p.dst) "


@op("reachable_distinct", _CONTAINED + "SELECT DISTINCT dst AS id FROM p WHERE start = 'region::0'", recursive=True)
def _(s, d):
    return paths.reachable(gedges(s, d, "CONTAINS"), s.createDataFrame([("region::0",)], "id string")).select("id")


def min_depth(s: SparkSession, d: str) -> DataFrame:
    """The flagship: fewest containment hops from every region to whatever it holds."""
    out = paths.reachable(gedges(s, d, "CONTAINS"), gnodes(s, d).where("kind = 'Package'").select("id"))
    return out.groupBy("start", "id").agg(F.min(long("depth")).alias("depth"))


op("min_depth", _CONTAINED + "SELECT start, dst AS id, CAST(min(depth) AS BIGINT) AS depth FROM p GROUP BY start, dst", recursive=True)(min_depth)


_LASTS = "lasts AS (SELECT dst FROM calls WHERE dst NOT IN (SELECT src FROM calls))"


@op(
    "callers_transitive",
    f", {_LASTS}, p AS (SELECT l.dst AS target, c.src AS caller FROM lasts l JOIN calls c ON c.dst = l.dst UNION ALL SELECT target, c.src FROM p JOIN calls c ON c.dst = p.caller) SELECT target, count(DISTINCT caller) AS callers FROM p GROUP BY target",
    recursive=True,
)
def _(s, d):
    e = gedges(s, d, "CALLS")
    last = e.select(F.col("dst").alias("id")).join(e.select(F.col("src").alias("id")), "id", "left_anti").distinct()
    return paths.reachable(paths.reverse(e), last).groupBy(F.col("start").alias("target")).agg(F.count_distinct("id").alias("callers"))


@op(
    "impact_count",
    ", p AS (SELECT src AS start, dst, 1 AS depth FROM contains_ WHERE src LIKE 'nation::%' UNION ALL SELECT start, c.dst, depth + 1 FROM p JOIN contains_ c ON c.src = p.dst) SELECT start, count(DISTINCT dst) AS reached FROM p GROUP BY start",
    recursive=True,
)
def _(s, d):
    out = paths.reachable(gedges(s, d, "CONTAINS"), gnodes(s, d).where("kind = 'Module'").select("id"))
    return out.groupBy("start").agg(F.count_distinct("id").alias("reached"))


@op("hotspot", "SELECT grp, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, grp) AS BIGINT) AS place FROM gnodes WHERE kind = 'Function' GROUP BY grp ORDER BY n DESC, grp LIMIT 50")
def _(s, d):
    top = gnodes(s, d).where("kind = 'Function'").groupBy("grp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "grp").limit(50)
    return top.withColumn("place", long(F.row_number().over(W.orderBy(F.desc("n"), "grp"))))


@op("collect_methods", "SELECT grp, string_agg(name, ',' ORDER BY name) AS methods FROM gnodes WHERE kind = 'Class' GROUP BY grp")
def _(s, d):
    return gnodes(s, d).where("kind = 'Class'").groupBy("grp").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("methods"))


@op("counts_by_kind_lang", "SELECT kind, split_part(grp, '::', 1) AS grp, count(*) AS n FROM gnodes GROUP BY ROLLUP (kind, split_part(grp, '::', 1))")
def _(s, d):
    return gnodes(s, d).select("kind", N.first_segment(F.col("grp")).alias("grp")).rollup("kind", "grp").agg(F.count("*").alias("n"))


@op("kind_summary", "SELECT count(*) FILTER (kind = 'Function') AS functions, count(*) FILTER (kind = 'Class') AS classes, count(*) FILTER (kind = 'Interface') AS interfaces, count(*) AS total FROM gnodes")
def _(s, d):
    c = lambda k: F.count_if(F.col("kind") == k)
    return gnodes(s, d).agg(c("Function").alias("functions"), c("Class").alias("classes"), c("Interface").alias("interfaces"), F.count("*").alias("total"))


@op("order_nulls_last", "SELECT id, grp, CAST(row_number() OVER (ORDER BY grp ASC NULLS LAST, id) AS BIGINT) AS up, CAST(row_number() OVER (ORDER BY grp DESC NULLS FIRST, id) AS BIGINT) AS down FROM gnodes WHERE kind IN ('Package', 'Module')")
def _(s, d):
    rows = gnodes(s, d).where(F.col("kind").isin("Package", "Module"))
    up, down = W.orderBy(F.asc_nulls_last("grp"), "id"), W.orderBy(F.desc_nulls_first("grp"), "id")
    return rows.select("id", "grp", long(F.row_number().over(up)).alias("up"), long(F.row_number().over(down)).alias("down"))


@op("distinct_endpoints", "SELECT DISTINCT a.kind AS source, b.kind AS target, relation FROM gedges e JOIN gnodes a ON a.id = e.src JOIN gnodes b ON b.id = e.dst")
def _(s, d):
    n, e = gnodes(s, d).select("id", "kind"), gedges(s, d)
    a, b = n.select(F.col("id").alias("src"), F.col("kind").alias("source")), n.select(F.col("id").alias("dst"), F.col("kind").alias("target"))
    return e.select("src", "dst", "relation").join(a, "src").join(b, "dst").select("source", "target", "relation").distinct()


@op("path_count_distinct", "SELECT count(DISTINCT a.src || '>' || a.dst || '>' || b.dst) AS n FROM trans a JOIN trans b ON b.src = a.dst WHERE a.src <> b.src OR a.dst <> b.dst")
def _(s, d):
    e = trans(s, d)
    return paths.expand(e, e.select(F.col("src").alias("id")).distinct(), 2, 2, nodes=False).agg(F.count_distinct("edge_ids").alias("n"))


@op(
    "unwind_list",
    "SELECT p_partkey, CAST(pos AS BIGINT) AS pos, w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part)",
    graph=False,
)
def _(s, d):
    rows = table(s, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "w"))
    return rows.withColumn("pos", long("pos"))


@op(
    "merge_nodes_fold",
    """WITH v AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN '' ELSE 'a/' || event_type || '.java' END AS file_path FROM events),
    last AS (SELECT user_id, coalesce(max(event_id) FILTER (file_path <> ''), max(event_id)) AS event_id FROM v GROUP BY user_id)
    SELECT CAST(v.user_id AS VARCHAR) AS id, v.file_path, v.event_id AS ord FROM v JOIN last USING (user_id, event_id)""",
    graph=False,
)
def _(s, d):
    path = F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("a/"), "event_type", F.lit(".java")))
    line = F.struct(F.lit(1).alias("start_line"))
    rows = table(s, d, "events").select(F.col("user_id").cast("string").alias("id"), path.alias("file_path"), line.alias("location"), "event_id", F.col("event_id").alias("ord"))
    return merge.merge_nodes(rows, ["event_id"]).select("id", "file_path", "ord")


@op("bag_union_edges", "SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM uses UNION ALL SELECT src, dst FROM uses WHERE dst LIKE '%7') GROUP BY src, dst HAVING count(*) > 1")
def _(s, d):
    e = gedges(s, d, "USES").select("src", "dst")
    return merge.bag_union(e, e.where(F.endswith("dst", F.lit("7")))).groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")


@op(
    "stub_insert_if_absent",
    """, have AS (SELECT id FROM gnodes WHERE kind = 'Type' AND id LIKE '%1')
    SELECT id, false AS stub FROM have UNION ALL SELECT DISTINCT dst, true FROM defines WHERE dst NOT IN (SELECT id FROM have)""",
)
def _(s, d):
    have = gnodes(s, d).where("kind = 'Type'").where(F.endswith("id", F.lit("1"))).select("id", F.lit(False).alias("stub"))
    return merge.insert_if_absent(have, gedges(s, d, "DEFINES").select(F.col("dst").alias("id"), F.lit(True).alias("stub")))


def _classes(s, d):
    return gnodes(s, d).where("kind = 'Class'").select(F.col("name").alias("fqn"), "id")


@op(
    "resolve_fqn",
    """, refs AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment || '.' || c_name ELSE 'none.' || c_name END AS ref FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT o_orderkey, ref, g.id AS target_id, CASE WHEN g.id IS NULL THEN 'External' ELSE 'Local' END AS target_status FROM refs LEFT JOIN gnodes g ON g.kind = 'Class' AND g.name = ref""",
)
def _(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ref = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.col("c_mktsegment")).otherwise("none"), F.lit("."), "c_name")
    return resolve.resolve_reference(o.select("o_orderkey", ref.alias("ref")), _classes(s, d)).select("o_orderkey", "ref", "target_id", "target_status")


@op(
    "resolve_simple_min",
    """, idx AS (SELECT split_part(name, '.', 2) AS simple, min(name || '|' || id) AS m FROM gnodes WHERE kind = 'Class' GROUP BY 1)
    SELECT c_custkey, split_part(m, '|', 2) AS target_id FROM customer LEFT JOIN idx ON simple = c_name""",
)
def _(s, d):
    refs = table(s, d, "customer").select("c_custkey", F.col("c_name").alias("ref"))
    return resolve.resolve_reference(refs, _classes(s, d)).select("c_custkey", "target_id")


@op(
    "resolve_with_fallback",
    """, r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'x.' || c_name ELSE c_mktsegment || '.' || c_name END AS first, c_name AS second FROM customer),
    idx AS (SELECT split_part(name, '.', 2) AS simple, min(name || '|' || id) AS m FROM gnodes WHERE kind = 'Class' GROUP BY 1)
    SELECT c_custkey, coalesce(g.id, split_part(m, '|', 2)) AS target_id FROM r LEFT JOIN gnodes g ON g.kind = 'Class' AND g.name = first AND first LIKE 'BUILDING.%' LEFT JOIN idx ON simple = second""",
)
def _(s, d):
    first = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x."), "c_name")).otherwise(F.concat("c_mktsegment", F.lit("."), "c_name"))
    rows = table(s, d, "customer").select("c_custkey", first.alias("first"), F.col("c_name").alias("second"))
    return resolve.resolve_with_fallback(rows, _classes(s, d), "first", "second", PackageFilter(["BUILDING"])).select("c_custkey", "target_id")


@op(
    "resolve_interfaces_positional",
    """, l AS (SELECT c_nationkey, c_mktsegment || '.' || c_name AS f, c_name AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
    idx AS (SELECT split_part(name, '.', 2) AS simple, min(name || '|' || id) AS m FROM gnodes WHERE kind = 'Class' GROUP BY 1)
    SELECT 'nation::' || c_nationkey AS src, split_part(m, '|', 2) AS dst FROM l JOIN idx ON simple = n""",
)
def _(s, d):
    # two parallel lists for each nation; no package passes the filter, so every name resolves by its place in the second
    c = table(s, d, "customer").select("c_nationkey", F.struct("c_custkey", F.concat("c_mktsegment", F.lit("."), "c_name").alias("f"), F.col("c_name").alias("n")).alias("x"))
    lists = c.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    joined = lambda f: F.array_join(F.transform("x", lambda v: v[f]), ", ")
    metadata = F.create_map(F.lit("interfaces_fqn"), joined("f"), F.lit("interfaces"), joined("n"))
    rows = lists.select(F.concat(F.lit("nation::"), F.col("c_nationkey").cast("string")).alias("id"), F.lit("Class").alias("kind"), metadata.alias("metadata"))
    return resolve.resolve_implements(rows, _classes(s, d), PackageFilter()).select("src", "dst")


_FUNCTIONS = "f AS (SELECT 'f' || (o_orderkey % 7) || '::pkg::T' || (o_custkey % 11) || '::function:m' || (o_orderkey % 13) AS id, 'm' || (o_orderkey % 13) AS name, 'f' || (o_orderkey % 7) AS file FROM orders)"


def _functions(s, d):
    n = lambda c, k: (F.col(c) % k).cast("string")
    o = table(s, d, "orders")
    file, name = F.concat(F.lit("f"), n("o_orderkey", 7)), F.concat(F.lit("m"), n("o_orderkey", 13))
    return o.select(F.concat(file, F.lit("::pkg::T"), n("o_custkey", 11), F.lit("::function:"), name).alias("id"), name.alias("name"), file.alias("file"))


@op(
    "resolve_typed_call",
    f""", {_FUNCTIONS}, c AS (SELECT o_orderkey AS k, 'm' || (o_orderkey % 17) AS method_name, CASE WHEN o_orderkey % 3 = 0 THEN 'pkg::' ELSE '' END || 'T' || (o_custkey % 14) AS object_type FROM orders),
    u AS (SELECT DISTINCT method_name, object_type FROM c), df AS (SELECT DISTINCT id, name FROM f),
    r AS (SELECT method_name, object_type, min(id) AS target_id FROM u JOIN df ON name = method_name AND contains(id, '::' || object_type || '::') GROUP BY ALL)
    SELECT k, method_name, object_type, target_id FROM c LEFT JOIN r USING (method_name, object_type)""",
)
def _(s, d):
    n = lambda c, k: (F.col(c) % k).cast("string")
    kind = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "pkg::").otherwise(""), F.lit("T"), n("o_custkey", 14))
    calls = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("m"), n("o_orderkey", 17)).alias("method_name"), kind.alias("object_type"))
    return resolve.resolve_typed_calls(calls, _functions(s, d)).select("k", "method_name", "object_type", "target_id")


@op(
    "resolve_untyped_call",
    f""", {_FUNCTIONS}, c AS (SELECT o_orderkey AS k, 'm' || (o_orderkey % 17) AS method_name, 'f' || (o_custkey % 9) AS file FROM orders),
    h AS (SELECT name, file, min(id) AS x FROM f GROUP BY ALL), o AS (SELECT name, min(id) AS y FROM f GROUP BY name HAVING count(*) = 1)
    SELECT k, method_name, c.file, coalesce(x, y) AS target_id FROM c LEFT JOIN h ON h.name = method_name AND h.file = c.file LEFT JOIN o ON o.name = method_name""",
)
def _(s, d):
    n = lambda c, k: (F.col(c) % k).cast("string")
    calls = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("m"), n("o_orderkey", 17)).alias("method_name"), F.concat(F.lit("f"), n("o_custkey", 9)).alias("file"))
    return resolve.resolve_untyped_calls(calls, _functions(s, d)).select("k", "method_name", "file", "target_id")


@op(
    "phantom_functions",
    """, c AS (SELECT DISTINCT c_mktsegment || '.X' || (c_custkey % 5) AS t, 'm' || (c_custkey % 3) AS m FROM customer)
    SELECT DISTINCT t AS id, 'Class' AS kind, t AS name, split_part(t, '.', 1) AS package FROM c UNION ALL SELECT t || '::function:' || m, 'Function', m, split_part(t, '.', 1) FROM c""",
)
def _(s, d):
    n = lambda k: (F.col("c_custkey") % k).cast("string")
    calls = table(s, d, "customer").select(F.concat("c_mktsegment", F.lit(".X"), n(5)).alias("object_type"), F.concat(F.lit("m"), n(3)).alias("method_name"))
    nodes, _ = resolve.phantom_functions(calls)
    return nodes.select("id", "kind", "name", F.col("metadata")["package"].alias("package"))


@op("function_index", "SELECT name, count(*) AS n, min(id) AS first, string_agg(id, ',' ORDER BY id) AS ids FROM gnodes WHERE kind = 'Function' GROUP BY name")
def _(s, d):
    return resolve.function_index(gnodes(s, d)).select("name", long(F.size("ids")).alias("n"), F.col("ids")[0].alias("first"), F.array_join("ids", ",").alias("ids"))


@op(
    "inheritance_with_phantoms",
    """, x AS (SELECT 'nation::' || n_nationkey AS src, CASE WHEN n_nationkey % 2 = 0 THEN 'lib.' || n_name ELSE r_name END AS parent FROM nation JOIN region ON r_regionkey = n_regionkey),
    c AS (SELECT name, min(id) AS id FROM gnodes WHERE kind = 'Package' GROUP BY name)
    SELECT src, coalesce(c.id, parent) AS dst, c.id IS NULL AS phantom FROM x LEFT JOIN c ON c.name = parent""",
)
def _(s, d):
    both = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parent = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("lib."), "n_name")).otherwise(F.col("r_name"))
    own = both.select(F.concat(F.lit("nation::"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("Class").alias("kind"), F.col("n_name").alias("name"), F.create_map(F.lit("superclass"), parent, F.lit("superclass_simple"), parent).alias("metadata"))
    regions = gnodes(s, d).where("kind = 'Package'").select("id", F.lit("Class").alias("kind"), "name", F.create_map().cast("map<string,string>").alias("metadata"))
    nodes, edges = resolve.resolve_inheritance_local(own.unionByName(regions))
    stubs = nodes.where(F.col("metadata")["is_phantom"] == "true").select(F.col("id").alias("dst"), F.lit(True).alias("phantom"))
    return edges.join(stubs, "dst", "left").select("src", "dst", F.coalesce("phantom", F.lit(False)).alias("phantom"))


_DANGLING = "dang AS (SELECT src, CASE WHEN dst LIKE '%5' THEN 'lost::' || (SELECT name FROM gnodes g WHERE g.id = calls.dst) WHEN dst LIKE '%6' THEN 'lost::nowhere' ELSE dst END AS dst FROM calls)"


def _dangling(s, d):
    e = gedges(s, d, "CALLS").select("src", "dst").join(gnodes(s, d).where("kind = 'Function'").select(F.col("id").alias("dst"), "name"), "dst")
    lost = F.when(F.endswith("dst", F.lit("5")), F.concat(F.lit("lost::"), "name")).when(F.endswith("dst", F.lit("6")), F.lit("lost::nowhere")).otherwise(F.col("dst"))
    return e.select("src", lost.alias("dst"), F.lit("Calls").alias("relation"))


@op(
    "endpoint_repair",
    f", {_DANGLING}, fix AS (SELECT name, min(id) AS f FROM gnodes WHERE kind = 'Function' GROUP BY name) SELECT src, CASE WHEN dst LIKE 'lost::%' THEN coalesce(f, dst) ELSE dst END AS dst, 'Calls' AS relation FROM dang LEFT JOIN fix ON name = split_part(dst, '::', -1) AND dst LIKE 'lost::%'",
)
def _(s, d):
    return resolve.repair_endpoints(_dangling(s, d), gnodes(s, d).where("kind = 'Function'"))


@op(
    "edge_export_inner",
    f", {_DANGLING}, m AS (SELECT src, dst, 'Calls' AS relation FROM dang UNION ALL SELECT src, dst, 'ImplementedBy' FROM defines UNION ALL SELECT src, dst, 'References' FROM uses) SELECT src, dst, CASE relation WHEN 'Calls' THEN 'CALLS' ELSE 'IMPLEMENTED_BY' END AS type FROM m JOIN gnodes a ON a.id = src JOIN gnodes b ON b.id = dst WHERE relation <> 'References'",
)
def _(s, d):
    e = _dangling(s, d).unionByName(gedges(s, d, "DEFINES").select("src", "dst", F.lit("ImplementedBy").alias("relation")))
    e = e.unionByName(gedges(s, d, "USES").select("src", "dst", F.lit("References").alias("relation")))
    return store.edge_view(e, gnodes(s, d)).select("src", "dst", "type")


@op(
    "package_filter",
    r"SELECT doc_id, 'com.' || source || '.' || lang AS package, regexp_matches('com.' || source || '.' || lang, '^com\.src1.*\.en$|^com\.src2\.fr$') AND NOT regexp_matches('com.' || source || '.' || lang, '^com\.src13\..*$') AS ok FROM documents",
    graph=False,
)
def _(s, d):
    package = F.concat_ws(".", F.lit("com"), "source", "lang")
    accept = PackageFilter(["com.src1*.en", "com.src2.fr"], ["com.src13.*"])
    return table(s, d, "documents").select("doc_id", package.alias("package")).withColumn("ok", accept.should_process(F.col("package")))


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@op("package_split", f"SELECT page_id, regexp_extract({_HOST}, '^(.*)\\.[^.]*$', 1) AS package, split_part({_HOST}, '.', -1) AS class FROM pages", graph=False)
def _(s, d):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return table(s, d, "pages").select("page_id", host.alias("h")).select("page_id", N.package_of(F.col("h")).alias("package"), N.class_name_of(F.col("h")).alias("class"))


@op("qualified_id", "SELECT 'f' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '::p' || s_nationkey ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN '::C' ELSE '' END || '::function:' || s_name AS id FROM supplier", graph=False)
def _(s, d):
    k = F.col("s_suppkey")
    package = F.when(k % 2 == 0, F.concat(F.lit("p"), F.col("s_nationkey").cast("string")))
    made = N.qualified_id(F.concat(F.lit("f"), k.cast("string")), F.lit("function"), F.col("s_name"), package, None, F.when(k % 3 == 0, F.lit("C")))
    return table(s, d, "supplier").select(made.alias("id"))


_FILES = "f AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'a/WEB-INF/Web.xml' WHEN 1 THEN 'a/b.JAVA' WHEN 2 THEN 'c.tsx' WHEN 3 THEN 'x.jspf' WHEN 4 THEN 'lib.rs' WHEN 5 THEN '.hidden' WHEN 6 THEN 'b/page.html' WHEN 7 THEN 'index.jsp' ELSE 'note.txt' END AS path FROM pages)"


def _files(s, d):
    names = ["a/WEB-INF/Web.xml", "a/b.JAVA", "c.tsx", "x.jspf", "lib.rs", ".hidden", "b/page.html", "index.jsp", "note.txt"]
    pick = F.get(F.array(*map(F.lit, names)), (F.col("page_id") % 9).cast("int"))
    return table(s, d, "pages").select("page_id", pick.alias("path"))


@op("language_detect", f"WITH {_FILES} SELECT page_id, path, CASE page_id % 9 WHEN 0 THEN 'xml' WHEN 1 THEN 'java' WHEN 2 THEN 'javascript' WHEN 3 THEN 'jspf' WHEN 4 THEN 'rust' WHEN 6 THEN 'html' WHEN 7 THEN 'jsp' END AS language FROM f", graph=False)
def _(s, d):
    return registry.detect_language(_files(s, d)).select("page_id", "path", "language")


@op("jsp_first_order", f"WITH {_FILES} SELECT page_id, CAST(row_number() OVER (ORDER BY (path LIKE '%.jsp' OR path LIKE '%.jspf'), path, page_id) AS BIGINT) AS seq FROM f", graph=False)
def _(s, d):
    return registry.in_source_order(_files(s, d), tie="page_id").select("page_id", long("seq").alias("seq"))


@op(
    "html_links",
    """SELECT page_id, CAST(pos AS BIGINT) AS pos, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)""",
    graph=False,
)
def _(s, d):
    links = table(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("pos", "href"))
    return links.withColumn("pos", long("pos"))


def _page_markup():
    name = F.col("page_id").cast("string")
    return F.concat(F.lit('<script  src = "js/a'), name, F.lit('.js"></script><link rel="stylesheet" href="c/'), name, F.lit('.css?v=1"/><%@ include file="f'), name, F.lit('.jspf" %><jsp:include page="/p.jsp"/><%@ page import="a.B"%>'))


@op(
    "html_script_css",
    "SELECT page_id, 'js/a' || page_id || '.js' AS script, 'c/' || page_id || '.css' AS css, 'f' || page_id || '.jspf' AS static, '/p.jsp' AS dynamic, 'a.B' AS import FROM pages",
    graph=False,
)
def _(s, d):
    from arborweft.operators import markup

    rows = table(s, d, "pages").select("page_id", _page_markup().alias("text"))
    first = lambda a: F.get(a, F.lit(0))
    m = markup.jsp_references(F.col("text"))
    return rows.select("page_id", *(first(m[k]).alias(k) for k in ("script", "css", "static", "dynamic", "import")))


@op("xml_blocks", "SELECT 'servlet::' || s_name AS src, 'com.n' || s_nationkey || '.S' || s_suppkey AS dst, '/' || s_suppkey || '.do,/x' || s_suppkey || '/*' AS url_pattern FROM supplier", graph=False)
def _(s, d):
    from arborweft.operators import markup

    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(
        F.lit("<web-app>\n<servlet>\n <servlet-name> "), "s_name", F.lit(" </servlet-name><servlet-class>com.n"), n, F.lit(".S"), k,
        F.lit("</servlet-class>\n</servlet><servlet-mapping><servlet-name>"), "s_name", F.lit("</servlet-name><url-pattern>/"), k, F.lit(".do</url-pattern><url-pattern>/x"), k, F.lit("/*</url-pattern></servlet-mapping></web-app>"),
    )
    files = table(s, d, "supplier").select(F.concat(F.lit("p"), k, F.lit("/web.xml")).alias("path"), text.alias("text"), F.lit(1).alias("seq"))
    nodes, edges = markup.extract_web_xml(files)
    by = edges.where("relation = 'ImplementedBy'").join(nodes.select(F.col("id").alias("src"), F.col("metadata")["url-pattern"].alias("url_pattern")), "src")
    return by.select("src", "dst", "url_pattern")


@op(
    "last_block_wins",
    "SELECT 'servlet::S' || s_nationkey AS id, max_by('/u' || s_suppkey, s_suppkey) AS url_pattern FROM supplier GROUP BY s_nationkey",
    graph=False,
)
def _(s, d):
    from arborweft.operators import markup

    rows = table(s, d, "supplier").select("s_nationkey", F.struct("s_suppkey", F.concat(F.lit("<servlet-mapping><servlet-name>S"), F.col("s_nationkey").cast("string"), F.lit("</servlet-name><url-pattern>/u"), F.col("s_suppkey").cast("string"), F.lit("</url-pattern></servlet-mapping>")).alias("b")).alias("x"))
    blocks = rows.groupBy("s_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["b"]), "").alias("b"))
    head = F.concat(F.lit("<servlet><servlet-name>S"), F.col("s_nationkey").cast("string"), F.lit("</servlet-name><servlet-class>c.S</servlet-class></servlet>"))
    files = blocks.select(F.concat(F.col("s_nationkey").cast("string"), F.lit("/web.xml")).alias("path"), F.concat(head, "b").alias("text"), F.lit(1).alias("seq"))
    nodes, _ = markup.extract_web_xml(files)
    return nodes.where("kind = 'Servlet'").select("id", F.col("metadata")["url-pattern"].alias("url_pattern"))


@op(
    "ancestor_lookup",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]+)', 1) AS path FROM pages), known AS (SELECT DISTINCT regexp_extract(path, '^([^/]+)', 1) AS dir FROM p UNION SELECT DISTINCT regexp_extract(path, '^([^/]+/[a-z]+)/', 1) FROM p),
    c AS (SELECT page_id, dir FROM p JOIN known ON starts_with(path, dir || '/') WHERE dir <> '') SELECT page_id, max_by(dir, length(dir)) AS nearest FROM c GROUP BY page_id""",
    graph=False,
)
def _(s, d):
    p = table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^?#]+)", 1).alias("path"))
    one, two = F.regexp_extract("path", "^([^/]+)", 1), F.regexp_extract("path", "^([^/]+/[a-z]+)/", 1)
    known = p.select(one.alias("dir")).union(p.select(two.alias("dir"))).where("dir <> ''").distinct()
    return registry.nearest_ancestor(p, known, "page_id").select("page_id", F.col("dir").alias("nearest"))


@op(
    "dao_classify",
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'QUERY' WHEN event_type = 'purchase' THEN 'SAVE' WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation FROM events",
    graph=False,
)
def _(s, d):
    verb = F.create_map(*(F.lit(x) for kv in {"click": "getX", "view": "FindX", "purchase": "insertX", "error": "removeX", "signup": "modifyX"}.items() for x in kv))
    return table(s, d, "events").select("event_id", N.dao_operation(F.try_element_at(verb, F.col("event_type"))).alias("operation"))


_PROJECTS = ", pn AS (SELECT *, CASE WHEN kind = 'Class' THEN grp ELSE 'rest' END AS project_path FROM gnodes WHERE kind IN ('Class', 'Module', 'Package'))"


def _projects(s, d):
    n = gnodes(s, d).where(F.col("kind").isin("Class", "Module", "Package"))
    return n.withColumn("project_path", F.when(F.col("kind") == "Class", F.col("grp")).otherwise("rest"))


@op(
    "project_delete_count",
    _PROJECTS + ", gone AS (SELECT id FROM pn WHERE project_path = 'nation::3') SELECT (SELECT count(*) FROM gone) AS deleted, count(*) AS edges_left FROM contains_ WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)",
)
def _(s, d):
    nodes, edges = _projects(s, d), gedges(s, d, "CONTAINS")
    _, kept, gone = store.without_project(nodes, edges, "nation::3")
    return gone.agg(F.count("*").alias("deleted")).crossJoin(kept.agg(F.count("*").alias("edges_left")))


@op("project_isolation", _PROJECTS + " SELECT project_path, count(*) AS n FROM pn GROUP BY project_path")
def _(s, d):
    return _projects(s, d).groupBy("project_path").agg(F.count("*").alias("n"))


@op("cross_project_shared", "SELECT o_orderpriority AS name, count(DISTINCT c_nationkey) AS projects FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_orderpriority HAVING count(DISTINCT c_nationkey) >= 2", graph=False)
def _(s, d):
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count_distinct("c_nationkey").alias("projects")).where("projects >= 2")


@op("transitive_closure_depth_limit", ", p AS (SELECT src AS start, dst AS id FROM trans UNION SELECT start, t.dst FROM p JOIN trans t ON t.src = p.id) SELECT start, id FROM p", recursive=True)
def _(s, d):
    e = trans(s, d)
    return paths.reachable(e, e.select(F.col("src").alias("id")).distinct(), 64).select("start", "id")


@op("wildcard_regex", r"SELECT p_partkey, regexp_matches(p_name, '^.*a.*$') AS any_a, regexp_matches(p_name, '^Part\..*$') AS dotted FROM part", graph=False)
def _(s, d):
    c = F.col("p_name")
    return table(s, d, "part").select("p_partkey", PackageFilter(["*a*"]).should_process(c).alias("any_a"), PackageFilter(["Part.*"]).should_process(c).alias("dotted"))


@op(
    "metadata_update",
    ", v AS (SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'lost::' ELSE 'nation::' END || c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1) SELECT gnodes.id, coalesce('n' || CAST(v.n AS VARCHAR), 'old') AS value FROM gnodes LEFT JOIN v USING (id) WHERE kind = 'Module'",
)
def _(s, d):
    # every customer counts; nodes stay as they are where the values have another name
    nodes = gnodes(s, d).where("kind = 'Module'").withColumn("metadata", F.create_map(F.lit("url-pattern"), F.lit("old"), F.lit("type"), F.lit("x")))
    prefix = F.when(F.col("c_nationkey") % 5 == 0, "lost::").otherwise("nation::")
    values = table(s, d, "customer").groupBy(F.concat(prefix, F.col("c_nationkey").cast("string")).alias("id")).agg(F.concat(F.lit("n"), F.count("*").cast("string")).alias("value"))
    return merge.put_metadata(nodes, values, "url-pattern").select("id", F.col("metadata")["url-pattern"].alias("value"))


@op(
    "node_view",
    "SELECT id, kind AS node_type, 'unknown' AS language, coalesce(grp, '') AS package, 'Node,' || kind AS labels FROM gnodes WHERE kind IN ('Module', 'Class', 'Package')",
)
def _(s, d):
    n = gnodes(s, d).where(F.col("kind").isin("Module", "Class", "Package"))
    location = F.struct(*(F.lit(0).alias(x) for x in ("start_line", "start_col", "end_line", "end_col")))
    full = n.select(
        F.lit("p").alias("project_path"), F.lit("p").alias("project_name"), "id", "kind", "name", F.lit("").alias("file_path"), location.alias("location"),
        F.map_filter(F.create_map(F.lit("package"), F.col("grp")), lambda _, v: v.isNotNull()).alias("metadata"),
    )
    return store.node_view(full).select("id", "node_type", "language", "package", F.array_join("labels", ",").alias("labels"))


def _sources(s, d, ext: str, text) -> DataFrame:
    """A source file for each supplier; k is its key and b the next."""
    k = F.col("s_suppkey")
    rows = table(s, d, "supplier").select(k.cast("string").alias("k"), (k + 1).cast("string").alias("b"), F.col("s_nationkey").cast("string").alias("n"))
    files = rows.select(F.concat(F.lit("f"), "k", F.lit(ext)).alias("path"), F.format_string(text, *(F.col(c) for c in ("k", "b", "n"))).alias("text"))
    return registry.detect_language(files).withColumn("supported", F.lit(True)).withColumn("read_error", F.lit(None).cast("string"))


def _resolved(s, d, ext: str, text: str, *relations: str) -> DataFrame:
    from arborweft.operators.analysis import analyze_texts

    return analyze_texts(_sources(s, d, ext, text)).edges.where(F.col("relation").isin(*relations)).select("src", "dst", "relation")


_S = "s AS (SELECT s_suppkey AS k, s_suppkey + 1 AS b, s_nationkey AS n FROM supplier)"


@op(
    "extract_java_graph",
    f"""WITH {_S}, f AS (SELECT *, 'f' || k || '.java::com.n' || n || '::S' || k || '::' AS p, 'com.n' || n || '.S' || k AS c FROM s)
    SELECT c AS src, p || 'function:' || m AS dst, 'Contains' AS relation FROM f, (VALUES ('run'), ('go')) t(m)
    UNION ALL SELECT c, p || 'variable:prev', 'Contains' FROM f
    UNION ALL SELECT 'f' || k || '.java::package:com.n' || n, c, 'Contains' FROM f
    UNION ALL SELECT 'f' || k || '.java::module', x, 'Contains' FROM (SELECT k, 'f' || k || '.java::package:com.n' || n AS x FROM f UNION ALL SELECT k, 'f' || k || '.java::import:java.util.List' FROM f)
    UNION ALL SELECT a.c, b.c, 'Extends' FROM f a JOIN f b ON b.k = a.b
    UNION ALL SELECT a.p || 'function:run', coalesce(b.p || 'function:go', 'S' || a.b || '::function:go'), 'Calls' FROM f a LEFT JOIN f b ON b.k = a.b
    UNION ALL SELECT p || 'function:go', p || 'function:run', 'Calls' FROM f
    UNION ALL SELECT 'S' || a.b, 'S' || a.b || '::function:go', 'Contains' FROM f a WHERE a.b NOT IN (SELECT k FROM f)
    UNION ALL SELECT p || 'function:run', p || 'param:n', 'Defines' FROM f UNION ALL SELECT c, 'java.util.List', 'Imports' FROM f""",
    graph=False,
)
def _(s, d):
    text = "package com.n%3$s;\nimport java.util.List;\npublic class S%1$s extends S%2$s {\n  private S%2$s prev;\n  public void run(int n) { prev.go(); }\n  public void go() { run(1); }\n}\n"
    return _resolved(s, d, ".java", text, "Contains", "Extends", "Calls", "Defines", "Imports")


@op(
    "extract_javascript_graph",
    f"""WITH {_S}, f AS (SELECT *, 'f' || k || '.js::' AS p FROM s)
    SELECT p || 'module' AS src, p || 'class:D' || k AS dst, 'Contains' AS relation FROM f UNION ALL SELECT p || 'class:D' || k, p || 'D' || k || '::function:' || m, 'Contains' FROM f, (VALUES ('run'), ('go')) t(m)
    UNION ALL SELECT p || 'module', p || 'object:o' || k, 'Contains' FROM f UNION ALL SELECT p || 'object:o' || k, p || 'o' || k || '::function:show', 'Defines' FROM f
    UNION ALL SELECT a.p || 'class:D' || a.k, b.p || 'class:D' || b.k, 'Extends' FROM f a JOIN f b ON b.k = a.b
    UNION ALL SELECT a.p || 'D' || a.k || '::function:run', coalesce(b.p || 'D' || b.k || '::function:go', 'D' || a.b || '::function:go'), 'Calls' FROM f a LEFT JOIN f b ON b.k = a.b
    UNION ALL SELECT 'D' || b, 'D' || b || '::function:go', 'Contains' FROM f WHERE b NOT IN (SELECT k FROM f)""",
    graph=False,
)
def _(s, d):
    text = "class D%1$s extends D%2$s { svc = new D%2$s(%3$s); run() { this.svc.go(); } go() { return `x${1}`; } }\nconst o%1$s = { show: function (m) { return m; } };\n"
    return _resolved(s, d, ".js", text, "Contains", "Extends", "Calls", "Defines")


@op(
    "extract_rust_graph",
    f"""WITH {_S}, f AS (SELECT *, 'f' || k || '.rs::' AS p FROM s)
    SELECT p || 'module' AS src, p || x || k AS dst, 'Contains' AS relation FROM f, (VALUES ('class:T'), ('trait:R')) t(x)
    UNION ALL SELECT p || 'module', p || 'function:helper', 'Contains' FROM f UNION ALL SELECT p || 'class:T' || k, p || 'T' || k || '::function:make', 'Contains' FROM f
    UNION ALL SELECT p || 'T' || k || '::function:make', p || 'function:helper', 'Calls' FROM f UNION ALL SELECT p || 'function:helper', p || 'T' || k || '::function:make', 'Calls' FROM f""",
    graph=False,
)
def _(s, d):
    text = "use std::fmt;\npub struct T%1$s { n: u%2$s }\npub trait R%1$s { fn sig(&self) -> u8; }\nimpl T%1$s { pub fn make() -> u8 { helper() } }\nfn helper() -> u8 { T%1$s::make(); String::new(); println!(\"{}\", other()); %3$s }\n"
    return _resolved(s, d, ".rs", text, "Contains", "Calls")


@op(
    "extract_portlets",
    """SELECT 'portlet::P' || s_suppkey AS dst, 'view,edit' AS modes, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS cache, 'v' || s_suppkey || '.jsp' AS template FROM supplier""",
    graph=False,
)
def _(s, d):
    from arborweft.operators import markup

    k = F.col("s_suppkey").cast("string")
    cache = F.when(F.col("s_suppkey") % 2 == 0, k).otherwise("none")
    text = F.concat(
        F.lit("<portlet><portlet-name> P"), k, F.lit("</portlet-name><portlet-class>c.P</portlet-class><expiration-cache>"), cache, F.lit("</expiration-cache><portlet-mode>view</portlet-mode><portlet-mode> edit </portlet-mode><init-param><name>template-view</name><value>v"),
        k, F.lit(".jsp</value></init-param><init-param><name>other</name><value>x</value></init-param></portlet>"),
    )
    _, edges = markup.extract_portlet_xml(table(s, d, "supplier").select(F.concat(k, F.lit("/portlet.xml")).alias("path"), text.alias("text"), F.lit(1).alias("seq")))
    m = F.col("metadata")
    return edges.where("relation = 'Configures'").select("dst", m["modes"].alias("modes"), m["cacheSeconds"].alias("cache"), m["param_template-view"].alias("template"))


@op(
    "kind_relation_summary",
    """SELECT 'node' AS what, kind AS name, count(*) AS n FROM gnodes GROUP BY kind UNION ALL SELECT 'edge', relation, count(*) FROM gedges GROUP BY relation
    UNION ALL SELECT 'node', 'total', count(*) FROM gnodes UNION ALL SELECT 'edge', 'total', count(*) FROM gedges""",
)
def _(s, d):
    return store.summary(gnodes(s, d), gedges(s, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from arborweft.operators import bindings_more  # noqa: F401  registers
    from arborweft.plans import catalogue

    return QUERIES | catalogue.queries()


def oracle_sql() -> dict[str, str]:
    from arborweft.operators import bindings_more  # noqa: F401  registers
    from arborweft.plans import catalogue

    return ORACLE | catalogue.oracle_sql()
