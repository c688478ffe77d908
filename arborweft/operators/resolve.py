"""Names to nodes: references, inheritance and calls, as equi-joins.

Wherever several candidates fit, the smallest one is taken, so results never depend on the order of anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborweft.functions.filters import PackageFilter
from arborweft.functions.names import class_name_of, last_segment, package_of


def class_index(nodes: DataFrame) -> DataFrame:
    """fqn, id of the classes and interfaces of the sources, by qualified name or else name."""
    own = nodes.where(F.col("kind").isin("Class", "Interface") & (F.coalesce(F.col("metadata")["is_external"], F.lit("")) != "true"))
    return own.groupBy(F.coalesce(F.col("metadata")["qualified_name"], F.col("name")).alias("fqn")).agg(F.min("id").alias("id"))


def simple_index(classes: DataFrame) -> DataFrame:
    """simple, fqn, id: for each simple name the smallest qualified one."""
    return classes.groupBy(class_name_of(F.col("fqn")).alias("simple")).agg(F.min(F.struct("fqn", "id")).alias("m")).select("simple", "m.fqn", "m.id")


def resolve_reference(refs: DataFrame, classes: DataFrame, column: str = "ref") -> DataFrame:
    """refs with target_id and target_status: Local by qualified name, or by simple name where the reference has no dot; External
    with a dot; Unresolved otherwise."""
    by_fqn = classes.select(F.col("fqn").alias(column), F.col("id").alias("_by_fqn"))
    by_simple = simple_index(classes).select(F.col("simple").alias(column), F.col("id").alias("_by_simple"))
    dotted = F.contains(F.col(column), F.lit("."))
    out = refs.join(by_fqn, column, "left").join(by_simple, column, "left")
    target = F.coalesce("_by_fqn", F.when(~dotted, F.col("_by_simple")))
    status = F.when(target.isNotNull(), "Local").when(dotted, "External").otherwise("Unresolved")
    return out.withColumn("target_id", target).withColumn("target_status", status).drop("_by_fqn", "_by_simple")


def resolve_with_fallback(rows: DataFrame, classes: DataFrame, first: str, second: str, accept: PackageFilter) -> DataFrame:
    """rows with target_id: the first name where the filter accepts it and it is local, else the second."""
    a = resolve_reference(rows.withColumn("_ref", F.when(accept.accepts_reference(F.col(first)), F.col(first))), classes, "_ref")
    a = a.withColumnRenamed("target_id", "_first").drop("target_status", "_ref")
    b = resolve_reference(a.withColumn("_ref", F.when(accept.accepts_reference(F.col(second)), F.col(second))), classes, "_ref")
    return b.withColumn("target_id", F.coalesce("_first", "target_id")).drop("target_status", "_ref", "_first")


def resolve_imports(nodes: DataFrame, classes: DataFrame, accept: PackageFilter) -> DataFrame:
    """Edges of Import nodes to local classes: from their module (Imports) and from themselves (References)."""
    imports = nodes.where("kind = 'Import'").select("id", F.col("metadata")["module_id"].alias("module"), F.coalesce(F.col("metadata")["import_path"], F.col("name")).alias("ref"))
    hit = resolve_reference(imports.where(accept.accepts_reference(F.col("ref"))), classes).where("target_status = 'Local'")
    ends = F.array(F.struct(F.col("module").alias("src"), F.lit("Imports").alias("relation")), F.struct(F.col("id").alias("src"), F.lit("References").alias("relation")))
    return hit.select(F.explode(ends).alias("e"), F.col("target_id").alias("dst")).select("e.src", "dst", "e.relation").where("src IS NOT NULL")


def resolve_extends(nodes: DataFrame, classes: DataFrame, accept: PackageFilter, phantoms: bool = False) -> DataFrame:
    """Extends edges of classes by superclass, then by its simple name. With phantoms, what stays open points to its name."""
    rows = nodes.where("kind = 'Class'").select("id", F.col("metadata")["superclass"].alias("first"), F.col("metadata")["superclass_simple"].alias("second"))
    rows = rows.where("first IS NOT NULL OR second IS NOT NULL")
    out = resolve_with_fallback(rows, classes, "first", "second", accept)
    target = F.coalesce("target_id", "first", "second") if phantoms else F.col("target_id")
    return out.select(F.col("id").alias("src"), target.alias("dst"), F.lit("Extends").alias("relation")).where("dst IS NOT NULL")


def resolve_implements(nodes: DataFrame, classes: DataFrame, accept: PackageFilter, phantoms: bool = False) -> DataFrame:
    """Implements edges of classes: each qualified interface name, then the simple name at the place where that one stands first."""
    m = F.col("metadata")
    has = nodes.where("kind = 'Class'").select("id", F.coalesce(m["interfaces_fqn"], m["interfaces"]).alias("fqns"), m["interfaces"].alias("simples")).where("fqns IS NOT NULL")
    trimmed = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x))
    # the lists meet place by place and a digest stands for them, as rows that carry whole lists are quadratic in their length
    both = F.arrays_zip(trimmed("fqns").alias("first"), F.coalesce(trimmed("simples"), F.array().cast("array<string>")).alias("second"))
    lists = has.select("id", F.sha2("fqns", 256).alias("_a"), F.sha2("simples", 256).alias("_b"), both.alias("both"))
    rows = lists.select("id", "_a", "_b", F.posexplode("both").alias("pos", "x"))
    rows = rows.select("id", "_a", "_b", "pos", F.col("x")["first"].alias("first"), F.col("x")["second"].alias("second")).where("first <> ''")
    earliest = Window.partitionBy("id", "_a", "_b", "first").orderBy("pos")
    rows = rows.withColumn("second", F.first("second").over(earliest)).drop("_a", "_b")
    out = resolve_with_fallback(rows, classes, "first", "second", accept)
    target = F.coalesce("target_id", "first") if phantoms else F.col("target_id")
    return out.select(F.col("id").alias("src"), target.alias("dst"), F.lit("Implements").alias("relation")).where("dst IS NOT NULL")


def resolve_inheritance_local(nodes: DataFrame, accept: PackageFilter | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes with stub classes for parents that are not there, and Extends and Implements edges to them and to local ones."""
    accept = accept or PackageFilter()
    classes = class_index(nodes)
    edges = resolve_extends(nodes, classes, accept, phantoms=True).unionByName(resolve_implements(nodes, classes, accept, phantoms=True))
    missing = edges.select("dst").distinct().join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema if f.name not in ("id", "kind", "name", "metadata")]
    stubs = phantom_class(missing, "dst").select("*", *rest)
    return nodes.unionByName(stubs.withColumn("metadata", F.col("metadata").cast(nodes.schema["metadata"].dataType))), edges


def function_index(nodes: DataFrame) -> DataFrame:
    """name, ids: all functions of a name, in order."""
    return nodes.where("kind = 'Function'").groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def function_segments(functions: DataFrame) -> DataFrame:
    """name, segment, id: each function with every part of its id between two ``::``. ids are (id, name)."""
    parts = F.split("id", "::")
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return functions.select("name", "id", F.explode(F.array_distinct(inner)).alias("segment"))


def resolve_typed_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls (method_name, object_type) with target_id: the smallest function of that name whose id holds ::object_type::.

    A type without ``::`` is one segment of the id, so the search is an equi-join; the few others are compared as strings among
    functions of the name. Candidates are reduced to one for each (name, segment) before anything meets, which keeps common method
    names from multiplying."""
    best = function_segments(functions).groupBy(F.col("name").alias("method_name"), F.col("segment").alias("object_type")).agg(F.min("id").alias("_plain"))
    out = calls.join(best, ["method_name", "object_type"], "left")
    nested = calls.where(F.contains("object_type", F.lit("::"))).select("method_name", "object_type").distinct()
    own = functions.select(F.col("name").alias("method_name"), F.col("id").alias("_fid"))
    hits = nested.join(own, "method_name").where(F.contains("_fid", F.concat(F.lit("::"), "object_type", F.lit("::"))))
    hits = hits.groupBy("method_name", "object_type").agg(F.min("_fid").alias("_nested"))
    return out.join(hits, ["method_name", "object_type"], "left").withColumn("target_id", F.coalesce("_plain", "_nested")).drop("_plain", "_nested")


def resolve_untyped_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls (method_name, file) with target_id: the smallest function of that name in the same file, else the only one anywhere."""
    here = functions.groupBy(F.col("name").alias("method_name"), "file").agg(F.min("id").alias("_here"))
    only = functions.groupBy(F.col("name").alias("method_name")).agg(F.min("id").alias("_only"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    out = calls.join(here, ["method_name", "file"], "left").join(only, "method_name", "left")
    return out.withColumn("target_id", F.coalesce("_here", "_only")).drop("_here", "_only")


def phantom_class(ids: DataFrame, column: str) -> DataFrame:
    """Stub nodes of classes that are called but not there."""
    c = F.col(column)
    package = package_of(c)
    base = F.create_map(F.lit("is_phantom"), F.lit("true"), F.lit("language"), F.lit("java"))
    return ids.select(c.alias("id"), F.lit("Class").alias("kind"), c.alias("name"), F.when(package.isNotNull(), F.map_concat(base, F.create_map(F.lit("package"), package))).otherwise(base).alias("metadata"))


def phantom_functions(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stub nodes and Contains edges for typed calls (method_name, object_type) that resolve to nothing."""
    want = calls.select("object_type", "method_name").distinct()
    cls, fn = F.col("object_type"), F.concat("object_type", F.lit("::function:"), "method_name")
    package = package_of(cls)
    base = F.create_map(F.lit("is_phantom"), F.lit("true"), F.lit("language"), F.lit("java"), F.lit("object_type"), cls)
    made = F.when(package.isNotNull(), F.map_concat(base, F.create_map(F.lit("package"), package))).otherwise(base)
    functions = want.select(fn.alias("id"), F.lit("Function").alias("kind"), F.col("method_name").alias("name"), made.alias("metadata"))
    return phantom_class(want.select("object_type").distinct(), "object_type").unionByName(functions), want.select(cls.alias("src"), fn.alias("dst"), F.lit("Contains").alias("relation"))


def repair_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges whose dst is no node get the smallest function named as its last segment, if there is one."""
    known = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("_known"))
    named = nodes.where("kind = 'Function'").groupBy(F.col("name").alias("_last")).agg(F.min("id").alias("_fix"))
    out = edges.join(known, "dst", "left").withColumn("_last", F.when(F.col("_known").isNull(), last_segment(F.col("dst"))))
    out = out.join(named, "_last", "left").withColumn("dst", F.coalesce("_fix", "dst"))
    return out.select(*edges.columns)
