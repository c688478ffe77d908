"""From a source tree to a resolved graph."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.functions.filters import PackageFilter
from arborweft.functions.names import class_name_of, first_segment
from arborweft.functions.scratch import cut
from arborweft.operators import resolve
from arborweft.operators.extract import extract
from arborweft.operators.merge import bag_union, insert_if_absent
from arborweft.schema import LOCATION, METADATA
from arborweft.sources.files import list_files, read_texts
from arborweft.sources.registry import source_rank, supported_languages


@dataclass
class CodeGraph:
    nodes: DataFrame
    edges: DataFrame
    errors: DataFrame
    files: DataFrame | None = None

    def counts(self) -> DataFrame:
        """processed, unsupported, errors: one row, whatever the number of files."""
        read = F.col("supported") & F.col("read_error").isNull()
        seen = self.files.agg(F.count_if(read).alias("processed"), F.count_if(~F.col("supported")).alias("unsupported"), F.count_if(F.col("supported") & F.col("read_error").isNotNull()).alias("_unread"))
        failed = self.errors.agg(F.count("*").alias("_failed"))
        return seen.crossJoin(failed).select("processed", "unsupported", (F.col("_unread") + F.col("_failed")).alias("errors"))

    def report(self, directory: str) -> dict:
        """What a run saw: one small document."""
        f = self.files
        read = f.where("supported") if f is not None else None
        return {
            "generated_at": datetime.datetime.now(datetime.UTC).isoformat(),
            "directory": directory,
            "supported_languages": supported_languages(),
            "processed_files": read.where("read_error IS NULL").count() if f is not None else 0,
            "unsupported_files": [r["path"] for r in f.where("NOT supported").select("path").orderBy("path").toLocalIterator()] if f is not None else [],
            "read_errors": [{"file": r["path"], "error": r["read_error"]} for r in read.where("read_error IS NOT NULL").select("path", "read_error").toLocalIterator()] if f is not None else [],
            "parse_errors": [{"file": r["file"], "error": r["error"]} for r in self.errors.toLocalIterator()],
        }


def _stub(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", "name", F.lit("").alias("file_path"), F.lit(None).cast(LOCATION).alias("location"), F.col("metadata").cast(METADATA).alias("metadata"))


def _typed(calls: DataFrame, functions: DataFrame, mode: str) -> DataFrame:
    """Typed calls with target_id. 'reference' looks for ::type:: in function ids, so receivers known by qualified name never match
    local methods; 'fixed' falls back to the type's simple name."""
    out = resolve.resolve_typed_calls(calls, functions)
    if mode == "fixed":
        simple = resolve.resolve_typed_calls(out.where("target_id IS NULL").drop("target_id").withColumn("_full", F.col("object_type")).withColumn("object_type", class_name_of(F.col("object_type"))), functions)
        out = out.where("target_id IS NOT NULL").unionByName(simple.withColumn("object_type", F.col("_full")).drop("_full"))
    return out


def resolve_graph(parts: dict[str, DataFrame], accept: PackageFilter | None = None, mode: str = "reference") -> CodeGraph:
    """Extracted rows with names resolved: imports, then inheritance, then calls. Typed calls that find nothing make phantoms."""
    accept = accept or PackageFilter()
    nodes, edges = cut(parts["nodes"].select("id", "kind", "name", "file_path", "location", "metadata")), parts["edges"]
    classes = cut(resolve.class_index(nodes))
    made = [resolve.resolve_imports(nodes, classes, accept), resolve.resolve_extends(nodes, classes, accept), resolve.resolve_implements(nodes, classes, accept)]
    functions = nodes.where("kind = 'Function'").select("id", "name", first_segment(F.col("id")).alias("file"))
    calls = parts["calls"].withColumn("file", first_segment(F.col("src")))
    typed = cut(_typed(calls.where("object_type IS NOT NULL"), functions, mode))
    untyped = resolve.resolve_untyped_calls(calls.where("object_type IS NULL"), functions).where("target_id IS NOT NULL")
    calls_of = lambda df, dst: df.select("src", dst.alias("dst"), F.lit("Calls").alias("relation"))
    made += [calls_of(typed.where("target_id IS NOT NULL"), F.col("target_id")), calls_of(untyped, F.col("target_id"))]
    if accept.create_phantoms:
        missing = typed.where("target_id IS NULL")
        stubs, contains = resolve.phantom_functions(missing)
        contains = contains.join(edges.select("src", "dst", "relation").distinct(), ["src", "dst", "relation"], "left_anti")
        nodes = insert_if_absent(nodes, _stub(stubs))
        made += [contains, calls_of(missing, F.concat("object_type", F.lit("::function:"), "method_name"))]
    empty = F.create_map().cast(METADATA)
    out = bag_union(edges, *(e.select("src", "dst", "relation").withColumn("metadata", empty) for e in made))
    return CodeGraph(nodes, out, parts["errors"])


def analyze_texts(files: DataFrame, accept: PackageFilter | None = None, mode: str = "reference", inventory: DataFrame | None = None, records: DataFrame | None = None) -> CodeGraph:
    """The graph of texts as ``read_texts`` or ``from_texts`` gives them; records, where known, spare reading the texts of code again."""
    ordered = cut(files.where("supported").withColumn("seq", source_rank(F.col("path"))))
    graph = resolve_graph(extract(ordered, inventory if inventory is not None else files, records), accept, mode)
    graph.files = files
    return graph


def analyze(spark: SparkSession, path: str, accept: PackageFilter | None = None, mode: str = "reference") -> CodeGraph:
    """The graph of a source tree."""
    files = list_files(spark, path)
    known = cut(read_texts(files.where("supported")))
    rest = files.where("NOT supported").select("*", *(F.lit(None).cast("string").alias(c) for c in ("text", "encoding", "read_error")))
    return analyze_texts(known.unionByName(rest), accept, mode, files)
