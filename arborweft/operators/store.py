"""The stored graph: export views, projects, deletion. Tables are Parquet, partitioned by project and sorted by id."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.operators.resolve import repair_endpoints
from arborweft.schema import DEFAULTS, EDGES, EXPORTED, EXPORTED_METADATA, LABELS, NODES


def node_view(nodes: DataFrame, label_mode: str | None = None) -> DataFrame:
    """What readers of the graph see. Missing properties are '' (language: 'unknown'). label_mode 'both' has node_type and labels,
    'typed-only' no node_type, anything else only the Node label."""
    mode = label_mode or os.environ.get("NEO4J_LABEL_MODE", "both")
    names = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    kind = F.coalesce(F.try_element_at(names, F.col("kind")), F.col("kind"))
    fields = [F.coalesce(F.col("metadata")[key], F.lit(DEFAULTS.get(name, ""))).alias(name) for name, key in EXPORTED_METADATA.items()]
    place = [F.col(f"location.{x}").cast("long").alias(x) for x in ("start_line", "start_col", "end_line", "end_col")]
    typed = [] if mode == "typed-only" else [kind.alias("node_type")]
    labels = F.array(F.lit("Node"), kind) if mode in ("both", "typed-only") else F.array(F.lit("Node"))
    return nodes.select("id", "name", *typed, "file_path", *fields, *place, "project_path", "project_name", labels.alias("labels"), "metadata")


def edge_view(edges: DataFrame, nodes: DataFrame, strict: bool = False) -> DataFrame:
    """Exported edges: known relations under their export names, both ends there. Ends are looked up in the same project if the
    tables have one; strict looks everywhere, so ids that several projects share multiply edges."""
    names = F.create_map(*(F.lit(x) for kv in EXPORTED.items() for x in kv))
    key = ["project_path"] if not strict and "project_path" in edges.columns and "project_path" in nodes.columns else []
    ids = nodes.select("id", *key)
    end = lambda c: ids.withColumnRenamed("id", c)
    out = edges.where(F.col("relation").isin(*EXPORTED)).join(end("src"), ["src", *key]).join(end("dst"), ["dst", *key])
    keep = [c for c in ("project_path", "project_name", "edge_id", "metadata") if c in edges.columns]
    return out.select("src", "dst", F.try_element_at(names, F.col("relation")).alias("type"), *keep)


def without_project(nodes: DataFrame, edges: DataFrame, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges that stay when a project goes, with the nodes that go; edges go with either end."""
    gone = nodes.where(F.col("project_path") == project).select("id")
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return nodes.where(F.col("project_path") != project), edges, gone


class GraphStore:
    """Graph tables under a path: <path>/nodes and <path>/edges, a partition for each project."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def nodes(self) -> DataFrame:
        return self._read("nodes", NODES)

    def edges(self) -> DataFrame:
        return self._read("edges", EDGES)

    def test_connection(self) -> bool:
        """Whether the place can be read and written."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return bool(fs.exists(p) or fs.mkdirs(p))

    def export(self, nodes: DataFrame, edges: DataFrame, project_path: str = "", project_name: str = "", clear: bool = False, full: bool = False) -> None:
        """Write a project's graph with repaired edge ends. clear replaces the project, full everything; otherwise nodes are added,
        again if they are there already."""
        mark = lambda df: df.withColumn("project_path", F.lit(project_path)).withColumn("project_name", F.lit(project_name))
        edges = repair_endpoints(edges, nodes)
        if "edge_id" not in edges.columns:
            # ids of other projects and of earlier exports are others
            edges = edges.withColumn("edge_id", F.xxhash64(F.lit(uuid.uuid4().hex), F.monotonically_increasing_id()))
        for name, df, schema, key in (("nodes", mark(nodes), NODES, "id"), ("edges", mark(edges), EDGES, "src")):
            df = df.select(*(F.col(f.name).cast(f.dataType) for f in schema)).repartition("project_path", key).sortWithinPartitions("project_path", key)
            mode = "overwrite" if clear or full else "append"
            writer = df.write.mode(mode).partitionBy("project_path").option("partitionOverwriteMode", "static" if full else "dynamic")
            writer.parquet(f"{self.path}/{name}")
            if clear and not full and df.isEmpty():  # only partitions with rows are overwritten
                self._drop(name, project_path)

    def _drop(self, name: str, project_path: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        part = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(project_path) if project_path else "__HIVE_DEFAULT_PARTITION__"
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/project_path={part}")
        p.getFileSystem(conf).delete(p, True)

    def delete_project(self, project_path: str) -> int:
        """Drop a project's partitions; returns how many nodes went."""
        n = self.nodes().where(F.col("project_path") == project_path).count()
        for name in ("nodes", "edges"):
            self._drop(name, project_path)
        return n

    def graph(self) -> "Graph":  # noqa: UP037
        """The stored graph for Cypher: nodes and edges by project."""
        from arborweft.plans.cypher import Graph

        return Graph(self.node_view(), self.edge_view().select("project_path", "edge_id", "src", "dst", "type"))

    def clear(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(conf).delete(p, True)

    def node_view(self, label_mode: str | None = None) -> DataFrame:
        return node_view(self.nodes(), label_mode)

    def edge_view(self, strict: bool = False) -> DataFrame:
        return edge_view(self.edges(), self.nodes(), strict)


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, name, n: counts by kind and by relation, and totals."""
    kinds = nodes.groupBy(F.lit("node").alias("what"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    relations = edges.groupBy(F.lit("edge").alias("what"), F.col("relation").alias("name")).agg(F.count("*").alias("n"))
    totals = nodes.agg(F.lit("node").alias("what"), F.lit("total").alias("name"), F.count("*").alias("n"))
    return kinds.union(relations).union(totals).union(edges.agg(F.lit("edge"), F.lit("total"), F.count("*")))


def write_report(report: dict, path: str = ".output/report.json") -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False)
