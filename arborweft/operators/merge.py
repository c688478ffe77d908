"""Set operators on nodes and edges: the ordered keyed merge, insert-if-absent, bag union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _absolute(path: Column) -> Column:
    c = lambda s: F.contains(path, F.lit(s))
    return c("/") & (c("examples/") | c("workspaces/") | c("src/") | ~F.startswith(path, F.lit("/")))


def _web_path(path: Column) -> Column:
    c = lambda s: F.contains(path, F.lit(s))
    return F.startswith(path, F.lit("/")) & ~c("workspaces/") & ~c("examples/")


def keeps_existing(old: Column, new: Column) -> Column:
    """Whether the node that is there outlives a new one of the same id; both have file_path and start_line."""
    return (
        ((old["file_path"] != "") & (new["file_path"] == ""))
        | (_absolute(old["file_path"]) & _web_path(new["file_path"]))
        | ((old["start_line"] > 0) & (new["start_line"] == 0))
    )


def merge_nodes(versions: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """One row for each key: its versions folded in order. Only what the rules look at is folded; the winner is joined back, so
    a key with many versions costs one small array."""
    key = key or ["id"]
    rest = [c for c in versions.columns if c not in (*key, *order)]
    place = F.struct(*order)
    small = F.struct(place.alias("at"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("location.start_line", F.lit(0)).alias("start_line"))
    folded = versions.groupBy(*key).agg(F.sort_array(F.collect_list(small)).alias("v"))
    winner = F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.col("v")[0], lambda old, new: F.when(keeps_existing(old, new), old).otherwise(new))
    best = folded.select(*key, winner["at"].alias("_at"))
    hit = versions.withColumn("_at", place).join(best, [*key, "_at"], "left_semi")
    return hit.select(*key, *rest).dropDuplicates(key)


def bag_union(*edges: DataFrame) -> DataFrame:
    """Edges are a bag: equal ones stay."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def insert_if_absent(nodes: DataFrame, stubs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """nodes and those stubs, one for each key, that have no node."""
    key = key or ["id"]
    return nodes.unionByName(stubs.dropDuplicates(key).join(nodes.select(*key), key, "left_anti"))


def put_metadata(nodes: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """nodes with metadata[name] set from values (id, value), where there is one."""
    joined = nodes.join(values.select("id", F.col("value").alias("_value")), "id", "left")
    rest = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != name)
    put = F.when(F.col("_value").isNotNull(), F.map_concat(rest, F.create_map(F.lit(name), F.col("_value")))).otherwise(F.col("metadata"))
    return joined.withColumn("metadata", put).select(*nodes.columns)
