"""Path expansion over edge tables (edge_id, src, dst, relation).

``expand`` lists trails (no edge twice) hop by hop, one equi-join each; ``reachable`` keeps the nearest hop of each node and drops
what it has seen, so cycles cost nothing. Prune edges to the relations asked for and seeds to the more selective end first;
``reverse`` turns edges round for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arborweft.functions.scratch import cut


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "_x"}).withColumnsRenamed({"dst": "src"}).withColumnsRenamed({"_x": "dst"})


def expand(edges: DataFrame, seeds: DataFrame, least: int = 1, most: int | None = None, nodes: bool = True, cap: int | None = None, every: int = 6) -> DataFrame:
    """start, end, depth, edge_ids and, if asked, node_ids of all trails of least..most hops from seeds (id). Without a bound, until
    no trail goes on, which happens by itself as no trail has an edge twice; a cap given refuses longer ones, and never leaves them out.
    Lineage is cut every few hops."""
    hop = edges.select(F.col("src").alias("end"), F.col("dst").alias("_to"), F.col("edge_id").alias("_e"))
    if most is None or most > 2:
        hop = cut(hop)  # met again each hop
    first = seeds.select(F.col("id").alias("start"), F.col("id").alias("end"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("edge_ids"), F.array("id").alias("node_ids"))
    frontier, out = first, first if least == 0 else None
    depth = 0
    while most is None or depth < most:
        depth += 1
        step = frontier.join(hop, "end").where(~F.array_contains("edge_ids", F.col("_e")) if depth > 1 else F.lit(True))
        frontier = step.select("start", F.col("_to").alias("end"), F.lit(depth).alias("depth"), F.concat("edge_ids", F.array("_e")).alias("edge_ids"), F.concat("node_ids", F.array("_to")).alias("node_ids"))
        if most is None or depth % every == 0:
            frontier = cut(frontier)
            if most is None and frontier.isEmpty():
                break
            if most is None and cap is not None and depth > cap:
                raise ValueError(f"trails of more than {cap} hops; give an upper bound or a larger cap")
        if depth >= least:
            out = frontier if out is None else out.unionByName(frontier)
    out = out if out is not None else first.where("false")
    return out if nodes else out.drop("node_ids")


def reachable(edges: DataFrame, seeds: DataFrame, most: int | None = None, per_start: bool = True) -> DataFrame:
    """start, id, depth: for each seed (id) the nodes it reaches in 1..most hops, with the fewest hops. A seed is in its own result only
    if a cycle leads back. Breadth first; a round meets only nodes not seen before, and is written to the shared folder."""
    hop = edges.select(F.col("src").alias("id"), F.col("dst").alias("_to")).distinct()
    if most is None or most > 2:
        hop = cut(hop)  # met again each round
    key = ["start", "id"]
    frontier = seeds.select((F.col("id") if per_start else F.lit("*")).alias("start"), "id").distinct()
    seen, depth = None, 0
    while most is None or depth < most:
        depth += 1
        found = frontier.join(hop, "id").select("start", F.col("_to").alias("id")).distinct()
        if seen is not None:
            found = found.join(seen.select(*key), key, "left_anti")
        rows = Observation()
        found = cut(found.withColumn("depth", F.lit(depth)).observe(rows, F.count("*").alias("n")))
        if not rows.get["n"]:
            break
        seen = found if seen is None else seen.unionByName(found)
        if depth % 8 == 0:
            seen = cut(seen)  # one table in place of many
        frontier = found.select(*key)
    return seen if seen is not None else frontier.withColumn("depth", F.lit(0)).where("false")


def degrees(nodes: DataFrame, edges: DataFrame, end: str = "src") -> DataFrame:
    """id, degree of every node, zeros included."""
    counts = edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("_n"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("_n", F.lit(0)).alias("degree"))


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an outgoing edge."""
    return nodes.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
