"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source has a target number of words; equal blocks of words are the seats, and each seat goes to the source with
the highest quotient target / (2 seats + 1). A source's seats are divided the same way over groups of shards (rows by hash of
their id), and a group's over its shards, so that no task sees more than a group. Inside a shard, documents stand in seeded order and are cut
into blocks; the quota takes whole passes and then a run of blocks from a seeded start, on a ring. The runs' edges may cut a
document, so a source meets its quota to the word.

Defined cases: null text has no words; a null source is a source of its own, after all others; a null doc_id is an empty one; documents
without words, and so empty texts, are taken 0 times; very long texts are cut by blocks like others; repeated rows are rows of their own; ties of
quotients go to the source that comes first; an empty table gives no rows; other columns, whatever their names, are ignored by ``mix`` and kept
by ``mix_documents``. What the driver holds is a row for each source.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborweft.llm.common import join_sized, materialise


#: Shards of a group: seats are divided over groups, then inside each, by tasks that see no more rows than this or the groups there are.
GROUP = 4096


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1); ties go to the earlier one. A divisor found by halving gives all
    but the last few seats at once, so the work does not grow with the seats."""
    v = np.asarray(votes, float)
    if seats <= 0 or v.sum() <= 0:
        return [0] * len(v)
    lo, hi = 0.0, float(v.max()) * 2 + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (lo, mid) if np.floor(v / mid + 0.5).sum() <= seats else (mid, hi)
    got = [int(x) for x in np.floor(v / hi + 0.5)]
    heap = [(-x / (2 * s + 1), i) for i, (x, s) in enumerate(zip(v, got, strict=True)) if x > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-v[i] / (2 * got[i] + 1), i))
    return got


def share_targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the whole by weight, none above ``most`` times its own size; the excess is shared again by weight."""
    left, target = float(sum(sizes)), [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free and left > 0:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
        free = [i for i in free if i not in set(over)]
    return target


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix in whole documents: every column of docs, a row for each time the mix takes it. Rows of one doc_id, or of none, are told
    apart by their number of words."""
    taken = mix(docs, **options)
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).collect()[0]
    taken = taken.select(F.col("doc_id").alias("_mix_id"), F.col("size").alias("_mix_n"), F.col("whole").cast("int").alias("_mix_whole"))
    packed = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_document")
    keyed = docs.select(packed, F.col("doc_id").alias("_doc"), word_count(F.col("text")).alias("_mix_size"), F.xxhash64("text").alias("_mix_hash"))
    same = F.col("_doc").eqNullSafe(F.col("_mix_id"))
    if ids["n"] != ids["d"]:
        taken = taken.withColumn("_mix_k", F.row_number().over(W.partitionBy("_mix_id", "_mix_n").orderBy("_mix_whole")))
        keyed = keyed.withColumn("_mix_row", F.row_number().over(W.partitionBy("_doc", "_mix_size").orderBy("_mix_hash")))
        same = same & (F.col("_mix_size") == F.col("_mix_n")) & (F.col("_mix_row") == F.col("_mix_k"))
    joined = join_sized(keyed, materialise(taken.where("_mix_whole > 0"), "mix-whole"), same, "inner", 32)
    return joined.select("_document", F.explode(F.array_repeat(F.lit(1), F.col("_mix_whole"))).alias("_copy")).select("_document.*")


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), block_words: int = 128, most: int = 3, rows_per_shard: int = 2_000, seed: int = 20
) -> DataFrame:
    """doc_id, size, source_size, target, taken, whole: ``taken`` words of the document go into the mix, ``whole`` is how
    often a mix of undivided documents takes it (a run takes a document that starts in it)."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("_src"),
        word_count(F.col("text")).alias("size"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), own)), 1, 15), 16, 10).cast("long").alias("_shard"),
        F.md5(F.concat(F.lit(f"{seed + 1}/"), own)).alias("_h"),
    )
    narrow = materialise(narrow, "mix-sizes")
    sources = narrow.groupBy("_src").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    found = {r["_src"]: r["n"] for r in sources}
    names = sorted(found, key=lambda s: (s[0] == "n", s))  # code points, null last
    sizes = [found[s] for s in names]
    targets = share_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
    quota = sainte_lague(targets, (min(sum(sizes), most * sum(sizes)) + block_words // 2) // block_words)
    rows = {r["_src"]: r["rows"] for r in sources}
    # a source gets shards by its rows, so a large one is spread as evenly as all others together
    plans = [(s, -(-rows[s] // rows_per_shard), n, t, q) for s, n, t, q in zip(names, sizes, targets, quota, strict=True)]
    plans = docs.sparkSession.createDataFrame(plans, "_src string, _shards long, source_size long, target double, _quota long")
    narrow = join_sized(narrow, plans.select("_src", "_shards"), "_src", "inner").withColumn("_shard", F.pmod("_shard", "_shards")).drop("_shards")
    cells = materialise(narrow.groupBy("_src", "_shard").agg(F.sum("size").alias("_cell")).withColumn("_group", F.floor(F.col("_shard") / GROUP)), "mix-cells")

    def divide(rows: pd.DataFrame, by: str, votes: str) -> pd.DataFrame:
        """The seats of _quota over rows in order of a column, by their votes."""
        rows = rows.sort_values(by)
        return rows.assign(_seats=sainte_lague(rows[votes].tolist(), int(rows["_quota"].iloc[0])))

    def of_groups(rows: pd.DataFrame) -> pd.DataFrame:
        return divide(rows, "_group", "_votes")[["_src", "_group", "_seats"]]

    def of_cells(rows: pd.DataFrame) -> pd.DataFrame:
        rows = divide(rows, "_shard", "_cell")
        n = rows["_cell"].to_numpy()
        take = np.minimum(rows["_seats"].to_numpy() * block_words, n * most)
        whole = np.where(n > 0, take // np.maximum(n, 1), 0)
        blocks = np.maximum(1, -(-n // block_words))
        pick = np.array([int(hashlib.md5(f"{seed}/{src}/{s}".encode()).hexdigest()[:8], 16) for src, s in zip(rows["_src"], rows["_shard"], strict=True)])
        made = rows.assign(_pass=whole, _run=take - whole * n, _start=pick % blocks * block_words)
        return made[["_src", "_shard", "_cell", "_pass", "_run", "_start"]]

    groups = cells.groupBy("_src", "_group").agg(F.sum("_cell").alias("_votes"))
    groups = join_sized(groups, plans.select("_src", "_quota"), "_src", "inner").groupBy("_src").applyInPandas(of_groups, "_src string, _group long, _seats long")
    plan = cells.join(groups.withColumnRenamed("_seats", "_quota"), ["_src", "_group"])
    plan = plan.groupBy("_src", "_group").applyInPandas(of_cells, "_src string, _shard long, _cell long, _pass long, _run long, _start long")
    plan = join_sized(plan, plans.select("_src", "source_size", "target"), "_src", "inner")
    order = W.partitionBy("_src", "_shard").orderBy("_h", "doc_id", "size")
    placed = narrow.withColumn("_off", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(plan, ["_src", "_shard"])
    off, end, start, stop, cell = F.col("_off"), F.col("_off") + F.col("size"), F.col("_start"), F.col("_start") + F.col("_run"), F.col("_cell")
    zero = F.lit(0).cast("long")
    part = F.greatest(zero, F.least(end, stop, cell) - F.greatest(off, start)) + F.greatest(zero, F.least(end, stop - cell) - off)
    begins = ((off >= start) & (off < F.least(stop, cell))) | (off < stop - cell)
    full = F.col("_pass") * F.col("size")
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (full + part).alias("taken"),
        F.when(F.col("size") > 0, F.col("_pass") + F.when(begins, 1).otherwise(0)).otherwise(zero).alias("whole"),
    )
