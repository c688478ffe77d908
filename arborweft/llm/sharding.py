"""Sharding by sampled splitters, in DataFrame expressions only.

A record's key is the hash of its text followed by the hash of its id, so equal texts are neighbours and a large group of
them can still be divided. A sample drawn with probability in proportion to size gives boundaries at even quantiles of the
bytes; records fall into ranges by binary search, overfull ranges get boundaries of their own from a denser sample, and
inside a range running sums place each record on the line of all bytes. Shards are equal stretches of that line.

The driver holds the sample (a parameter), and one sum for each range and shard, never anything for each record.

Defined cases: null text has size 0 (plus overhead) and checksum 0; a null doc_id is an empty one; repeated rows take places next to each
other; of equal keys the order is by doc_id, size and checksum; very long texts are records like others: one larger than a shard's stretch
fills its shard and leaves others empty; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborweft.llm.common import materialise


def _key() -> Column:
    half = lambda c: F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 16)
    return F.concat(half(F.col("text")), half(F.col("doc_id")))


def _search(bounds: list[str], key: Column) -> Column:
    """How many of the sorted boundaries are at or below the key."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(bounds)), ",")
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = F.get(table, mid) <= key
        done = acc["lo"] >= acc["hi"]
        return F.struct(
            F.when(done, acc["lo"]).when(right, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(done, acc["hi"]).when(right, acc["hi"]).otherwise(mid).alias("hi"),
        )

    return F.aggregate(steps, start, halve, lambda acc: acc["lo"])


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    """Boundaries that cut the sample's weight into about so many even parts; a key is a boundary once."""
    total, seen, at, out = sum(w for _, w in sample), 0.0, 1, []
    for k, w in sorted(sample):
        if seen > 0 and seen * parts >= at * total and (not out or k > out[-1]):
            out.append(k)
            at = int(seen * parts / total) + 1
        seen += w
    return out


def _sample(records: DataFrame, total: int, draws: int, seed: int) -> list[tuple[str, float]]:
    """About so many keys, each drawn with probability size * draws / total, with the bytes it stands for."""
    chance = F.col("size") * F.lit(draws / max(1, total))
    draw = F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    rows = records.where(draw < chance).select("_key", F.greatest(F.lit(1.0), chance).alias("w")).collect()
    return [(r["_key"], r["w"]) for r in rows]


def _at(values: list[int], i: Column) -> Column:
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), i)


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, ranges_per_shard: int = 4, draws_per_range: int = 8, seed: int = 9) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the place inside the shard) of every record; sizes come out near equal."""
    utf8 = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    records = materialise(
        docs.select("doc_id", (F.length(utf8) + overhead).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"), _key().alias("_key")),
        "shard-records",
    )
    whole = records.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()[0]
    total, rows = whole["bytes"] or 0, whole["n"]
    parts = max(shards * ranges_per_shard, -(-rows // 1_000_000))
    bounds = _quantiles(_sample(records, total, parts * draws_per_range, seed), parts)
    for attempt in range(3):
        placed = records.withColumn("_range", _search(bounds, F.col("_key")))
        sums = {r["_range"]: r for r in placed.groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect()}
        over = [r for r, x in sums.items() if x["b"] > 2 * total / parts and x["lo"] < x["hi"]]
        if not over or attempt == 2:
            break
        fresh: dict[int, list] = {}
        drawn = placed.where(_at([int(i in over) for i in range(len(bounds) + 1)], F.col("_range")) == 1)
        for k, w in _sample(drawn, total, parts * draws_per_range * 4, seed + 1 + attempt):
            fresh.setdefault(bisect_right(bounds, k), []).append((k, w))
        extra = [q for r, s in fresh.items() for q in _quantiles(s, max(2, round(2 * sums[r]["b"] * parts / total)))]
        bounds = sorted({*bounds, *extra})
    n = len(bounds) + 1
    bytes_before, rows_before = [0], [0]
    for r in range(n):
        bytes_before.append(bytes_before[-1] + (sums[r]["b"] if r in sums else 0))
        rows_before.append(rows_before[-1] + (sums[r]["n"] if r in sums else 0))
    order = W.partitionBy("_range").orderBy("_key", "doc_id", "size", "text_crc32")
    run = order.rowsBetween(W.unboundedPreceding, 0)
    line = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        (_at(bytes_before, F.col("_range")) + F.sum("size").over(run) - F.col("size")).alias("_off"),
        (_at(rows_before, F.col("_range")) + F.row_number().over(order) - 1).alias("_row"),
    )
    middle = F.expr(f"((2 * _off + size) * {shards}) div {2 * max(1, total)}")
    line = materialise(line.withColumn("shard", F.least(F.lit(shards - 1), middle).cast("int")), "shard-line")
    first = {r["shard"]: r["f"] for r in line.groupBy("shard").agg(F.min("_row").alias("f")).collect()}
    slot = F.col("_row") - _at([first.get(i, 0) for i in range(shards)], F.col("shard"))
    return line.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
