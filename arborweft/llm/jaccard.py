"""N-gram Jaccard join by T-occurrence search.

A document is the set of its distinct word n-grams, as 64-bit hashes; sets of sizes a and b with similarity t share at least
T = t (a + b) / (1 + t) of them. The corpus-wide search works like DivideSkip's split into short and long lists: with n-grams in
order of rising frequency, two linked documents share one of their first a - t a + 1, so only those rarest ones (the
short lists) bring documents together, and the rest are only probed. Frequencies come from a sketch over all documents, of fixed
size; they order n-grams, and never decide a link.

1. sketch: documents for each bucket of n-gram hashes, added up in levels of 64; its size follows the bytes of all texts, and the
   mean count, which is what chance alone puts into a bucket, is taken off.
2. features: size, digest and rare prefix of each document; equal digests are one class.
3. documents that share a prefix n-gram, and that their sizes, the places of that n-gram and parity bitmaps of their sets leave
   a chance, are candidates; their components are found by contraction.
   Passages that many unrelated documents quote join those to large components, so all pairs of each component that sizes allow
   are tested by bitmap (large ones in tiles of bounded size), and components are found anew from what is left.
4. each component, pairs too, is searched in one place (huge ones in chunks): short inverted lists are merged, long ones
   probed by binary search, or counted where that takes less, and documents that reach T are linked. A document linked to a leader is not indexed itself. Links between two
   leaders' followers are bounded by the triangle inequality of the Jaccard distance, and only pairs of leaders near
   enough for one have their followers compared. So a group of n near copies costs about n searches, and no link is lost.
5. chunks of one component meet by their leaders, then by those pairs of different components that sizes and bitmaps leave a chance,
   in blocks of bounded size.

Defined cases: white space is \\x20\\x09-\\x0D; null or empty texts have no set and link with nothing; fewer words than n are one n-gram;
rows of equal doc_id are one node; rows without doc_id are nodes by their text (128-bit hash), link like others and never name a component: a
component of such rows alone has a null id; an empty table gives no rows; very long texts are sets like others; other columns, whatever their
names, are ignored by ``jaccard_components`` and kept by ``near_dedup``; hashes are compared in place of n-grams.
"""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from array import array
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweft.llm.common import Powers, bound_arrow, join_sized, materialise, mix64, prefix_sums, range_hash, slices, text_bytes, trimmed

#: How many of the longest lists are set aside: T / (MU log2(longest) + 1), the published rule and constant.
MU = 0.0085
CHUNKS = 64


FACTORS = mix64(np.arange(1, 65, dtype=np.uint64))
FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _sets(column: pa.Array, n: int, powers: Powers, slice_bytes: int = 1 << 20):
    """For each text the sorted distinct hashes of its word n-grams; of all its words where they are fewer."""
    data, offsets = text_bytes(column)
    for first, last in slices(offsets, slice_bytes):
        own = offsets[first : last + 1] - offsets[first]
        b = FOLD[data[offsets[first] : offsets[last]]]
        word = ~BLANK[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[own] = True  # words end with their text
        before = np.append(False, word)
        starts = np.flatnonzero(word & (~before[:-1] | edge[:-1]))
        ends = np.flatnonzero(word & (~np.append(word[1:], False) | edge[1:])) + 1
        h = range_hash(prefix_sums(b, powers), starts, ends, powers) if len(starts) else np.zeros(0, np.uint64)
        grams = _combine(h, n)
        at = np.searchsorted(starts, own)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield _combine(h[lo:hi], hi - lo)
            else:
                yield np.zeros(0, np.uint64)


def _combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    m = max(0, len(h) - k + 1)
    total = h[:m] * FACTORS[0]
    for i in range(1, k):
        total = total + mix64(h[i : m + i] ^ FACTORS[i % 64]) * FACTORS[i % 64]
    return mix64(total + np.uint64(k))


def sketch_bits(text_bytes: int, least: int = 22, most: int = 26) -> int:
    """Buckets of the sketch, as a power of two: one for 64 n-grams of a corpus of so many bytes. The least is enough for 2.7e8 n-grams;
    the most keeps a worker's table at 256 MB, and beyond it counts get coarser, never wrong."""
    return min(most, max(least, (text_bytes // 6 // 64).bit_length()))


def _sketch(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """How many documents have an n-gram in each of 2**bits buckets beyond the mean bucket, at most 65535."""
    part, fan = (1 << bits) // CHUNKS, 64

    def count(batches):
        table, powers = np.zeros(1 << bits, np.uint32), Powers()
        for b in batches:
            column = b.column(0)
            for first in range(0, len(column), 256):
                found = [x >> np.uint64(64 - bits) for x in _sets(column.slice(first, 256), n, powers)]
                np.add.at(table, np.concatenate(found).astype(np.int64), 1)
        task = TaskContext.get().partitionId() // fan
        for c in range(CHUNKS):
            piece = table[c * part : (c + 1) * part]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([task]), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["c", "task", "piece"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(part, np.uint64)
        for x in group["piece"]:
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        total = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pd.DataFrame({"c": [int(group["c"].iloc[0])], "task": [int(group["task"].iloc[0]) // fan], "piece": [zlib.compress(total.tobytes(), 1)]})

    kind = "c long, task long, piece binary"
    level = docs.select("text").mapInArrow(count, kind)
    for _ in range(3):  # a group adds up 64 pieces; 64**4 tasks are 16 million
        level = level.groupBy("c", "task").applyInPandas(add, kind)
    table = np.zeros(1 << bits, np.uint32)
    for r in level.groupBy("c").applyInPandas(add, kind).collect():  # 2**bits counters, whatever the input
        table[r["c"] * part : (r["c"] + 1) * part] = np.frombuffer(zlib.decompress(r["piece"]), np.uint32)
    return np.minimum(table - np.minimum(table, np.uint32(table.mean())), 65535).astype(np.uint16)


def number_rows(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, object, int]:
    """docs as _id, text and the columns of keep, a function that gives a node's doc_id, and the bytes of all texts. A row without doc_id
    gets the number of its text, from a stretch of numbers that no doc_id lies in."""
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", *keep)
    known = own.agg(F.count("*").alias("n"), F.count("_id").alias("ids"), F.max("_id").alias("top"), F.sum(F.octet_length("text")).alias("size")).collect()[0]
    if known["n"] == known["ids"]:
        return own, lambda c: c, known["size"] or 0
    text = F.coalesce("text", F.lit(""))
    hashed = own.where("_id IS NULL").select("*", F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(7), text).alias("_h2"))
    numbers = materialise(hashed.select("_h1", "_h2").distinct().select("_h1", "_h2", F.monotonically_increasing_id().alias("_number")), "numbers")
    width = (numbers.agg(F.max("_number")).collect()[0][0] or 0) + 1
    base, chance = (known["top"] if known["top"] is not None else 0) + 1, random.Random(5)
    while base + width >= 1 << 63 or not docs.where(F.col("doc_id").between(base, base + width)).isEmpty():
        base = chance.randrange(-(1 << 63), (1 << 63) - width)
    named = join_sized(hashed, numbers, ["_h1", "_h2"], "inner", 32).select((F.col("_number") + base).alias("_id"), "text", *keep)
    return own.where("_id IS NOT NULL").unionByName(named), lambda c: F.when(~c.between(base, base + width), c), known["size"] or 0


def _features(docs: DataFrame, n: int, percent: int, bits: int, hot: int) -> DataFrame:
    """_id, n_shingles, _digest, a parity bitmap of the set, and the rare prefix: _rare, and _hot for n-grams that more than
    ``hot`` documents may have."""
    shared = docs.sparkSession.sparkContext.broadcast(_sketch(docs, n, bits))
    schema = "_id long, n_shingles long, _digest binary, _bits array<long>, _rare array<long>, _hot array<long>"

    def run(batches):
        table, powers = shared.value, Powers()
        shift = np.uint64(64 - bits)
        for b in batches:
            size, digest, bits_of, rare, hots = [], [], [], [], []
            for s in _sets(b.column("text"), n, powers):
                a = len(s)
                size.append(a)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bits_of.append(_parity(s))
                freq = table[(s >> shift).astype(np.int64)]
                first = np.lexsort((s, freq))[: a - -(-percent * a // 100) + 1] if a else np.zeros(0, np.int64)
                over = freq[first] > hot
                rare.append(s[first[~over]].view(np.int64))
                hots.append(s[first[over]].view(np.int64))
            made = [pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits_of, pa.list_(pa.int64())), pa.array(rare, pa.list_(pa.int64())), pa.array(hots, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("_id"), *made], names=["_id", "n_shingles", "_digest", "_bits", "_rare", "_hot"])

    return docs.select("_id", "text").mapInArrow(run, schema)


def _parity(s: np.ndarray) -> np.ndarray:
    """A bitmap of the parity of the n-grams in each of 4 to 8 buckets an n-gram, a power of two from 256 to 2**18: two of them differ
    in at most as many places as the sets in elements. Sets that may be linked have widths that are equal or differ by one step."""
    width = 1 << min(18, max(8, (4 * len(s)).bit_length()))
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _near_pairs(nodes: DataFrame, percent: int, few: int = 32) -> DataFrame:
    """Edges (u, v) that connect at least all linked documents that share a rare prefix n-gram. Among few documents of an n-gram
    pairs are tested: by size, by how many n-grams stand before the first shared one, and by parity bitmaps. Many
    documents become a chain in order of size, cut where sizes are too far apart."""
    rows = nodes.select("_id", "n_shingles", F.posexplode("_rare").alias("p", "t"))
    met = rows.groupBy("t").agg(F.array_sort(F.collect_set(F.struct(F.col("n_shingles").alias("a"), F.col("p"), F.col("_id").alias("i")))).alias("r"))
    met = materialise(met.where(F.size("r") > 1), "shared-grams")
    close = lambda x, y: x["a"] * 100 >= y["a"] * percent

    def together(x, y):
        total = x["a"] + y["a"]
        need = F.ceil(total * percent / F.lit(100.0 + percent) - 1e-9)
        return (x["p"] + y["p"]) <= total - 2 * need

    pairs = F.flatten(
        F.transform(
            "r",
            lambda x, k: F.transform(
                F.filter(F.slice("r", k + 2, F.lit(few)), lambda y: close(x, y) & together(x, y)), lambda y: F.struct(x["i"].alias("u"), y["i"].alias("v"))
            ),
        )
    )
    chain = F.filter(
        F.transform("r", lambda y, k: F.when((k > 0) & close(F.get("r", k - 1), y), F.struct(F.get("r", k - 1)["i"].alias("u"), y["i"].alias("v")))),
        lambda e: e.isNotNull(),
    )
    tested = materialise(met.where(F.size("r") <= few).select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u != v").distinct(), "pairs")
    side = lambda c: nodes.select(F.col("_id").alias(c), F.col("n_shingles").alias(f"{c}_n"), F.col("_bits").alias(f"{c}_bits"))
    known = tested.join(side("u"), "u").join(side("v"), "v")
    xor = lambda x, y: x.bitwiseXOR(y)
    width = F.least(F.size("u_bits"), F.size("v_bits"))
    fold = lambda c: F.when(F.size(c) > width, F.zip_with(F.slice(c, 1, width), F.slice(c, width + 1, width), xor)).otherwise(F.col(c))
    differ = F.aggregate(F.zip_with(fold("u_bits"), fold("v_bits"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda s, x: s + x)
    most = (F.col("u_n") + F.col("v_n")) * ((100 - percent) / (100.0 + percent)) + 1e-6
    known = known.where(differ <= most)
    return known.select("u", "v").union(met.where(F.size("r") > few).select(F.explode(chain).alias("e")).select("e.u", "e.v"))


def _need(a: int, b: int, percent: int) -> int:
    """The overlap at which sets of these sizes have a similarity of percent / 100."""
    return -(-percent * (a + b) // (100 + percent))


def components(edges: DataFrame) -> DataFrame:
    """_id, _root for every node of the edges (u, v): equal roots are one component. Each round every node joins the neighbour
    of lowest hash, and edges are contracted; hashes change by round, so rounds grow with the logarithm of the nodes."""
    levels, edges = [], materialise(edges.where("u != v").distinct(), "edges")
    while edges.limit(1).count():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(levels)), c).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        parents = materialise(near.select("u", F.least(F.col("m"), rank("u"))["id"].alias("p")), "parents")
        levels.append(parents)
        step = join_sized(edges, parents.withColumnRenamed("p", "pu"), "u", "inner", 16)
        step = join_sized(step, parents.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v", "inner", 16)
        edges = materialise(step.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u != v").distinct(), "edges")
    if not levels:
        return edges.select(F.col("u").alias("_id"), F.col("v").alias("_root"))
    out = levels[0].select(F.col("u").alias("_id"), F.col("p").alias("_root"))
    for parents in levels[1:]:
        step = join_sized(out, parents.select(F.col("u").alias("_root"), "p"), "_root", "left", 16)
        out = step.select("_id", F.coalesce("p", "_root").alias("_root"))
    return materialise(out, "roots")


def near_pairs(sizes: np.ndarray, bitmaps: list[np.ndarray], percent: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of numbers of sets that connect all those whose sizes and parity bitmaps leave a link a chance; where components are known,
    all such pairs between different ones. With sides, those pairs only that have one set on either. bitmaps: unsigned, as bits of
    signed numbers are counted without their sign."""
    root, share, out = np.arange(len(sizes)) if known is None else known, (100 - percent) / (100.0 + percent), []
    classes: dict[int, np.ndarray] = {}
    for k in np.argsort(sizes, kind="stable").tolist():
        classes.setdefault(len(bitmaps[k]), []).append(k)
    rows = {w: (np.array(own), np.stack([bitmaps[k] for k in own])) for w, own in classes.items()}
    for w, (own, bits) in rows.items():
        parts = [(own, bits)]
        if 2 * w in rows:  # bucket by remainder, so the wider bitmap is folded by adding its halves
            more, wide = rows[2 * w]
            parts.append((more, wide[:, :w] ^ wide[:, w:]))
        for at, k in enumerate(own.tolist()):
            for part, (others, of) in enumerate(parts):
                first = 0 if part else at + 1
                last = np.searchsorted(sizes[others], sizes[k] * 100 // percent, "right")
                js = others[first:last]
                fit = root[js] != root[k]
                if side is not None:
                    fit &= side[js] != side[k]
                if not fit.any():
                    continue
                js = js[fit]
                differ = np.bitwise_count(of[first:last][fit] ^ bits[at]).sum(1, dtype=np.int64)
                js = js[differ <= (sizes[k] + sizes[js]) * share + 1e-6]
                if known is not None:
                    out += [(k, int(j)) for j in js]
                elif len(js):
                    met, where = np.unique(root[js], return_index=True)
                    out += [(k, int(j)) for j in js[where]]
                    root[np.isin(root, met)] = root[k]
    return out


def _near_edges(members: DataFrame, percent: int, limit: int = 4 << 20) -> DataFrame:
    """u, v: what near_pairs leaves of each component of members (_comp, _id, n_shingles, _bits, _known). Components of more bytes of bitmaps than limit are cut by size, so that links cross to the next class at most, and each class into pieces, which meet two by two."""
    step = max(math.log(100 / percent), 1e-3) + 1e-9
    weight = F.size("_bits") * 8 + 64
    rows = members.withColumn("_class", F.floor(F.log("n_shingles") / step).cast("int"))
    sums = rows.groupBy("_comp", "_class").agg(F.sum(weight).alias("b")).groupBy("_comp").agg(F.sum("b").alias("b"), F.max("b").alias("most"))
    cut = F.when(F.col("b") > limit, F.ceil(F.col("most") / limit)).otherwise(0).cast("int")
    sums = materialise(sums.select("_comp", cut.alias("_cut")), "cuts")
    rows = join_sized(rows, sums, "_comp", "inner", 16)
    own = F.pmod(F.xxhash64("_id"), F.greatest("_cut", F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.col("_cut") - 1)
    tile = lambda cls, across, i, j, side: F.struct(cls.alias("_class"), F.lit(across).alias("_across"), i.alias("_i"), j.alias("_j"), side.alias("_side"))
    zero = F.lit(0)
    tiles = F.when(F.col("_cut") == 0, F.array(tile(zero, 0, zero, zero, zero))).otherwise(
        F.concat(
            F.transform(every, lambda j: tile(F.col("_class"), 0, F.least(own, j), F.greatest(own, j), (own > j).cast("int"))),
            F.transform(every, lambda j: tile(F.col("_class"), 1, own, j, zero)),
            F.transform(every, lambda j: tile(F.col("_class") - 1, 1, j, own, F.lit(1))),
        )
    )
    keys = ["_comp", "_class", "_across", "_i", "_j"]
    dealt = rows.select("_comp", "_id", "n_shingles", "_bits", "_known", F.explode(tiles).alias("t")).select("_comp", "t.*", "_id", "n_shingles", "_bits", "_known")

    def run(batches):
        for (_, _, across, i, j), held in _groups(batches, keys, ["_side", "_id", "n_shingles", "_bits", "_known"]):
            side, ids, sizes, bits, known = zip(*held, strict=True)
            side = np.array(side) if across or i != j else None
            if side is not None and (side == side[0]).all():
                continue
            known = None if known[0] is None else np.array(known, np.int64)
            found = near_pairs(np.array(sizes), [np.array(b, np.int64).view(np.uint64) for b in bits], percent, side, known)
            if found:
                u, v = zip(*((ids[x], ids[y]) for x, y in found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


class Inverted:
    """An inverted index of sets (sorted arrays of hashes), searched by DivideSkip."""

    def __init__(self) -> None:
        self.lists: dict[int, array] = {}
        self.sets: list[np.ndarray] = []
        self.sizes = np.zeros(16, np.int64)

    def add(self, own: np.ndarray) -> None:
        k = len(self.sets)
        self.sets.append(own)
        if k == len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros(k, np.int64)])
        self.sizes[k] = len(own)
        for t in own.tolist():
            if (x := self.lists.get(t)) is None:
                self.lists[t] = x = array("i")
            x.append(k)

    def search(self, query: np.ndarray, percent: int, wanted=None):
        """(set, overlap) of the sets whose similarity with the query reaches the percentage, the most promising first. wanted(set) is
        asked just before a set would be probed, so a caller can pass over what it has come to know."""
        a = len(query)
        lists = [x for t in query.tolist() if (x := self.lists.get(t))]
        least = -(-percent * a // 100)
        if len(lists) < least:
            return
        lists.sort(key=len)
        # the longest lists are set aside; a set needs the rest of T from the short ones
        aside = min(least - 1, int(least / (MU * math.log2(len(lists[-1])) + 1)))
        short = lists[: len(lists) - aside]
        long = lists[len(lists) - aside :]
        merged = np.frombuffer(b"".join(short), np.int32)
        if len(merged) * 8 < len(self.sets):
            ks, counts = np.unique(merged, return_counts=True)
        else:
            counts = np.bincount(merged, minlength=1)
            ks = np.flatnonzero(counts)
            counts = counts[ks]
        need = -(-percent * (a + self.sizes[ks]) // (100 + percent))
        open_ = counts + aside >= need
        ks, counts, need = ks[open_], counts[open_], need[open_]
        # more probes than entries: the long lists are counted as well
        probe = long if len(ks) * len(long) * 8 < sum(map(len, long)) + 2000 else ()
        if long and not probe and len(ks):
            counts = counts + np.bincount(np.frombuffer(b"".join(long), np.int32), minlength=int(ks[-1]) + 1)[ks]
            open_ = counts >= need
            ks, counts, need = ks[open_], counts[open_], need[open_]
        order = np.lexsort((ks, -counts))
        for k, n, least in zip(ks[order].tolist(), counts[order].tolist(), need[order].tolist(), strict=True):
            if wanted is not None and not wanted(k):
                continue
            for x in probe:
                at = bisect_left(x, k)
                n += at < len(x) and x[at] == k
            if n >= least:
                yield k, n


class Sets:
    """Disjoint sets of small numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    a, b = sorted((len(x), len(y)))
    return 100 * a >= percent * b and len(np.intersect1d(x, y, assume_unique=True)) >= _need(a, b, percent)


def _near(x: np.ndarray, y: np.ndarray, far: float) -> bool:
    """Whether the Jaccard distance is at most far."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return len(x) + len(y) - 2 * shared <= far * (len(x) + len(y) - shared) + 1e-9


def cluster(sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """For each of some different sets: its component (of all links among them) and its leader, a set that it is linked to or
    is itself. Two followers x, y of leaders p, q can only be linked if d(p, q) <= d(p, x) + d(x, y) + d(y, q) <= 3 (1 - t)."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    joined, index, leaders, leader = Sets(len(sets)), Inverted(), [], [0] * len(sets)
    for i in order:
        best = None
        apart = lambda k: best is None or joined.find(leaders[k]) != joined.find(i)  # noqa: B023, E731
        for k, _ in index.search(sets[i], percent, apart):
            joined.join(i, leaders[k])
            best = leaders[k] if best is None else best
        leader[i] = i if best is None else best
        if best is None:
            index.add(sets[i])
            leaders.append(i)
    if len(leaders) < len(sets) and len({joined.find(p) for p in leaders}) > 1:
        _link_followers(sets, percent, joined, index, leaders, leader)
    return [joined.find(i) for i in range(len(sets))], leader


def _link_followers(sets, percent, joined, index, leaders, leader) -> None:
    far = (100 - percent) / 100
    group: dict[int, list[int]] = {}
    for i, p in enumerate(leader):
        group.setdefault(p, []).append(i)
    for k, p in enumerate(leaders):
        apart = lambda other: other < k and joined.find(leaders[other]) != joined.find(p) and len(group[p]) + len(group[leaders[other]]) > 2  # noqa: B023, E731
        for other, _ in index.search(sets[p], max(1, 100 - 3 * (100 - percent)), apart):
            q = leaders[other]
            ys = [y for y in group[q] if _near(sets[y], sets[p], 2 * far)]
            for x in group[p] if ys else ():
                if not _near(sets[x], sets[q], 2 * far):
                    continue
                if any(_similar(sets[x], sets[y], percent) for y in ys):
                    joined.join(p, q)
                    break


def _decode(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _groups(batches, keys: list[str], rest: list[str]):
    """(key, rows) of runs of equal keys in sorted batches."""
    held, rows = None, []
    for b in batches:
        columns = [b.column(c).to_pylist() for c in (*keys, *rest)]
        for r in zip(*columns, strict=True):
            key = r[: len(keys)]
            if key != held:
                if rows:
                    yield held, rows
                held, rows = key, []
            rows.append(r[len(keys) :])
    if rows:
        yield held, rows


def _cluster_blocks(batches, percent: int):
    """Rows (_comp, _chunks, _id, _root, _leader, _set): roots are the smallest id of a component inside the block; _set is given
    for leaders of components that have several blocks."""
    out = []
    for (comp, chunks, _), rows in _groups(batches, ["_comp", "_chunks", "_chunk"], ["_id", "_set"]):
        texts: dict[bytes, list[int]] = {}
        for i, s in rows:
            texts.setdefault(s, []).append(i)
        raw = list(texts)
        own = [min(x) for x in texts.values()]
        root, leader = cluster([np.frombuffer(s, np.uint64) for s in raw], percent) if len(raw) > 1 else ([0], [0])
        least: dict[int, int] = {}
        for k, r in enumerate(root):
            least[r] = min(least.get(r, own[k]), own[k])
        for k, s in enumerate(raw):
            for i in texts[s]:
                out.append((comp, chunks, i, least[root[k]], own[leader[k]], s if chunks > 1 and leader[k] == k and i == own[k] else None))
        if len(out) > 20_000:
            yield _block_batch(out)
            out = []
    if out:
        yield _block_batch(out)


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary()]
    names = ["_comp", "_chunks", "_id", "_root", "_leader", "_set"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _pair_blocks(rows: DataFrame, percent: int, limit: int) -> DataFrame:
    """u, v: linked pairs across the sides of each group, as many as connect what is linked. rows:
    _group, _side (0 or 1), _id, _set; each side is cut into pieces of about ``limit`` n-grams, and pieces meet two by two."""
    size = F.floor(F.octet_length("_set") / 8)
    pieces = rows.groupBy("_group").agg(
        *(F.ceil(F.coalesce(F.sum(F.when(F.col("_side") == s, size)), F.lit(0)) / limit).cast("int").alias(f"_n{s}") for s in (0, 1))
    )
    cut = rows.join(pieces, "_group").where("_n0 > 0 AND _n1 > 0")
    own = F.pmod(F.xxhash64("_id"), F.when(F.col("_side") == 0, F.col("_n0")).otherwise(F.col("_n1"))).cast("int")
    cut = cut.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(F.col("_side") == 0, F.col("_n1")).otherwise(F.col("_n0")) - 1)))
    a, b = F.when(F.col("_side") == 0, F.col("_own")).otherwise(F.col("_other")), F.when(F.col("_side") == 0, F.col("_other")).otherwise(F.col("_own"))
    cut = cut.select("_group", a.cast("int").alias("_a"), b.cast("int").alias("_b"), "_side", "_id", "_set")
    keys = ["_group", "_a", "_b"]

    def run(batches):
        for _, rows in _groups(batches, keys, ["_side", "_id", "_set"]):
            index, ids, out = Inverted(), [], []
            number: dict[int, int] = {}
            for _, i, _ in rows:
                number.setdefault(i, len(number))
            joined = Sets(len(number))
            for side, i, s in rows:  # side 0 comes first
                own = np.frombuffer(s, np.uint64)
                if side == 0:
                    index.add(own)
                    ids.append(i)
                    continue
                apart = lambda k: joined.find(number[ids[k]]) != joined.find(number[i])  # noqa: B023, E731
                for k, _ in index.search(own, percent, apart):
                    joined.join(number[ids[k]], number[i])
                    out.append((ids[k], i))
            if out:
                u, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return cut.repartition(*keys).sortWithinPartitions(*keys, "_side").mapInArrow(run, "u long, v long")


def _texts(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """members (keyed by _id) with the set of each document's text as binary column _set."""
    rows = join_sized(docs.select("_id", "text"), members, "_id", "inner")
    rest = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*rest).schema) + ", _set binary"

    def run(batches):
        powers = Powers()
        for b in batches:
            made = pa.array([s.tobytes() for s in _sets(b.column("text"), n, powers)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), made], names=[*rest, "_set"]).filter(pa.compute.greater(pa.compute.binary_length(made), 0))

    return rows.mapInArrow(run, schema)


def _join_chunks(docs: DataFrame, nodes: DataFrame, blocks: DataFrame, n: int, percent: int, limit: int) -> DataFrame:
    """_id, _root over the components that have several blocks."""
    several = blocks.where("_chunks > 1")
    leaders = several.where("_set IS NOT NULL").select("_comp", F.col("_id"), "_set")
    both = leaders.select(F.col("_comp").alias("_group"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_side"), "_id", "_set")
    edges = several.select(F.col("_id").alias("u"), F.col("_root").alias("v")).union(several.select(F.col("_id").alias("u"), F.col("_leader").alias("v")))
    edges = materialise(edges.union(_pair_blocks(both, percent, limit)), "chunk-edges")
    roots = components(edges)
    # pairs of different components that their bitmaps leave a chance
    members = materialise(several.select("_id", "_comp").distinct().join(roots, "_id", "left").select("_id", "_comp", F.coalesce("_root", "_id").alias("_known")), "chunk-members")
    open_pairs = materialise(_near_edges(join_sized(nodes.select("_id", "n_shingles", "_bits"), members, "_id", "inner", 32), percent).distinct(), "open-pairs")
    if not open_pairs.limit(1).count():
        return roots
    sides = open_pairs.select(F.col("u").alias("_group"), F.lit(0).alias("_side"), F.col("u").alias("_id")).distinct()
    sides = materialise(sides.union(open_pairs.select(F.col("u").alias("_group"), F.lit(1), F.col("v").alias("_id"))), "sides")
    return components(edges.union(_pair_blocks(_texts(docs, sides, n), percent, limit)))


def _components(docs: DataFrame, real, words: int, percent: int, bits: int, hot: int, chunk_shingles: int) -> DataFrame:
    """_id, n_shingles and _least, the node that stands for the component, for every row of numbered docs (_id, text)."""
    if not 67 <= percent <= 100:  # below, leaders of linked followers may share nothing
        raise ValueError("percent has to be from 67 to 100")
    bound_arrow(docs.sparkSession)
    least_of = F.coalesce(F.min(real(F.col("_id"))), F.min("_id"))
    features = materialise(_features(docs, words, percent, bits, hot), "features")
    copies = features.where("n_shingles > 0").groupBy("_digest").agg(least_of.alias("_rep"), F.count("*").alias("n")).where("n > 1")
    copies = materialise(copies.select("_digest", "_rep"), "copies")
    classes = join_sized(features, copies, "_digest", "left", 48).withColumn("_rep", F.coalesce("_rep", "_id"))
    nodes = classes.where("_id = _rep")
    # n-grams few documents have: their documents meet; those that many may have: the smallest id is found first
    common = nodes.select("_id", F.explode("_hot").alias("t"))
    least = common.groupBy("t").agg(F.min("_id").alias("v"), F.max("_id").alias("w")).where("v != w")
    edges = _near_pairs(nodes, percent).union(common.join(least, "t").select(F.col("_id").alias("u"), "v"))
    members = components(edges).select("_id", F.col("_root").alias("_comp"))
    members = join_sized(nodes.select("_id", "n_shingles", "_bits"), members, "_id", "inner", 24).withColumn("_known", F.lit(None).cast("long"))
    members = components(_near_edges(members, percent))
    sizes = features.select("_id", "n_shingles").dropDuplicates(["_id"])
    members = members.select("_id", F.col("_root").alias("_comp")).join(sizes, "_id")
    total = members.groupBy("_comp").agg(F.ceil(F.sum("n_shingles") / chunk_shingles).cast("int").alias("_chunks"))
    members = materialise(members.join(total, "_comp").select("_id", "_comp", "_chunks", F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int").alias("_chunk")), "members")
    keys = ["_comp", "_chunks", "_chunk"]
    sets = _texts(docs, members, words).repartition(*keys).sortWithinPartitions(*keys)
    blocks = materialise(sets.mapInArrow(lambda it: _cluster_blocks(it, percent), "_comp long, _chunks int, _id long, _root long, _leader long, _set binary"), "blocks")
    roots = blocks.where("_chunks = 1").select("_id", "_root")
    if blocks.where("_chunks > 1").limit(1).count():
        roots = roots.union(_join_chunks(docs, nodes, blocks, words, percent, chunk_shingles))
    # a doc_id with several texts is one node
    twice = features.groupBy("_id").agg(F.count("*").alias("n"), F.max("n_shingles").alias("m")).where("n > 1")
    if twice.limit(1).count():
        links = classes.select(F.col("_id").alias("u"), F.col("_rep").alias("v"))
        roots = components(links.union(roots.select(F.col("_id").alias("u"), F.col("_root").alias("v"))))
        classes = classes.withColumn("_rep", F.col("_id"))
    smallest = roots.groupBy("_root").agg(least_of.alias("_least"))
    roots = roots.join(smallest, "_root").select("_id", "_least")
    roots = materialise(roots.where("_id != _least").distinct().select(F.col("_id").alias("_rep"), "_least"), "components")
    out = join_sized(classes, roots, "_rep", "left", 16)
    return out.select("_id", "n_shingles", F.coalesce("_least", "_rep").alias("_least"))


def jaccard_components(
    docs: DataFrame, words: int = 3, percent: int = 90, bits: int | None = None, hot: int = 20_000, chunk_shingles: int = 1_000_000
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest doc_id reachable by links of similarity percent / 100 or more."""
    rows, real, size = number_rows(docs, [])
    found = _components(rows, real, words, percent, sketch_bits(size) if bits is None else bits, hot, chunk_shingles)
    return found.select(real(F.col("_id")).alias("doc_id"), "n_shingles", real(F.col("_least")).alias("component_id"))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, bits: int | None = None, hot: int = 20_000, chunk_shingles: int = 1_000_000) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id or, where no row has one, any. A doc_id found twice keeps one row; rows
    without words are linked with nothing, so those without doc_id all stay."""
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_document"))
    rows, real, size = number_rows(packed, ["_document"])
    found = _components(rows.select("_id", "text"), real, words, percent, sketch_bits(size) if bits is None else bits, hot, chunk_shingles)
    gone = materialise(found.where("_id != _least").select("_id").distinct(), "near-copies")
    left = join_sized(rows, gone, "_id", "left_anti", 16)
    ids = rows.agg(F.count("*").alias("n"), F.count_distinct("_id").alias("d")).collect()[0]
    if ids["n"] != ids["d"]:
        open_ended = real(F.col("_id")).isNull() & (trimmed(F.col("text")) == "")
        left = left.where(~open_ended).dropDuplicates(["_id"]).union(left.where(open_ended))
    return left.select("_document.*")
