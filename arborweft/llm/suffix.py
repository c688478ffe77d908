"""Removal of long repeated byte strings with suffix arrays over shards of the corpus.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in this or another document. Shards that
could hold a third of the corpus each would not help, so content decides where strings meet: every window of ``length`` bytes
has one anchor, its 32-gram of lowest hash, and equal windows have equal anchors at equal offsets. The windows of one anchor
are neighbours and span one context of bytes.

1. anchors found once in the corpus are gone: no window of theirs repeats.
2. contexts that are equal byte for byte repeat in whole; counting their 128-bit keys settles the inside of every copy.
3. what is left are contexts at the edges of copies. One of each different context goes to a shard with all others of
   its anchor, and each shard gets a suffix array by induced sorting: suffixes are classified, leftmost smaller ones (LMS)
   are sorted by their substrings and by recursion on the string of their names, the others are induced. Over bytes that is linear
   work, whole batches of a bucket at a time; over names, whose buckets are too many for that, every run of larger (then of smaller)
   suffixes is ordered up to the suffix that ends it, by doubling along the run. Permuted common prefixes (each suffix against its
   predecessor in the array, in text order) give the windows that repeat: those of at least ``length``.
4. an anchor with too many different contexts for one shard is counted by window hash instead, which spreads over all tasks.

Texts move once: they are written in buckets of their rows' identity, and what is found about rows is brought to the buckets.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; rows are known by 128 bits of their doc_id and text, so rows
without doc_id are told apart by text; repeated rows are further copies, so they lose what repeats; very long texts are cut by anchors like
others; ties cannot arise, as results are sets of positions; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweft.llm.common import SYMBOLS, Powers, bound_arrow, materialise, mix64, prefix_sums, range_hash, scratch_path, slices, text_bytes

GRAM = 32


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    two = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << 8)
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << 16)
    h = four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))
    for k in (8, 16):
        h = mix64(h[:-k] * np.uint64(0xD6E8FEB86659FD93) + h[k:] * np.uint64(0xCA5A826395121157))
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _anchors(b: np.ndarray, offsets: np.ndarray, length: int, powers: Powers):
    """(row, first start, last start, gram, context) of the anchors of all windows inside rows of one buffer."""
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none, none, none, none, none
    grams = _gram_hashes(b)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min(packed, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    for e in offsets[1:-1]:
        inside[max(0, e - length + 1) : e] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, none, none
    own = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    s, e, a = starts[first], starts[np.append(first[1:], len(starts)) - 1], own[first]
    prefix = prefix_sums(b, powers)
    shape = mix64(((a - s).astype(np.uint64) << np.uint64(32)) | (e - s).astype(np.uint64))
    context = mix64(range_hash(prefix, s, e + length, powers) ^ shape)
    row = np.searchsorted(offsets, s, "right") - 1
    return row, s - offsets[row], e - offsets[row], grams[a].view(np.int64), context.view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """_id and _tag, 128 bits that tell rows apart by doc_id and text, the text and doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("_id"), F.xxhash64(F.lit(7), text, "doc_id").alias("_tag"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def anchors(docs: DataFrame, length: int, only_grams: bool = False, slice_bytes: int = 1 << 20) -> DataFrame:
    schema = "_gram long" if only_grams else "_id long, _tag long, _s int, _e int, _gram long, _ctx long"

    def run(batches):
        powers = Powers()
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            for first, last in slices(offsets, slice_bytes):
                own = offsets[first : last + 1] - offsets[first]
                row, s, e, gram, ctx = _anchors(data[offsets[first] : offsets[last]], own, length, powers)
                if not len(row):
                    continue
                if only_grams:
                    yield pa.RecordBatch.from_arrays([pa.array(gram)], names=["_gram"])
                    continue
                at = pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").take(at), b.column("_tag").take(at), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(gram), pa.array(ctx)],
                    names=["_id", "_tag", "_s", "_e", "_gram", "_ctx"],
                )

    return _rows(docs).select("_id", "_tag", "text").mapInArrow(run, schema)


def _spread(queues: list[list], j: np.ndarray, chars: np.ndarray) -> None:
    if not len(j):
        return
    order = chars.argsort(kind="stable")
    j, chars = j[order], chars[order]
    cuts = [0, *((chars[1:] != chars[:-1]).nonzero()[0] + 1).tolist(), len(j)]
    for k in range(len(cuts) - 1):
        queues[chars[cuts[k]]].append(j[cuts[k] : cuts[k + 1]])


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes, from the LMS ones in order: larger ones from left to right, then smaller ones from right to left. A bucket's
    entries are handled in waves; each wave is what the one before put into the same bucket."""
    by_char: list[list] = [[] for _ in range(symbols)]
    _spread(by_char, lms, t[lms])
    large: list[list] = [[] for _ in range(symbols)]
    for c in range(symbols):
        k = 0
        while k < len(large[c]):
            j = large[c][k] - 1
            j = j[j >= 0]
            j = j[~small[j]]
            _spread(large, j, t[j])
            k += 1
        for part in by_char[c]:
            j = part - 1
            j = j[j >= 0]
            _spread(large, j, t[j])
    little: list[list] = [[] for _ in range(symbols)]  # from right to left
    for c in range(symbols - 1, -1, -1):
        k = 0
        while k < len(little[c]):
            j = little[c][k] - 1
            j = j[j >= 0]
            j = j[small[j]]
            _spread(little, j, t[j])
            k += 1
        if large[c]:
            j = np.concatenate(large[c])[::-1] - 1
            j = j[j >= 0]
            j = j[small[j]]
            _spread(little, j, t[j])
    out = [np.array([len(t) - 1])]
    for c in range(symbols):
        out += large[c]
        out += [x[::-1] for x in reversed(little[c])]
    return np.concatenate(out)


def _before(counts: np.ndarray) -> np.ndarray:
    """How many stand in the classes before each."""
    return np.cumsum(counts) - counts


def _order_runs(t: np.ndarray, own: np.ndarray, ends: np.ndarray, ends_last: bool) -> np.ndarray:
    """The suffixes where ``own`` is true, in order. Each of their runs goes on to one of ``ends``, suffixes in order; of suffixes
    with one first symbol the ends stand last or first. Doubling along runs: a suffix whose run has ended is told from all others,
    and only those not yet told apart are looked at again."""
    n, at = len(t), np.flatnonzero(own)
    if not len(at):
        return at
    kind = 2 * t.astype(np.int64) + (own != ends_last)  # first symbol, then side
    classes = int(kind.max()) + 1
    here, there = np.bincount(kind[at], minlength=classes), np.bincount(kind[ends], minlength=classes)
    start = _before(here + there)
    rank = np.zeros(n, np.int64)  # a place in the order of all; suffixes not yet told apart have one together
    rank[at] = start[kind[at]]
    rank[ends] = start[kind[ends]] + np.arange(len(ends)) - _before(there)[kind[ends]]
    is_end = np.full(n, n, np.int64)
    is_end[ends] = ends
    far = np.minimum.accumulate(is_end[::-1])[::-1] - np.arange(n)  # steps to the end of the run
    live, k = at, 1
    while len(live):
        key = rank[live] << 32 | rank[live + np.minimum(k, far[live])]
        order = np.argsort(key)
        live, key = live[order], key[order]
        fresh = np.append(True, key[1:] != key[:-1])
        group = np.append(True, key[1:] >> 32 != key[:-1] >> 32)
        place = np.arange(len(live))
        rank[live] = (key >> 32) + place[fresh][np.cumsum(fresh) - 1] - place[group][np.cumsum(group) - 1]
        live = live[~(fresh & np.append(fresh[1:], True))]
        k *= 2
    return at[np.argsort(rank[at])]


def _induce_names(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same as ``_induce`` for strings with many symbols."""
    large = _order_runs(t, ~small, lms, True)
    own = small.copy()
    own[-1] = False  # the last symbol comes first
    both = np.concatenate([large, _order_runs(t, own, large, False)])
    return np.append(len(t) - 1, both[np.argsort(2 * t[both] + own[both], kind="stable")])


def suffix_array(t: np.ndarray, powers: Powers) -> np.ndarray:
    """The suffix array of t, whose last symbol is the only 0."""
    n, symbols = len(t), int(t.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    place = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(place[::-1])[::-1]  # the next change decides a run
    small = np.append(step[np.minimum(nearest, n - 2)] > 0, True)
    first = np.zeros(n, bool)
    first[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(first)
    if symbols <= len(SYMBOLS):
        induce = lambda order: _induce(t, small, order, symbols)
    else:
        induce = lambda order: _induce_names(t, small, order[np.argsort(t[order], kind="stable")])
    rough = induce(lms)
    found = rough[first[rough]]
    end = np.append(lms[1:] + 1, n)
    prefix = prefix_sums(t, powers) if symbols <= len(SYMBOLS) else _name_sums(t, powers)
    h = range_hash(prefix, lms, end, powers) ^ mix64((end - lms).astype(np.uint64))
    where = np.zeros(n, np.int64)
    where[lms] = np.arange(len(lms))
    own = where[found]
    name = np.cumsum(np.append(0, h[own[1:]] != h[own[:-1]]))
    if name[-1] == len(lms) - 1:
        return induce(found)
    names = np.empty(len(lms), np.int64)
    names[own] = name
    return induce(lms[suffix_array(names, powers)])


def _name_sums(t: np.ndarray, powers: Powers) -> np.ndarray:
    up, _ = powers.of(len(t) + 1)
    out = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(mix64(t.astype(np.uint64) + np.uint64(1)) * up[: len(t)], out=out[1:])
    return out


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The permuted array of common prefixes, and the predecessor of each suffix in the suffix array (-1: none). Where a suffix and its
    predecessor go on to the left with equal symbols, the value is one less than its left neighbour's; the others, whose sum is
    n log n at most, are compared, four symbols at a time."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    before = np.append(-1, t[:-1].astype(np.int64))  # of the first suffix: equal to none
    fresh = (phi < 1) | (before != before[phi])
    fresh[0] = True
    p = np.flatnonzero(fresh)
    q = phi[p]
    held = np.zeros(n + 8, np.uint64)
    held[:n] = t.astype(np.uint64) + np.uint64(1)
    held[n:] = np.arange(2, 10).astype(np.uint64) * np.uint64(4099)  # no symbols
    four = held[:-3] | (held[1:-2] << np.uint64(16)) | (held[2:-1] << np.uint64(32)) | (held[3:] << np.uint64(48))
    length = np.zeros(len(p), np.int64)
    live = np.flatnonzero(q >= 0)
    while len(live):
        differ = four[p[live] + length[live]] ^ four[q[live] + length[live]]
        last = differ != 0
        low = differ[last] & (~differ[last] + np.uint64(1))
        length[live[last]] += np.searchsorted(FOUR, low, "right") - 1
        live = live[~last]
        length[live] += 4
    base = np.zeros(n, np.int64)
    base[p] = np.arange(len(p))
    base = np.maximum.accumulate(base)
    return np.maximum(0, length[base] - (np.arange(n) - p[base])), phi


#: Least bits of the four symbols of a word.
FOUR = np.array([1, 1 << 16, 1 << 32, 1 << 48], np.uint64)


def repeated_starts(contexts: list[np.ndarray], length: int, powers: Powers) -> list[np.ndarray]:
    """For each context of a shard, which of its windows also stand in another one, from the shard's suffix array."""
    t = np.empty(sum(len(c) + 1 for c in contexts) + 1, np.int16)
    at, begins = 0, []
    for c in contexts:
        begins.append(at)
        t[at : at + len(c)] = c.astype(np.int16) + 2
        t[at + len(c)] = 1
        at += len(c) + 1
    t[at] = 0
    same, phi = common_prefixes(t, suffix_array(t, powers))
    whole = np.zeros(len(t), bool)
    for b, c in zip(begins, contexts, strict=True):
        whole[b : b + len(c) - length + 1] = True
    hit = np.zeros(len(t), bool)
    p = np.flatnonzero(whole & (same >= length))
    hit[p] = True
    hit[phi[p]] = True
    return [np.flatnonzero(hit[b : b + len(c) - length + 1]) for b, c in zip(begins, contexts, strict=True)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] != starts[:-1] + 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


RANGES = "_id long, _tag long, _s int, _e int"
PIECES = "_gram long, _once boolean, _wide boolean, _id long, _tag long, _s int, _bytes binary"


def _range_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_id", "_tag", "_s", "_e"])


def _shard_ranges(batches, length: int, shard_bytes: int):
    """Ranges of repeated starts of the contexts found once, from suffix arrays over whole anchors' contexts in sorted batches. A
    context that a repeated row brings again is passed over."""
    powers = Powers()
    held: list[tuple] = []
    size, last = 0, None

    def solve():
        found = repeated_starts([raw for *_, raw in held], length, powers)
        rows = [(i, tag, s + lo, s + hi) for (once, i, tag, s, _), starts in zip(held, found, strict=True) if once for lo, hi in _runs(starts)]
        return _range_batch(rows) if rows else None

    for b in batches:
        data, offsets = text_bytes(b.column("_bytes"))
        keys = zip(*(b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_gram", "_once", "_id", "_tag", "_s")), strict=True)
        for k, (gram, *rest) in enumerate(keys):
            key = (gram, *rest[1:])
            if key == last:
                continue
            if last is not None and gram != last[0] and size >= shard_bytes:
                if (out := solve()) is not None:
                    yield out
                held, size = [], 0
            last = key
            held.append((*rest, data[offsets[k] : offsets[k + 1]]))
            size += int(offsets[k + 1] - offsets[k])
    if held and (out := solve()) is not None:
        yield out


def _window_ranges(wide: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many contexts, by counting window hashes."""

    def run(batches):
        powers = Powers()
        for b in batches:
            data, offsets = text_bytes(b.column("_bytes"))
            for k in range(b.num_rows):
                prefix = prefix_sums(data[offsets[k] : offsets[k + 1]], powers)
                at = np.arange(len(prefix) - length)
                same = pa.array(np.full(len(at), k))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(same) for c in ("_gram", "_once", "_id", "_tag")), pa.array((at + b.column("_s")[k].as_py()).astype(np.int32)), pa.array(range_hash(prefix, at, at + length, powers).view(np.int64))],
                    names=["_gram", "_once", "_id", "_tag", "_s", "_h"],
                )

    windows = wide.mapInArrow(run, "_gram long, _once boolean, _id long, _tag long, _s int, _h long")
    twice = windows.groupBy("_gram", "_h").agg(F.count("*").alias("n")).where("n > 1")
    return windows.where("_once").join(twice, ["_gram", "_h"]).select("_id", "_tag", "_s", F.col("_s").alias("_e"))


def _cut(batches, length: int):
    """The bytes of the contexts that are wanted of rows, in batches of a few MB."""
    want_type = pa.list_(pa.struct([("_gram", pa.int64()), ("_once", pa.bool_()), ("_wide", pa.bool_()), ("_s", pa.int32()), ("_e", pa.int32())]))
    for b in batches:
        data, offsets = text_bytes(b.column("text"))
        want = b.column("want").cast(want_type)
        flat, many = want.flatten(), np.diff(want.offsets.to_numpy())
        row = np.repeat(np.arange(b.num_rows), many)
        first = offsets[row] + flat.field("_s").to_numpy()
        size = flat.field("_e").to_numpy().astype(np.int64) - flat.field("_s").to_numpy() + length
        for lo, hi in slices(np.append(0, np.cumsum(size)), 4 << 20):
            part, n = slice(lo, hi), size[lo:hi]
            ends = np.cumsum(n)
            taken = data[np.arange(ends[-1]) + np.repeat(first[part] - (ends - n), n)]
            raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(taken)])
            at = pa.array(row[part])
            own = [flat.field(c).slice(lo, hi - lo) for c in ("_gram", "_once", "_wide")]
            yield pa.RecordBatch.from_arrays([*own, b.column("_id").take(at), b.column("_tag").take(at), flat.field("_s").slice(lo, hi - lo), raw], names=[x.split()[0] for x in PIECES.split(", ")])


def _bucketed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows written in buckets of their identity, so that joins with them move the other side alone; and the table's name."""
    spark = docs.sparkSession
    buckets = min(50_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"rows_{uuid.uuid4().hex}"
    rows = _rows(docs).repartition(buckets, "_id", "_tag")
    rows.write.bucketBy(buckets, "_id", "_tag").option("path", scratch_path(spark, "rows")).format("parquet").saveAsTable(name)
    return spark.table(name), name


def repeated_ranges(docs: DataFrame, length: int = 200, shard_bytes: int = 1 << 20, wide_bytes: int = 2 << 20, rows: DataFrame | None = None) -> DataFrame:
    """_id, _tag, _ranges: for every document with repeated windows the starts of these, as (first, last) pairs."""
    bound_arrow(docs.sparkSession)
    rows = _rows(docs) if rows is None else rows
    again = materialise(anchors(docs, length, only_grams=True).groupBy("_gram").agg(F.count("*").alias("n")).where("n > 1").select("_gram"), "grams")
    found = materialise(anchors(docs, length).join(again, "_gram"), "anchors")
    one = F.min(F.struct("_id", "_tag", "_s", "_e")).alias("one")
    contexts = materialise(found.groupBy("_gram", "_ctx").agg(F.count("*").alias("n"), one), "contexts")
    full = found.join(contexts.where("n > 1").select("_gram", "_ctx"), ["_gram", "_ctx"], "left_semi").select("_id", "_tag", "_s", "_e")
    per_gram = contexts.groupBy("_gram").agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"), F.sum(F.expr(f"one._e - one._s + {length}")).alias("bytes"))
    per_gram = per_gram.where("once > 0").select("_gram", (F.col("bytes") > wide_bytes).alias("_wide"))
    edges = contexts.join(per_gram, "_gram").select("one.*", "_gram", (F.col("n") == 1).alias("_once"), "_wide")
    wanted = edges.groupBy("_id", "_tag").agg(F.collect_list(F.struct("_gram", "_once", "_wide", "_s", "_e")).alias("want"))
    pieces = rows.select("_id", "_tag", "text").join(wanted.hint("shuffle_hash"), ["_id", "_tag"])
    cuts = materialise(pieces.mapInArrow(lambda it: _cut(it, length), PIECES), "edges")
    shards = cuts.where("NOT _wide").drop("_wide").repartition("_gram").sortWithinPartitions("_gram", "_id", "_tag", "_s")
    parts = shards.mapInArrow(lambda it: _shard_ranges(it, length, shard_bytes), RANGES)
    parts = full.union(parts)
    if cuts.where("_wide").limit(1).count():
        parts = parts.union(_window_ranges(cuts.where("_wide").dropDuplicates(["_id", "_tag", "_s"]).drop("_wide"), length))
    return parts.groupBy("_id", "_tag").agg(F.collect_set(F.struct("_s", "_e")).alias("_ranges"))


def _spans(ranges, length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["_s"], r["_e"]) for r in ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + length)
        else:
            out.append([s, e + length])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, length: int = 200, **more) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document."""
    bound_arrow(docs.sparkSession)
    rows, name = _bucketed(docs)
    ranges = materialise(repeated_ranges(docs, length, rows=rows, **more), "ranges")
    joined = rows.join(ranges.hint("shuffle_hash"), ["_id", "_tag"], "left")
    atexit.register(_forget, docs.sparkSession, name)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches):
        for b in batches:
            out = []
            for doc, text, ranges in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "_ranges")), strict=True):
                raw = text.encode()
                spans, at, kept = _spans(ranges or (), length), 0, []
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
            if out:
                kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.select("doc_id", "text", "_ranges").mapInArrow(run, schema)


def _forget(spark, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended, and its catalogue with it or not; the files go with the scratch folder
        pass
