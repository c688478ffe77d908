"""Benchmark decontamination by the q-gram lemma.

Texts are compared as bytes with letters lower-cased and runs of white space and punctuation as one space. A benchmark item is
cut into overlapping segments; two strings of length m within k edits share at least m + 1 - q (k + 1) q-grams, and all of
those lie in a band of diagonals k wide. So every document's q-grams are looked up in the benchmark's, the hits of each
segment are counted in bands that overlap by half, and only regions that reach the lemma's bound are aligned, in a band,
for the exact number of edits. Documents are read once, in place; nothing is exchanged.

Items are searched as a whole or by segments of 128 bytes, then, where a document has no match of an item, by parts of 64 bytes that begin
every 16 bytes, under the same rate of edits. So of items above 64 bytes every verbatim part of 69 normalised bytes or more is found: at most
5 bytes of some part stick out of it. Items up to 64 bytes are found as a whole, within the rate.

The benchmark is the query set: it is broadcast in blocks, one pass over the documents each. Parts and segments together are some six
times a block's texts, so a block is cut to a third of ``block_bytes``: at 4 MB an index has about 8 million q-grams, 160 MB.

Defined cases: null or empty texts match nothing; very long texts are searched whole; items without id, or without q bytes after normalising,
are no queries; of a tie between matches of an item the first in the text is reported; repeated rows give a result row each, whatever their
doc_id; an empty benchmark leaves everything clean; columns of the documents other than these two are ignored by ``find_leaks`` and kept
by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweft.llm.common import bound_arrow, mix64, slices, text_bytes

Q, SEGMENT, STRIDE, BAND = 10, 128, 64, 16
PART, STEP = 64, 16
POSTINGS = 1 << 22
FOUND = "doc_id long, item_id long, start_byte long, end_byte long, edits int"


def _fold_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 32
    return table


FOLD = _fold_table()


def _normal(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, the place of each in raw, and the offsets of the rows."""
    b = FOLD[raw]
    blank = b == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of a run
    first = offsets[:-1][offsets[:-1] < len(raw)]
    keep[first] = True
    at = np.flatnonzero(keep)
    return b[at], at, np.searchsorted(at, offsets)


def _grams(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all Q-grams."""
    if len(b) < Q:
        return np.zeros(0, np.uint64)
    two = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << 8)
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << 16)
    eight = four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))
    return mix64(eight[: len(b) - Q + 1] * np.uint64(0x9E3779B97F4A7C15) + two[8 : len(b) - 1].astype(np.uint64))


@dataclass
class Index:
    """Segments of the benchmark and the postings of their q-grams; from number ``parts`` on they are the short ones."""

    keys: np.ndarray
    starts: np.ndarray
    segment: np.ndarray
    place: np.ndarray
    bits: np.ndarray
    text: list[np.ndarray]
    item: list[int]
    edits: np.ndarray
    bound: np.ndarray
    parts: int


def build_index(items: list[tuple[int, str | None]], rate: float) -> Index:
    texts, owner, parts, part_owner = [], [], [], []
    for number, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        b = _normal(raw, np.array([0, len(raw)]))[0] if len(raw) else raw
        while len(b) and b[-1] == 32:
            b = b[:-1]
        while len(b) and b[0] == 32:
            b = b[1:]
        if len(b) < Q:
            continue
        cuts = [(0, len(b))] if len(b) <= SEGMENT + STRIDE // 2 else [(s, s + SEGMENT) for s in [*range(0, len(b) - SEGMENT, STRIDE), len(b) - SEGMENT]]
        for s, e in cuts:
            texts.append(b[s:e])
            owner.append(number)
        if len(b) > PART:
            for s in [*range(0, len(b) - PART, STEP), len(b) - PART]:
                parts.append(b[s : s + PART])
                part_owner.append(number)
    first = len(texts)
    texts, owner = texts + parts, owner + part_owner
    m = np.array([len(t) for t in texts], np.int64)
    k = np.maximum(0, np.minimum((m * rate).astype(np.int64), (m + 1 - Q // 2) // Q - 1)) if len(m) else m
    grams = [_grams(t) for t in texts]
    flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    seg = np.repeat(np.arange(len(texts), dtype=np.int32), [len(g) for g in grams]) if grams else np.zeros(0, np.int32)
    place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
    order = np.argsort(flat, kind="stable")
    keys, starts = np.unique(flat[order], return_index=True)
    bits = np.zeros(1 << 20, bool)
    bits[keys >> np.uint64(44)] = True
    return Index(keys, np.append(starts, len(flat)).astype(np.int32), seg[order], place[order], bits, texts, owner, k, m + 1 - Q * (k + 1), first)


def _align(ix: Index, seg: np.ndarray, begin: np.ndarray, text: np.ndarray, least: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits, start and end (in text) of the best banded alignment of each segment with text[begin:], free at both ends;
    what lies outside least..stop equals nothing."""
    width = 2 * BAND + 2 * int(ix.edits[seg].max()) + 1
    lengths = np.array([len(ix.text[s]) for s in seg])
    longest = int(lengths.max())
    query = np.zeros((len(seg), longest), np.uint8)
    for r, s in enumerate(seg):
        query[r, : lengths[r]] = ix.text[s]
    span = begin[:, None] + np.arange(longest + width)[None, :]
    inside = (span >= least[:, None]) & (span < stop[:, None])
    window = np.where(inside, text[np.clip(span, 0, max(0, len(text) - 1))], 0)
    step = 1 << 20  # value: edits * step + start
    along = np.arange(width, dtype=np.int64) * step
    row = np.broadcast_to(np.arange(width, dtype=np.int64), (len(seg), width)).copy()
    best = np.full(len(seg), step * step, np.int64)
    last = np.zeros(len(seg), np.int64)
    for i in range(longest):
        miss = np.where(window[:, i : i + width] == query[:, i : i + 1], 0, step)
        up = np.full_like(row, step * step)
        up[:, :-1] = row[:, 1:] + step
        row = np.minimum(row + miss, up)
        row = np.minimum.accumulate(row - along, axis=1) + along
        done = np.flatnonzero(lengths == i + 1)
        if len(done):
            o = row[done].argmin(axis=1)
            best[done], last[done] = row[done, o], i + 1 + o
    return best // step, begin + best % step, begin + last


def _search(ix: Index, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of what the rows of one buffer share with the benchmark."""
    b, at, rows = _normal(raw, offsets)
    h = _grams(b)
    if not len(h) or not len(ix.keys):
        return []
    hit = np.flatnonzero(ix.bits[h >> np.uint64(44)])
    j = np.minimum(np.searchsorted(ix.keys, h[hit]), len(ix.keys) - 1)
    real = ix.keys[j] == h[hit]
    hit, j = hit[real], j[real]
    row = np.searchsorted(rows, hit, "right") - 1
    real = hit + Q <= rows[row + 1]
    hit, j, row = hit[real], j[real], row[real]
    # rows are counted in groups of about so many postings, as common q-grams of a large benchmark have many
    last = np.searchsorted(row, np.arange(len(rows) - 1), "right")
    done = np.append(0, np.cumsum(ix.starts[j + 1] - ix.starts[j], dtype=np.int64))[last]
    found, first = [], 0
    while first < len(done):
        before = done[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(done, before + POSTINGS, "right")))
        part = slice(int(last[first - 1]) if first else 0, int(last[stop - 1]))
        found.append(_full_bands(ix, hit[part], j[part], row[part], rows))
        first = stop
    bands, own, which = (np.concatenate(x) for x in zip(*found, strict=True))
    short = which >= ix.parts
    out = _matches(ix, bands[~short], own[~short], which[~short], b, at, rows)
    bands, own, which = bands[short], own[short], which[short]
    have = {(r, item) for r, item, *_ in out}
    new = np.array([(int(r), ix.item[s]) not in have for r, s in zip(own, which, strict=True)], bool)
    return out + _matches(ix, bands[new], own[new], which[new], b, at, rows)


def _full_bands(ix: Index, hit: np.ndarray, j: np.ndarray, row: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band, row and segment of the regions with as many shared q-grams as the lemma asks for."""
    many = ix.starts[j + 1] - ix.starts[j]
    again = np.repeat(np.arange(len(hit)), many)
    post = np.arange(len(again)) - np.repeat(np.cumsum(many, dtype=np.int64) - many, many) + ix.starts[j][again]
    seg = ix.segment[post]
    diagonal = hit[again] - rows[row[again]] - ix.place[post] + (SEGMENT + STRIDE)
    # numbers of the (row, segment) pairs that meet: fewer than hits, so a number and a band always fit into 64 bits
    pairs, pair = np.unique(row[again] * len(ix.text) + seg, return_inverse=True)
    band = (pair.astype(np.int64) << 32) + diagonal // BAND
    bands, counts = np.unique(np.concatenate([band, band - 1]), return_counts=True)
    own, which = np.divmod(pairs[bands >> 32], len(ix.text))
    full = counts >= ix.bound[which]
    return (bands & 0xFFFFFFFF)[full], own[full], which[full]


def _matches(ix: Index, bands: np.ndarray, rows_of: np.ndarray, which: np.ndarray, b: np.ndarray, at: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """What of the regions that reach the bound is within the edits of its segment."""
    out = []
    for k in range(0, len(bands), 256):
        s, own = which[k : k + 256], rows_of[k : k + 256]
        begin = bands[k : k + 256] * BAND - (SEGMENT + STRIDE) - ix.edits[s] + rows[own]
        edits, start, end = _align(ix, s, begin, b, rows[own], rows[own + 1])
        start = np.maximum(start, rows[own])
        for r in np.flatnonzero(edits <= ix.edits[s]):
            end_at = min(int(end[r]), int(rows[own[r] + 1]))
            out.append((int(own[r]), ix.item[s[r]], int(at[min(start[r], len(at) - 1)]), int(at[max(0, end_at - 1)]) + 1, int(edits[r])))
    return out


def _scan(ix: Index, column: pa.Array, most: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(row, item) -> (edits, start byte, end byte) of the best match in a column of texts."""
    data, offsets = text_bytes(column)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for first, last in slices(offsets, most):
        own = offsets[first : last + 1] - offsets[first]
        for r, item, s, e, k in _search(ix, data[offsets[first] : offsets[last]], own):
            got, key = (k, s - int(own[r]), e - int(own[r])), (first + r, item)
            best[key] = min(best.get(key, got), got)
    return best


def _blocks(benchmark: DataFrame, rate: float, block_bytes: int):
    """Indexes of the query set, each of items of at most so many bytes, as broadcast values."""
    spark = benchmark.sparkSession
    bound_arrow(spark)
    sized = benchmark.select("item_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    blocks = max(1, -(-3 * (sized.agg(F.sum("n")).collect()[0][0] or 0) // block_bytes))  # parts make three times the q-grams of segments alone
    for k in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").collect()
        yield spark.sparkContext.broadcast(build_index(sorted(tuple(r) for r in rows if r[0] is not None), rate))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.09, block_bytes: int = 4 << 20, slice_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, item_id, start_byte, end_byte, edits: the best match of every item a document holds a segment of."""

    def of(shared):
        def run(batches):
            for b in batches:
                best = sorted(_scan(shared.value, b.column("text"), slice_bytes).items())
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[r], item, s, e, k) for (r, item), (k, s, e) in best]
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)

    out = None
    for shared in _blocks(benchmark, rate, block_bytes):
        out = of(shared) if out is None else out.unionByName(of(shared))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.09, block_bytes: int = 4 << 20, slice_bytes: int = 2 << 20) -> DataFrame:
    """The documents that hold no segment of any item, all columns as they were."""
    for shared in _blocks(benchmark, rate, block_bytes):

        def run(batches, shared=shared):
            for b in batches:
                bad = {r for r, _ in _scan(shared.value, b.column("text"), slice_bytes)}
                yield b.filter(pa.array([r not in bad for r in range(b.num_rows)], pa.bool_())) if bad else b

        docs = docs.mapInArrow(run, docs.schema)
    return docs
