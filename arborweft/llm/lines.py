"""Line dedup by range partitions of line hashes.

Lines become (128-bit key hash, document, position); these are partitioned by range of (hash, document), so even a line that
a third of all documents hold is spread over several partitions while a document's copies of it stay together, and sorted
by (hash, document, position) inside each. One pass over a partition sees every hash as a run: its documents, and its first
occurrence. What crosses partitions is one summary for each run. The result is a bitmap of kept lines for each document,
packed and deflated; text never takes part in the exchange of lines.

Defined cases: null or empty text is one empty line; a key shorter than ``min_chars`` is never dropped; repeated rows of one
doc_id count as one document, and each row gets its own bitmap; rows without doc_id are one document; very long texts have a bit for each
line; of equal lines the first by (doc_id, text hash, position) is the first; an empty table gives no rows; extra columns, whatever their
names, are ignored by ``line_digests`` and kept by ``apply_bitmaps``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from arborweft.llm.common import LOWER, SPACE, UPPER, bound_arrow, join_sized, materialise

RUNS = "_h1 long, _h2 long, n_docs long, first_doc long, first_row long, first_pos int"


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """_doc, _row (hash of the row's text), _pos and the two halves of the key's hash, for keys long enough."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        F.col("doc_id").alias("_doc"), F.xxhash64(text).alias("_row"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line")
    )
    key = F.translate(F.btrim("_line", F.lit(SPACE)), UPPER, LOWER)
    lines = lines.select("_doc", "_row", "_pos", key.alias("_key")).where(F.length("_key") >= min_chars)
    return lines.select("_doc", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))


def _runs(batches):
    """Summaries of the runs of equal hashes in sorted batches; a run may go on in the next batch."""
    held = None
    out: list[tuple] = []
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, row, pos = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_h1", "_h2", "_row", "_pos"))
        column = b.column("_doc")
        none = column.is_null().to_numpy(zero_copy_only=False)
        doc = column.fill_null(0).to_numpy(zero_copy_only=False)
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        other = new.copy()
        other[1:] |= (doc[1:] != doc[:-1]) | (none[1:] != none[:-1])
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(other.astype(np.int64), starts)
        last = len(h1) - 1
        for k, s in enumerate(starts.tolist()):
            n = int(counts[k])
            if held and k == 0 and held[0] == h1[s] and held[1] == h2[s]:
                held[2] += n - (held[6] == (doc[0], none[0]))
            else:
                if held:
                    out.append(tuple(held[:6]))
                held = [int(h1[s]), int(h2[s]), n, None if none[s] else int(doc[s]), int(row[s]), int(pos[s]), None]
        held[6] = (doc[last], none[last])
        if len(out) >= 50_000:
            yield _run_batch(out)
            out = []
    if held:
        out.append(tuple(held[:6]))
    if out:
        yield _run_batch(out)


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32()]
    names = [x.split()[0] for x in RUNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _pack(positions, n_lines: int) -> bytes:
    """Deflated bitmap of kept lines, one bit for each, highest bit first."""
    bits = np.ones(-(-n_lines // 8) * 8, np.uint8)  # what no bit stands for is kept
    bits[positions] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which lines a bitmap keeps; no bitmap keeps all."""
    if bitmap is None:
        return np.ones(n_lines, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)


def _bitmaps(batches):
    for b in batches:
        drops, sizes = b.column("_drops").to_pylist(), b.column("_n").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("_doc"), b.column("_row"), pa.array([_pack(d, n) for d, n in zip(drops, sizes, strict=True)], pa.binary())],
            names=["_doc", "_row", "bitmap"],
        )


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first") -> DataFrame:
    """_doc, _row, bitmap of every document that loses lines. keep='first' leaves the first occurrence, in order of
    (doc_id, text hash, position), of each key found in min_docs documents or more; keep='none' leaves none."""
    bound_arrow(docs.sparkSession)
    keys = materialise(line_keys(docs, min_chars), "line-keys")
    ordered = keys.repartitionByRange("_h1", "_h2", "_doc").sortWithinPartitions("_h1", "_h2", "_doc", "_row", "_pos")
    runs = ordered.mapInArrow(_runs, RUNS)
    first = F.min(F.struct("first_doc", "first_row", "first_pos")).alias("first")
    common = runs.groupBy("_h1", "_h2").agg(F.sum("n_docs").alias("n_docs"), first).where(F.col("n_docs") >= min_docs)
    # written first, so that the join has exchanges of its own, which a hot line's rows can be split in
    drops = join_sized(keys, materialise(common, "common-lines"), ["_h1", "_h2"], "inner", 48)
    if keep == "first":
        here = F.struct(F.col("_doc"), F.col("_row"), F.col("_pos"))
        drops = drops.where(here != F.struct(F.col("first.first_doc"), F.col("first.first_row"), F.col("first.first_pos")))
    dropped = drops.groupBy("_doc", "_row").agg(F.collect_set("_pos").alias("_drops"), (F.max("_pos") + 1).alias("_n"))
    return dropped.mapInArrow(_bitmaps, "_doc long, _row long, bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """_document (all columns of docs in one), text and _bitmap (null: keeps all) of every row."""
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_document"), "text", F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_hash")
    )
    on = F.col("_id").eqNullSafe(bitmaps["_doc"]) & (F.col("_hash") == bitmaps["_row"])
    return packed.join(bitmaps, on, "left").select("_document", "text", F.col("bitmap").alias("_bitmap"))


def _kept(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), 0, text or ""
    bits = unpack(bitmap, len(lines))
    bits = np.concatenate([bits, np.ones(len(lines) - len(bits), bool)])  # bitmaps end with the last dropped line
    left = [x for x, k in zip(lines, bits.tolist(), strict=True) if k]
    return len(lines), len(lines) - len(left), "\n".join(left)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the kept lines as text, and two further columns, _n_lines and _n_dropped; a column that is called so already stays, and
    the new one gets one more underscore."""
    joined = with_bitmaps(docs, bitmaps).select("_document", "text", "_bitmap")
    schema = StructType([joined.schema["_document"], *StructType.fromDDL("_kept string, _lines long, _dropped long").fields])

    def run(batches):
        for b in batches:
            rows = [_kept(t.as_py(), m.as_py()) for t, m in zip(b.column("text"), b.column("_bitmap"), strict=True)]
            made = [pa.array([r[2] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([b.column("_document"), *made], names=["_document", "_kept", "_lines", "_dropped"])

    out = joined.mapInArrow(run, schema)
    own = [F.col("_kept").alias(c) if c == "text" else F.col("_document")[c].alias(c) for c in docs.columns]
    return out.select(*own, *(F.col(c).alias(_free(n, docs.columns)) for c, n in (("_lines", "_n_lines"), ("_dropped", "_n_dropped"))))


def line_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and the bitmap of every document."""

    def run(batches):
        for b in batches:
            rows = []
            for t, m in zip(b.column("text"), b.column("_bitmap"), strict=True):
                n, dropped, left = _kept(t.as_py(), m.as_py())
                rows.append((n, dropped, hashlib.sha256(left.encode()).hexdigest()))
            sha = pa.array([r[2] for r in rows], pa.string())
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, sha, b.column("_bitmap")], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_bitmap"])

    joined = with_bitmaps(docs.select("doc_id", "text"), bitmaps)
    schema = StructType.fromDDL("doc_id long, n_lines long, n_dropped long, kept_sha256 string").add(StructField("keep_bitmap", BinaryType()))
    return joined.select(F.col("_document")["doc_id"].cast("long").alias("doc_id"), "text", "_bitmap").mapInArrow(run, schema)
