"""What the operators share: scratch tables in the shared folder, Arrow buffers, 64-bit mixing."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word and line contract: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only a local master, whose executors are this machine, gets one of its own where
    spark.checkpoint.dir is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    os.makedirs("/tmp/checkpoints", exist_ok=True)
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(dir="/tmp/checkpoints"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path with the file system that holds it."""
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended; its owner clears the folder
        pass


_open: list[list[str]] = []


@contextlib.contextmanager
def scratch_tables(spark: SparkSession):
    """Scratch tables made inside go when the block ends: results have to be written before. Without it they go when the driver ends."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _at_exit(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the block of scratch_tables, or else the driver, ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    else:
        atexit.register(_at_exit, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it again: lineage ends here, and losing executors costs
    no more than the tasks they ran."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the offsets of its rows. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int):
    """Row ranges of at most so many bytes, or of one row that has more."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Base of range hashes, and a random value for each symbol.
BASE = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = mix64(np.arange(1, 260, dtype=np.uint64))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as asked for."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, None, None

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.n = max(n, 1 << 16)
            for name, b in (("up", BASE), ("down", inverse)):
                x = np.full(self.n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


def prefix_sums(symbols: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums whose differences, scaled, are hashes of ranges."""
    up, _ = powers.of(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(SYMBOLS[symbols] * up[: len(symbols)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    return mix64((prefix[end] - prefix[begin]) * powers.down[begin])


def trimmed(text):
    """The text without the contracts' white space at its ends; null is empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))


def words_of(text):
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; [''] where it has none."""
    return F.split(trimmed(text), r"[ \t-\r]+")


#: A side of a join is broadcast up to so many bytes, by count of its written rows; beyond, both sides are exchanged.
BROADCAST_BYTES = 32 << 20


def join_sized(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int = 64, most: int | None = None) -> DataFrame:
    """big joined with a written table, which is broadcast only if its rows prove small."""
    if small.count() * row_bytes <= (BROADCAST_BYTES if most is None else most):
        small = F.broadcast(small)
    return big.join(small, on, how)


def bound_arrow(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that a Python worker holds little text at once; a setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (spark.conf.get(key) or "").lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(key, "4m")
