"""Helpers that the operators of this subpackage share.

Texts are handled as whole Arrow buffers: words are found and hashed with
array operations over slices of a bounded number of bytes, so neither a long
text nor a large batch makes a Python object per word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18
#: Bytes of rows that go to a worker at a time, where the session keeps Spark's own 64 MB.
BATCH_BYTES, _SPARKS_OWN = 16 << 20, 64 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's reader alone. Rows go to workers in
    batches of BATCH_BYTES from then on: a batch is held by Spark and by the
    worker, along with what is made of it."""
    if spark.conf.get(_BATCH).rstrip("b") == str(_SPARKS_OWN):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session on one machine (local, as in tests) may leave it unset: a
    temporary folder is made then, and set for the session. On a cluster that
    would be another disk on every executor, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="noteloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later stages read the files, so
    the lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_.scratch_path = path
    return table_


def dropped(*tables: DataFrame) -> None:
    """Delete the files of written() tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot that holds over one HOT_SHARE-th of all rows: there are fewer than HOT_SHARE.
HOT_SHARE = 1000
LEAST_HOT = 100


def joined_by_key(rows: DataFrame, key: str, found: DataFrame, named: str, n: str, total: int) -> DataFrame:
    """rows inner-joined with found, which has one row for each value `named`
    of the key and, as column n, how many of the `total` rows meet it.

    Hot keys are broadcast, fewer than HOT_SHARE (or total / LEAST_HOT) of
    them; the other rows are shuffled, and their groups are small.
    """
    hot = F.col(n) > max(LEAST_HOT, total // HOT_SHARE)
    by_hot = rows.join(F.broadcast(found.where(hot)), F.col(key) == F.col(named), "left")
    met = by_hot.where(F.col(named).isNotNull())
    others = by_hot.where(F.col(named).isNull()).select(*rows.columns)
    return met.unionByName(others.join(found.where(~hot), F.col(key) == F.col(named)))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, sorted (np.unique hashes, which takes far longer)."""
    values = np.sort(values)
    keep = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of values are in some, a sorted array."""
    if not len(some):
        return np.zeros(len(values), dtype=bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def freed() -> None:
    """Give memory that is no longer in use back to the system: a worker lives
    on after its task, next to those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        found = []
        for b in (self.base, self.inverse):
            steps = np.full(n, b, dtype=np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps, dtype=np.uint64))
        if n <= 2 * SLICE_BYTES:  # those of a very long text are not kept
            self.up, self.down = found
        return found[0], found[1]


_BYTES = Powers(_BASE)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of values[s:e] for each span, from one prefix sum."""
    up, down = powers.upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=prefix[1:])
    got = (prefix[ends] - prefix[starts]) * down[starts]
    return mix64(got + (ends - starts).astype(np.uint64) * _GOLD)


class Texts:
    """A run of texts: bytes, and for its words first byte, end and hash.

    Words are the longest runs without the six ASCII space characters.
    first[i] is the number of words before text i (one entry more than texts).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        gap = np.ones(len(data) + 2, dtype=bool)
        gap[1:-1] = _SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        inside = ~gap[1:-1]
        self.starts = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = spans_hash(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, _BYTES)
        return self._hashes


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return held, at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int, Texts]]:
    """(from, to, texts) for runs of at most `rows` rows and about `most` bytes; a longer
    text is a run of its own."""
    data, offsets = text_buffers(column)
    i = 0
    while i < len(column):
        j = max(i + 1, min(i + rows, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j, Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
