"""Helpers of the training-data operators: shared scratch tables, Arrow batch sizes, numpy views of text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows handed to a Python worker at once.
BATCH_BYTES = 4 << 20
#: Bytes of text that numpy code works on at once; a longer text is a piece of its own.
WORK_BYTES = 1 << 20


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session without a cluster may leave it unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


#: Tables stored by this driver and not dropped yet.
_STORED: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, before: int = 0, but: DataFrame | None = None) -> None:
    """Delete the tables stored since `before` (a value of stored_count), but for those that `but` reads.

    What still reads them can't be computed any more, so this is for callers that have stored a result.
    """
    kept = [] if but is None else but.inputFiles()
    jvm = spark._jvm
    for path in _STORED[before:]:
        if any(path.rsplit("/", 1)[1] in f for f in kept):
            continue
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _STORED.remove(path)


def stored_count() -> int:
    """How many tables are stored now, for drop_stored."""
    return len(_STORED)


def batches_of(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Lower the session's bound on the bytes of an Arrow batch, so that batches of long texts stay small; never raises it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0, one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(column) else 0)


def parts(offsets: np.ndarray, most: int = WORK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes each (one row at least)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; between them Arrow's allocator returns what it holds unused, so that workers stay small."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1024), base, np.uint64)
        out[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and the range of words of each row."""
    n = len(data)
    solid = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    after[last] = False
    ends = np.flatnonzero(solid & ~after) + 1
    lens = ends - starts
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    which = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(which, lens)
    values = (_LOWER[data[solid]].astype(np.uint64) + np.uint64(1)) * powers(0x9E3779B97F4A7C15, int(lens.max()))[at]
    return mixed(np.add.reduceat(values, which) + lens.astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of `size` words; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    out = words[: n - size + 1].copy()
    for k in range(1, size):
        out = mixed(out * np.uint64(0xD1342543DE82EF95) + words[k : n - size + 1 + k])
    return np.unique(out)


_ALNUM = np.arange(256) >= 128
_ALNUM[48:58] = _ALNUM[97:123] = True


def word_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of each row, A-Z lower-cased before.

    Gives the words' bytes without what lies between, the offsets of the words in them (one more than words), and the
    range of words of each row (one more than rows). A word never crosses rows.
    """
    low = _LOWER[data]
    solid = _ALNUM[low]
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    fresh[first] = solid[first]
    starts = np.flatnonzero(fresh)
    flat = low[solid]
    at = np.empty(len(starts) + 1, np.int64)
    at[:-1] = np.flatnonzero(fresh[solid])
    at[-1] = len(flat)
    return flat, at, np.searchsorted(starts, offsets)


def slice_hashes(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices flat[at[i]:at[i + 1]], none of them empty."""
    if len(at) < 2:
        return np.zeros(0, np.uint64)
    lens = np.diff(at)
    inside = np.arange(len(flat)) - np.repeat(at[:-1], lens)
    values = (flat.astype(np.uint64) + np.uint64(1)) * powers(0x9E3779B97F4A7C15, int(lens.max()))[inside]
    return mixed(np.add.reduceat(values, at[:-1]) + lens.astype(np.uint64))
