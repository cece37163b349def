"""Shared folder, input tables and vectorised word hashes."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

GAMMA = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spare(columns: list[str], base: str) -> str:
    """A name that none of the columns has, in small or capital letters."""
    taken, name = {c.lower() for c in columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str], list[str]]:
    """The rows with columns named c0, c1, ..., these names, and those of the wanted columns.

    Operators work on such rows, so that no column of the caller has a name of theirs.
    """
    names = [f"c{k}" for k in range(len(df.columns))]
    at = {c.lower(): n for c, n in zip(df.columns, names)}
    return df.toDF(*names), names, [at[c.lower()] for c in wanted]


def scratch(spark: SparkSession, name: str) -> str:
    """New folder below spark.checkpoint.dir (below the warehouse where that is unset); removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder is left to its owner
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps that are done, which it does when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# one random 64-bit value per byte; A-Z share the values of a-z
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * GAMMA)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x5851F42D4C957F2D
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            grown, step = np.ones(1, dtype=np.uint64), base
            while len(grown) < size:
                grown = np.concatenate([grown, grown * np.uint64(step)])
                step = step * step % (1 << 64)
            _POWERS[k] = grown
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, outside: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of each word ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) of UTF-8 bytes; `outside` marks other bytes that part words."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = np.concatenate([[False], ~outside[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up, dtype=np.uint64)])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * GAMMA), starts


_WEIGHT = mix64(np.arange(11, 11 + 64, dtype=np.uint64) * GAMMA) | np.uint64(1)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each run of `size` words in order; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total = total + words[k : k + n] * _WEIGHT[k]
    return mix64(total)


def text_bytes(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of each value as views into the Arrow buffer; null is empty."""
    column = column.cast(pa.large_string())
    if not len(column):
        return []
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [data[a:b] if ok else data[:0] for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]
