"""Arrow text columns as byte arrays, rolling hashes over them, and packed rows between stages.

Everything here works inside tasks: Spark partitions and shuffles, these helpers turn one
Arrow batch into numpy arrays. Rows travel between stages as blobs of many entries, because a
shuffled row of a few bytes costs several times its content.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.session import shared_folder

CHUNK = 1 << 20  # bytes of text that are hashed at a time; one longer text is a chunk of its own

_ONE = np.uint64(1)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Tasks a shuffle is dealt to: the session's setting, which grows with the cluster and the data.

    Also lets Python workers on the driver's machine find this package when it was not installed."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and lost executors lose nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, n: int, key: str = "part") -> DataFrame:
    """One task for each number in `key`, which must be below n."""
    return df.repartitionById(n, F.col(key).cast("int"))


def part_of(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(n)).cast("int")


def part_of_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """`part_of` for an array of longs, with Spark's xxhash64 (seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    v = np.asarray(ids, np.int64).view(np.uint64)
    h = np.full(len(v), 42 + 8, np.uint64) + p5
    h = turn(h ^ (turn(v * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    return np.mod(h.view(np.int64), n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]
_BASE = 0xD6E8FEB86659FD93
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + CHUNK // 4)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


class Rolling:
    """Hashes of any spans of a byte array, equal for equal bytes (A-Z taken as a-z if asked)."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        up, self._down = _grown(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER_BYTE if lower else _BYTE)[data] * up[: len(data)], out=self._sums[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self._sums[stop] - self._sums[start]) * self._down[start] + (stop - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        n = len(self._sums) - size
        return mix((self._sums[size:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts (nulls: empty)."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(at, wide, len(column) + 1, column.offset * wide().itemsize).astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[ends[0] : ends[-1]], ends - ends[0]


def chunks(batches, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about `limit` bytes of text: rows, bytes, row starts."""
    for batch in batches:
        data, ends = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start), data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
            start = stop


_DELIMITER = np.ones(256, bool)
_DELIMITER[[0x20, *range(0x09, 0x0E)]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(data: np.ndarray, ends: np.ndarray, alphanumeric: bool = False):
    """Start and stop of every word, and each row's first word (one more entry than rows).

    Words are runs of bytes other than the six ASCII blanks, or runs of ASCII letters, digits
    and non-ASCII bytes; they never cross rows."""
    inside = (_LETTER if alphanumeric else _DELIMITER)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    start = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = inside[1:]
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, stop, np.searchsorted(start, ends)


def shingles(word: np.ndarray, width: int) -> np.ndarray:
    """Hashes of `width` consecutive words, from the words' hashes."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix(out ^ word[i : i + n])
    return out


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    return np.arange(total) - np.repeat(first, count) + np.repeat(start, count)


def bundles(part: np.ndarray, entries: np.ndarray, n: int) -> tuple[list[int], list[bytes]]:
    """Structured entries by part: part numbers and one blob for each."""
    order = np.argsort(part, kind="stable")
    entries, cuts = entries[order], np.searchsorted(part[order], np.arange(n + 1))
    full = np.flatnonzero(np.diff(cuts))
    return full.tolist(), [entries[cuts[i] : cuts[i + 1]].tobytes() for i in full]


def unbundled(blobs, kind: np.dtype) -> np.ndarray:
    held = [np.frombuffer(b, kind) for b in blobs if b]
    return np.concatenate(held) if held else np.zeros(0, kind)


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in arrays sorted by `keys`."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
