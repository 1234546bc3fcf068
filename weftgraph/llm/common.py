"""Shared plumbing of the training-data operators: tables, Arrow text buffers, vectorised words."""

from __future__ import annotations

import ctypes
import gc
import inspect
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes; a longer document is a step of its own.
CHUNK = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where the session names none and all runs in one
    process (tests) it is a temporary one; on a cluster a missing name is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="weft-")
    return shared_dir.own


#: Bytes of rows that a Python task is handed at a time in a pipeline.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Has rows handed to Python tasks BATCH_BYTES at a time from now on, unless the session has its own smaller bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def staged(df: DataFrame, label: str, apart: str | None = None) -> DataFrame:
    """df written once to the shared folder and read again, so that lineage ends at a table; rows of each value of the column
    apart in a folder of their own, which may be dropped alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(apart) if apart else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def settled(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps that nothing refers to any more; else they stay on the
    executors' disks until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(*tables: DataFrame, only: str = "") -> None:
    """Deletes staged tables that nothing reads any more, or only a folder of theirs (column=value)."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{df.staged_at}/{only}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _trim() -> Callable[[], None]:
    try:
        trim = ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return pa.default_memory_pool().release_unused
    return lambda: (pa.default_memory_pool().release_unused(), trim(0))


_trimmed = [0.0]


def release(always: bool = False) -> None:
    """Gives memory that a reused Python worker no longer needs back to the system, every now and then."""
    if always or time.monotonic() - _trimmed[0] > 0.5:
        _trim()()
        _trimmed[0] = time.monotonic()


def tidy(f: Callable) -> Callable:
    """f, after which the worker's free memory goes back to the system."""
    if inspect.isgeneratorfunction(f):

        def batches(x):
            try:
                yield from f(x)
            finally:
                release(always=True)

        return batches
    if len(inspect.signature(f).parameters) == 1:

        def one(x):
            try:
                return f(x)
            finally:
                release()

        return one

    def two(x, y):
        try:
            return f(x, y)
        finally:
            release()

    return two


def held_out(doc_id, parts: int):
    """crc32(doc_id as text) mod parts is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 2, F.lit(False))


def task_key() -> int:
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; null reads as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets, data = column.buffers()[1:3]
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about limit bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def slices(batch: pa.RecordBatch, column: int, limit: int = 2 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes of text in a string column, so that few are Python objects at a time."""
    for i, j in chunks(buffers(batch.column(column))[0], limit):
        yield batch.slice(i, j - i)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z only."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        steps = np.full(max(n, CHUNK + (CHUNK >> 2)), base, np.uint64)
        steps[0] = 1
        have = _powers[key] = np.cumprod(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the polynomial hash of any range of data."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes give equal hashes wherever they stand."""
    inv = powers(len(sums), inverse=True)
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a range of documents: hashes, byte ranges, and each document's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.hashes)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_bounds(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words [^\\x20\\x09-\\x0D]+ and each document's first word."""
    n = len(data)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[0] = edge[n] = True
    before = np.concatenate(([False], solid[:-1])) if n else solid
    after = np.concatenate((solid[1:], [False])) if n else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(off: np.ndarray, data: np.ndarray) -> Words:
    starts, ends, first = word_bounds(off, data)
    return Words(range_hashes(prefix_sums(data), starts, ends), starts, ends, first)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's word shingles, in order, and each document's first one.
    A document with fewer words has its whole sequence as one; one without words has none."""
    n = np.diff(w.first)
    h = w.hashes
    count = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    first = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(n)), count)
    at = w.first[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]
    short = n[doc] < size
    out = np.zeros(first[-1], np.uint64)
    for k in range(size):
        use = ~short | (k < n[doc])
        val = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else out
        out = np.where(use, mix(out * np.uint64(0xD6E8FEB86659FD93) + val), out)
    return out, first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values, ascending, and each document's first one."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[new], d[new]
    return v, np.searchsorted(d, np.arange(len(first)))


def binary_lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The slices values[first[i]:first[i+1]] as one binary column."""
    raw = np.ascontiguousarray(values)
    off = (np.asarray(first, np.int64) - int(first[0]) if len(first) else np.zeros(1, np.int64)) * raw.itemsize
    lo, hi = (int(first[0]), int(first[-1])) if len(first) else (0, 0)
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(raw[lo:hi].tobytes())]).cast(pa.binary())


def joined(column: pa.Array | pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column end to end, and each row's number of values."""
    parts = [x.as_py() or b"" for x in column]
    sizes = np.array([len(x) for x in parts], np.int64) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(parts), dtype), sizes


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: small ones take little room in a shuffle."""
    raw = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T).tobytes())


def unpacked(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def packed_rising(values: np.ndarray) -> bytes:
    """Ascending numbers, as their compressed differences."""
    values = values.astype(np.uint64, copy=False)
    return packed(np.diff(values, prepend=np.uint64(0)))


def unpacked_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


def packed_strings(values: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(values), *map(len, values)], "<u4").tobytes() + b"".join(values))


def unpacked_strings(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 * (n + 1)
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist())]
