"""Vector code compression: product-quantised codes whose codebooks are trained by heap Lloyd.

A vector's components become the integers ``floor(256 * x)`` and are cut into ``parts`` equal runs. Each part position has a codebook of
at most 64 entries, which starts as that part of the rows with the smallest ids. A round assigns every part to its nearest entry and moves
the entries to ``floor(sum / count)``; all sums are integers, so that results do not depend on how rows are dealt to tasks.

Rows lie in blocks, one row of a written table each, together with what Lloyd's rounds carry on: every part's entry and, for every entry, a
heap of its parts. A heap's key is a part's slack (a lower bound on the distance to every other entry minus an upper bound on the distance to its own)
plus the drift that the entry had already seen. When entries move, an entry's cumulative drift grows by its own movement and the largest other one.
A round pops only parts whose key no longer exceeds that drift, measures them exactly against all entries, and pushes them again. Keys are
rounded down and drifts up, so that a part left alone has a strictly nearest entry. Only changes of sums and counts leave a block.

Defined results: a row whose vector is null, or holds a null, NaN or infinity, is dropped; so is one with an empty vector. Rows with a null
id are coded, but start no codebook while others are there (nulls sort last); rows of equal id are ordered by their components. With fewer than 64 rows a codebook
has as many entries as there are rows. Vectors of differing lengths, of a length that is no multiple of ``parts``, or with
a component of ``MOST`` or more are refused by a ValueError. Null labels are one label. Other columns are dropped, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, packed, staged, tidy, unpacked

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block; a heap item's low ROW_BITS are its row, the rest its key in units of 2 ** -KEY_BITS.
BLOCK, ROW_BITS, KEY_BITS = 8192, 13, 10
#: Components from here on could overflow a long sum of squares.
MOST = 1 << 16
#: Labels up to which their sums are broadcast; more are joined by a shuffle over SALTS parts a label.
MOST_LABELS, SALTS = 100_000, 32

BLOCKS = "ids binary, no_id binary, labels binary, no_label binary, vectors binary, codes binary, heaps binary, sizes binary, sums binary, moved boolean"
OUT = "vec_id long, code string, error long, label long"


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to entries of integers."""
    x, entries = x.astype(np.int64), entries.astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        step = x[:, k, None] - entries[None, :, k]
        out += step * step
    return out


def slack(d2: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Distance to the second nearest entry minus that to the nearest, in units of 2 ** -KEY_BITS, rounded down."""
    rows = np.arange(len(d2))
    own = np.sqrt(d2[rows, best].astype(np.float64))
    if d2.shape[1] == 1:
        return np.full(len(d2), 1 << 48, np.int64)
    rest = d2.copy()
    rest[rows, best] = np.iinfo(np.int64).max
    other = np.sqrt(rest.min(1).astype(np.float64))
    return np.floor((other * (1 - 1e-12) - own * (1 + 1e-12)) * (1 << KEY_BITS)).astype(np.int64) - 1


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far each part's entries' slacks have shrunk at most, rounded up: an entry's own movement plus the largest other one."""
    step = ((after.astype(np.int64) - before.astype(np.int64)) ** 2).sum(2)
    moved = np.ceil(np.sqrt(step.astype(np.float64)) * (1 + 1e-12) * (1 << KEY_BITS)).astype(np.int64)
    moved += step > 0
    order = np.sort(moved, axis=1)
    most, second = order[:, -1:], order[:, -2:-1] if moved.shape[1] > 1 else np.zeros_like(order)
    return moved + np.where(moved == most, second, most)  # two entries that moved most are each other's largest other one


def gathered(x: np.ndarray, codes: np.ndarray, weight: int, sums: np.ndarray) -> None:
    """Adds weight times (1, components) of every row to its entry's count and sums."""
    np.add.at(sums, codes, np.concatenate((np.ones((len(x), 1), np.int64), x.astype(np.int64)), axis=1) * weight)


class Block:
    """The rows of one block and their heaps: items[start[p, e]:start[p, e + 1]] is the heap of entry e of part p."""

    def __init__(self, x: np.ndarray, codes: np.ndarray, heaps: list[list[list[int]]]):
        self.x, self.codes, self.heaps = x, codes, heaps

    @classmethod
    def assigned(cls, x: np.ndarray, books: np.ndarray) -> tuple[Block, np.ndarray]:
        """A block whose parts are all measured, and its counts and sums."""
        parts, entries, width = books.shape
        codes, heaps = np.zeros((len(x), parts), np.uint8), []
        sums = np.zeros((parts, entries, width + 1), np.int64)
        rows = np.arange(len(x))
        for p in range(parts):
            own = x[:, p * width : (p + 1) * width]
            d2 = distances(own, books[p])
            best = d2.argmin(1)  # the lowest index of equal ones
            codes[:, p] = best
            items = (slack(d2, best) << ROW_BITS) | rows
            heaps.append([])
            for e in range(entries):
                heap = items[best == e].tolist()
                heapq.heapify(heap)
                heaps[p].append(heap)
            gathered(own, best, 1, sums[p])
        return cls(x, codes, heaps), sums

    def moved(self, books: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Pops and measures the parts whose bounds the cumulative drift has violated; the change of counts and sums."""
        parts, entries, width = books.shape
        sums = np.zeros((parts, entries, width + 1), np.int64)
        mask = (1 << ROW_BITS) - 1
        for p in range(parts):
            rows = []
            for e, heap in enumerate(self.heaps[p]):
                limit = int(drift[p, e])
                while heap and heap[0] >> ROW_BITS <= limit:
                    rows.append(heapq.heappop(heap) & mask)
            if not rows:
                continue
            rows = np.array(rows)
            own, before = self.x[rows, p * width : (p + 1) * width], self.codes[rows, p]
            d2 = distances(own, books[p])
            best = d2.argmin(1)
            gathered(own, before, -1, sums[p])
            gathered(own, best, 1, sums[p])
            self.codes[rows, p] = best
            items = ((slack(d2, best) + drift[p, best]) << ROW_BITS) | rows
            for e, item in zip(best.tolist(), items.tolist()):
                heapq.heappush(self.heaps[p][e], item)
        return sums

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Each row's squared distance to its entries."""
        parts, _, width = books.shape
        out = np.zeros(len(self.x), np.int64)
        for p in range(parts):
            step = self.x[:, p * width : (p + 1) * width].astype(np.int64) - books[p][self.codes[:, p]]
            out += (step * step).sum(1)
        return out

    def row(self, keys: dict, sums: np.ndarray) -> dict:
        flat = [h for part in self.heaps for h in part]
        items = np.array([i for h in flat for i in h], np.int64)
        return keys | {
            "vectors": packed(self.x.reshape(-1)), "codes": packed(self.codes.reshape(-1)), "heaps": packed(items), "sizes": packed(np.array([len(h) for h in flat], np.int32)),
            "sums": packed(sums.reshape(-1)), "moved": bool(sums.any()),
        }

    @classmethod
    def read(cls, row: dict, dims: int, parts: int, entries: int) -> Block:
        sizes = unpacked(row["sizes"], np.int32)
        items, ends = unpacked(row["heaps"], np.int64).tolist(), np.cumsum(sizes).tolist()
        heaps = [items[b - n : b] for n, b in zip(sizes.tolist(), ends)]
        codes = np.array(unpacked(row["codes"], np.uint8)).reshape(-1, parts)
        return cls(unpacked(row["vectors"], np.int32).reshape(-1, dims), codes, [heaps[p * entries : (p + 1) * entries] for p in range(parts)])


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<int>, label) of the rows whose vector is whole, as integers."""
    x = F.col("embedding").cast("array<double>")
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.col("label").cast("long").alias("label"), F.coalesce(whole, F.lit(False)).alias("whole")).where("whole")
    return rows.select("vec_id", F.transform("x", lambda v: F.when(F.abs(v) < MOST, F.floor(v * SCALE)).otherwise(F.lit(None)).cast("int")).alias("x"), "label")


def arrays_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column("x")
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    if (lengths != dims).any():
        raise ValueError(f"vectors have {sorted(set(lengths.tolist()) | {dims})} components; all must have as many")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError(f"a component of {MOST} or more is too large for exact sums")
    return flat.to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dims)


def long_or_zero(column: pa.Array) -> tuple[bytes, bytes]:
    none = column.is_null().to_numpy(zero_copy_only=False)
    return packed(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), packed(none.astype(np.uint8))


SCHEMA = pa.schema([("ids", pa.binary()), ("no_id", pa.binary()), ("labels", pa.binary()), ("no_label", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary()), ("heaps", pa.binary()), ("sizes", pa.binary()), ("sums", pa.binary()), ("moved", pa.bool_())])


def first_blocks(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Blocks of rows, all parts measured."""
    dims = books.shape[0] * books.shape[2]

    @tidy
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                block, sums = Block.assigned(arrays_of(part, dims), books)
                (ids, no_id), (labels, no_label) = long_or_zero(part.column("vec_id")), long_or_zero(part.column("label"))
                yield pa.RecordBatch.from_pylist([block.row({"ids": ids, "no_id": no_id, "labels": labels, "no_label": no_label}, sums)], SCHEMA)

    return rows.mapInArrow(run, BLOCKS)


def next_blocks(blocks: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """Blocks after a round: only parts with violated bounds have been measured again."""
    parts, entries, width = books.shape

    @tidy
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row, parts * width, parts, entries)
                sums = block.moved(books, drift)
                yield pa.RecordBatch.from_pylist([block.row({k: row[k] for k in ("ids", "no_id", "labels", "no_label")}, sums)], SCHEMA)

    return blocks.mapInArrow(run, BLOCKS)


def coded_rows(blocks: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """(vec_id, code, error, label) of all rows, after the final assignment."""
    parts, entries, width = books.shape

    @tidy
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row, parts * width, parts, entries)
                block.moved(books, drift)
                ids, labels = (pa.array(unpacked(row[k], np.int64), mask=unpacked(row[n], np.uint8).astype(bool)) for k, n in (("ids", "no_id"), ("labels", "no_label")))
                text = block.codes.tobytes().hex()
                codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(codes, pa.string()), pa.array(block.errors(books)), labels], ["vec_id", "code", "error", "label"])

    return blocks.mapInArrow(run, OUT)


def total_sums(blocks: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The blocks' counts and sums, summed by number: partial sums in every task, then one row for each of the codebooks' numbers."""
    size = int(np.prod(shape))

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for sums in batch.column(0).to_pylist():
                total += unpacked(sums, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "value"])

    found = blocks.where("moved").select("sums").mapInArrow(run, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size, np.int64)  # at most parts * entries * (width + 1) rows, whatever the input
    for row in found:
        out[row["at"]] = row["value"]
    return out.reshape(shape)


def refilled(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries moved to the floor of their parts' mean; unused ones stay."""
    count = sums[:, :, :1]
    return np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray | None, np.ndarray | None]:
    """Blocks of all rows after rounds of heap Lloyd, the codebooks, and the drift that the blocks have not seen yet."""
    rows = kept_vectors(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not first:
        return None, None, None
    lengths = {len(r["x"]) for r in first}
    if len(lengths) > 1 or min(lengths) % parts:
        raise ValueError(f"vectors have {sorted(lengths)} components; all must have as many, a multiple of {parts}")
    if any(v is None for r in first for v in r["x"]):
        raise ValueError(f"a component of {MOST} or more is too large for exact sums")
    start = np.array([r["x"] for r in first], np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    shape = (parts, len(first), books.shape[2] + 1)
    blocks = staged(first_blocks(rows, books), "codes")
    total, drift = total_sums(blocks, shape), np.zeros(shape[:2], np.int64)
    for k in range(rounds):
        before, books = books, refilled(books, total)
        drift = drift + drifts(before, books)
        if k + 1 < rounds:
            last, blocks = blocks, staged(next_blocks(blocks, books, drift), "codes")
            total = total + total_sums(blocks, shape)
            dropped(last)
    return blocks, books, drift


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of vectors(vec_id, embedding, label)."""
    spark = vectors.sparkSession
    blocks, books, drift = train(vectors, parts, entries, rounds)
    if blocks is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = staged(coded_rows(blocks, books, drift), "coded")
    dropped(blocks)
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    if sums.count() <= MOST_LABELS:
        out = rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")))
    else:
        salted = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))).join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLE: dict = {}
