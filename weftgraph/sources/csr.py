"""CSR arrays as relations: read and written in byte ranges by tasks, checked by windows, turned into entries by a range join.

An array is a table (pos, value), its positions counted from 0. Three make a matrix: row pointers, columns and values. In files they are little-endian numbers without a
header (``indptr.bin`` u64, ``indices.bin`` u32, ``data.bin`` f32); a folder in a file's place holds parts of it, joined in the order of their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.components import checkpointed
from ..operators.graph import Graph, prefix_sums

FILES = {"indptr.bin": "<u8", "indices.bin": "<u4", "data.bin": "<f4"}
#: Bytes that a task reads; positions of a bucket of the range join.
RANGE, BUCKET = 8 << 20, 1 << 12


def opened(path: str):
    """The file system of a path or URI, and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, path: str, at: int, size: int, first: int):
        super().__init__(None)
        self.path, self.at, self.size, self.first = path, at, size, first


class ArrayReader(DataSourceReader):
    """Partitions are byte ranges of whole numbers; only names and sizes are looked at on the driver."""

    def __init__(self, path: str, kind: str, size: int):
        self.path, self.kind, self.size = path, kind, size

    def partitions(self):
        from pyarrow import fs

        store, path = opened(self.path)
        info = store.get_file_info(path)
        parts = sorted((x for x in store.get_file_info(fs.FileSelector(path)) if x.is_file and x.base_name[0] not in "._"), key=lambda x: x.base_name) if info.type == fs.FileType.Directory else [info]
        width, first, out = np.dtype(self.kind).itemsize, 0, []
        step = max(width, self.size // width * width)
        for x in parts:
            if x.type == fs.FileType.NotFound or x.size % width:
                raise ValueError(f"{x.path} is missing or no whole number of {width}-byte numbers")
            out += [Range(x.path, at, min(step, x.size - at), (first + at) // width) for at in range(0, x.size, step)]
            first += x.size
        return out or [Range("", 0, 0, 0)]

    def read(self, partition):
        values = np.zeros(0, self.kind)
        if partition.size:
            with opened(self.path)[0].open_input_file(partition.path) as f:
                values = np.frombuffer(f.read_at(partition.size, partition.at), self.kind)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.first + len(values))), pa.array(values.astype(np.float32 if self.kind[1] == "f" else np.int64))], ["pos", "value"])


class ArraySource(DataSource):
    """``spark.read.format("number_array")`` with the options path, dtype (as numpy writes it) and bytes, a task's share."""

    @classmethod
    def name(cls) -> str:
        return "number_array"

    def schema(self) -> str:
        return f"pos long, value {'float' if self.options['dtype'][1] == 'f' else 'long'}"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], self.options["dtype"], int(self.options.get("bytes", RANGE)))


def read_array(spark: SparkSession, path: str, dtype: str, size: int = RANGE) -> DataFrame:
    """(pos, value) of a file, or folder of parts, of numbers."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("number_array").option("dtype", dtype).option("bytes", str(size)).load(path)


def read_csr_arrays(spark: SparkSession, folder: str, size: int = RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Row pointers, columns and values of a folder's three files."""
    return tuple(read_array(spark, f"{folder.rstrip('/')}/{name}", kind, size) for name, kind in FILES.items())


def write_array(array: DataFrame, path: str, dtype: str) -> None:
    """array(pos, value) as a folder of parts, each written by the task that holds its range of positions and named by the first one; a task that is tried again writes the same part."""

    def write(batches):
        found = [(b.column("pos").to_numpy(zero_copy_only=False), b.column("value").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if found:
            pos, value = (np.concatenate(x) for x in zip(*found))
            with opened(path)[0].open_output_stream(f"{opened(path)[1]}/part-{int(pos[0]):020d}") as f:
                f.write(value.astype(dtype).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(x) for x, _ in found)])], ["n"])

    opened(path)[0].create_dir(opened(path)[1], recursive=True)
    array.select("pos", "value").repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def csr_arrays(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph's full symmetric matrix as row pointers, columns and values."""
    rows = checkpointed(graph.csr_rows(), "rows")  # all three are taken from it
    ends = rows.select((F.col("id") + 1).alias("pos"), (F.col("start") + F.size("nbrs")).alias("value"))
    ptrs = graph.nodes.sparkSession.range(1).select(F.col("id").alias("pos"), F.lit(0).cast("long").alias("value")).unionByName(ends)
    entry = rows.select("start", F.posexplode(F.arrays_zip("nbrs", "weights")).alias("k", "x")).select((F.col("start") + F.col("k")).alias("pos"), F.col("x.nbrs").alias("col"), F.col("x.weights").alias("weight"))
    return ptrs, entry.select("pos", F.col("col").alias("value")), entry.select("pos", F.col("weight").alias("value"))


def write_csr(graph: Graph, folder: str) -> None:
    for (name, kind), array in zip(FILES.items(), csr_arrays(graph)):
        write_array(array, f"{folder.rstrip('/')}/{name}", kind)


def row_ranges(ptrs: DataFrame) -> DataFrame:
    """(row, start, end) of the row pointers: each one's next, by positions and not by a window over all."""
    after = ptrs.select((F.col("pos") - 1).alias("row"), F.col("value").alias("end"))
    return ptrs.select(F.col("pos").alias("row"), F.col("value").alias("start")).join(after, "row")


def csr_entries(ptrs: DataFrame, cols: DataFrame, values: DataFrame) -> DataFrame:
    """(row, col, value) of the matrix: each entry joined with the row whose range holds its position, bucket by bucket."""
    bucket = lambda c: F.floor(c / BUCKET)
    rows = row_ranges(ptrs).where("start < end").select("row", "start", "end", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end") - 1))).alias("bucket"))
    entry = cols.select("pos", F.col("value").alias("col")).join(values.select("pos", "value"), "pos").withColumn("bucket", bucket(F.col("pos")))
    return entry.join(rows, "bucket").where("pos >= start and pos < end").select("row", "col", "value")


def csr_faults(ptrs: DataFrame, cols: DataFrame, values: DataFrame, node_weights: DataFrame | None = None) -> DataFrame:
    """(problem, pos, value): one row for each fault of a matrix's arrays; none if they can be read.

    no row pointers; lengths differ (pos, value: columns, values); end differs (last pointer, entries); pointers fall (row, by how much), the first not being 0 among them; column out of range (pos,
    column); not finite, negative (pos, value); node weights differ (weights, nodes)."""
    row = lambda problem, pos, value: (F.lit(problem).alias("problem"), pos.cast("long").alias("pos"), value.cast("double").alias("value"))
    n = ptrs.agg((F.count(F.lit(1)) - 1).alias("n"), F.max_by("value", "pos").alias("end"))
    lengths = cols.agg(F.count(F.lit(1)).alias("cols")).join(F.broadcast(values.agg(F.count(F.lit(1)).alias("values")))).join(F.broadcast(n))  # one row each
    found = lengths.where("n < 0").select(*row("no row pointers", F.lit(0), F.lit(0)))
    found = found.unionByName(lengths.where("cols <> values").select(*row("lengths differ", F.col("cols"), F.col("values"))))
    found = found.unionByName(lengths.where("end <> cols").select(*row("end differs", F.col("end"), F.col("cols"))))
    found = found.unionByName(row_ranges(ptrs).where("end < start").select(*row("pointers fall", F.col("row"), F.col("start") - F.col("end"))))
    found = found.unionByName(ptrs.where("pos = 0 and value <> 0").select(*row("pointers fall", F.col("pos"), F.col("value"))))
    found = found.unionByName(cols.join(F.broadcast(n)).where("value < 0 or value >= n").select(*row("column out of range", F.col("pos"), F.col("value"))))
    w = F.col("value").cast("double")
    bad = w.isNull() | F.isnan(w) | (F.abs(w.cast("float")) == float("inf"))
    found = found.unionByName(values.where(bad).select(*row("not finite", F.col("pos"), w))).unionByName(values.where(~bad & (w < 0)).select(*row("negative", F.col("pos"), w)))
    if node_weights is not None:
        found = found.unionByName(node_weights.agg(F.count(F.lit(1)).alias("got")).join(F.broadcast(n)).where("got <> n").select(*row("node weights differ", F.col("got"), F.col("n"))))
    return found


def read_csr(spark: SparkSession, folder: str, strict: bool = False, size: int = RANGE) -> Graph:
    """The graph of a folder's three files; nothing but counts passes the driver."""
    from ..errors import InvalidCsr

    ptrs, cols, values = read_csr_arrays(spark, folder, size)
    fault = csr_faults(ptrs, cols, values).orderBy("problem", "pos").first()
    if fault is not None:
        raise InvalidCsr(f"{fault['problem']} (at {fault['pos']}: {fault['value']})")
    return Graph.from_adjacency(ptrs.count() - 1, checkpointed(csr_entries(ptrs, cols, values), "entries"), strict=strict)


def counted(array: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(pos, value): a column of a table as an array, in the order of keys; ranks are counted range by range of the first key."""
    first = keys[0]
    own = Window.partitionBy(first).orderBy(*keys[1:])
    sizes = prefix_sums(array.groupBy(first).agg(F.count(F.lit(1)).alias("_size")), first, "_size", "_from").select(first, "_from")
    return array.withColumn("_rank", F.row_number().over(own) - 1).join(sizes, first).select((F.col("_from") + F.col("_rank")).alias("pos"), F.col(value).alias("value"))
