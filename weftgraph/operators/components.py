"""Connected components of an edge DataFrame by minimum labels and pointer jumping."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where the session names none and all runs in one process (tests)."""
    named, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if named:
        return named
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = tempfile.mkdtemp(prefix="weft-")
    return shared_folder.own


def checkpointed(df: DataFrame, label: str = "round") -> DataFrame:
    """df written to the shared checkpoint folder and read again; lineage ends there."""
    spark = df.sparkSession
    base = shared_folder(spark)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes a table of checkpointed() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Links that a task takes in before it puts together what they link.
LINKS = 1 << 21


def least_linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that the links name, and the smallest one it hangs together with: roots are hooked on smaller ones, then pointers jump."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        root[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(up := root[root], root):
            root = up
    return ids, ids[root]


def linked_in_tasks(pairs: DataFrame) -> DataFrame:
    """(u, v): each node that a task's pairs(u, v) name, itself too, with the smallest one it hangs together with there. A task holds its nodes and LINKS links; dense graphs are few rows then."""

    def contract(batches):
        u = v = np.zeros(0, np.int64)
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += len(b)
            if n >= LINKS + len(u):
                u, v = least_linked(*(np.concatenate(x) for x in zip((u, v), *held)))
                held, n = [], 0
        u, v = least_linked(*(np.concatenate(x) for x in zip((u, v), *held)))
        for at in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + (1 << 16)]), pa.array(v[at : at + (1 << 16)])], ["u", "v"])

    return pairs.mapInArrow(contract, "u long, v long").distinct()


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) of every node that an edge names; component is the smallest node id reachable.

    Rounds of large-star and small-star: every node's larger neighbours are linked to its smallest one, then its
    smaller ones, until the edges are stars; before that, tasks put together what their own edges link. Each round is one grouped minimum and one join; the number of rounds
    grows with the logarithm of a component's diameter. Loops name a node without linking it."""
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    linked = checkpointed(linked_in_tasks(pairs), "linked")
    nodes = linked.select(F.col("u").alias("node")).distinct()
    now = checkpointed(linked.where("u <> v"), "edges")
    before = None
    while True:  # each round but the last changes an edge, and labels only fall
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v").distinct()
        last, now = now, checkpointed(small, "edges")
        removed(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(now.select(F.col("u").alias("node"), "v"), "node", "left").groupBy("node").agg(F.min(F.coalesce("v", "node")).alias("component"))
