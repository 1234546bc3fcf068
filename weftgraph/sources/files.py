"""Readers and writers of graph files: text edges and labels, binary CSR arrays, JSON references and fixtures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import GraphBatch
from ..operators.graph import Graph
from .csr import read_csr


def read_edges(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """n and edges of white-space separated lines ``u v [w]``; w is 1 where it is missing, n the largest id plus one."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    edges = rows.select(part[0].cast("long").alias("src"), part[1].cast("long").alias("dst"), F.coalesce(F.try_element_at(part, F.lit(3)).cast("double"), F.lit(1.0)).alias("weight"))
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return (0 if top is None else top + 1), edges


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(node, label) of a text file with a label on each line; the line's number is the node. The file is read as one record."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")).alias("node", "label")).select(F.col("node").cast("long").alias("node"), F.trim("label").cast("long").alias("label"))


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst", "weight").alias("value")).write.text(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """One file with a label on each line, in the order of the nodes."""
    labels.orderBy("node").select(F.col("label").cast("string").alias("value")).coalesce(1).write.text(path)


def read_binary_csr(spark: SparkSession, folder: str, strict: bool = False) -> Graph:
    """A graph of ``indptr.bin`` (u64), ``indices.bin`` (u32) and ``data.bin`` (f32), little-endian, read in byte ranges by tasks."""
    return read_csr(spark, folder, strict)


def csr_bytes(graph: Graph) -> dict[str, bytes]:
    """The three files' contents of a graph that fits on the driver."""
    ptrs, cols, values = graph.to_csr()
    return {"indptr.bin": np.array(ptrs, "<u8").tobytes(), "indices.bin": np.array(cols, "<u4").tobytes(), "data.bin": np.array(values, "<f4").tobytes()}


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document of references or fixtures, one row."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


REFERENCE = "resolutions map<string, struct<labels: array<long>, n_clusters: long, seconds: double>>, annotation struct<name: string, labels: array<long>, categories: array<string>>"
META = "dataset string, n_cells long, n_entries long, n_neighbors long, max_asymmetry double, scanpy string"
FIXTURES = "graphs map<string, struct<n_nodes: long, edges: array<array<double>>>>, cases array<struct<name: string, graph: string, objective: string, resolution: double, seed: long, reference_membership: array<long>, reference_n_clusters: long, reference_quality: double, reference_modularity: double>>"


def reference_labels(reference: DataFrame) -> DataFrame:
    """(resolution, node, label) of a read reference."""
    rows = reference.select(F.explode("resolutions").alias("resolution", "r"))
    return rows.select("resolution", F.posexplode("r.labels").alias("node", "label")).select("resolution", F.col("node").cast("long").alias("node"), "label")


def fixture_batch(fixtures: DataFrame) -> GraphBatch:
    """The graphs of a read FIXTURES document, keyed by their names."""
    each = fixtures.select(F.explode("graphs").alias("graph", "g"))
    nodes = each.where("g.n_nodes > 0").select("graph", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g.n_nodes") - 1)).alias("id"))
    edges = each.select("graph", F.explode("g.edges").alias("e")).select("graph", F.col("e")[0].cast("long").alias("src"), F.col("e")[1].cast("long").alias("dst"), F.coalesce(F.get("e", F.lit(2)), F.lit(1.0)).alias("weight"))
    return GraphBatch.from_edges(nodes, edges)


def fixture_cases(fixtures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, graph, objective, resolution, seed, reference_quality, reference_modularity, reference_n_clusters) and the members (name, graph, node, community) of a read FIXTURES document's cases."""
    each = fixtures.select(F.explode("cases").alias("c")).select("c.*")
    members = each.select("name", "graph", F.posexplode("reference_membership").alias("node", "community"))
    return each.drop("reference_membership"), members.select("name", "graph", F.col("node").cast("long").alias("node"), "community")


def write_fixtures(batch: GraphBatch, cases: DataFrame, members: DataFrame, path: str) -> None:
    """A FIXTURES document of graphs, cases (as fixture_cases gives them) and members(name, graph, node, community), for fixtures that fit one document."""
    ends = batch.edges.groupBy("graph").agg(F.array_sort(F.collect_list(F.array(F.col("src").cast("double"), F.col("dst").cast("double"), F.col("weight").cast("double")))).alias("edges"))
    graphs = batch.nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n_nodes")).join(ends, "graph", "left").select(F.col("graph").cast("string").alias("key"), F.struct("n_nodes", F.coalesce("edges", F.array().cast("array<array<double>>")).alias("edges")).alias("value"))
    own = members.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "community"))), lambda x: x["community"]).alias("reference_membership"))
    each = cases.join(own, "name").select(F.struct("name", F.col("graph").cast("string").alias("graph"), *(c for c in ("objective", "resolution", "seed", "reference_membership", "reference_n_clusters", "reference_quality", "reference_modularity"))).alias("case"))
    one = graphs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("graphs")).join(each.agg(F.array_sort(F.collect_list("case")).alias("cases")))  # one row each
    one.coalesce(1).write.json(path)


def points_of(frame: pd.DataFrame | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """(id, features) of a table of vectors."""
    return frame.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("features")) if isinstance(frame, DataFrame) else spark.createDataFrame(frame)
