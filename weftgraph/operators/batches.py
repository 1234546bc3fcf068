"""Many graphs at once: the first column of every table is the graph's key, and each graph counts its own nodes from 0.

Sums and qualities are grouped by (graph, community), so that a graph may be of any size; Leiden and the exhaustive search take one graph a group and
are for graphs that fit a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.objective import Cpm, Objective, Rb
from . import kernel
from .components import checkpointed
from .graph import Graph, edge_ends, merged_edges, spread
from .leiden import LeidenConfig

#: Nodes up to which all partitions of a graph are tried (115,975 for ten).
MOST_NODES = 10


@dataclass(frozen=True)
class GraphBatch:
    """nodes(graph, id, node_weight), ids 0..n-1 in every graph, and edges(graph, src, dst, weight), each once with src <= dst. Where all graphs are
    small, sums by community save few rows before a shuffle, so that rows are dealt to tasks by graph first."""

    nodes: DataFrame
    edges: DataFrame
    small: bool = False

    @classmethod
    def from_edges(cls, nodes: DataFrame, edges: DataFrame, small: bool = False) -> GraphBatch:
        """nodes(graph, id) or (graph, id, node_weight); parallel edges are summed, those of weight zero dropped."""
        w = F.col("node_weight").cast("double") if "node_weight" in nodes.columns else F.lit(1.0)
        low, high = F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")
        total = edges.select("graph", low, high, F.col("weight").cast("float").cast("double").alias("weight")).groupBy("graph", "src", "dst").agg(F.sum("weight").cast("float").alias("weight"))
        return cls(nodes.select("graph", F.col("id").cast("long").alias("id"), w.alias("node_weight")), total.where("weight <> 0"), small)

    def alone(self, key) -> Graph:
        """One of the graphs."""
        return Graph(self.nodes.where(F.col("graph") == key).drop("graph"), merged_edges(self.edges.where(F.col("graph") == key).drop("graph")))

    def strengths(self) -> DataFrame:
        """(graph, id, strength); loops count twice."""
        ends = edge_ends(self.edges.select(F.struct("graph", F.col("src").alias("id")).alias("src"), F.struct("graph", F.col("dst").alias("id")).alias("dst"), "weight"))
        sums = ends.groupBy(F.col("node.graph").alias("graph"), F.col("node.id").alias("id")).agg(F.sum("weight").alias("strength"))
        return self.nodes.join(sums, ["graph", "id"], "left").select("graph", "id", F.coalesce("strength", F.lit(0.0)).alias("strength"))

    def totals(self) -> DataFrame:
        """(graph, n_nodes, n_edges, total_weight, node_weight)."""
        e = self.edges.groupBy("graph").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("weight").cast("double")).alias("total_weight"))
        n = self.nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("node_weight").alias("node_weight"))
        return n.join(e, "graph", "left").select("graph", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"), "node_weight")

    def communities(self, partition: DataFrame) -> DataFrame:
        """(graph, community, size, weight, strength, internal) of partition(graph, node, community)."""
        p = partition.select("graph", F.col("node").alias("id"), "community")
        own = spread(self.nodes, "graph", "id").join(spread(p, "graph", "id"), ["graph", "id"])
        ends = self.edges.select("graph", "src", "dst", F.col("weight").cast("double").alias("w"))
        for end, name in (("src", "_a"), ("dst", "_b")):
            ends = spread(ends, "graph", end).join(own.select("graph", F.col("id").alias(end), F.col("community").alias(name)), ["graph", end], "left")
        none = F.lit(0.0)
        side = lambda c, w, inside: F.struct(F.col(c).alias("community"), F.lit(0).cast("long").alias("size"), none.alias("weight"), w.alias("strength"), inside.alias("internal"))
        sides = F.when(F.col("_a") == F.col("_b"), F.array(side("_a", F.col("w") * 2, F.col("w")))).otherwise(F.array(side("_a", F.col("w"), none), side("_b", F.col("w"), none)))
        rows = ends.select("graph", F.inline(sides)).where("community is not null").unionByName(own.select("graph", "community", F.lit(1).cast("long").alias("size"), F.col("node_weight").alias("weight"), none.alias("strength"), none.alias("internal")))
        return (spread(rows, "graph") if self.small else rows).groupBy("graph", "community").agg(*(F.sum(c).alias(c) for c in ("size", "weight", "strength", "internal")))

    def qualities(self, partition: DataFrame, objective: Objective | None = None) -> DataFrame:
        """(graph, quality) of every graph that has nodes."""
        share = community_share(objective or Rb())
        m = self.edges.groupBy("graph").agg(F.sum(F.col("weight").cast("double")).alias("total_weight"))
        table = self.communities(partition).join(m, "graph", "left").withColumn("total_weight", F.coalesce("total_weight", F.lit(0.0)))
        return table.groupBy("graph").agg(F.sum(share(F.col("internal"), F.col("strength"), F.col("weight"), F.col("total_weight"))).alias("quality"))

    def leiden(self, config: LeidenConfig | None = None) -> DataFrame:
        """(graph, node, label): each graph's communities, one graph a group; the same as running it alone."""
        config = config or LeidenConfig()
        config.validate()
        key = dict(self.nodes.dtypes)["graph"]
        rows = self.nodes.select("graph", F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst"), F.col("node_weight").alias("w")).unionByName(self.edges.select("graph", "src", "dst", F.col("weight").cast("double").alias("w")))

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            own, e = pdf[pdf.dst < 0].sort_values("src"), pdf[pdf.dst >= 0].sort_values(["src", "dst"])
            arrays = kernel.Arrays.build(len(own), e.src.to_numpy(), e.dst.to_numpy(), e.w.to_numpy(), own.w.to_numpy())
            return pd.DataFrame({"graph": pdf.graph.iloc[0], "node": own.src.to_numpy(), "label": kernel.leiden(arrays, config.objective, float(e.w.sum()), config)})

        return checkpointed(spread(rows, "graph").groupBy("graph").applyInPandas(solve, f"graph {key}, node long, label long"), "labels")  # solved once, however often labels are read

    def optimum(self, objective: Objective | None = None, most: int = MOST_NODES) -> DataFrame:
        """(graph, n_nodes, quality, community array<int>): the best of all partitions of every graph of at most `most` nodes, the first in the order
        of growth strings among equal ones; graphs with more nodes are left out. Qualities are rounded to nine places first."""
        if most > MOST_NODES:
            raise ValueError(f"partitions of more than {MOST_NODES} nodes are not enumerated")
        objective, key = objective or Rb(), dict(self.nodes.dtypes)["graph"]
        nodes = self.nodes.join(self.strengths(), ["graph", "id"]).groupBy("graph").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("id", "strength", "node_weight"))).alias("nodes")).where(F.col("n") <= most)  # at most MOST_NODES entries
        edges = self.edges.join(nodes.select("graph"), "graph", "left_semi").groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("src", "dst", F.col("weight").cast("double").alias("w")))).alias("edges"))  # and their pairs
        linked = F.coalesce("edges", F.array().cast("array<struct<src:long,dst:long,w:double>>"))
        graphs = nodes.join(edges, "graph", "left").select("graph", "nodes.strength", "nodes.node_weight", *(linked[c].alias(c) for c in ("src", "dst", "w")))

        def solve(parts):
            for pdf in parts:
                best = [best_partition(*row, objective) for row in zip(pdf.strength, pdf.node_weight, pdf.src, pdf.dst, pdf.w)]
                yield pd.DataFrame({"graph": pdf.graph, "n_nodes": [len(c) for _, c in best], "quality": [q for q, _ in best], "community": [c for _, c in best]})

        return spread(graphs, "graph").mapInPandas(solve, f"graph {key}, n_nodes long, quality double, community array<int>")


@lru_cache
def growth_table(n: int) -> np.ndarray:
    """All restricted growth strings of n numbers, one a column, in their order."""
    rows = np.zeros((1, 1), np.int64)
    for _ in range(n - 1):
        more = rows.max(axis=1) + 2
        last = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        rows = np.column_stack((np.repeat(rows, more, axis=0), last))
    return np.ascontiguousarray(rows.T)


def best_partition(strength, weight, src, dst, w, objective: Objective) -> tuple[float, np.ndarray]:
    """The best quality of one small graph's partitions, rounded to nine places, and the first string that has it."""
    strings, m = growth_table(len(strength)), float(np.sum(w))
    n, count = strings.shape
    at, (inside, k, a, size) = strings * count + np.arange(count), np.zeros((4, n * count))  # at: each node's community of each string
    for v in range(n):
        k[at[v]] += strength[v]
        a[at[v]] += weight[v]
        size[at[v]] += 1
    for x, y, by in zip(src, dst, w):
        inside[at[x][strings[x] == strings[y]]] += by
    if isinstance(objective, Rb):
        m = max(m, 0.0)  # as community_share
    share = np.where(size > 0, objective.community_quality(inside, k, a, m), 0.0)
    quality = np.round(share.reshape(n, count).sum(axis=0), 9) + 0.0
    best = int(quality.argmax())
    return float(quality[best]), strings[:, best].astype(np.int32)


def community_share(objective: Objective) -> Callable:
    """A community's share of the quality where m is a column."""
    if isinstance(objective, Rb):
        return lambda inside, strength, weight, m: F.when(m > 0, inside - strength * strength * (objective.resolution / 4.0) / m).otherwise(0.0)
    if isinstance(objective, Cpm):
        return lambda inside, strength, weight, m: objective.community_quality(inside, strength, weight, 1.0)
    return objective.community_quality


def growth_strings(spark: SparkSession, most: int) -> DataFrame:
    """(n, string) of all partitions of 1 to most nodes as restricted growth strings: each number is at most one above the largest before it. Strings grow
    by one node a step, in parallel."""
    now = spark.range(1).select(F.array(F.lit(0)).alias("string"))
    out = now
    for _ in range(most - 1):
        now = now.select(F.explode(F.transform(F.sequence(F.lit(0), F.array_max("string") + 1), lambda c: F.concat("string", F.array(c)))).alias("string"))
        out = out.unionByName(now)
    return out.select(F.size("string").alias("n"), "string")


def sampled_batch(spark: SparkSession, graphs: int, most: int = 40, seed: int = 1) -> GraphBatch:
    """Random graphs of 1 to most nodes, of all densities, some with loops, weights from 0.25 to 3.75: by hashes, the same on any cluster."""
    from ..sources.generators import uniform

    u = lambda *k: uniform(F.lit(seed), *k)
    own = spark.range(graphs).select(F.col("id").alias("graph"), (F.floor(u(F.lit("n"), F.col("id")) * most) + 1).alias("n"), (u(F.lit("p"), F.col("id")) * u(F.lit("p"), F.col("id")) * 0.6 + 0.01).alias("p"), (F.col("id") % 3 == 0).alias("loops"))
    nodes = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("src"))
    pairs = nodes.select("*", F.explode(F.sequence(F.col("src"), F.col("n") - 1)).alias("dst")).where("loops or src < dst")
    edges = pairs.where(u(F.lit("e"), F.col("graph"), F.col("src"), F.col("dst")) < F.col("p"))
    return GraphBatch.from_edges(nodes.select("graph", F.col("src").alias("id")), edges.select("graph", "src", "dst", F.round(u(F.lit("w"), F.col("graph"), F.col("src"), F.col("dst")) * 3.5 + 0.25, 4).alias("weight")))


def degenerate_batch(spark: SparkSession) -> GraphBatch:
    """Graphs at the edges of what is allowed, by name: one node, nodes without edges, one edge, loops only, a loop beside an edge, a star, a path, two cliques
    with a bridge, three separate cliques."""
    clique = lambda a, n: [(i, j) for i in range(a, a + n) for j in range(i + 1, a + n)]
    shapes = {
        "one node": (1, []), "no edges": (5, []), "one edge": (2, [(0, 1)]), "loops only": (3, [(0, 0), (2, 2)]), "a loop beside an edge": (3, [(0, 1), (1, 1)]), "star": (9, [(0, k) for k in range(1, 9)]), "path": (12, [(k, k + 1) for k in range(11)]),
        "barbell": (10, clique(0, 5) + clique(5, 5) + [(0, 5)]), "separate cliques": (15, clique(0, 5) + clique(5, 5) + clique(10, 5)),
    }
    nodes = spark.createDataFrame([(g, k) for g, (n, _) in shapes.items() for k in range(n)], "graph string, id long")
    return GraphBatch.from_edges(nodes, spark.createDataFrame([(g, a, b, 1.0) for g, (_, e) in shapes.items() for a, b in e], "graph string, src long, dst long, weight double"))
