"""Leiden and Louvain communities of a graph.

A community that grows from single nodes never spans two connected components, and quality is a sum over communities, so
components of up to ``kernel_max_edges`` edges are solved each in a grouped-map task, all in parallel. Larger components run
rounds of DataFrame operations (``rounds``) with aggregation between levels; ``leiden_by_rounds`` takes that way for graphs of any size.
For a fixed seed results are the same on any number of tasks.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..functions.objective import Cpm, Objective, Rb
from . import kernel, rounds
from .components import checkpointed, components
from .graph import Graph, spread
from .labels import from_labels
from .partition import communities, neighbor_weights


@dataclass(frozen=True)
class LeidenConfig:
    objective: Objective = field(default_factory=Rb)
    seed: int | None = 42
    n_iterations: int = 2
    max_levels: int = 64
    tolerance: float = 1e-9
    refine: bool = True
    randomness: float = 0.01
    patience: int = 2
    max_community_weight: float | None = None
    #: Edges of a component that one task takes.
    kernel_max_edges: int = 5_000_000
    #: Edges of a graph that one task takes whole.
    one_task_edges: int = 100_000
    #: What a round, and a level, of the distributed path must gain, as a share of the graph's weight.
    round_tolerance: float = 2e-4
    #: Edges of a coarse level that the distributed path hands to one task.
    coarse_edges: int = 1_000_000

    @classmethod
    def with_resolution(cls, resolution: float) -> LeidenConfig:
        return cls(objective=Rb(resolution))

    def validate(self) -> None:
        if not math.isfinite(self.objective.resolution) or self.objective.resolution < 0:
            raise InvalidConfig(f"resolution must be finite and non-negative, not {self.objective.resolution}")
        for name in ("n_iterations", "max_levels", "patience"):
            if getattr(self, name) < 1:
                raise InvalidConfig(f"{name} must be at least 1")
        if not math.isfinite(self.randomness) or self.randomness < 0:
            raise InvalidConfig("randomness must be finite and non-negative")
        if not math.isfinite(self.tolerance) or self.tolerance < 0:
            raise InvalidConfig("tolerance must be finite and non-negative")
        cap = self.max_community_weight
        if cap is not None and (not math.isfinite(cap) or cap <= 0):
            raise InvalidConfig("max_community_weight must be finite and positive")


def kernel_labels(graph: Graph, comps: DataFrame, config: LeidenConfig, m: float, one: bool = False) -> DataFrame:
    """(node, label) of all nodes of comps(node, component), each component solved in one task; a label is the
    smallest node of its community. Components are dealt to many tasks, as each is long work on few bytes, unless there is but one."""
    objective = config.objective
    edges = graph.edges.join(comps, F.col("src") == F.col("node")).select("component", "src", "dst", F.col("weight").cast("double").alias("w"))
    nodes = graph.nodes.join(comps, F.col("id") == F.col("node")).select("component", F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst"), F.col("node_weight").alias("w"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.dst < 0].sort_values("src")
        ids = own.src.to_numpy()
        e = pdf[pdf.dst >= 0].sort_values(["src", "dst"])
        arrays = kernel.Arrays.build(len(ids), ids.searchsorted(e.src), ids.searchsorted(e.dst), e.w.to_numpy(), own.w.to_numpy())
        found = kernel.leiden(arrays, objective, m, config)
        first: dict[int, int] = {}
        return pd.DataFrame({"node": ids, "label": [first.setdefault(c, int(v)) for c, v in zip(found, ids)]})

    rows = edges.unionByName(nodes)
    return (rows if one else spread(rows, "component")).groupBy("component").applyInPandas(solve, "node long, label long")


def leiden(graph: Graph, config: LeidenConfig | None = None) -> DataFrame:
    """(node, label) of every node; labels are consecutive in the order of their first node."""
    config = config or LeidenConfig()
    config.validate()
    graph = Graph(graph.nodes, checkpointed(graph.edges, "edges"))  # read many times
    m = graph.total_weight()
    if graph.edge_count() <= config.one_task_edges:  # its components are not worth finding
        return from_labels(checkpointed(kernel_labels(graph, graph.nodes.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component")), config, m, one=True), "labels"))
    found = components(graph.edges).withColumnRenamed("node", "_n")
    comps = checkpointed(graph.nodes.join(found, F.col("id") == F.col("_n"), "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component")), "components")
    sizes = graph.edges.join(comps, F.col("src") == F.col("node")).groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    large = sizes.where(F.col("edges") > config.kernel_max_edges).select("component")
    small = comps.join(large, "component", "left_anti") if not large.isEmpty() else comps
    out = kernel_labels(graph, small, config, m)
    if not large.isEmpty():
        out = out.unionByName(round_labels(part_of(graph, comps.join(large, "component", "left_semi")), config, m))
    return from_labels(checkpointed(out, "labels"))  # solved once, however often labels are read


def louvain(graph: Graph, config: LeidenConfig | None = None) -> DataFrame:
    from dataclasses import replace

    return leiden(graph, replace(config or LeidenConfig(), refine=False))


def part_of(graph: Graph, nodes: DataFrame) -> Graph:
    keep = nodes.select(F.col("node").alias("id"))
    return Graph(graph.nodes.join(keep, "id", "left_semi"), graph.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "weight"))


def round_labels(graph: Graph, config: LeidenConfig, m: float) -> DataFrame:
    """(node, label) by rounds, for a graph whose components are too large for one task."""
    return rounds.labels_by_rounds(graph, config, m)


def leiden_by_rounds(graph: Graph, config: LeidenConfig | None = None) -> DataFrame:
    """(node, label) of every node by rounds of DataFrame operations, whatever the graph's size: no component is one task's but as a coarse level of at most coarse_edges edges."""
    config = config or LeidenConfig()
    config.validate()
    return from_labels(round_labels(graph, config, graph.total_weight()))


def candidates(graph: Graph, partition: DataFrame, objective: Objective, m: float, constraint: DataFrame | None = None) -> DataFrame:
    """(node, community, own, gain, comm_weight, node_weight): for each node its own community, those beside it and an empty one (a negative
    id), with the gain of sitting there rather than alone; the node itself is left out of its community."""
    table = communities(graph, partition).select(F.col("community").alias("_c"), F.col("strength").alias("comm_strength"), F.col("weight").alias("comm_weight"))
    nodes = graph.nodes.join(graph.strengths(), "id").join(graph.self_loops(), "id").select(F.col("id").alias("_n"), "node_weight", "strength", "self_loop")
    own = partition.select("node", F.col("community").alias("own"))
    beside = neighbor_weights(graph, partition, constraint)
    stay = partition.select("node", "community", F.lit(0.0).alias("weight"))
    options = beside.unionByName(stay).unionByName(partition.select("node", (-F.col("node") - 1).alias("community"), F.lit(0.0).alias("weight")))
    options = options.groupBy("node", "community").agg(F.sum("weight").alias("w"))
    full = options.join(own, "node").join(nodes, F.col("node") == F.col("_n")).join(table, F.col("community") == F.col("_c"), "left")
    mine = F.col("community") == F.col("own")
    full = full.withColumn("comm_strength", F.coalesce("comm_strength", F.lit(0.0)) - F.when(mine, F.col("strength")).otherwise(0.0)).withColumn("comm_weight", F.coalesce("comm_weight", F.lit(0.0)) - F.when(mine, F.col("node_weight")).otherwise(0.0))
    gain = objective.delta_insert(F.col("w"), F.col("self_loop"), F.col("strength"), F.col("node_weight"), F.col("comm_strength"), F.col("comm_weight"), m)
    return full.select("node", "community", "own", gain.alias("gain"), "comm_weight", "node_weight")


def best_moves(graph: Graph, partition: DataFrame, objective: Objective, m: float, cap: float | None = None) -> DataFrame:
    """(node, own, community, gain): each node's best move and what it gains over staying; the lowest id of equal ones."""
    options = candidates(graph, partition, objective, m).withColumn("gain", F.round("gain", 9))  # sums' last bits decide nothing
    if cap is not None:
        options = options.where((F.col("community") == F.col("own")) | (F.col("comm_weight") + F.col("node_weight") <= cap))
    base = F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("base")
    best = options.groupBy("node", "own").agg(F.max(F.struct("gain", (-F.col("community")).alias("c"))).alias("best"), base)
    return best.select("node", "own", (-F.col("best.c")).alias("community"), (F.col("best.gain") - F.col("base")).alias("gain"))


def local_move_rounds(graph: Graph, partition: DataFrame, objective: Objective, m: float, seed: int = 42, cap: float | None = None, tolerance: float = 0.0) -> DataFrame:
    """partition after rounds of local moves; see ``rounds.local_moves``."""
    level, table, _ = rounds.local_moves(rounds.Level.of(graph, partition), objective, m, itertools.count(1), seed, cap, tolerance)
    return level.vertices.select("node", "community")


def refine_rounds(graph: Graph, constraint: DataFrame, objective: Objective, m: float, seed: int = 42, randomness: float = 0.01, cap: float | None = None) -> DataFrame:
    """(node, community): singletons merged inside constraint's communities; see ``rounds.refine``."""
    return rounds.refine(rounds.Level.of(graph, constraint), objective, m, itertools.count(1), seed, randomness, cap).select("node", "community")


__all__ = ["Cpm", "LeidenConfig", "Rb", "best_moves", "leiden", "leiden_by_rounds", "local_move_rounds", "louvain", "refine_rounds"]
