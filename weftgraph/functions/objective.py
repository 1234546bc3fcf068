"""Quality functions: Column expressions for DataFrames and the same formulas for arrays.

m is the total edge weight, K a community's strength, k a node's, n a community's node weight, a a node's, g the resolution.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph


class Objective(ABC):
    """A quality function. Its formulas take Columns or numbers and arrays alike."""

    resolution: float

    @abstractmethod
    def delta_insert(self, w_to_c, loop, strength, node_weight, comm_strength, comm_weight, m: float):
        """The gain of putting a node into a community that does not hold it."""

    @abstractmethod
    def community_quality(self, internal, comm_strength, comm_weight, m: float):
        """A community's share of the quality."""

    def quality(self, communities: DataFrame, m: float) -> float:
        """The quality of communities(community, size, weight, strength, internal)."""
        if not m and isinstance(self, Rb):
            return 0.0
        return communities.agg(F.sum(self.community_quality(F.col("internal"), F.col("strength"), F.col("weight"), m))).first()[0] or 0.0


@dataclass(frozen=True)
class Rb(Objective):
    """Modularity with a resolution, in units of edge weight: the quality over m is the modularity."""

    resolution: float = 1.0

    def delta_insert(self, w_to_c, loop, strength, node_weight, comm_strength, comm_weight, m: float):
        if not m:
            return w_to_c * 0.0
        return (w_to_c + loop) - strength * (comm_strength * 2.0 + strength) * self.resolution / (4.0 * m)

    def community_quality(self, internal, comm_strength, comm_weight, m: float):
        return internal - comm_strength * comm_strength * (self.resolution / (4.0 * m)) if m else internal * 0.0


@dataclass(frozen=True)
class Cpm(Objective):
    """The constant Potts model on node weights."""

    resolution: float = 0.05

    def delta_insert(self, w_to_c, loop, strength, node_weight, comm_strength, comm_weight, m: float):
        return (w_to_c + loop) - node_weight * (comm_weight * 2.0 + node_weight - 1.0) * (self.resolution / 2.0)

    def community_quality(self, internal, comm_strength, comm_weight, m: float):
        return internal - comm_weight * (comm_weight - 1.0) * (self.resolution / 2.0)


KINDS = {"rb": Rb, "cpm": Cpm}


def build_objective(kind: str = "rb", resolution: float | None = None) -> Objective:
    """The objective of a kind, with its default resolution unless one is given."""
    return KINDS[kind]() if resolution is None else KINDS[kind](resolution)


def modularity(graph: Graph, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity): the sum over the labels of inside / m - resolution * (K / 2m)^2; 0 without weight. It takes
    its own way through edges and strengths, so that it can check the objectives."""
    l = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    a, b = l.select(F.col("_n").alias("_a"), F.col("_l").alias("_la")), l.select(F.col("_n").alias("_b"), F.col("_l").alias("_lb"))
    inside = graph.edges.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).where("_la = _lb").groupBy(F.col("_la").alias("_i")).agg(F.sum(F.col("weight").cast("double")).alias("inside"))
    degree = graph.strengths().join(l, F.col("id") == F.col("_n")).groupBy("_l").agg(F.sum("strength").alias("degree"))
    m = graph.edges.agg(F.coalesce(F.sum(F.col("weight").cast("double")), F.lit(0.0)).alias("m"))
    rows = degree.join(inside, F.col("_l") == F.col("_i"), "left").join(F.broadcast(m))  # one row
    share: Column = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.lit(resolution) * F.pow(F.col("degree") / (F.col("m") * 2), F.lit(2.0))
    return rows.agg(F.coalesce(F.sum(F.when(F.col("m") > 0, share)), F.lit(0.0)).alias("modularity"))
