"""Weighted undirected graphs as a pair of DataFrames.

``nodes(id, node_weight)`` is the dense range 0..n-1 and includes isolated nodes; ``edges(src, dst, weight)`` holds each
undirected edge once with src <= dst. Weights are stored as float and computed with as double. A loop of weight w adds
2w to its node's strength and w to the total weight; its degree is one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import MAX_NODES, AsymmetricGraph, InvalidCsr, InvalidNodeWeight, NegativeWeight, NodeIndexOutOfRange, NodeWeightLengthMismatch, NonFiniteWeight, TooManyNodes

TOLERANCE = 1e-6


def stored(weight: Column) -> Column:
    """A weight as it is stored, ready for arithmetic."""
    return weight.cast("float").cast("double")


def merged_edges(edges: DataFrame, few_parallel: bool = False) -> DataFrame:
    """Canonical edges: parallel ones summed, those of weight zero dropped. One partial and one final aggregate; where few edges are parallel,
    a partial one in the scan would hold all rows and save none, so that edges are dealt to tasks first."""
    low, high = F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")
    rows = edges.select(low, high, stored(F.col("weight")).alias("weight"))
    total = (spread(rows, "src", "dst") if few_parallel else rows).groupBy("src", "dst").agg(F.sum("weight").cast("float").alias("weight"))
    return total.where("weight <> 0")


def directed_edges(edges: DataFrame) -> DataFrame:
    """(node, nbr, weight double): both directions of each edge and a loop once, in one scan without a union."""
    one = F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.col("weight").cast("double").alias("weight"))
    two = F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr"), F.col("weight").cast("double").alias("weight"))
    return edges.select(F.inline(F.when(F.col("src") == F.col("dst"), F.array(one)).otherwise(F.array(one, two))))


def edge_ends(edges: DataFrame) -> DataFrame:
    """(node, weight double): each end of each edge, so that a loop counts twice."""
    w = F.col("weight").cast("double").alias("weight")
    return edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), w), F.struct(F.col("dst").alias("node"), w))))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to many tasks, whatever their bytes: partitions joined by their bytes would leave long work, or many rows that are few bytes, to a few tasks.
    With as many as a shuffle has, and not one more, Spark would take an earlier shuffle by the keys for this one, and join its partitions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *keys)


def prefix_sums(df: DataFrame, key: str, value: str, out: str, width: int = 1 << 16) -> DataFrame:
    """Exclusive running sums of value by key, for non-negative long keys, without a global window: sums within
    ranges of width keys, plus the sums of the ranges before, of which there are few."""
    ranged = df.withColumn("_range", F.floor(F.col(key) / width))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(out, inside).join(before, "_range").withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")


@dataclass(frozen=True)
class Graph:
    """Build one with a constructor below; nodes and edges are canonical then."""

    nodes: DataFrame
    edges: DataFrame

    # constructors

    @classmethod
    def from_edges(cls, n: int, edges: DataFrame, validate: bool = True) -> Graph:
        """Unit node weights; edges(src, dst, weight), one row per undirected edge, repeats summed."""
        if n > MAX_NODES:
            raise TooManyNodes(n)
        return cls.from_edges_with_node_weights(edges.sparkSession.range(n).select("id", F.lit(1.0).alias("node_weight")), edges, validate)

    @classmethod
    def from_edges_with_node_weights(cls, nodes: DataFrame, edges: DataFrame, validate: bool = True, few_parallel: bool = False) -> Graph:
        """nodes(id, node_weight) must be the range 0..n-1; few_parallel as in merged_edges."""
        nodes = nodes.select(F.col("id").cast("long").alias("id"), F.col("node_weight").cast("double").alias("node_weight"))
        if validate:
            check_nodes(nodes)
            check_edges(edges, nodes.count())
        return cls(nodes, merged_edges(edges, few_parallel))

    @classmethod
    def from_coo(cls, n: int, coo: DataFrame, node_weights: DataFrame | None = None) -> Graph:
        """coo(row, col, value) of a sparse matrix: the upper triangle with its diagonal is read, the rest is ignored."""
        upper = coo.where("row <= col and value <> 0").select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").alias("weight"))
        if node_weights is None:
            return cls.from_edges(n, upper)
        got = node_weights.count()
        if got != n:
            raise NodeWeightLengthMismatch(got, n)
        return cls.from_edges_with_node_weights(node_weights, upper)

    @classmethod
    def from_adjacency(cls, n: int, coo: DataFrame, node_weights: DataFrame | None = None, strict: bool = True) -> Graph:
        """coo(row, col, value) of a full symmetric adjacency. The degree sum must be twice the total weight; strict
        also looks at every entry's reverse."""
        own = coo.select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").alias("weight"))
        check_edges(own, n)
        entries = coo.groupBy("row", "col").agg(F.sum(stored(F.col("value"))).cast("float").alias("value")).where("value <> 0")
        total = entries.agg(
            F.sum(F.when(F.col("row") == F.col("col"), 2 * F.col("value").cast("double")).otherwise(F.col("value").cast("double"))),
            F.sum(F.when(F.col("row") <= F.col("col"), F.col("value").cast("double")).otherwise(F.lit(0.0))),
        ).first()
        check_degree_sum(total[0] or 0.0, total[1] or 0.0)
        if strict:
            bad = symmetry_violations(entries).limit(1).collect()
            if bad:
                raise InvalidCsr(bad[0]["problem"])
        graph = cls.from_coo(n, entries, node_weights)
        return graph

    @classmethod
    def from_csr(cls, spark: SparkSession, ptrs: list[int], cols: list[int], values: list[float], node_weights: list[float] | None = None, strict: bool = True) -> Graph:
        """CSR arrays of the full symmetric adjacency; rows need not be sorted and repeats sum."""
        if not len(ptrs):
            raise InvalidCsr("row pointers are empty")
        n = len(ptrs) - 1
        if n > MAX_NODES:
            raise TooManyNodes(n)
        if len(cols) != len(values):
            raise InvalidCsr(f"{len(cols)} column indices but {len(values)} values")
        if ptrs[-1] != len(cols):
            raise InvalidCsr(f"row pointers end at {ptrs[-1]}, but there are {len(cols)} entries")
        if any(a > b for a, b in zip(ptrs, ptrs[1:])) or ptrs[0] != 0:
            raise InvalidCsr("row pointers must start at 0 and never fall")
        if node_weights is not None and len(node_weights) != n:
            raise NodeWeightLengthMismatch(len(node_weights), n)
        rows = [(i, int(cols[k]), float(values[k])) for i in range(n) for k in range(ptrs[i], ptrs[i + 1])]
        coo = spark.createDataFrame(rows, "row long, col long, value double")
        weights = None if node_weights is None else spark.createDataFrame(list(enumerate(map(float, node_weights))), "id long, node_weight double")
        return cls.from_adjacency(n, coo, weights, strict)

    # accessors

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        """Distinct undirected edges, loops included."""
        return self.edges.count()

    def adjacency(self) -> DataFrame:
        return directed_edges(self.edges)

    def neighbors(self, node: int) -> DataFrame:
        return self.adjacency().where(F.col("node") == node).select("nbr", "weight").orderBy("nbr")

    def degrees(self) -> DataFrame:
        """(id, degree): distinct neighbours, a loop is one."""
        own = self.adjacency().groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.join(own, F.col("id") == F.col("node"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def strengths(self) -> DataFrame:
        """(id, strength): summed weights, loops twice."""
        own = edge_ends(self.edges).groupBy("node").agg(F.sum("weight").alias("strength"))
        return self.nodes.join(own, F.col("id") == F.col("node"), "left").select("id", F.coalesce("strength", F.lit(0.0)).alias("strength"))

    def self_loops(self) -> DataFrame:
        """(id, self_loop): a node's loop weight, 0 without one."""
        own = self.edges.where("src = dst").select("src", F.col("weight").cast("double").alias("self_loop"))
        return self.nodes.join(own, F.col("id") == F.col("src"), "left").select("id", F.coalesce("self_loop", F.lit(0.0)).alias("self_loop"))

    def total_weight(self) -> float:
        return self.edges.agg(F.sum(F.col("weight").cast("double"))).first()[0] or 0.0

    def total_node_weight(self) -> float:
        return self.nodes.agg(F.sum("node_weight")).first()[0] or 0.0

    def has_self_loops(self) -> bool:
        return not self.edges.where("src = dst").isEmpty()

    def edge_weight(self, u: int, v: int) -> float | None:
        row = self.edges.where((F.col("src") == min(u, v)) & (F.col("dst") == max(u, v))).first()
        return None if row is None else float(row["weight"])

    def edge_weights(self, pairs: DataFrame) -> DataFrame:
        """(u, v, weight) of pairs(u, v), in either order of the nodes; null where there is no edge."""
        own = self.edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("weight").cast("double").alias("weight"))
        return pairs.select("u", "v").join(own, (F.least("u", "v") == F.col("_s")) & (F.greatest("u", "v") == F.col("_d")), "left").select("u", "v", "weight")

    def density(self) -> float:
        """Edges over pairs of nodes, loops counted with the edges; 0 under two nodes."""
        n = self.node_count()
        return self.edge_count() / (n * (n - 1) / 2) if n > 1 else 0.0

    def memory_bytes(self) -> int:
        """Bytes of the compressed rows that would hold the graph: 8 for each row's start, 8 for each entry, 16 for a node."""
        n, entries = self.node_count(), self.adjacency().count()
        return 8 * (n + 1) + 8 * entries + 16 * n

    def __repr__(self) -> str:
        return f"Graph({self.node_count()} nodes, {self.edge_count()} edges, total_weight: {self.total_weight()}, density: {self.density():.4f})"

    # exports

    def to_coo(self) -> DataFrame:
        """(row, col, value double): symmetric, a loop's weight once on the diagonal."""
        return self.adjacency().select(F.col("node").alias("row"), F.col("nbr").alias("col"), F.col("weight").alias("value"))

    def csr_rows(self) -> DataFrame:
        """(id, start, nbrs, weights): a row of the adjacency with its offset, ascending neighbours."""
        own = self.adjacency().groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nbr", F.col("weight").cast("float").alias("weight")))).alias("row"))
        rows = self.nodes.join(own, F.col("id") == F.col("node"), "left").select("id", F.coalesce(F.size("row"), F.lit(0)).alias("n"), "row")
        rows = rows.withColumn("n", F.greatest("n", F.lit(0)).cast("long"))
        return prefix_sums(rows, "id", "n", "start").select("id", "start", F.coalesce(F.col("row.nbr"), F.array().cast("array<long>")).alias("nbrs"), F.coalesce(F.col("row.weight"), F.array().cast("array<float>")).alias("weights"))

    def to_csr(self) -> tuple[list[int], list[int], list[float]]:
        """The CSR arrays on the driver, for graphs that fit there."""
        rows = self.csr_rows().orderBy("id").collect()
        ptrs, cols, values = [0], [], []
        for r in rows:
            cols += r["nbrs"]
            values += r["weights"]
            ptrs.append(len(cols))
        return ptrs, cols, values

    # checks and coarsening

    def validate_symmetry(self) -> None:
        bad = symmetry_violations(self.to_coo()).limit(1).collect()
        if bad:
            raise InvalidCsr(bad[0]["problem"])

    def check_degree_sum(self) -> None:
        check_degree_sum(self.strengths().agg(F.sum("strength")).first()[0] or 0.0, self.total_weight())

    def aggregate(self, grouping: DataFrame) -> Graph:
        """One node per group of grouping(node, group), groups 0..k-1: node weights are summed, weight inside a group becomes its
        loop, weight between two groups their edge."""
        g = grouping.select(F.col("node").alias("_n"), F.col("group").alias("_g"))
        nodes = self.nodes.join(g, F.col("id") == F.col("_n")).groupBy(F.col("_g").alias("id")).agg(F.sum("node_weight").alias("node_weight"))
        ends = self.edges.join(g, F.col("src") == F.col("_n")).select(F.col("_g").alias("a"), "dst", "weight").join(g, F.col("dst") == F.col("_n")).select(F.col("a").alias("src"), F.col("_g").alias("dst"), "weight")
        return Graph(nodes, merged_edges(ends))


def check_nodes(nodes: DataFrame) -> None:
    """Finite, non-negative weights and the ids 0..n-1, in one aggregate."""
    w = F.col("node_weight")
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == math.inf) | (w < 0)
    row = nodes.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_distinct("id").alias("kinds"), F.min_by(F.struct("id", "node_weight"), F.when(bad, F.col("id"))).alias("bad"), F.count_if(bad).alias("n_bad")).first()
    if row["n"] > MAX_NODES:
        raise TooManyNodes(row["n"])
    if row["n_bad"]:
        raise InvalidNodeWeight(row["bad"]["id"], row["bad"]["node_weight"])
    if row["n"] and (row["lo"] != 0 or row["hi"] != row["n"] - 1 or row["kinds"] != row["n"]):
        raise NodeIndexOutOfRange(row["hi"] if row["hi"] >= row["n"] else row["lo"], row["n"])


def edge_problem(n: int) -> Column:
    """The first thing wrong with an edge: source out of range, target out of range, not finite, negative; else null."""
    w = F.col("weight").cast("double")
    kept = w.cast("float")  # what is stored must be finite too
    return (
        F.when(F.col("src").isNull() | (F.col("src") < 0) | (F.col("src") >= n), "src out of range")
        .when(F.col("dst").isNull() | (F.col("dst") < 0) | (F.col("dst") >= n), "dst out of range")
        .when(w.isNull() | F.isnan(w) | (F.abs(kept) == math.inf), "not finite")
        .when(w < 0, "negative")
    )


def edge_validation_report(edges: DataFrame, n: int) -> DataFrame:
    """(problem, n_edges) of the edges that are refused."""
    return edges.withColumn("problem", edge_problem(n)).where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n_edges"))


def check_edges(edges: DataFrame, n: int) -> None:
    row = edges.withColumn("problem", edge_problem(n)).where("problem is not null").first()
    if row is None:
        return
    edge = row["src"], row["dst"]
    if row["problem"] == "src out of range":
        raise NodeIndexOutOfRange(row["src"], n)
    if row["problem"] == "dst out of range":
        raise NodeIndexOutOfRange(row["dst"], n)
    raise NonFiniteWeight(edge) if row["problem"] == "not finite" else NegativeWeight(edge, row["weight"])


def check_degree_sum(degree_sum: float, total_weight: float) -> None:
    expected = 2 * total_weight
    if not abs(degree_sum - expected) <= TOLERANCE * max(abs(expected), 1.0):
        raise AsymmetricGraph(degree_sum, expected)


def symmetry_violations(coo: DataFrame) -> DataFrame:
    """(row, col, value, reverse, problem) of entries whose reverse is missing or differs."""
    a = coo.select("row", "col", F.col("value").cast("double").alias("value"))
    b = coo.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").cast("double").alias("reverse"))
    both = a.join(b, (a["row"] == b["c"]) & (a["col"] == b["r"]), "full")
    problem = F.when(F.col("value").isNull() | F.col("reverse").isNull(), "missing reverse entry").when(F.abs(F.col("value") - F.col("reverse")) > TOLERANCE * F.greatest(F.abs("value"), F.lit(1.0)), "mismatched entries")
    return both.select(F.coalesce("row", "c").alias("row"), F.coalesce("col", "r").alias("col"), "value", "reverse", problem.alias("problem")).where("problem is not null")
