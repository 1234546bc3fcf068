"""Partitions (node, community) of a graph, their communities' aggregates and the weights from nodes to communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MembershipLengthMismatch
from .graph import Graph, spread
from .labels import normalized


def singleton(graph: Graph) -> DataFrame:
    return graph.nodes.select(F.col("id").alias("node"), F.col("id").alias("community"))


def from_membership(graph: Graph, membership: DataFrame) -> DataFrame:
    """membership(node, community), one row for every node of the graph."""
    got, expected = membership.count(), graph.node_count()
    if got != expected:
        raise MembershipLengthMismatch(got, expected)
    return membership.select(F.col("node").cast("long").alias("node"), F.col("community").cast("long").alias("community"))


def communities(graph: Graph, partition: DataFrame) -> DataFrame:
    """(community, size, weight, strength, internal): nodes, node weight, strength, and weight inside, each edge and loop once."""
    p = partition.select(F.col("node").alias("_n"), F.col("community").alias("_c"))
    own = graph.nodes.join(graph.strengths().withColumnRenamed("id", "_s"), F.col("id") == F.col("_s")).join(p, F.col("id") == F.col("_n"))
    sums = own.groupBy(F.col("_c").alias("community")).agg(F.count(F.lit(1)).alias("size"), F.sum("node_weight").alias("weight"), F.sum("strength").alias("strength"))
    a, b = p.select(F.col("_n").alias("_a"), F.col("_c").alias("_ca")), p.select(F.col("_n").alias("_b"), F.col("_c").alias("_cb"))
    inside = graph.edges.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).where("_ca = _cb").groupBy(F.col("_ca").alias("_i")).agg(F.sum(F.col("weight").cast("double")).alias("internal"))
    return sums.join(inside, F.col("community") == F.col("_i"), "left").select("community", "size", "weight", "strength", F.coalesce("internal", F.lit(0.0)).alias("internal"))


def slots(partition: DataFrame) -> int:
    """The largest community id plus one, empty ones included."""
    top = partition.agg(F.max("community")).first()[0]
    return 0 if top is None else top + 1


def community_count(partition: DataFrame) -> int:
    return partition.select("community").distinct().count()


def of_communities(asked: DataFrame, table: DataFrame) -> DataFrame:
    """The aggregates of asked(community), zeros for unknown ones."""
    names = ("size", "weight", "strength", "internal")
    return asked.select("community").join(table, "community", "left").select("community", *[F.coalesce(n, F.lit(0).cast(dict(table.dtypes)[n])).alias(n) for n in names])


def empty_community(graph: Graph, node):
    """The id of the empty community that a node can open: no other node's, and no community's in use."""
    return F.lit(graph.node_count()) + node


def moved(partition: DataFrame, moves: DataFrame) -> DataFrame:
    """partition after moves(node, community)."""
    m = moves.select(F.col("node").alias("_n"), F.col("community").alias("_c"))
    return partition.join(m, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("_c", "community").alias("community"))


def renumbered(partition: DataFrame) -> DataFrame:
    """Consecutive ids in the order of the old ones."""
    return normalized(partition.withColumnRenamed("community", "group")).withColumnRenamed("group", "community")


def renumbered_grouping(partition: DataFrame) -> DataFrame:
    return renumbered(partition).withColumnRenamed("community", "group")


def neighbor_weights(graph: Graph, partition: DataFrame, constraint: DataFrame | None = None) -> DataFrame:
    """(node, community, weight): summed weight from each node to each community beside it, its loop left out. With
    constraint(node, community), only between nodes of the same constraint community. Ends are dealt to tasks before each look-up, as
    they are more rows than their bytes tell; ends and nodes are joined by shuffles on both sides, as either could seem small enough to be
    broadcast and would go through the driver."""
    far = partition.select(F.col("node").alias("_n"), "community")
    if constraint is not None:
        k = constraint.select(F.col("node").alias("_k"), F.col("community").alias("_kc")).hint("merge")
        far = far.join(k, F.col("_n") == F.col("_k")).select("_n", "community", F.col("_kc").alias("_far"))
    beside = spread(graph.adjacency().where("node <> nbr"), "nbr").join(far.hint("merge"), F.col("nbr") == F.col("_n"))
    if constraint is not None:
        beside = spread(beside.select("node", "community", "weight", "_far"), "node").join(k, F.col("node") == F.col("_k")).where("_kc between _far and _far")  # an equation would be a key, and rows dealt by both
    return beside.groupBy("node", "community").agg(F.sum("weight").alias("weight"))


def link_changes(links: DataFrame, states: DataFrame) -> DataFrame:
    """(node, from, to, nbr, nbr_from, nbr_to, weight) of the links(node, nbr, weight), both ways and without loops, of all nodes that states(node, from, to) moves."""
    gone = states.where("from <> to").select("node", "from", "to")
    far = states.select(F.col("node").alias("nbr"), F.col("from").alias("nbr_from"), F.col("to").alias("nbr_to"))
    return links.join(gone, "node").join(far, "nbr").select("node", "from", "to", "nbr", "nbr_from", "nbr_to", "weight")


def move_deltas(changes: DataFrame, states: DataFrame) -> DataFrame:
    """(community, size, weight, strength, internal): what the moves of states(node, from, to, strength, node_weight, loop) add to each
    community, with the changes of their links. Deltas of several batches may be summed in any order."""
    side = lambda c, sign, size, weight, strength, internal: F.struct(F.col(c).alias("community"), F.lit(sign * size).cast("long").alias("size"), (weight * sign).alias("weight"), (strength * sign).alias("strength"), (internal * sign).alias("internal"))
    none = F.lit(0.0)
    node = states.where("from <> to").select(F.inline(F.array(*(side(c, sign, 1, F.col("node_weight"), F.col("strength"), F.col("loop")) for c, sign in (("from", -1), ("to", 1))))))
    share = F.col("weight") * F.when(F.col("nbr_from") != F.col("nbr_to"), 0.5).otherwise(1.0)  # a link of two moved nodes is met from both ends
    ends = [F.when(F.col(c) == F.col(f"nbr_{c}"), side(c, sign, 0, none, none, share)) for c, sign in (("from", -1), ("to", 1))]
    link = changes.select(F.inline(F.filter(F.array(*ends), lambda x: x.isNotNull())))
    return node.unionByName(link).groupBy("community").agg(*(F.sum(c).alias(c) for c in ("size", "weight", "strength", "internal")))


def applied(table: DataFrame, deltas: DataFrame) -> DataFrame:
    """A community table with deltas merged in; communities without nodes go."""
    both = table.select("community", "size", "weight", "strength", "internal").unionByName(deltas)
    return both.groupBy("community").agg(*(F.sum(c).alias(c) for c in ("size", "weight", "strength", "internal"))).where("size > 0")


def vertex_states(graph: Graph, partition: DataFrame, moves: DataFrame) -> DataFrame:
    """(node, from, to, strength, node_weight, loop) of all nodes under moves(node, community); a node named twice goes to the smallest one."""
    m = moves.groupBy(F.col("node").alias("_n")).agg(F.min("community").cast("long").alias("_to"))
    own = graph.nodes.join(graph.strengths(), "id").join(graph.self_loops(), "id").select(F.col("id").alias("node"), "node_weight", "strength", F.col("self_loop").alias("loop"))
    return own.join(partition.select("node", F.col("community").alias("from")), "node").join(m, F.col("node") == F.col("_n"), "left").select("node", "from", F.coalesce("_to", "from").alias("to"), "strength", "node_weight", "loop")


def deltas_of(graph: Graph, partition: DataFrame, moves: DataFrame) -> DataFrame:
    """The signed deltas of moves(node, community) from partition(node, community)."""
    states = vertex_states(graph, partition, moves)
    return move_deltas(link_changes(graph.adjacency().where("node <> nbr"), states), states)


def verify(graph: Graph, partition: DataFrame, table: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Communities whose aggregates in table differ from recomputed ones; none if all is well."""
    now = communities(graph, partition)
    names = ("size", "weight", "strength", "internal")
    other = table.select(F.col("community").alias("_c"), *[F.col(n).alias(f"_{n}") for n in names])
    differs = F.col("community").isNull() | F.col("_c").isNull()
    for n in names:
        differs |= F.abs(F.col(n) - F.col(f"_{n}")) > tolerance * F.greatest(F.abs(n), F.lit(1.0))
    return now.join(other, F.col("community") == F.col("_c"), "full").where(differs)
