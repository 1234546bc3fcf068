"""The distributed path: batches of moves as deltas, rounds of local moves, refinement, and whole runs beside the array kernel."""

import itertools

import numpy as np
import pytest

from weftgraph.functions import metrics
from weftgraph.functions.objective import Cpm, Rb, modularity
from weftgraph.operators import leiden, partition, rounds
from weftgraph.operators.graph import Graph
from weftgraph.sources import generators


def random_graph(spark, n, p, seed):
    rng = np.random.default_rng(seed)
    rows = [(a, b, float(np.float32(rng.random() + 0.1))) for a in range(n) for b in range(a, n) if rng.random() < p]
    return Graph.from_edges(n, spark.createDataFrame(rows, "src long, dst long, weight double")), rng


def rows_of(table):
    return {r["community"]: tuple(round(r[c], 5) for c in ("size", "weight", "strength", "internal")) for r in table.collect()}


def test_moves_as_deltas_equal_sums_from_scratch(spark):
    graph, rng = random_graph(spark, 40, 0.2, 1)
    own = spark.createDataFrame([(k, int(rng.integers(5))) for k in range(40)], "node long, community long")
    moves = spark.createDataFrame([(k, int(rng.integers(7))) for k in range(0, 40, 2)], "node long, community long")
    table = partition.communities(graph, own)
    after = partition.applied(table, partition.deltas_of(graph, own, moves))
    assert rows_of(after) == rows_of(partition.communities(graph, partition.moved(own, moves)))
    assert partition.verify(graph, partition.moved(own, moves), after, 1e-6).isEmpty() and not partition.verify(graph, own, after, 1e-6).isEmpty()
    assert partition.deltas_of(graph, own, moves.where("false")).isEmpty()


def test_level_sums_and_coarsening_keep_the_quality(spark):
    graph, rng = random_graph(spark, 30, 0.25, 2)
    own = spark.createDataFrame([(k, (k % 6) * 5) for k in range(30)], "node long, community long")
    level = rounds.Level.of(graph, own)
    assert rows_of(level.communities()) == rows_of(partition.communities(graph, own))
    up = level.coarse(own)
    before, after = rows_of(level.communities()), rows_of(up.communities())
    assert up.n == 6 and {c: x[1:] for c, x in before.items()} == {c: x[1:] for c, x in after.items()}


def test_rounds_send_no_table_through_the_driver(spark):
    graph, _ = random_graph(spark, 24, 0.2, 4)
    level, m = rounds.Level.of(graph), graph.total_weight()
    table, _ = rounds.written_communities(level.communities(), Rb(), m)
    states = level.vertices.select("node", rounds.F.col("community").alias("from"), rounds.F.lit(0).cast("long").alias("to"), "strength", "node_weight", "loop")
    for found in (level.communities(), rounds.best_moves(level, table, Rb(), m, 1, level.vertices.where("node < 9").select("node")), partition.link_changes(level.links, states)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("objective", [Rb(1.0), Cpm(0.2)])
def test_local_moves_end_where_no_single_move_gains(spark, objective):
    graph, _ = random_graph(spark, 24, 0.2, 3)
    m = graph.total_weight()
    level, table, quality = rounds.local_moves(rounds.Level.of(graph), objective, m, itertools.count(1), tolerance=0.0)
    own = level.vertices.select("node", "community")
    assert partition.verify(graph, own, table, 1e-6).isEmpty()
    assert quality == pytest.approx(objective.quality(partition.communities(graph, own), m))
    assert leiden.best_moves(graph, own, objective, m).where("gain > 1e-6").isEmpty()


def test_rounds_find_planted_blocks_and_come_near_the_kernel(spark):
    n, e, truth = generators.stochastic_blocks(spark, 3, 20, 0.5, 0.02, 5)
    graph = Graph.from_edges(n, e)
    found = leiden.leiden_by_rounds(graph, leiden.LeidenConfig(n_iterations=1))
    alone = leiden.leiden_by_rounds(graph, leiden.LeidenConfig(coarse_edges=0, n_iterations=1))  # no level in one task
    assert metrics.nmi(alone, truth) > 0.9 and metrics.disconnected_communities(graph, alone).isEmpty()
    assert metrics.nmi(found, truth) > 0.95 and metrics.disconnected_communities(graph, found).isEmpty()
    assert modularity(graph, found).first()[0] >= 0.99 * modularity(graph, leiden.leiden(graph)).first()[0]


def test_rounds_keep_the_cap(spark):
    n, e, _ = generators.karate(spark)
    found = leiden.leiden_by_rounds(Graph.from_edges(n, e), leiden.LeidenConfig(max_community_weight=5.0, n_iterations=1))
    assert max(r["count"] for r in found.groupBy("label").count().collect()) <= 5 and found.count() == n


def test_rounds_on_empty_and_edgeless_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert leiden.leiden_by_rounds(Graph.from_edges(0, none)).count() == 0
    assert sorted(r["label"] for r in leiden.leiden_by_rounds(Graph.from_edges(3, none)).collect()) == [0, 1, 2]


def test_best_moves_deal_links_by_nodes_alone(spark):
    n, e, _ = generators.ring_of_cliques(spark, 4, 5)
    g = Graph.from_edges(n, e)
    level = rounds.Level.of(g)
    found = rounds.best_moves(level, rounds.written(level.communities(), "communities"), Rb(1.0), g.total_weight(), rounds.FRESH)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(node#" in plan and "hashpartitioning(to#" not in plan and "Broadcast" not in plan
    moves = {r["node"]: r for r in found.collect()}
    assert all(moves[k]["from"] == k and moves[k]["to"] // 5 == k // 5 and moves[k]["gain"] > 0 for k in range(20))
