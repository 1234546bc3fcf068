"""Closed forms and invariants of the graph engine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import errors
from weftgraph.functions import metrics
from weftgraph.functions.objective import Cpm, Rb, modularity
from weftgraph.operators import kernel, knn, labels, leiden, partition
from weftgraph.operators.components import components
from weftgraph.operators.graph import Graph
from weftgraph.sources import generators


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def test_loop_counts_twice_in_strength(spark):
    g = Graph.from_edges(3, edges_of(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (0, 0, 3.0)]))
    assert dict(g.strengths().collect()) == {0: 8.0, 1: 2.0, 2: 2.0}
    assert g.total_weight() == 6.0 and g.edge_count() == 4 and g.has_self_loops()
    assert dict(g.degrees().collect())[0] == 3


def test_parallel_edges_sum_zero_edges_go_and_isolated_nodes_stay(spark):
    g = Graph.from_edges(4, edges_of(spark, [(0, 1, 1.0), (1, 0, 2.0), (1, 2, 0.0)]))
    assert [tuple(r) for r in g.edges.collect()] == [(0, 1, 3.0)]
    assert dict(g.strengths().collect())[3] == 0.0 and g.edge_weight(1, 0) == 3.0 and g.edge_weight(2, 3) is None


@pytest.mark.parametrize(
    ("row", "error"),
    [((0, 9, 1.0), errors.NodeIndexOutOfRange), ((0, 1, -1.0), errors.NegativeWeight), ((0, 1, float("nan")), errors.NonFiniteWeight), ((0, 1, 1e300), errors.NonFiniteWeight)],
)
def test_bad_edges_are_refused(spark, row, error):
    with pytest.raises(error):
        Graph.from_edges(3, edges_of(spark, [row]))


def test_csr_round_trip_and_asymmetry(spark):
    n, e, _ = generators.karate(spark)
    g = Graph.from_edges(n, e)
    ptrs, cols, values = g.to_csr()
    again = Graph.from_csr(spark, ptrs, cols, values)
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    with pytest.raises(errors.AsymmetricGraph):
        Graph.from_csr(spark, [0, 1, 1], [1], [1.0])
    with pytest.raises(errors.InvalidCsr):
        Graph.from_csr(spark, [0, 2, 1], [1], [1.0])


def test_karate_modularity_and_quality(spark):
    n, e, truth = generators.karate(spark)
    g = Graph.from_edges(n, e)
    q = modularity(g, truth).first()[0]
    assert q == pytest.approx(0.4197896120973044)
    table = partition.communities(g, truth.withColumnRenamed("label", "community"))
    assert Rb(1.0).quality(table, 78.0) / 78 == pytest.approx(q)
    coarse = g.aggregate(truth.withColumnRenamed("label", "group"))
    assert coarse.total_weight() == 78.0
    own = partition.communities(coarse, partition.singleton(coarse))
    assert Cpm(0.05).quality(own, 78.0) == pytest.approx(Cpm(0.05).quality(table, 78.0))


def test_leiden_on_karate_and_ring(spark):
    n, e, truth = generators.karate(spark)
    g = Graph.from_edges(n, e)
    found = leiden.leiden(g)
    assert modularity(g, found).first()[0] == pytest.approx(0.41979, abs=1e-5) and labels.n_clusters(found) == 4
    assert metrics.disconnected_communities(g, found).isEmpty()
    n, e, cliques = generators.ring_of_cliques(spark, 20, 5)
    found = leiden.leiden(Graph.from_edges(n, e), leiden.LeidenConfig(objective=Cpm(0.1)))
    assert metrics.ari(found, cliques) == pytest.approx(1.0)


def test_empty_and_edgeless_graphs(spark):
    assert leiden.leiden(Graph.from_edges(0, edges_of(spark, []))).count() == 0
    assert labels.n_clusters(leiden.leiden(Graph.from_edges(3, edges_of(spark, [])))) == 3


def test_labels_renumber_in_their_two_orders(spark):
    rows = spark.createDataFrame([(0, 7), (1, 3), (2, -1), (3, 7)], "node long, label long")
    assert dict(labels.from_labels(rows).collect()) == {0: 0, 1: 1, 2: -1, 3: 0}
    groups = spark.createDataFrame([(0, 7), (1, 3), (2, 9)], "node long, group long")
    assert dict(labels.normalized(groups).collect()) == {0: 1, 1: 0, 2: 2}


def test_components(spark):
    e = edges_of(spark, [(k, k + 1, 1.0) for k in range(20)] + [(30, 31, 1.0), (40, 40, 1.0)])
    found = dict(components(e).collect())
    assert {found[k] for k in range(21)} == {0} and found[31] == 30 and found[40] == 40


def test_tasks_put_together_what_their_edges_link(spark):
    from weftgraph.operators.components import least_linked, linked_in_tasks

    rng = np.random.default_rng(14)
    u, v = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    ids, root = least_linked(u, v)
    group = {int(k): {int(k)} for k in ids}
    for a, b in zip(u.tolist(), v.tolist()):
        both = group[a] | group[b]
        for k in both:
            group[k] = both
    assert dict(zip(ids.tolist(), root.tolist())) == {k: min(x) for k, x in group.items()}
    dense = spark.createDataFrame([(c * 60 + a, c * 60 + 30 + b) for c in range(3) for a in range(30) for b in range(30)], "src long, dst long").repartition(4)
    assert linked_in_tasks(dense.toDF("u", "v")).count() < 400  # 2,700 edges of 180 nodes
    assert dict(components(dense).collect()) == {k: k // 60 * 60 for k in range(180)}


def test_components_are_solved_in_tasks_of_their_own(spark):
    n, e, truth = generators.ring_of_cliques(spark, 6, 5)
    g = Graph.from_edges(n, e.where("floor(src / 5) = floor(dst / 5)"))
    comps = truth.select("node", (F.col("label") * 5).alias("component"))
    found = leiden.kernel_labels(g, comps, leiden.LeidenConfig(), g.total_weight())
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    assert {r["node"]: r["label"] for r in found.collect()} == {k: k // 5 * 5 for k in range(30)}


@pytest.mark.parametrize(("cells", "big"), [(0, 1), (0, 1 << 45), (8, 1), (10**6, 1)])  # 1 << 45: keys and places do not fit in one number
def test_sums_of_pairs_and_the_best_of_a_row(cells, big, monkeypatch):
    monkeypatch.setattr(kernel, "CELLS", cells)
    rng = np.random.default_rng(15)
    row, col, w = np.concatenate((np.arange(50), rng.integers(0, 50, 850))), rng.integers(0, 40, 900) * 7, rng.random(900)
    total: dict = {}
    for a, b, x in zip(row.tolist(), col.tolist(), w.tolist()):
        total[a, b] = total.get((a, b), 0.0) + x
    k, to, got = kernel.summed(row * big, col, w, 50 * big, 280)
    assert list(zip((k // big).tolist(), to.tolist())) == sorted(total) and got.tolist() == [total[x] for x in sorted(total)]
    value = np.round(got, 1)  # some are equal
    assert kernel.best_of(k // big, value, 50).tolist() == np.lexsort((to, -value, k))[np.searchsorted(k // big, np.arange(50))].tolist()


def test_bad_config():
    with pytest.raises(errors.InvalidConfig):
        leiden.LeidenConfig(tolerance=float("nan")).validate()


def small_graph(n, edges, weights=None):
    src, dst = np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int)
    w = np.ones(len(edges)) if weights is None else np.asarray(weights, float)
    return kernel.Arrays.build(n, src, dst, w, np.ones(n)), float(w.sum())


def brute_quality(n, edges, weights, member, objective, m):
    """The quality by loops over communities and edges."""
    total = 0.0
    for c in set(member):
        inside = sum(w for (a, b), w in zip(edges, weights) if member[a] == member[b] == c)
        strength = sum(w * ((member[a] == c) + (member[b] == c)) for (a, b), w in zip(edges, weights))
        total += objective.community_quality(inside, strength, float(list(member).count(c)), m)
    return total


def random_edges(rng, n, p, loops=False):
    return [(a, b) for a in range(n) for b in range(a if loops else a + 1, n) if rng.random() < p]


@pytest.mark.parametrize("objective", [Rb(1.0), Rb(0.5), Cpm(0.3)])
def test_kernel_sums_follow_moves(objective):
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 14))
        edges = random_edges(rng, n, 0.4, loops=True)
        weights = rng.random(len(edges)) + 0.1
        graph, m = small_graph(n, edges, weights)
        member = rng.integers(0, n, n)
        nodes = np.flatnonzero(rng.random(n) < 0.5)
        to = rng.integers(0, n, len(nodes))
        trial, sums, more = kernel.after(graph, member, kernel.sums_of(graph, member), nodes, to, objective, m)
        before, then = (brute_quality(n, edges, weights, x.tolist(), objective, m) for x in (member, trial))
        assert kernel.quality(graph, member, objective, m) == pytest.approx(before) and more == pytest.approx(then - before)
        for x, y in zip(sums, kernel.sums_of(graph, trial)):
            assert x == pytest.approx(y)


def partitions(n):
    """All partitions of n nodes, as restricted growth strings."""
    def grow(head, top):
        if len(head) == n:
            yield head
            return
        for c in range(top + 1):
            yield from grow([*head, c], max(top, c + 1))

    return grow([], 0)


def test_leiden_reaches_the_exhaustive_optimum_of_small_graphs():
    assert sum(1 for _ in partitions(5)) == 52
    rng, hits, worst = np.random.default_rng(1), 0, 0.0
    cases = [(6 + k % 3, random_edges(rng, 6 + k % 3, 0.2 + 0.05 * (k % 8))) for k in range(24)]
    cases.append((8, [(a, b) for s in (0, 4) for a in range(s, s + 4) for b in range(a + 1, s + 4)] + [(3, 4)]))
    for n, edges in cases:
        if not edges:
            hits += 1
            continue
        graph, m = small_graph(n, edges)
        best = max(kernel.quality(graph, np.array(x), Rb(1.0), m) for x in partitions(n))
        got = kernel.quality(graph, np.array(kernel.leiden(graph, Rb(1.0), m, leiden.LeidenConfig())), Rb(1.0), m)
        hits += got >= best - 1e-9
        worst = max(worst, (best - got) / m)
    assert hits >= 0.9 * len(cases) and worst < 0.05


def test_leiden_invariants_on_random_and_degenerate_graphs():
    rng = np.random.default_rng(7)
    graphs = [(int(n), random_edges(rng, int(n), 0.6 * rng.random() ** 2 + 0.01, loops=bool(k % 3 == 0))) for k, n in enumerate(rng.integers(1, 60, 60))]
    graphs += [(1, []), (4, []), (2, [(0, 1)]), (3, [(0, 0), (2, 2)]), (9, [(0, k) for k in range(1, 9)]), (12, [(k, k + 1) for k in range(11)])]
    for n, edges in graphs:
        weights = rng.random(len(edges)) + 0.05
        graph, m = small_graph(n, edges, weights)
        for objective in (Rb(1.0), Cpm(0.1)):
            labels_ = np.array(kernel.leiden(graph, objective, m, leiden.LeidenConfig()))
            kinds, first = np.unique(labels_, return_index=True)
            assert list(kinds) == list(range(len(kinds))) and list(first) == sorted(first)
            assert kernel.quality(graph, labels_, objective, m) >= kernel.quality(graph, np.arange(n), objective, m) - 1e-9
            for c in kinds:  # every community hangs together
                inside = {int(v) for v in np.flatnonzero(labels_ == c)}
                seen, todo = set(), [min(inside)]
                while todo:
                    v = todo.pop()
                    if v not in seen:
                        seen.add(v)
                        todo += [int(u) for u in graph.nbr[graph.ptr[v] : graph.ptr[v + 1]] if int(u) in inside]
                assert seen == inside
        assert (np.bincount(kernel.leiden(graph, Rb(1.0), m, leiden.LeidenConfig(max_community_weight=4.0)), minlength=1) <= 4).all()
        assert kernel.leiden(graph, Rb(1.0), m, leiden.LeidenConfig(seed=5)) == kernel.leiden(graph, Rb(1.0), m, leiden.LeidenConfig(seed=5))


@pytest.mark.parametrize(("blocks", "size", "p_in", "p_out", "seed"), [(6, 60, 0.25, 0.01, 11), (4, 40, 0.35, 0.02, 5)])
def test_leiden_finds_planted_blocks(spark, blocks, size, p_in, p_out, seed):
    n, e, truth = generators.stochastic_blocks(spark, blocks, size, p_in, p_out, seed)
    assert metrics.nmi(leiden.leiden(Graph.from_edges(n, e), leiden.LeidenConfig(one_task_edges=0 if blocks == 4 else 100_000)), truth) > 0.95


def test_leiden_by_rounds_comes_near_the_kernel(spark):
    n, e, truth = generators.ring_of_cliques(spark, 4, 5)
    g = Graph.from_edges(n, e)
    found = leiden.leiden(g, leiden.LeidenConfig(kernel_max_edges=3, one_task_edges=3, n_iterations=1))
    assert metrics.ari(found, truth) == pytest.approx(1.0) and metrics.disconnected_communities(g, found).isEmpty()


def test_nearest_keeps_ties_by_id_and_recall_over_many_buckets(spark):
    rng = np.random.default_rng(2)
    same = [(k, [0.5, 0.25]) for k in range(60)] + [(k, rng.random(2).tolist()) for k in range(60, 200)]
    points = spark.createDataFrame(same, "id long, features array<float>")
    rows = knn.nearest_exact(points, 5).collect()
    assert {k: [r["j"] for r in sorted(rows, key=lambda r: r["r"]) if r["i"] == k] for k in range(60)} == {k: [0, 1, 2, 3, 4, 5] for k in range(60)}
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<float>")
    exact = {(r["i"], r["j"]) for r in knn.nearest_exact(points, 10).collect()}
    near = knn.nearest_approximate(points, 10, cell=150).collect()
    assert len(near) == 1500 * 11 and len(exact & {(r["i"], r["j"]) for r in near}) >= 0.9 * len(exact)
    d2 = ((x[:, None].astype(float)[:50] - x[None].astype(float)) ** 2).sum(2)
    assert all(r["d2"] == pytest.approx(d2[r["i"], r["j"]]) for r in near if r["i"] < 50)
    few = spark.createDataFrame([(3,), (7,)], "id long")
    assert {r["i"] for r in knn.nearest_exact(points, 10, queries=few).collect()} == {3, 7}


def test_recall_holds_for_centred_and_shifted_points(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)) + rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)] * 2
    for shift in (0.0, 5.0):
        points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate((x + shift).astype(np.float32))], "id long, features array<float>")
        row = knn.recall(points, knn.nearest_approximate(points, 10, cell=150), 10).first()
        assert row["queries"] == 30 and row["total"] == 330 and row["hits"] >= 0.9 * row["total"]


def test_pivots_give_exact_lists_with_fewer_pairs(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    x = (rng.normal(size=(600, 3)) + rng.integers(0, 6, (600, 1)) * 20).astype(np.float32)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate([*x, *x[:40]])], "id long, features array<float>")
    taxi = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    found, pairs = knn.nearest_by_pivots(points, 5, taxi)
    key = lambda rows: sorted((r["i"], r["r"], r["j"], round(r["d2"], 9)) for r in rows)
    assert key(found.collect()) == key(knn.nearest_exact(points, 5, metric=taxi).collect())
    row = pairs.first()
    assert row["all_pairs"] == 640 * 640 and row["compared"] < 0.4 * row["all_pairs"]


def test_pivots_on_arrays_give_the_exact_lists(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    x = (rng.normal(size=(600, 3)) + rng.integers(0, 6, (600, 1)) * 20).astype(np.float32)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate([*x, *x[:40]])], "id long, features array<float>")
    taxi = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    key = lambda rows: sorted((r["i"], r["r"], r["j"], round(r["d2"], 9)) for r in rows)
    found, pairs = knn.nearest_by_pivots(points, 5, knn.TAXICAB)
    assert key(found.collect()) == key(knn.nearest_exact(points, 5, metric=taxi).collect()) == key(knn.nearest_exact(points, 5, metric=knn.TAXICAB).collect())
    row = pairs.first()
    assert row["all_pairs"] == 640 * 640 and row["compared"] < 0.4 * row["all_pairs"]


@pytest.mark.parametrize("metric, order", [(knn.SQUARED, 2), (knn.TAXICAB, 1)])
def test_rough_tables_lose_no_neighbour(metric, order):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 5)) * 1e-3 + 1e4  # far from the origin
    x[1000:1400] = x[5]  # more copies than a list holds
    x[17, 2] = np.inf
    ids = rng.permutation(len(x))
    q = x[:30]
    row, j, d = knn.nearest_of(q[np.arange(30) != 17], ids, x, 6, metric)
    for at, v in enumerate(q[np.arange(30) != 17]):
        own = (np.abs(v - x) ** order).sum(1)
        best = np.lexsort((ids, own))[:7]
        assert j[row == at].tolist() == ids[best].tolist() and d[row == at] == pytest.approx(own[best])


def test_points_that_cells_do_not_tell_apart_are_searched_exactly(spark):
    x = np.random.default_rng(12).normal(size=(1200, 32)).astype(np.float32)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<float>")
    key = lambda rows: sorted((r["i"], r["r"], r["j"]) for r in rows)
    assert key(knn.nearest_approximate(points, 10, cell=60).collect()) == key(knn.nearest_exact(points, 10).collect())


def test_points_in_cells_ask_in_few_of_them(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = (rng.normal(size=(2400, 4)) * 0.01 + rng.normal(size=(40, 4))[rng.integers(0, 40, 2400)]).astype(np.float32)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<float>")
    true = {(r["i"], r["j"]) for r in knn.nearest_exact(points, 10).collect()}
    monkeypatch.setattr(knn, "MOST_PROBES", 2)  # cells are made larger on the way
    found = {(r["i"], r["j"]) for r in knn.nearest_approximate(points, 10, cell=60).collect()}
    assert len(found) == len(true) and len(found & true) >= 0.9 * len(true)


def test_a_graph_of_points_is_searched_once(spark):
    x = np.random.default_rng(3).normal(size=(120, 4))
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>").mapInPandas(counted, "id long, features array<double>")
    g = knn.knn_graph(points, 5)
    before = seen.value
    found = leiden.leiden(g)
    assert found.count() == 120 and metrics.disconnected_communities(g, found).isEmpty()
    assert seen.value == before > 0


@pytest.mark.parametrize("name", ["best_move_per_node", "knn_graph", "leiden_capped", "leiden_cpm", "louvain_embeddings"])
def test_graphs_of_points_rest_on_exact_lists_whatever_their_number(spark, tmp_path, monkeypatch, name):
    from weftgraph.plans import catalogue

    x = np.random.default_rng(16).normal(size=(90, 3)).astype(np.float32)
    spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = lambda: sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
    own = rows()
    monkeypatch.setattr(knn, "APPROXIMATE_FROM", 10, raising=False)  # the switch there was
    monkeypatch.setattr(knn, "nearest_approximate", lambda *_: pytest.fail("searched approximately"))
    monkeypatch.setattr(knn, "BLOCK", 12)  # blocks change nothing either
    assert rows() == own


def test_knn_recall_asks_for_all_points(spark, tmp_path):
    from weftgraph.plans import catalogue

    x = np.random.default_rng(17).normal(size=(250, 6)).astype(np.float32)
    spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalogue.knn_recall(spark, str(tmp_path)).collect() == [(250, 250 * 16, True)]


def test_a_graph_is_read_and_solved_once(spark):
    n, e, _ = generators.ring_of_cliques(spark, 6, 5)
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    g = Graph(spark.range(n).select("id", F.lit(1.0).alias("node_weight")), e.mapInPandas(counted, "src long, dst long, weight double"))
    for config in (leiden.LeidenConfig(), leiden.LeidenConfig(one_task_edges=0)):
        before = seen.value
        found = leiden.leiden(g, config)
        assert seen.value - before == e.count()
        assert labels.n_clusters(found) == 6 and found.count() == n
        assert seen.value - before == e.count()


def test_edges_and_their_ends_are_spread_over_tasks(spark):
    """Rows that are few bytes: partitions joined by their bytes would be one task's. What is found equals a plain loop over the edges."""
    rows = [(a, b, 1.0) for a in range(12) for b in range(12) if a != b] + [(3, 3, 5.0)]
    g = Graph.from_edges_with_node_weights(spark.range(12).select("id", F.lit(1.0).alias("node_weight")), edges_of(spark, rows), few_parallel=True)
    p = spark.createDataFrame([(v, v // 5) for v in range(12)], "node long, community long")
    k = p.select("node", (F.col("node") % 2).alias("community"))
    inside = partition.neighbor_weights(g, p, k)
    assert g.edges.rdd.getNumPartitions() == 5 and inside.rdd.getNumPartitions() == 5
    for found, step in ((partition.neighbor_weights(g, p), 1), (inside, 2)):
        want = {}
        for a, b, w in rows:
            if a != b and a % step == b % step:
                want[a, b // 5] = want.get((a, b // 5), 0.0) + 2 * w  # both rows of a pair are one edge
        assert {(r["node"], r["community"]): r["weight"] for r in found.collect()} == want


def test_ends_and_nodes_are_not_broadcast(spark):
    """Tables of few bytes: what is broadcast goes through the driver, and edges and nodes in files are more rows than their bytes tell."""
    g = Graph.from_edges(12, edges_of(spark, [(a, b, 1.0) for a in range(12) for b in range(a)]))
    p = spark.range(12).select(F.col("id").alias("node"), F.expr("id div 5").alias("community"))
    for found in (partition.neighbor_weights(g, p), partition.neighbor_weights(g, p, p.select("node", (F.col("node") % 2).alias("community")))):
        assert "SortMergeJoin" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Broadcast" not in plan
