"""Batches of graphs, exhaustive optima, fixtures, and CSR arrays in files and as relations."""

import numpy as np
import pytest

from weftgraph import errors
from weftgraph.functions import metrics
from weftgraph.functions.objective import Cpm, Rb
from weftgraph.operators import batches, kernel, leiden, partition
from weftgraph.operators.graph import Graph
from weftgraph.plans import catalogue
from weftgraph.sources import csr, files, generators


@pytest.fixture(scope="module")
def some(spark):
    batch = batches.sampled_batch(spark, 12, 9)
    return batches.GraphBatch(spark.createDataFrame(batch.nodes.collect(), batch.nodes.schema), spark.createDataFrame(batch.edges.collect(), batch.edges.schema))


def arrays_of(batch, key):
    n = batch.nodes.where(batch.nodes.graph == key).count()
    e = batch.edges.where(batch.edges.graph == key).collect()
    w = np.array([r["weight"] for r in e], float)
    return kernel.Arrays.build(n, np.array([r["src"] for r in e], int), np.array([r["dst"] for r in e], int), w, np.ones(n)), float(w.sum())


def strings(n):
    out = [[0]]
    for _ in range(n - 1):
        out = [[*s, c] for s in out for c in range(max(s) + 2)]
    return out


def test_growth_strings_are_all_partitions(spark):
    got = {}
    for r in batches.growth_strings(spark, 6).collect():
        got.setdefault(r["n"], []).append(list(r["string"]))
    assert {n: len(x) for n, x in got.items()} == {1: 1, 2: 2, 3: 5, 4: 15, 5: 52, 6: 203} and sorted(got[5]) == sorted(strings(5))


@pytest.mark.parametrize("objective", [Rb(1.0), Cpm(0.4)])
def test_optimum_and_batch_leiden_equal_each_graph_alone(spark, some, objective):
    found = some.leiden(leiden.LeidenConfig(objective=objective)).collect()
    best = {r["graph"]: r for r in some.optimum(objective, 8).collect()}
    part = spark.createDataFrame([(r["graph"], r["node"], r["label"]) for r in found], "graph long, node long, community long")
    quality = {r["graph"]: r["quality"] for r in some.qualities(part, objective).collect()}
    for key in range(12):
        graph, m = arrays_of(some, key)
        own = [r["label"] for r in sorted((r for r in found if r["graph"] == key), key=lambda r: r["node"])]
        assert own == list(kernel.leiden(graph, objective, m, leiden.LeidenConfig(objective=objective)))
        assert quality[key] == pytest.approx(kernel.quality(graph, np.array(own), objective, m), abs=1e-6)
        if len(graph) <= 8:
            all_ = [(kernel.quality(graph, np.array(s), objective, m), s) for s in strings(len(graph))]
            assert best[key]["quality"] == pytest.approx(max(q for q, _ in all_), abs=1e-6)
            assert kernel.quality(graph, np.array(best[key]["community"]), objective, m) == pytest.approx(best[key]["quality"], abs=1e-6)
            assert quality[key] <= best[key]["quality"] + 1e-6
        else:
            assert key not in best


def test_small_graphs_are_spread_over_tasks(spark, some):
    """Few bytes and long work: partitions joined by their bytes would be one task's."""
    assert some.optimum(most=8).rdd.getNumPartitions() == 5


def test_batch_leiden_is_spread_over_tasks_and_solved_once(some):
    assert len(some.leiden().inputFiles()) > 1


def test_optimum_takes_the_first_of_equal_partitions_and_ten_nodes(spark):
    nodes = spark.createDataFrame([(g, k) for g, n in enumerate((3, 4, 10, 11)) for k in range(n)], "graph long, id long")
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (1, 2, 3, 1.0), (1, 1, 2, 0.5), (1, 3, 3, 0.5), *((2, k, k + 1, 1.0) for k in range(9))], "graph long, src long, dst long, weight double")
    best = {r["graph"]: (r["n_nodes"], r["quality"], list(r["community"])) for r in batches.GraphBatch.from_edges(nodes, edges).optimum().collect()}
    assert best[0] == (3, 0.0, [0, 0, 0]) and best[1][::2] == (4, [0, 0, 1, 1]) and best[1][1] == pytest.approx(2.5 - (2.5**2 + 3.5**2) / 12) and best[2][1] == pytest.approx(7 - (5**2 + 6**2 + 7**2) / 36)
    assert sorted(best) == [0, 1, 2]  # eleven nodes are too many


def test_batch_sums_equal_each_graph_alone_and_the_odd_ones(spark, some):
    odd = batches.degenerate_batch(spark)
    own = odd.leiden().withColumnRenamed("label", "community")
    table = odd.communities(own)
    for key in ("loops only", "barbell", "one node"):
        graph = odd.alone(key)
        p = own.where(own.graph == key).drop("graph")
        want = sorted(tuple(r) for r in partition.communities(graph, p).collect())
        assert sorted(tuple(r)[1:] for r in table.where(table.graph == key).collect()) == want
    totals = {r["graph"]: tuple(r)[1:] for r in odd.totals().collect()}
    assert totals["no edges"] == (5, 0, 0.0, 5.0) and totals["barbell"] == (10, 21, 21.0, 10.0) and len(totals) == 9
    sizes = {(r["graph"], r["size"]) for r in table.collect()}
    assert ("barbell", 5) in sizes and ("separate cliques", 5) in sizes and ("no edges", 1) in sizes


def test_sums_of_small_graphs_are_spread_over_tasks_and_keep_ends_beside_unlabelled_nodes(spark):
    """Rows that are few bytes: partitions joined by their bytes would be one task's."""
    nodes = spark.createDataFrame([(g, v) for g in range(3) for v in range(4)], "graph long, id long")
    edges = spark.createDataFrame([(g, *e) for g in range(3) for e in ((0, 1, 2.0), (1, 2, 1.0), (2, 3, 4.0), (3, 3, 8.0))], "graph long, src long, dst long, weight double")
    part = nodes.where("id <> 2").selectExpr("graph", "id node", "id div 2 community")
    for small in (True, False):
        table = batches.GraphBatch.from_edges(nodes, edges, small).communities(part)
        assert {tuple(r) for r in table.collect()} == {x for g in range(3) for x in ((g, 0, 2, 2.0, 5.0, 2.0), (g, 1, 1, 1.0, 20.0, 8.0))}
        assert not small or table.rdd.getNumPartitions() == 5
    b = catalogue.order_batch(spark, "/root/testdata/sf0.001")
    assert b.small and b.edges.rdd.getNumPartitions() == 5


def test_fixture_documents_round_trip_to_a_summary(spark, some, tmp_path):
    from pyspark.sql import functions as F

    members = some.leiden().select(F.concat(F.lit("case "), "graph").alias("name"), F.col("graph").cast("string").alias("graph"), "node", F.col("label").alias("community"))
    text = batches.GraphBatch(some.nodes.withColumn("graph", F.col("graph").cast("string")), some.edges.withColumn("graph", F.col("graph").cast("string")))
    quality = text.qualities(members)
    cases = quality.select(F.concat(F.lit("case "), "graph").alias("name"), "graph", F.lit("rb").alias("objective"), F.lit(1.0).alias("resolution"), F.lit(42).cast("long").alias("seed"), F.lit(0).cast("long").alias("reference_n_clusters"), (F.col("quality") + F.when(F.col("graph") == "1", 1.0).otherwise(0.0)).alias("reference_quality"), F.lit(0.0).alias("reference_modularity"))
    files.write_fixtures(text, cases, members, str(tmp_path / "doc"))
    read = files.read_json(spark, str(tmp_path / "doc"), files.FIXTURES)
    again = files.fixture_batch(read)
    key = lambda b: (sorted(map(tuple, b.nodes.collect())), sorted(map(tuple, b.edges.collect())))
    assert key(again) == key(text)
    own, back = files.fixture_cases(read)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, members.collect()))
    runs = own.join(again.qualities(back), "graph").select("quality", "reference_quality")
    row = metrics.quality_summary(runs, 1e-6).first()
    assert (row["better"], row["equal"], row["worse"]) == (0, 11, 1)


def test_csr_files_round_trip_in_small_ranges(spark, tmp_path):
    n, e, _ = generators.karate(spark)
    graph = Graph.from_edges(n + 2, e.unionByName(spark.createDataFrame([(3, 3, 2.5)], "src long, dst long, weight double")))
    csr.write_csr(graph, str(tmp_path / "m"))
    again = csr.read_csr(spark, str(tmp_path / "m"), size=24)
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, graph.edges.collect())) and again.node_count() == n + 2
    one = tmp_path / "one"
    one.mkdir()
    for name in csr.FILES:  # plain files in the parts' place
        (one / name).write_bytes(b"".join(p.read_bytes() for p in sorted((tmp_path / "m" / name).glob("part-*"))))
    assert sorted(map(tuple, files.read_binary_csr(spark, str(one)).edges.collect())) == sorted(map(tuple, graph.edges.collect()))
    assert {k: (one / k).read_bytes() for k in csr.FILES} == files.csr_bytes(graph)
    (one / "data.bin").write_bytes((one / "data.bin").read_bytes()[:-4])
    with pytest.raises(errors.InvalidCsr, match="lengths differ"):
        csr.read_csr(spark, str(one))


def arrays(spark, ptrs, cols, values):
    table = lambda x, kind: spark.createDataFrame(list(enumerate(x)), f"pos long, value {kind}")
    return table(ptrs, "long"), table(cols, "long"), table(values, "double")


@pytest.mark.parametrize(
    ("ptrs", "cols", "values", "want"),
    [
        ([0, 1, 2], [1, 0], [1.0, 1.0], []),
        ([], [], [], [("no row pointers", 0, 0.0)]),
        ([0, 1, 2], [1, 0], [1.0], [("lengths differ", 2, 1.0)]),
        ([0, 1, 3], [1, 0], [1.0, 1.0], [("end differs", 3, 2.0)]),
        ([0, 2, 1, 2], [1, 0], [1.0, 1.0], [("pointers fall", 1, 1.0)]),
        ([1, 1, 2], [1, 0], [1.0, 1.0], [("pointers fall", 0, 1.0)]),
        ([0, 1, 2], [2, -1], [1.0, 1.0], [("column out of range", 0, 2.0), ("column out of range", 1, -1.0)]),
        ([0, 1, 2], [1, 0], [float("inf"), -1.0], [("negative", 1, -1.0), ("not finite", 0, float("inf"))]),
    ],
)
def test_csr_faults(spark, ptrs, cols, values, want):
    assert sorted(tuple(r) for r in csr.csr_faults(*arrays(spark, ptrs, cols, values)).collect()) == want


def test_csr_node_weights_and_long_rows(spark, monkeypatch):
    three = arrays(spark, [0, 1, 2], [1, 0], [1.0, 1.0])
    assert [tuple(r) for r in csr.csr_faults(*three, three[0]).collect()] == [("node weights differ", 3, 2.0)]
    monkeypatch.setattr(csr, "BUCKET", 4)  # rows over many buckets
    ptrs, cols = [0, 0, 30, 31, 31, 50], [k % 5 for k in range(50)]
    got = sorted(tuple(r) for r in csr.csr_entries(*arrays(spark, ptrs, cols, [float(k) for k in range(50)])).collect())
    assert got == sorted((r, cols[k], float(k)) for r in range(5) for k in range(ptrs[r], ptrs[r + 1]))


def test_grid_lists_are_never_short(spark):
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.normal(0, 0.05, (60, 2)), rng.normal(3, 1.0, (30, 2)), [[500.0, -700.0], [500.0, -700.0]]])
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(xy)], "id long, features array<double>")
    got = {}
    for r in generators.grid_nearest(points, 7, 0.05).collect():
        got.setdefault(r["i"], {})[r["r"]] = r["j"]
    for i in range(len(xy)):
        d2 = ((xy - xy[i]) ** 2).sum(1)
        assert [got[i][r] for r in range(1, 8)] == [int(j) for j in np.lexsort((np.arange(len(xy)), d2)) if j != i][:7]
    few = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 9.0])], "id long, features array<double>")
    assert sorted((r["i"], r["j"]) for r in generators.grid_nearest(few, 3, 1.0).collect()) == [(0, 1), (1, 0)]


def test_grid_compares_places_and_not_copies(spark, monkeypatch):
    rng = np.random.default_rng(11)
    xy = np.concatenate([rng.integers(0, 12, (300, 2)) * 0.01, np.full((200, 2), 0.05)])  # dense places, 200 points in one
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(xy)], "id long, features array<double>")
    written, own = [], generators.checkpointed
    monkeypatch.setattr(generators, "checkpointed", lambda df, label="round": written.append((label, own(df, label))) or written[-1][1])
    got = {}
    for r in generators.grid_nearest(points, 4, 5.0).collect():
        got.setdefault(r["i"], {})[r["r"]] = r["j"]
    for i in range(len(xy)):
        d2 = (xy[:, 0] - xy[i, 0]) * (xy[:, 0] - xy[i, 0]) + (xy[:, 1] - xy[i, 1]) * (xy[:, 1] - xy[i, 1])
        assert [got[i][r] for r in range(1, 5)] == [int(j) for j in np.lexsort((np.arange(len(xy)), d2)) if j != i][:4]
    assert 0 < sum(df.count() for label, df in written if label == "places") <= 144  # no copy is looked at by itself


def test_a_graph_is_read_once_for_its_three_arrays(spark, tmp_path):
    from pyspark.sql import functions as F

    from weftgraph.operators.graph import Graph

    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    edges = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).cast("float").alias("weight"))
    g = Graph(spark.range(31).select("id", F.lit(1.0).alias("node_weight")), edges.mapInPandas(counted, "src long, dst long, weight float"))
    csr.write_csr(g, str(tmp_path / "csr"))
    assert seen.value == 30
    assert sorted(tuple(r) for r in csr.read_csr(spark, str(tmp_path / "csr")).edges.collect()) == [(k, k + 1, 1.0) for k in range(30)]
