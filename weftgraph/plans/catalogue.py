"""Registered queries over the star schema, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.objective import Cpm, Rb, modularity
from ..operators import graph as G
from ..operators import batches, knn, labels, leiden, partition
from ..operators.components import checkpointed, components, shared_folder
from ..operators.graph import Graph
from ..sources import csr, files, generators
from ..sources.files import points_of

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = WITH + sql if sql.startswith("select") else sql
        return f

    return add


# the part-supplier graph: parts 0..n-1, then suppliers; an edge's weight is its number of line items
WITH = """
with np as (select count(*) n from part),
e as (select l_partkey src, l_suppkey + (select n from np) dst, cast(count(*) as float)::double w from lineitem group by 1, 2),
nodes as (select p_partkey id, p_brand lbl from part union all select s_suppkey + (select n from np), concat('N', s_nationkey) from supplier),
adj as (select src node, dst nbr, w from e union all select dst, src, w from e where src <> dst),
ends as (select src node, w from e union all select dst, w from e),
k as (select id, lbl, coalesce(sum(w), 0) strength from nodes left join ends on node = id group by 1, 2),
m as (select sum(w) m from e),
ranks as (select lbl, row_number() over (order by min(id)) - 1 label from nodes group by 1),
lab as (select id node, label from nodes join ranks using (lbl)),
comm as (select label community, count(*) size, sum(strength) strength from k join lab on node = id group by 1),
ins as (select a.label community, sum(w) internal from e join lab a on a.node = src join lab b on b.node = dst where a.label = b.label group by 1),
c as (select community, size, size::double weight, strength, coalesce(internal, 0) internal from comm left join ins using (community)),
nw as (select adj.node, label community, sum(w) weight from adj join lab on lab.node = nbr where adj.node <> nbr group by 1, 2)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Few line items share a part and a supplier."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    n = part.count()
    nodes = part.select(F.col("p_partkey").alias("id")).unionByName(supplier.select((F.col("s_suppkey") + n).alias("id"))).withColumn("node_weight", F.lit(1.0))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + n).alias("dst"), F.lit(1.0).alias("weight"))
    return Graph.from_edges_with_node_weights(nodes, edges, validate=False, few_parallel=True)


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    n = part.count()
    return part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("label")).unionByName(supplier.select((F.col("s_suppkey") + n).alias("node"), F.concat(F.lit("N"), "s_nationkey").alias("label")))


def brand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.from_labels(raw_labels(spark, sf_dir))


def brand_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_labels(spark, sf_dir).withColumnRenamed("label", "community")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of(table(spark, sf_dir, "embeddings"))


# graphs


@query("select src, dst, cast(w as float) weight from e")
def graph_edges_part_supplier(spark, sf_dir):
    return part_supplier(spark, sf_dir).edges


@query("select least(l_suppkey, l_partkey % 10) src, greatest(l_suppkey, l_partkey % 10) dst, cast(sum(cast(l_quantity as float)::double) as float) weight from lineitem group by 1, 2 having sum(cast(l_quantity as float)::double) <> 0")
def graph_parallel_edges_merged(spark, sf_dir):
    return G.merged_edges(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 10).alias("dst"), F.col("l_quantity").alias("weight")))


@query("select l_suppkey src, l_linenumber::bigint dst, cast(sum(cast(l_quantity as float)::double) as float) weight from lineitem where l_suppkey <= l_linenumber and l_quantity <> 0 group by 1, 2")
def graph_coo_upper_triangle(spark, sf_dir):
    coo = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_linenumber").cast("long").alias("col"), F.col("l_quantity").alias("value"))
    return Graph.from_coo(table(spark, sf_dir, "supplier").count() + 10, coo).edges


@query("select node, nbr, w weight from adj")
def graph_adjacency(spark, sf_dir):
    return part_supplier(spark, sf_dir).adjacency()


@query("select id, (sum(d) over (order by id) - d)::bigint start from (select id, count(node) d from nodes left join adj on node = id group by 1)")
def graph_csr_offsets(spark, sf_dir):
    return part_supplier(spark, sf_dir).csr_rows().select("id", "start")


@query("select id, coalesce(string_agg(nbr || ':' || w::bigint, ',' order by nbr), '') row_text from nodes left join adj on node = id group by 1")
def graph_csr_rows(spark, sf_dir):
    rows = part_supplier(spark, sf_dir).csr_rows()
    return rows.select("id", F.array_join(F.transform(F.arrays_zip("nbrs", "weights"), lambda x: F.concat_ws(":", x["nbrs"], x["weights"].cast("long"))), ",").alias("row_text"))


@query("select (select count(*) from nodes) n_nodes, count(*) n_edges, sum(w) total_weight, (select count(*) from nodes)::double total_node_weight, false has_self_loops from e")
def graph_counts(spark, sf_dir):
    g = part_supplier(spark, sf_dir)
    return g.edges.agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("weight").cast("double")).alias("total_weight"), F.coalesce(F.bool_or(F.col("src") == F.col("dst")), F.lit(False)).alias("has_self_loops")).join(F.broadcast(g.nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("node_weight").alias("total_node_weight"))))


@query("select round((select count(*) from e) / (n * (n - 1) / 2), 9) density, (8 * (n + 1) + 8 * (select count(*) from adj) + 16 * n)::bigint memory_bytes from (select count(*) n from nodes)")
def graph_density_and_bytes(spark, sf_dir):
    g = part_supplier(spark, sf_dir)
    return spark.createDataFrame([(round(g.density(), 9), g.memory_bytes())], "density double, memory_bytes long")


@query("select id, count(node) degree from nodes left join adj on node = id group by 1")
def node_degree(spark, sf_dir):
    return part_supplier(spark, sf_dir).degrees()


@query("select id, strength from k")
def node_strength(spark, sf_dir):
    return part_supplier(spark, sf_dir).strengths()


@query("with x as (select l_linenumber - 1 a, l_suppkey % 7 b from lineitem) select i id, coalesce((select count(*) from x where a = i and b = i), 0)::double self_loop from range(7) t(i)")
def self_loops(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).alias("src"), (F.col("l_suppkey") % 7).alias("dst"), F.lit(1.0).alias("weight"))
    return Graph.from_edges(7, edges, validate=False).self_loops()


@query("select nbr, w weight from adj where node = 0")
def node_neighbors(spark, sf_dir):
    return part_supplier(spark, sf_dir).neighbors(0)


@query("with coo as (select l_suppkey r, l_linenumber::bigint c, sum(cast(l_quantity as float)::double) v from lineitem group by 1, 2) select coalesce(a.r, b.c) \"row\", coalesce(a.c, b.r) col, a.v \"value\", b.v reverse, case when a.v is null or b.v is null then 'missing reverse entry' else 'mismatched entries' end problem from coo a full join coo b on a.r = b.c and a.c = b.r where a.v is null or b.v is null or abs(a.v - b.v) > 1e-6 * greatest(abs(a.v), 1)")
def symmetry_violations(spark, sf_dir):
    coo = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_linenumber").cast("long").alias("col")).agg(F.sum(G.stored(F.col("l_quantity"))).alias("value"))
    return G.symmetry_violations(coo)


@query("select sum(strength) degree_sum, 2 * (select m from m) expected from k")
def degree_sum_check(spark, sf_dir):
    g = part_supplier(spark, sf_dir)
    return g.strengths().agg(F.sum("strength").alias("degree_sum")).join(F.broadcast(g.edges.agg((F.sum(F.col("weight").cast("double")) * 2).alias("expected"))))


@query("with x as (select l_partkey - 5 s, l_suppkey d, l_quantity - 3 w from lineitem) select case when s < 0 or s >= 100 then 'src out of range' when d < 0 or d >= 100 then 'dst out of range' else 'negative' end problem, count(*) n_edges from x where s < 0 or s >= 100 or d < 0 or d >= 100 or w < 0 group by 1")
def edge_validation_report(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") - 5).alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_quantity") - 3).alias("weight"))
    return G.edge_validation_report(edges, 100)


@query("select least(a.label, b.label) src, greatest(a.label, b.label) dst, cast(sum(w) as float) weight from e join lab a on a.node = src join lab b on b.node = dst group by 1, 2")
def graph_coarsen_by_brand(spark, sf_dir):
    return part_supplier(spark, sf_dir).aggregate(brand_labels(spark, sf_dir).withColumnRenamed("label", "group")).edges


@query("select label id, count(*)::double node_weight from lab group by 1")
def graph_coarsen_node_weights(spark, sf_dir):
    return part_supplier(spark, sf_dir).aggregate(brand_labels(spark, sf_dir).withColumnRenamed("label", "group")).nodes


# labels


def nations(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") * 3).cast("long").alias("group"))


@query("with d as (select distinct c_nationkey g from customer) select c_custkey node, (select count(*) from d where g < c_nationkey) as \"group\" from customer")
def labels_normalized(spark, sf_dir):
    return labels.normalized(nations(spark, sf_dir))


@query("select node, label from lab")
def labels_first_seen(spark, sf_dir):
    return brand_labels(spark, sf_dir)


@query("with x as (select c_custkey node, n_regionkey r from customer join nation on n_nationkey = c_nationkey), d as (select distinct r from x) select node, (select count(*) from d where d.r < x.r) as \"group\" from x")
def labels_merge(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("group"))
    return labels.merged(own, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").cast("long").alias("group")))


@query("select c_custkey node, case when c_acctbal < 0 then 99 when c_custkey = 7 then 98 else c_nationkey * 3 end::bigint as \"group\" from customer where c_custkey between 3 and 102")
def labels_updates_in_range(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("node"))
    return labels.groups_range(labels.with_groups(labels.with_group(nations(spark, sf_dir), 7, 98), poor, 99), 3, 103)


@query("select c_nationkey * 3::bigint as \"group\", count(*) size from customer group by 1".replace("c_nationkey * 3::bigint", "(c_nationkey * 3)::bigint"))
def group_sizes(spark, sf_dir):
    return labels.group_sizes(nations(spark, sf_dir))


@query("select (c_nationkey * 3)::bigint as \"group\", string_agg(c_custkey::varchar, ',' order by c_custkey) members from customer group by 1")
def group_members(spark, sf_dir):
    return labels.members(nations(spark, sf_dir)).select("group", F.array_join("members", ",").alias("members"))


@query("select c_nationkey::bigint label, count(*) size from customer where c_acctbal >= 0 group by 1")
def cluster_sizes(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_acctbal") < 0, labels.NOISE).otherwise(F.col("c_nationkey")).cast("long").alias("label"))
    return labels.cluster_sizes(own)


@query("select c_custkey node from customer where c_acctbal < 0")
def noise_items(spark, sf_dir):
    return labels.noise(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_acctbal") < 0, labels.NOISE).otherwise(F.col("c_nationkey")).alias("label")))


# partitions and quality


@query("select community, size, weight, strength, internal from c")
def partition_aggregates(spark, sf_dir):
    return partition.communities(part_supplier(spark, sf_dir), brand_partition(spark, sf_dir))


@query("select node, community, weight from nw")
def neighbor_community_weights(spark, sf_dir):
    return partition.neighbor_weights(part_supplier(spark, sf_dir), brand_partition(spark, sf_dir))


@query("select adj.node, label community, sum(w) weight from adj join lab on lab.node = nbr where adj.node % 2 = nbr % 2 group by 1, 2")
def neighbor_community_weights_constrained(spark, sf_dir):
    p = brand_partition(spark, sf_dir)
    return partition.neighbor_weights(part_supplier(spark, sf_dir), p, p.select("node", (F.col("node") % 2).alias("community")))


DELTAS = """select node, nw.community, round({}, 8) gain from nw join k on k.id = node join lab using (node) join c on c.community = nw.community, m where nw.community <> label"""


def deltas(spark, sf_dir, objective):
    g, p = part_supplier(spark, sf_dir), brand_partition(spark, sf_dir)
    found = leiden.candidates(g, p, objective, g.total_weight())
    beside = partition.neighbor_weights(g, p).select("node", "community")
    return found.where("community <> own").join(beside, ["node", "community"]).select("node", "community", F.round("gain", 8).alias("gain"))


@query(DELTAS.format("nw.weight - k.strength * (2 * c.strength + k.strength) / (4 * m.m)"))
def move_delta_rb(spark, sf_dir):
    return deltas(spark, sf_dir, Rb(1.0))


@query(DELTAS.format("nw.weight - 0.05 * (2 * c.weight + 1 - 1) / 2"))
def move_delta_cpm(spark, sf_dir):
    return deltas(spark, sf_dir, Cpm(0.05))


@query("select round(sum(internal - strength * strength / (4 * m.m)), 6) rb, round(sum(internal - 0.05 * weight * (weight - 1) / 2), 6) cpm from c, m")
def quality_rb_cpm(spark, sf_dir):
    g = part_supplier(spark, sf_dir)
    c, m = partition.communities(g, brand_partition(spark, sf_dir)), g.total_weight()
    return spark.createDataFrame([(round(Rb(1.0).quality(c, m), 6), round(Cpm(0.05).quality(c, m), 6))], "rb double, cpm double")


@query("select round(sum(internal / m.m - power(strength / (2 * m.m), 2)), 6) modularity from c, m")
def modularity_by_brand(spark, sf_dir):
    return modularity(part_supplier(spark, sf_dir), brand_labels(spark, sf_dir)).select(F.round("modularity", 6).alias("modularity"))


@query("select g resolution, round(q, 6) modularity, round(q - lag(q) over (order by g), 6) step from (select g, sum(internal / m.m - g * power(strength / (2 * m.m), 2)) q from c, m, (values (0.5), (1.0), (2.0), (4.0)) t(g) group by 1)".replace("select g resolution", "select g::double resolution"))
def modularity_resolution_sweep(spark, sf_dir):
    g, l = part_supplier(spark, sf_dir), brand_labels(spark, sf_dir)
    rows = None
    for r in (0.5, 1.0, 2.0, 4.0):
        one = modularity(g, l, r).select(F.lit(r).alias("resolution"), F.col("modularity").alias("q"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("step", F.round(F.col("q") - F.lag("q").over(Window.orderBy("resolution")), 6)).select("resolution", F.round("q", 6).alias("modularity"), "step")  # four rows


# comparison


def two_labelings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("node"), F.col("label").cast("long").alias("label")), e.select(F.col("vec_id").alias("node"), (F.col("vec_id") % 7).alias("label"))


@query("select label::bigint a, vec_id % 7 b, count(*) n from embeddings group by 1, 2")
def contingency(spark, sf_dir):
    return metrics.contingency(*two_labelings(spark, sf_dir))


AGREEMENT = """
with c as (select label a, vec_id % 7 b, count(*)::double n from embeddings group by 1, 2),
j as (select *, sum(n) over (partition by a) na, sum(n) over (partition by b) nb, sum(n) over () t from c),
mi as (select sum(n / t * ln(n * t / (na * nb))) v from j),
ha as (select -sum(na / t * ln(na / t)) v from (select distinct a, na, t from j)), hb as (select -sum(nb / t * ln(nb / t)) v from (select distinct b, nb, t from j)),
p as (select sum(n * (n - 1) / 2) s, max(t) * (max(t) - 1) / 2 tot from j),
pa as (select sum(na * (na - 1) / 2) v from (select distinct a, na from j)), pb as (select sum(nb * (nb - 1) / 2) v from (select distinct b, nb from j))
select round(2 * mi.v / (ha.v + hb.v), 6) nmi, round((p.s - pa.v * pb.v / p.tot) / (0.5 * (pa.v + pb.v) - pa.v * pb.v / p.tot), 6) ari from mi, ha, hb, p, pa, pb"""


@query(AGREEMENT)
def nmi_and_ari(spark, sf_dir):
    return metrics.agreement(metrics.contingency(*two_labelings(spark, sf_dir))).select(F.round("nmi", 6).alias("nmi"), F.round("ari", 6).alias("ari"))


@query("select conv_id * 1000 + turn node, min(conv_id * 1000 + turn) over (partition by conv_id) component from conversations")
def connected_components(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "conv_id", "turn")
    first = Window.partitionBy("conv_id").orderBy("turn")
    edges = c.select("node", F.coalesce(F.lag("node").over(first), F.col("node")).alias("before"))
    return components(edges, "node", "before")


@query("select n_regionkey::bigint label, count(*) parts from nation group by 1 having count(*) > 1")
def disconnected_communities(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    edges = nation.select(F.col("n_nationkey").alias("src"), F.lit(0).alias("dst"), F.lit(0.0).alias("weight"))
    return metrics.disconnected_communities(Graph.from_edges(25, edges, validate=False), nation.select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("label")))


# neighbours

KNN = """
with p as (select vec_id id, embedding x from embeddings),
d as (select a.id i, b.id j, list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1]::double - t[2]::double) * (t[1]::double - t[2]::double))) d2 from p a, p b),
n as (select *, row_number() over (partition by i order by d2, j) r from d qualify r <= 16),
s as (select i, sqrt(list_sort(list(d2))[(count(*) // 2) + 1]) sigma from n where d2 > 0 group by 1),
w as (select n.i "row", n.j col, sqrt(2 * a.sigma * b.sigma / (a.sigma * a.sigma + b.sigma * b.sigma)) * exp(-d2 / (a.sigma * a.sigma + b.sigma * b.sigma)) v from n join s a on a.i = n.i join s b on b.i = n.j where r > 1 and n.i <= n.j)
"""


@query(KNN + "select i, j, r, round(d2, 6) d2 from n")
def knn_pairs(spark, sf_dir):
    return knn.nearest_exact(points(spark, sf_dir), 15).select("i", "j", F.col("r").cast("long").alias("r"), F.round("d2", 6).alias("d2"))


@query(KNN + "select i, round(sigma, 6) sigma from s")
def knn_sigma(spark, sf_dir):
    return knn.bandwidths(knn.nearest_exact(points(spark, sf_dir), 15)).select("i", F.round("sigma", 6).alias("sigma"))


@query(KNN + "select \"row\", col, round(v, 6) \"value\" from w where v > 1e-14")
def knn_connectivities(spark, sf_dir):
    return knn.connectivities(knn.nearest_exact(points(spark, sf_dir), 15)).select("row", "col", F.round("value", 6).alias("value"))


@query(KNN + "select count(*) n_edges, round(sum(cast(v as float)::double), 4) total_weight from w where v > 1e-14")
def knn_graph(spark, sf_dir):
    return knn.knn_graph(points(spark, sf_dir), 15).edges.agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum(F.col("weight").cast("double")), 4).alias("total_weight"))


@query("with t(n) as (values (1000), (10000), (100000), (1000000), (2500000)) select n::bigint n, case when n < 10000 then 16 when n < 100000 then 24 when n < 1000000 then 32 else 48 end links, least(16, floor(ln(n)))::int layers, case when n < 10000 then 100 when n < 1000000 then 200 when n < 2500000 then 300 else 400 end construction, 30 search from t")
def hnsw_params(spark, sf_dir):
    return spark.createDataFrame([(n, *knn.hnsw_params(n, 15)) for n in (1000, 10000, 100000, 1000000, 2500000)], "n long, links int, layers int, construction int, search int")


@query()
def knn_approximate(spark, sf_dir):
    return knn.nearest_approximate(points(spark, sf_dir), 15, cell=60).select("i", "j", "r", "d2")


# generators


@query("with c as (select i, i // 6 c from range(72) t(i)) select a.i src, b.i dst, 1.0::float weight from c a join c b on a.c = b.c and a.i < b.i union all select least(g * 6, ((g + 1) % 12) * 6), greatest(g * 6, ((g + 1) % 12) * 6), 1.0::float from range(12) r(g)")
def ring_of_cliques(spark, sf_dir):
    n, edges, _ = generators.ring_of_cliques(spark, 12, 6)
    return Graph.from_edges(n, edges).edges


@query("with p as (select a.i src, b.i dst, concat('0x', substr(md5(concat_ws(':', 1, a.i, b.i)), 1, 13))::bigint / 4503599627370496.0 u from range(120) a(i), range(120) b(i) where a.i < b.i) select src, dst, 1.0::float weight from p where u < case when src // 30 = dst // 30 then 0.4 else 0.02 end")
def stochastic_blocks(spark, sf_dir):
    n, edges, _ = generators.stochastic_blocks(spark, 4, 30, 0.4, 0.02)
    return Graph.from_edges(n, edges).edges


@query("select least(i, (i + d) % 500) src, greatest(i, (i + d) % 500) dst, 1.0::float weight from range(500) a(i), range(1, 4) b(d)")
def lattice_edges(spark, sf_dir):
    n, edges = generators.lattice(spark, 500, 6)
    return Graph.from_edges(n, edges).edges


@query()
def grid_knn_blobs(spark, sf_dir):
    return generators.grid_neighbors(generators.blobs(spark, 2000, 8), 15, 0.05)


# communities


def embedding_graph(spark, sf_dir) -> Graph:
    return knn.knn_graph(points(spark, sf_dir), 15)


@query()
def leiden_embeddings(spark, sf_dir):
    return leiden.leiden(embedding_graph(spark, sf_dir))


@query()
def leiden_part_supplier(spark, sf_dir):
    return leiden.leiden(part_supplier(spark, sf_dir))


@query()
def leiden_cpm(spark, sf_dir):
    return leiden.leiden(embedding_graph(spark, sf_dir), leiden.LeidenConfig(objective=Cpm(0.05)))


@query()
def louvain_embeddings(spark, sf_dir):
    return leiden.louvain(embedding_graph(spark, sf_dir))


@query()
def leiden_capped(spark, sf_dir):
    return leiden.leiden(embedding_graph(spark, sf_dir), leiden.LeidenConfig(max_community_weight=25.0))


@query("select i node, i // 5 label from range(100) t(i)")
def leiden_ring_of_cliques_cpm(spark, sf_dir):
    n, edges, _ = generators.ring_of_cliques(spark, 20, 5)
    return leiden.leiden(Graph.from_edges(n, edges), leiden.LeidenConfig(objective=Cpm(0.1)))


@query("select 4 n_clusters, 0.41979 modularity")
def leiden_karate(spark, sf_dir):
    n, edges, _ = generators.karate(spark)
    g = Graph.from_edges(n, edges)
    found = leiden.leiden(g)
    return modularity(g, found).select(F.lit(labels.n_clusters(found)).cast("int").alias("n_clusters"), F.round("modularity", 5).alias("modularity"))


@query("select 0::bigint communities")
def leiden_disconnected(spark, sf_dir):
    """How many communities of the embeddings' graph fall into parts: none."""
    g = embedding_graph(spark, sf_dir)
    return metrics.disconnected_communities(g, leiden.leiden(g)).agg(F.count(F.lit(1)).alias("communities"))


@query("select true keeps_cap, count(*) nodes from embeddings")
def leiden_capped_sizes(spark, sf_dir):
    """Whether every community of the capped run keeps the cap, and how many nodes have one."""
    sizes = labels.cluster_sizes(leiden_capped(spark, sf_dir))
    return sizes.agg((F.max("size") <= 25).alias("keeps_cap"), F.sum("size").cast("long").alias("nodes"))


@query("select 6 clusters, true agrees")
def leiden_planted_blocks(spark, sf_dir):
    """Six planted blocks of 60 nodes are found again."""
    n, edges, truth = generators.stochastic_blocks(spark, 6, 60, 0.25, 0.01, 11)
    found = leiden.leiden(Graph.from_edges(n, edges))
    return spark.range(1).select(F.lit(labels.n_clusters(found)).cast("int").alias("clusters"), F.lit(metrics.nmi(found, truth) > 0.95).alias("agrees"))


@query("select u, v, w weight from (select l_partkey u, l_suppkey + (select n from np) v from lineitem where l_linenumber = 7 union select 0, 0) asked left join e on u = src and v = dst")
def edge_lookup(spark, sf_dir):
    """The weights of asked pairs of nodes; null where there is no edge."""
    g, n = part_supplier(spark, sf_dir), table(spark, sf_dir, "part").count()
    asked = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + n).alias("v"))
    return g.edge_weights(asked.unionByName(spark.range(1).select(F.col("id").alias("u"), F.col("id").alias("v"))).distinct())


@query("select p_partkey id, p_size::double node_weight from part")
def node_weights(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("node_weight"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(1.0).alias("weight"))
    return Graph.from_edges_with_node_weights(own, edges).nodes.select("id", "node_weight")


@query("select (select count(*) from nodes)::double total_node_weight, false has_self_loops")
def graph_totals(spark, sf_dir):
    g = part_supplier(spark, sf_dir)
    return spark.range(1).select(F.lit(g.total_node_weight()).alias("total_node_weight"), F.lit(g.has_self_loops()).alias("has_self_loops"))


@query('select id node, id "group" from nodes')
def labels_isolated(spark, sf_dir):
    return labels.isolated(part_supplier(spark, sf_dir).nodes)


@query('select id node, 0::bigint "group" from nodes')
def labels_unified(spark, sf_dir):
    return labels.unified(part_supplier(spark, sf_dir).nodes)


@query("select id node, id community from nodes")
def partition_singleton(spark, sf_dir):
    return partition.singleton(part_supplier(spark, sf_dir))


@query("select count(distinct label) communities, max(label) + 1 slots from lab")
def partition_slots(spark, sf_dir):
    own = partition.from_membership(part_supplier(spark, sf_dir), brand_partition(spark, sf_dir))
    return spark.range(1).select(F.lit(partition.community_count(own)).cast("long").alias("communities"), F.lit(partition.slots(own)).cast("long").alias("slots"))


@query(KNN + "select count(distinct i) queries, count(*) total, true enough from n")
def knn_recall(spark, sf_dir):
    """The exact lists of all points, and whether the search in learned cells finds nine tenths of their neighbours; knn_recall_counts has the hits."""
    p = points(spark, sf_dir)
    return knn.recall(p, knn.nearest_approximate(p, 15, cell=60), 15, step=1).select("queries", "total", (F.col("hits") >= 0.9 * F.col("total")).alias("enough"))


@query()
def best_move_per_node(spark, sf_dir):
    g = embedding_graph(spark, sf_dir)
    return leiden.best_moves(g, partition.singleton(g), Rb(1.0), g.total_weight())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the embeddings' neighbour graph: label, size, commonest true label and its share."""
    found = leiden_embeddings(spark, sf_dir)
    truth = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("label").alias("truth"))
    counts = found.join(truth, F.col("node") == F.col("_v")).groupBy("label", "truth").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("label").agg(F.sum("n").alias("size"), F.max_by("truth", F.struct("n", -F.col("truth"))).alias("commonest"), (F.max("n") / F.sum("n")).alias("purity"))


# incremental partitions


def moved_parts(spark, sf_dir) -> DataFrame:
    """Every fifth size of parts goes to another brand's community."""
    return table(spark, sf_dir, "part").where("p_size % 5 = 0").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 7).cast("long").alias("community"))


MOVED = (
    WITH.rstrip()
    + """,
lab2 as (select node, coalesce(p_size % 7, label)::bigint label from lab left join part on p_partkey = node and p_size % 5 = 0),
c2 as (select label community, count(*) size, count(*)::double weight, sum(strength) strength from k join lab2 on node = id group by 1),
i2 as (select a.label community, sum(w) internal from e join lab2 a on a.node = src join lab2 b on b.node = dst where a.label = b.label group by 1),
t2 as (select community, size, weight, strength, coalesce(internal, 0) internal from c2 left join i2 using (community))
"""
)


@query(MOVED + "select * from t2")
def partition_after_moves(spark, sf_dir):
    """The communities' sums after a batch of moves, by merging signed deltas into the table before it."""
    g, own = part_supplier(spark, sf_dir), brand_partition(spark, sf_dir)
    return partition.applied(partition.communities(g, own), partition.deltas_of(g, own, moved_parts(spark, sf_dir)))


@query(MOVED + "select coalesce(a.community, b.community) community, coalesce(a.size, 0) - coalesce(b.size, 0) size, coalesce(a.weight, 0) - coalesce(b.weight, 0) weight, coalesce(a.strength, 0) - coalesce(b.strength, 0) strength, coalesce(a.internal, 0) - coalesce(b.internal, 0) internal from t2 a full join c b on a.community = b.community where coalesce(a.size, 0) <> coalesce(b.size, 0) or coalesce(a.strength, 0) <> coalesce(b.strength, 0) or coalesce(a.internal, 0) <> coalesce(b.internal, 0)")
def partition_move_deltas(spark, sf_dir):
    """What the batch of moves adds to each community."""
    deltas = partition.deltas_of(part_supplier(spark, sf_dir), brand_partition(spark, sf_dir), moved_parts(spark, sf_dir))
    return deltas.where("size <> 0 or strength <> 0 or internal <> 0")


@query(MOVED + "select count(*) communities, 0::bigint faults from t2")
def partition_moves_verified(spark, sf_dir):
    """How many communities there are after the moves, and how many of them differ from sums from scratch."""
    g, own = part_supplier(spark, sf_dir), brand_partition(spark, sf_dir)
    after = partition_after_moves(spark, sf_dir)
    wrong = partition.verify(g, partition.moved(own, moved_parts(spark, sf_dir)), after)
    return after.agg(F.count(F.lit(1)).alias("communities")).join(F.broadcast(wrong.agg(F.count(F.lit(1)).alias("faults"))))  # one row each


# Leiden by rounds


def sized_communities(g: Graph, found: DataFrame) -> DataFrame:
    return partition.communities(g, found.withColumnRenamed("label", "community")).select(F.col("community").alias("label"), "size", "strength", "internal")


@query("select min(conv_id * 1000 + turn) label, count(*) size, (2 * count(*) - 2)::double strength, (count(*) - 1)::double internal from conversations group by conv_id")
def leiden_rounds_conversations(spark, sf_dir):
    """Communities found by rounds alone in a graph of stars, a conversation's turns linked to its first one: each is a community. A label is its smallest node."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.min(F.col("conv_id") * 1000 + F.col("turn")).over(Window.partitionBy("conv_id")).alias("first"))
    g = Graph(c.select("id", F.lit(1.0).alias("node_weight")), c.where("id <> first").select(F.col("first").alias("src"), F.col("id").alias("dst"), F.lit(1.0).cast("float").alias("weight")))
    return sized_communities(g, leiden.round_labels(g, leiden.LeidenConfig(), g.total_weight()))


@query()
def leiden_rounds_embeddings(spark, sf_dir):
    """Each community of the embeddings' graph by rounds alone: size, strength, weight inside, and the whole partition's modularity beside the array kernel's."""
    g = embedding_graph(spark, sf_dir)
    g = Graph(checkpointed(g.nodes), checkpointed(g.edges))
    found = checkpointed(leiden.leiden_by_rounds(g))
    q = modularity(g, found).join(F.broadcast(modularity(g, leiden.leiden(g)).withColumnRenamed("modularity", "kernel_modularity")))  # one row each
    return sized_communities(g, found).join(F.broadcast(q))


# searches


def shifted(points: DataFrame, by: float) -> DataFrame:
    return points.select("id", F.transform("features", lambda x: (x + by).cast("float")).alias("features"))


@query()
def knn_recall_counts(spark, sf_dir):
    """Hits among the exact neighbours of the points whose id is a multiple of 100, for the points as they are and far from the origin."""
    rows = None
    for shift in (0.0, 3.0):
        p = shifted(points(spark, sf_dir), shift)
        one = knn.recall(p, knn.nearest_approximate(p, 15, cell=60), 15).withColumn("shift", F.lit(shift))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("recall", F.col("hits") / F.col("total"))


TAXI = """with d as (select a.vec_id i, b.vec_id j, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: abs(t[1]::double - t[2]::double))) d from embeddings a, embeddings b)
select i, j, round(d, 6) d, row_number() over (partition by i order by d, j) r from d qualify r <= 11"""


@query(TAXI)
def knn_taxicab(spark, sf_dir):
    """Exact neighbours under a metric of one's own, by pivots."""
    return knn.nearest_by_pivots(points(spark, sf_dir), 10, knn.TAXICAB)[0].select("i", "j", F.round("d2", 6).alias("d"), F.col("r").cast("long").alias("r"))


@query("with p as (select p_partkey id, p_retailprice / 100 x, p_size::double y from part), d as (select a.id i, b.id j, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) d2 from p a, p b where a.id <> b.id) select i, j, round(d2, 6) d2, row_number() over (partition by i order by d2, j) r from d qualify r <= 6")
def grid_nearest_parts(spark, sf_dir):
    """The six nearest parts of each by price and size, in grids of growing cells."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_retailprice") / 100, F.col("p_size").cast("double")).alias("features"))
    return generators.grid_nearest(p, 6, 0.5).select("i", "j", F.round("d2", 6).alias("d2"), F.col("r").cast("long").alias("r"))


# CSR arrays

#: Line numbers repeat inside an order; these columns put its lines in one order.
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query("select src, dst, cast(w as float) weight from e")
def csr_file_round_trip(spark, sf_dir):
    """The part-supplier graph's edges after a way through its three binary files in the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/csr-{uuid.uuid4().hex}"
    csr.write_csr(part_supplier(spark, sf_dir), folder)
    return csr.read_csr(spark, folder).edges


@query(
    """with x as (select l_orderkey o, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 pos, l_suppkey - 3 col, case when l_quantity = 50 then null else l_quantity - 3 end v from lineitem),
n as (select max(o) + 1 n, count(*) entries from x), s as (select i, (select count(*) from x where o < i) - case when i % 100 = 7 then 5 else 0 end p from range((select n + 1 from n)) t(i)),
p as (select i, p, lead(p) over (order by i) q from s)
select 'pointers fall' problem, i::bigint pos, (p - q)::double "value" from p where q < p union all select 'pointers fall', 0, p from p where i = 0 and p <> 0
union all select 'end differs', p, entries from p, n where i = n and p <> entries
union all select 'column out of range', pos, col from x, n where col < 0 or col >= n
union all select 'not finite', pos, null from x where v is null union all select 'negative', pos, v from x where v < 0"""
)
def csr_faults_lineitem(spark, sf_dir):
    """Faults planted in the order-supplier matrix's arrays: pointers moved back, columns below zero, missing and negative values."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), *LINE, (F.col("l_suppkey") - 3).alias("col"), F.when(F.col("l_quantity") != 50, F.col("l_quantity") - 3).alias("v"))
    n = rows.agg(F.max("o")).first()[0] + 1
    sizes = spark.range(n + 1).join(rows.groupBy(F.col("o").alias("id")).agg(F.count(F.lit(1)).alias("size")), "id", "left").select("id", F.coalesce("size", F.lit(0)).alias("size"))
    ptrs = G.prefix_sums(sizes, "id", "size", "value").select(F.col("id").alias("pos"), (F.col("value") - F.when(F.col("id") % 100 == 7, 5).otherwise(0)).alias("value"))
    return csr.csr_faults(ptrs, csr.counted(rows, "col", ["o", *LINE]), csr.counted(rows, "v", ["o", *LINE]))


# batches of graphs


def order_batch(spark, sf_dir) -> batches.GraphBatch:
    """A graph for each order: its lines in a row, linked to the next one by their quantity and to the one after by one to three."""
    own = Window.partitionBy("l_orderkey").orderBy(*LINE)
    lines = G.spread(table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE), "l_orderkey")
    rows = lines.select(F.col("l_orderkey").alias("graph"), (F.row_number().over(own) - 1).cast("long").alias("id"), "l_quantity", (F.col("l_suppkey") % 3 + 1).alias("far"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n"))
    to = lambda step, w: F.when(F.col("id") + step < F.col("n"), F.struct((F.col("id") + step).alias("dst"), w.cast("double").alias("weight")))
    edges = rows.select("graph", F.col("id").alias("src"), F.inline(F.filter(F.array(to(1, F.col("l_quantity")), to(2, F.col("far"))), lambda x: x.isNotNull())))
    return batches.GraphBatch.from_edges(rows.select("graph", "id"), edges, small=True)


def talk_batch(spark, sf_dir) -> batches.GraphBatch:
    """A graph for each conversation: each turn is linked to the next by one to four, by its text's length, and to the one after by one."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph"), (F.row_number().over(own) - 1).cast("long").alias("id"), (F.length("text") % 4 + 1).alias("w"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"))
    to = lambda step, w: F.when(F.col("id") + step < F.col("n"), F.struct((F.col("id") + step).alias("dst"), w.cast("double").alias("weight")))
    edges = rows.select("graph", F.col("id").alias("src"), F.inline(F.filter(F.array(to(1, F.col("w")), to(2, F.lit(1))), lambda x: x.isNotNull())))
    return batches.GraphBatch.from_edges(rows.select("graph", "id"), edges)


ORDERS = """with x as (select l_orderkey graph, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 id, l_quantity q, l_suppkey % 3 + 1 f, count(*) over (partition by l_orderkey) n from lineitem),
be as (select graph, id src, id + 1 dst, q w from x where id + 1 < n union all select graph, id, id + 2, f from x where id + 2 < n),
ends as (select graph, src id, w from be union all select graph, dst, w from be),
bk as (select x.graph, x.id, x.id // 2 community, coalesce(sum(w), 0)::double strength from x left join ends on ends.graph = x.graph and ends.id = x.id group by 1, 2),
bi as (select graph, src // 2 community, sum(w)::double internal from be where src // 2 = dst // 2 group by 1, 2),
bc as (select graph, community, count(*) size, count(*)::double weight, sum(strength) strength from bk group by 1, 2),
bt as (select bc.*, coalesce(internal, 0) internal from bc left join bi using (graph, community)),
bm as (select graph, sum(w)::double m from be group by 1)
"""


@query(ORDERS + "select graph, community, size, weight, strength, internal from bt")
def batch_communities_orders(spark, sf_dir):
    """The sums of every community, lines paired in their order, of every order's graph."""
    b = order_batch(spark, sf_dir)
    return b.communities(b.nodes.select("graph", F.col("id").alias("node"), F.floor(F.col("id") / 2).alias("community")))


@query(ORDERS + "select graph, round(sum(case when m > 0 then internal - strength * strength / (4 * m) else 0 end), 6) quality from bt left join bm using (graph) group by 1")
def batch_qualities_orders(spark, sf_dir):
    """The quality of every order's graph under the same partition."""
    b = order_batch(spark, sf_dir)
    return b.qualities(b.nodes.select("graph", F.col("id").alias("node"), F.floor(F.col("id") / 2).alias("community"))).select("graph", F.round("quality", 6).alias("quality"))


@query(
    """with recursive s as (select [0] string, 0 top union all select list_append(string, c), greatest(top, c) from s, range(10) t(c) where c <= top + 1 and len(string) < 8),
x as (select conv_id graph, row_number() over (partition by conv_id order by turn) - 1 id, length(text) % 4 + 1 w, count(*) over (partition by conv_id) n from conversations),
e as (select graph, id src, id + 1 dst, w from x where id + 1 < n union all select graph, id, id + 2, 1 from x where id + 2 < n),
m as (select graph, sum(w)::double m from e group by 1), g as (select graph, n from x where n <= 8 group by 1, 2),
t as (select graph, n, string from g join s on len(string) = n),
q as (select t.graph, t.n, t.string, coalesce(sum(case when t.string[src + 1] = t.string[dst + 1] then w end), 0) inside from t left join e using (graph) group by 1, 2, 3),
z as (select graph, id, w from (select graph, src id, w from e union all select graph, dst, w from e)), k as (select graph, id, sum(w)::double k from z group by 1, 2),
c as (select t.graph, t.string, t.string[id + 1] c, sum(k) kc from t join k using (graph) group by 1, 2, 3), p as (select graph, string, sum(kc * kc) kk from c group by 1, 2)
select q.graph, q.n n_nodes, round(max(inside - case when m > 0 then kk / (4 * m) else 0 end), 6) + 0.0 quality from q left join m using (graph) left join p on p.graph = q.graph and p.string = q.string group by 1, 2""".replace("inside - case when m > 0 then kk / (4 * m) else 0 end", "case when m > 0 then inside - kk / (4 * m) else 0 end")
)
def batch_optimum_conversations(spark, sf_dir):
    """The best quality over all partitions of every conversation's graph of at most eight turns."""
    return talk_batch(spark, sf_dir).optimum(most=8).select("graph", "n_nodes", F.round("quality", 6).alias("quality"))


@query()
def batch_leiden_hits(spark, sf_dir):
    """How often Leiden reaches the best partition of the conversations' graphs of at most eight turns, and its worst gap as a share of the weight."""
    b = talk_batch(spark, sf_dir)
    best = b.optimum(most=8).select("graph", "quality")
    own = b.qualities(b.leiden().withColumnRenamed("label", "community")).select("graph", F.col("quality").alias("found"))
    gap = F.col("quality") - F.col("found")
    return best.join(own, "graph").join(b.totals().select("graph", "total_weight"), "graph").agg(F.count(F.lit(1)).alias("graphs"), F.count_if(gap < 1e-6).alias("hits"), F.max(gap / F.greatest("total_weight", F.lit(1.0))).alias("worst"))


@query("select count(*) filter (conv_id % 3 = 1) better, count(*) filter (conv_id % 3 = 0) equal, count(*) filter (conv_id % 3 = 2) worse from (select distinct conv_id from conversations)")
def fixture_summary(spark, sf_dir):
    """Wins, ties and losses against the references of a fixture document of the conversations' graphs, written to and read from the shared folder; every third
    reference is set above, and every third below, the quality of its members."""
    b = talk_batch(spark, sf_dir)
    b = batches.GraphBatch(b.nodes.withColumn("graph", F.col("graph").cast("string")), b.edges.withColumn("graph", F.col("graph").cast("string")))
    members = b.nodes.select(F.concat(F.lit("case "), "graph").alias("name"), "graph", F.col("id").alias("node"), F.floor(F.col("id") / 3).alias("community"))
    off = F.when(F.col("graph").cast("long") % 3 == 1, -1.0).when(F.col("graph").cast("long") % 3 == 2, 1.0).otherwise(0.0)
    none = F.lit(0).cast("long")
    cases = b.qualities(members).select(F.concat(F.lit("case "), "graph").alias("name"), "graph", F.lit("rb").alias("objective"), F.lit(1.0).alias("resolution"), none.alias("seed"), none.alias("reference_n_clusters"), (F.col("quality") + off).alias("reference_quality"), F.lit(0.0).alias("reference_modularity"))
    folder = f"{shared_folder(spark).rstrip('/')}/fixtures-{uuid.uuid4().hex}"
    files.write_fixtures(b, cases, members, folder)
    read = files.read_json(spark, folder, files.FIXTURES)
    own, back = files.fixture_cases(read)
    runs = own.join(files.fixture_batch(read).qualities(back), "graph").select("quality", "reference_quality")
    return metrics.quality_summary(runs, 1e-6).select("better", "equal", "worse")
