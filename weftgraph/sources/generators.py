"""Synthetic graphs and points as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import checkpointed

# The karate club's edges, and its labels of greatest modularity.
# fmt: off
#: How often a grid's first cells may be halved.
HALVINGS = 16
KARATE = [
    (0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (0, 6), (0, 7), (0, 8), (0, 10), (0, 11), (0, 12), (0, 13), (0, 17), (0, 19), (0, 21), (0, 31),
    (1, 2), (1, 3), (1, 7), (1, 13), (1, 17), (1, 19), (1, 21), (1, 30), (2, 3), (2, 7), (2, 8), (2, 9), (2, 13), (2, 27), (2, 28), (2, 32),
    (3, 7), (3, 12), (3, 13), (4, 6), (4, 10), (5, 6), (5, 10), (5, 16), (6, 16), (8, 30), (8, 32), (8, 33), (9, 33), (13, 33),
    (14, 32), (14, 33), (15, 32), (15, 33), (18, 32), (18, 33), (19, 33), (20, 32), (20, 33), (22, 32), (22, 33),
    (23, 25), (23, 27), (23, 29), (23, 32), (23, 33), (24, 25), (24, 27), (24, 31), (25, 31), (26, 29), (26, 33), (27, 33),
    (28, 31), (28, 33), (29, 32), (29, 33), (30, 32), (30, 33), (31, 32), (31, 33), (32, 33),
]
KARATE_LABELS = [0, 0, 0, 0, 1, 1, 1, 0, 2, 2, 1, 0, 0, 0, 2, 2, 1, 0, 2, 0, 2, 0, 2, 3, 3, 3, 2, 3, 3, 2, 2, 3, 2, 2]
# fmt: on


def uniform(*keys):
    """A number in [0, 1) from the md5 of the keys joined by colons, the same in any SQL engine with md5."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)


def karate(spark: SparkSession) -> tuple[int, DataFrame, DataFrame]:
    """n, edges and the labels of greatest modularity."""
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in KARATE], "src long, dst long, weight double")
    return 34, edges, spark.createDataFrame(list(enumerate(KARATE_LABELS)), "node long, label long")


def stochastic_blocks(spark: SparkSession, blocks: int, n_per: int, p_in: float, p_out: float, seed: int = 1) -> tuple[int, DataFrame, DataFrame]:
    """n, edges and the planted labels: pairs are edges with probability p_in inside a block and p_out between two."""
    n = blocks * n_per
    pairs = spark.range(n).select(F.col("id").alias("src")).select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(n))).alias("dst")).where(F.col("dst") < n)
    same = F.floor(F.col("src") / n_per) == F.floor(F.col("dst") / n_per)
    edges = pairs.where(uniform(F.lit(seed), F.col("src"), F.col("dst")) < F.when(same, p_in).otherwise(p_out)).select("src", "dst", F.lit(1.0).alias("weight"))
    return n, edges, spark.range(n).select(F.col("id").alias("node"), F.floor(F.col("id") / n_per).alias("label"))


def ring_of_cliques(spark: SparkSession, cliques: int, size: int) -> tuple[int, DataFrame, DataFrame]:
    """n, edges and the cliques: complete graphs whose first nodes form a ring."""
    n = cliques * size
    node = spark.range(n).select("id", F.floor(F.col("id") / size).alias("c"))
    inside = node.select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id"), (F.col("c") + 1) * size - 1)).alias("dst")).where("src < dst")
    ring = spark.range(cliques).select((F.col("id") * size).alias("src"), (((F.col("id") + 1) % cliques) * size).alias("dst"))
    edges = inside.unionByName(ring).withColumn("weight", F.lit(1.0))
    return n, edges, node.select(F.col("id").alias("node"), F.col("c").alias("label"))


def lattice(spark: SparkSession, n: int, k: int, noise: float = 0.0, seed: int = 1) -> tuple[int, DataFrame]:
    """n and edges of a ring in which each node meets its k / 2 next ones; with probability noise an edge goes to a node drawn anew."""
    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("d"))
    near = (F.col("src") + F.col("d")) % n
    far = F.floor(uniform(F.lit(seed), F.lit("far"), F.col("src"), F.col("d")) * n)
    return n, edges.select("src", F.when(uniform(F.lit(seed), F.col("src"), F.col("d")) < noise, far).otherwise(near).cast("long").alias("dst"), F.lit(1.0).alias("weight")).where("src <> dst")


def blobs(spark: SparkSession, n: int, centres: int, spread: float = 0.05, seed: int = 1) -> DataFrame:
    """(id, features, label): points in the plane about centres on a circle."""
    own = spark.range(n).select("id", (F.col("id") % centres).alias("label"))
    angle = F.col("label") * (2 * 3.141592653589793 / centres)
    radius = F.sqrt(-2 * F.log(1 - uniform(F.lit(seed), F.lit("r"), F.col("id")))) * spread
    turn = uniform(F.lit(seed), F.lit("t"), F.col("id")) * (2 * 3.141592653589793)
    return own.select("id", F.array(F.cos(angle) + radius * F.cos(turn), F.sin(angle) + radius * F.sin(turn)).cast("array<float>").alias("features"), "label")


def grid_nearest(points: DataFrame, k: int, cell: float) -> DataFrame:
    """(i, j, d2, r): each plane point's k nearest others by (d2, id), none missing. Points of one place are one place with its k + 1 smallest ids, since no list
    holds more of them. A place looks into its own cell of a grid and the eight about it; one whose last neighbour is not nearer than a cell is wide, or that has fewer
    than k + 1 with itself, asks again in a grid of cells twice as wide, until the cells about it hold all places. The first cells are ``cell`` wide, or narrower where places are dense."""
    from pyspark.sql import Window

    own = checkpointed(points.select("id", (F.col("features")[0].cast("double") + 0.0).alias("x"), (F.col("features")[1].cast("double") + 0.0).alias("y")), "plane")
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).where(F.col("r") <= k + 1)
    places = checkpointed(first.groupBy("x", "y").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("place", F.col("ids")[0]), "places")  # k + 1 ids a place
    row = places.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("wide")).first()
    left, low, wide = row["x"] or 0.0, row["y"] or 0.0, row["wide"] or 0.0
    at = lambda size: (F.floor((F.col("x") - left) / size).alias("cx"), F.floor((F.col("y") - low) / size).alias("cy"))
    # how many places share a place's cell, for cells of each width: one row a width
    widths = [cell / 2**s for s in range(HALVINGS)]
    shared = places.select(F.inline(F.array(*[F.struct(F.lit(s).alias("s"), *at(size)) for s, size in enumerate(widths)]))).groupBy("s", "cx", "cy").agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowd = {r["s"]: r["mates"] for r in shared.groupBy("s").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mates")).collect()}
    cell = next((widths[s] for s in sorted(crowd) if crowd[s] <= 2 * (k + 1)), widths[-1])
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    asked, out = places.select("place", "x", "y"), None
    while True:
        asks = asked.select("place", F.col("x").alias("xi"), F.col("y").alias("yi"), *at(cell)).select("place", "xi", "yi", "cx", "cy", F.inline(steps)).select("place", "xi", "yi", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
        d2 = (F.col("x") - F.col("xi")) * (F.col("x") - F.col("xi")) + (F.col("y") - F.col("yi")) * (F.col("y") - F.col("yi"))
        # a place's own ids are the first of its list; the k + 1 nearest places hold all the rest
        met = asks.join(places.select("x", "y", "ids", *at(cell)), ["cx", "cy"]).select("place", d2.alias("d2"), F.explode("ids").alias("j"))
        near = checkpointed(met.withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy("d2", "j"))).where(F.col("r") <= k + 1).select("place", "d2", "j", "r"), "near")
        if wide <= cell:  # all places are in the cells about each other
            out = near if out is None else out.unionByName(near)
            break
        done = near.where((F.col("r") == k + 1) & (F.col("d2") <= 0.999 * cell * cell)).select("place")
        found = near.join(done, "place", "left_semi")
        out = found if out is None else out.unionByName(found)
        asked = checkpointed(asked.join(done, "place", "left_anti"), "asked")
        if asked.isEmpty():
            break
        cell *= 2
    lists = checkpointed(out.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("d2", "j"))).alias("near")), "lists")  # k + 1 entries a place
    at_place = places.select("x", "y", "place").join(lists, "place").select("x", "y", "near")
    each = own.join(at_place, ["x", "y"]).select(F.col("id").alias("i"), F.slice(F.filter("near", lambda e: e["j"] != F.col("id")), 1, k).alias("near"))
    return each.select("i", F.posexplode("near").alias("at", "e")).select("i", F.col("e.j").alias("j"), F.col("e.d2").alias("d2"), (F.col("at") + 1).alias("r"))


def grid_neighbors(points: DataFrame, k: int, cell: float) -> DataFrame:
    """(src, dst, weight) of the union of each plane point's k nearest, by joins on the cells of grids."""
    near = grid_nearest(points, k, cell)
    return near.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).distinct().withColumn("weight", F.lit(1.0))


def random_weights(edges: DataFrame, seed: int = 1) -> DataFrame:
    """Weights from 0.25 to 3.75 by a hash of the edge."""
    return edges.withColumn("weight", F.round(uniform(F.lit(seed), F.col("src"), F.col("dst")) * 3.5 + 0.25, 4))
