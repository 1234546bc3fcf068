"""Comparing labelings: contingency, NMI, adjusted Rand index, disconnected communities, win/loss summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.graph import Graph


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n) of two labelings (node, label) of the same nodes."""
    one, two = a.select(F.col("node").alias("_x"), F.col("label").alias("a")), b.select(F.col("node").alias("_y"), F.col("label").alias("b"))
    return one.join(two, F.col("_x") == F.col("_y")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """One row (nmi, ari) of a contingency (a, b, n). Without nodes both are 1; NMI is 1 when both entropies are 0, ARI
    when its denominator is."""
    n = table.withColumn("n", F.col("n").cast("double"))
    total = n.agg(F.sum("n").alias("t"))
    j = n.withColumn("na", F.sum("n").over(Window.partitionBy("a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b"))).join(F.broadcast(total))  # one row
    x = lambda c: c * (c - 1) / 2
    #  each marginal's term is spread over the cells of its row or column
    sums = j.agg(
        F.max("t").alias("t"),
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"),
        F.sum(-F.col("n") / F.col("t") * F.log(F.col("na") / F.col("t"))).alias("ha"),
        F.sum(-F.col("n") / F.col("t") * F.log(F.col("nb") / F.col("t"))).alias("hb"),
        F.sum(x(F.col("n"))).alias("sij"),
        F.sum(F.col("n") * (F.col("na") - 1) / 2).alias("sa"),
        F.sum(F.col("n") * (F.col("nb") - 1) / 2).alias("sb"),
    )
    all_pairs = x(F.col("t"))
    expected = F.when(all_pairs > 0, F.col("sa") * F.col("sb") / all_pairs).otherwise(0.0)
    top = (F.col("sa") + F.col("sb")) / 2
    nmi = F.when(F.col("t").isNull() | (F.abs(F.col("ha") + F.col("hb")) < 1e-15), 1.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb")))
    ari = F.when(F.col("t").isNull() | (F.abs(top - expected) < 1e-12), 1.0).otherwise((F.col("sij") - expected) / (top - expected))
    return sums.select(nmi.alias("nmi"), ari.alias("ari"))


def nmi(a: DataFrame, b: DataFrame) -> float:
    return agreement(contingency(a, b)).first()["nmi"]


def ari(a: DataFrame, b: DataFrame) -> float:
    return agreement(contingency(a, b)).first()["ari"]


def disconnected_communities(graph: Graph, labels: DataFrame) -> DataFrame:
    """(label, parts) of the labels whose nodes fall into more than one component of the label's own edges."""
    l = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    a, b = l.select(F.col("_n").alias("_a"), F.col("_l").alias("_la")), l.select(F.col("_n").alias("_b"), F.col("_l").alias("_lb"))
    inside = graph.edges.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).where("_la = _lb").select("src", "dst")
    found = components(inside).withColumnRenamed("node", "_c")
    own = labels.join(found, F.col("node") == F.col("_c"), "left").select("label", F.coalesce("component", "node").alias("component"))
    return own.groupBy("label").agg(F.count_distinct("component").alias("parts")).where("parts > 1")


def quality_summary(runs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row (better, equal, worse, mean_relative) of runs(quality, reference_quality)."""
    gap = F.col("quality") - F.col("reference_quality")
    near = tolerance * F.greatest(F.abs("reference_quality"), F.lit(1.0))
    relative = F.when(F.abs("reference_quality") > 0, gap / F.abs("reference_quality"))
    return runs.agg(F.count_if(gap > near).alias("better"), F.count_if(F.abs(gap) <= near).alias("equal"), F.count_if(gap < -near).alias("worse"), F.avg(relative).alias("mean_relative"))


def best_runs(runs: DataFrame, key: str = "name") -> DataFrame:
    """Of runs(key, seed, quality), each key's best seed; the smaller one of equal."""
    best = F.max_by(F.struct("seed", "quality"), F.struct("quality", -F.col("seed"))).alias("best")
    return runs.groupBy(key).agg(best).select(key, "best.seed", "best.quality")
