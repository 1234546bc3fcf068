"""Groupings (node, group) and clusterings (node, label); label -1 is noise.

Renumbering never takes a window over all nodes: distinct groups are ranked, which are few beside the nodes, and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import prefix_sums

NOISE = -1


def isolated(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("node"), F.col("id").alias("group"))


def unified(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("group"))


def dense_ranks(keys: DataFrame, key: str) -> DataFrame:
    """(key, rank) of distinct non-negative long keys, ranks from 0 in ascending order, by range-wise running counts."""
    return prefix_sums(keys.select(key).distinct().withColumn("_one", F.lit(1).cast("long")), key, "_one", "rank").select(key, "rank")


def normalized(grouping: DataFrame) -> DataFrame:
    """Groups without gaps, in the order of their old ids."""
    ranks = dense_ranks(grouping.select("group"), "group")
    return grouping.join(ranks, "group").select("node", F.col("rank").cast("long").alias("group"))


def from_assignments(rows: DataFrame) -> DataFrame:
    return normalized(rows.select("node", "group"))


def members(grouping: DataFrame) -> DataFrame:
    """(group, members): ascending members of each group that has any."""
    return grouping.groupBy("group").agg(F.array_sort(F.collect_list("node")).alias("members"))


def group_of(grouping: DataFrame, node: int) -> int | None:
    row = grouping.where(F.col("node") == node).first()
    return None if row is None else row["group"]


def groups_range(grouping: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows of the nodes start..stop-1."""
    return grouping.where((F.col("node") >= start) & (F.col("node") < stop))


def with_group(grouping: DataFrame, node: int, group: int) -> DataFrame:
    return grouping.select("node", F.when(F.col("node") == node, F.lit(group).cast("long")).otherwise(F.col("group")).alias("group"))


def with_groups(grouping: DataFrame, nodes: DataFrame, group: int) -> DataFrame:
    """All of nodes(node) in one group."""
    moved = nodes.select("node").distinct().withColumn("_moved", F.lit(True))
    return grouping.join(moved, "node", "left").select("node", F.when(F.col("_moved"), F.lit(group).cast("long")).otherwise(F.col("group")).alias("group"))


def node_count(grouping: DataFrame) -> int:
    return grouping.count()


def group_count(grouping: DataFrame) -> int:
    """The largest id plus one, gaps included; 0 without nodes."""
    top = grouping.agg(F.max("group")).first()[0]
    return 0 if top is None else top + 1


def merged(grouping: DataFrame, arrangement: DataFrame) -> DataFrame:
    """Each group replaced by what arrangement(node, group) says of it, without gaps."""
    arrangement = arrangement.select(F.col("node").alias("_old"), F.col("group").alias("_new"))
    return normalized(grouping.join(arrangement, F.col("group") == F.col("_old")).select("node", F.col("_new").alias("group")))


def cleared(grouping: DataFrame) -> DataFrame:
    return grouping.select("node", F.lit(0).cast("long").alias("group"))


def group_sizes(grouping: DataFrame) -> DataFrame:
    return grouping.groupBy("group").agg(F.count(F.lit(1)).alias("size"))


# clusterings


def from_labels(rows: DataFrame) -> DataFrame:
    """(node, label): labels renumbered in the order of their first node; noise stays noise. rows may hold labels of any type
    that orders, with noise as -1 of a number type."""
    is_noise = F.col("label") == NOISE if dict(rows.dtypes)["label"] != "string" else F.lit(False)
    firsts = rows.where(~is_noise).groupBy("label").agg(F.min("node").alias("_first"))
    ranks = firsts.join(dense_ranks(firsts.select("_first"), "_first"), "_first").select(F.col("label").alias("_label"), F.col("rank").cast("long").alias("rank"))
    return rows.join(ranks, F.col("label") == F.col("_label"), "left").select("node", F.coalesce("rank", F.lit(NOISE).cast("long")).alias("label"))


def n_clusters(labels: DataFrame) -> int:
    return labels.where(F.col("label") != NOISE).select("label").distinct().count()


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("label") != NOISE).groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def clusters(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("label") != NOISE).groupBy("label").agg(F.array_sort(F.collect_list("node")).alias("members"))


def noise(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("label") == NOISE).select("node")


def first_rows(df: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("_r = 1").drop("_r")
