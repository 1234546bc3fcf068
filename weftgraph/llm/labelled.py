"""A bounded sample of labelled training documents, for the operators that learn from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, parts: int = 4) -> DataFrame:
    """(doc_id, text, label) of about bound labelled rows that are not held out, chosen by a hash of the id.

    A document with several labels has the largest one; null labels and ids are left out. The sample's ids
    are at most a little over bound rows, so they are broadcast and the texts are not shuffled."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    ids = ids.where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id"), parts)).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = ids.count()
    if n > bound:
        ids = ids.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int(bound / n * (1 << 20)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
