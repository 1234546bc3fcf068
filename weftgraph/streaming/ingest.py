"""Edges that arrive as a stream, merged batch by batch. An addition of this engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import merged_edges


def edge_ingest(stream: DataFrame, folder: str, checkpoint: str):
    """A started query that writes each batch of stream(src, dst, weight) once, its parallel edges summed, under
    folder/batch=k; a batch that is tried again overwrites itself."""

    def write(batch: DataFrame, k: int) -> None:
        merged_edges(batch).write.mode("overwrite").parquet(f"{folder}/batch={k}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested_edges(spark, folder: str) -> DataFrame:
    """The edges of all batches so far."""
    return merged_edges(spark.read.parquet(folder).select("src", "dst", "weight"))
