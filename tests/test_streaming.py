"""Edges that arrive as a stream."""

from weftgraph.streaming import ingest


def test_batches_of_edges_are_merged_and_a_later_run_adds_only_new_files(spark, tmp_path):
    schema = "src long, dst long, weight double"
    source, folder, state = (str(tmp_path / x) for x in ("source", "edges", "state"))
    spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0), (2, 2, 1.0)], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    for more in ([], [(0, 1, 4.0), (3, 1, 0.5)], []):
        if more:
            spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.edge_ingest(stream, folder, state).awaitTermination(60)
    assert sorted(tuple(r) for r in ingest.ingested_edges(spark, folder).collect()) == [(0, 1, 7.0), (1, 3, 0.5), (2, 2, 1.0)]
