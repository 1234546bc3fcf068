"""A corpus pipeline of the training-data operators: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import byte_bpe, quality_classifier, stages
from weftgraph.llm.common import documents, dropped, small_batches, staged


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject."""
    return stages.keep_good(docs, quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return stages.keep_one_of_each_group(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return stages.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their secrets."""
    return stages.redact_secrets(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of all documents."""
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path, public.PATTERN), path, texts=False)


def bounded(stage):
    """stage, its rows handed to Python tasks in small batches: five stages' workers share an executor."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", bounded(good_documents)),
    ("n-gram Jaccard join", bounded(distinct_documents)),
    ("benchmark decontamination", bounded(clean_documents)),
    ("secret scans", bounded(redacted_documents)),
    ("byte-level BPE", bounded(encoded_documents)),
]
#: The classifier and the vocabulary are beyond SQL; tests/llm runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, written like those of the others, so that the session's settings are its own again when
    this returns; what the stages before it kept is deleted once the next one is written."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    docs = documents(spark, sf_dir)
    try:
        for k, (_, stage) in enumerate(STAGES):
            out = staged(stage(spark, docs, sf_dir), "stage")
            if k:
                dropped(docs)
            docs = out
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return docs
