"""Forms of the operators that take whole documents in and give whole documents out.

All columns of the input pass through, whatever their names and types; ``text`` and ``doc_id`` are read.
A null text is empty; texts of any length are read whole. Rows of one doc_id are kept or dropped together where a stage decides
by document, and a row without a doc_id is then kept. Repeated rows are treated alike. An empty table gives an empty one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunks, slices, tidy
from .decontamination import decontaminate
from .ngram_join import MOST_BROADCAST, join_documents
from .quality_classifier import SCALE, THRESHOLD, features
from .secret_scan import redact


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids; few ids are broadcast, more are joined by a shuffle."""
    ids = ids.distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_anti").select(*docs.columns)


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose quality score is at least threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches):
        w, bias = np.append(sent.value, 0.0), sent.value[-1]
        for batch in batches:
            off, data = buffers(batch.column(at))
            keep = [np.zeros(0, bool)]
            for i, j in chunks(off):
                f, first, n = features(off[i : j + 1] - off[i], data[off[i] : off[j]])
                sums = np.concatenate(([0.0], np.cumsum(w[f].sum(1))))
                raw = bias + (sums[first[1:]] - sums[first[:-1]]) * SCALE / np.maximum(n, 1)
                keep.append(1 / (1 + np.exp(-np.clip(raw, -30, 30))) >= threshold)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(tidy(run), docs.schema)


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group that 5-word shingle links of 0.75 connect, the document with the smallest id."""
    own = join_documents(docs)
    return drop_ids(docs, own.where("component_id <> doc_id").select("doc_id"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    return drop_ids(docs, decontaminate(docs, benchmark).select("doc_id"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All documents, their secrets replaced; n_chars follows the text."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, at)):
            text = pa.array([None if t is None else redact(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), text)

    out = docs.mapInArrow(tidy(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
