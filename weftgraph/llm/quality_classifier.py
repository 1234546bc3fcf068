"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

Features are hashes of word 1- and 2-grams and of 1- to 3-grams of word shapes (``Word.`` is ``Aa.``,
``THE!!`` is ``A!``), and of words that repeat the one before; a document's value for a feature is
its count divided by the document's words. A score is a sparse dot product and a sigmoid.

The model is fitted on about ``SAMPLE`` labelled rows (a documented bound), in one task; all documents are
scored. Defined results: a null or empty text has no features and scores the model's bias; without any
label every score is 0.5; every row is scored by itself; an empty table gives no rows. Texts of any length are
read whole; a document with several labels has the largest; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, binary_lists, buffers, chunks, documents, held_out, lowered, mix, prefix_sums, range_hashes, tidy, word_bounds
from .labelled import labelled_sample

SAMPLE = 16_000
BITS = 18
SCALE = 8.0
#: The score from which a document is good, for the query and the pipeline's stage alike.
THRESHOLD = 0.7
SHAPES = np.arange(256, dtype=np.uint8)
SHAPES[97:123] = 97
SHAPES[128:] = 97
SHAPES[65:91] = 65
SHAPES[48:58] = 48


def features(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features by word (words x families, -1 for none), each document's first word, words."""
    starts, ends, first = word_bounds(off, data)
    n = len(starts)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    word = range_hashes(prefix_sums(lowered(data)), starts, ends)
    shape = SHAPES[data]
    keep = ~SPACE[data]
    same = np.zeros(len(data), bool)
    same[1:] = shape[1:] == shape[:-1]
    head = np.zeros(len(data), bool)
    head[starts] = True
    keep &= head | ~same
    at = np.concatenate(([0], np.cumsum(keep)))
    form = range_hashes(prefix_sums(shape[keep]), at[starts], at[ends])
    out = np.full((n, 6), -1, np.int32)
    mask = np.uint64((1 << BITS) - 1)

    def put(k: int, values: np.ndarray, ok=slice(None)) -> None:
        out[ok, k] = (mix(values + np.uint64((k + 1) * 0xA0761D6478BD642F % (1 << 64))) & mask).astype(np.int32)[ok]

    def before(values: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate((np.zeros(k, np.uint64), values[:-k]))[:n] if n else values

    second = np.zeros(n, bool)
    second[1:] = doc[1:] == doc[:-1]
    third = np.zeros(n, bool)
    third[2:] = doc[2:] == doc[:-2]
    twice = mix(before(form, 1)) + form
    put(0, word)
    put(1, mix(before(word, 1)) + word, second)
    put(2, form)
    put(3, twice, second)
    put(4, mix(mix(before(form, 2)) + before(form, 1)) + form, third)
    put(5, np.zeros(n, np.uint64), second & (before(word, 1) == word))
    return out, first, np.diff(first)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, int]], epochs: int = 5, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-2) -> np.ndarray:
    """Weights of FTRL-proximal logistic regression; the last one is the bias. rows: (label, distinct features, their counts, words)."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, i, c, words = rows[k]
            i, x = np.append(i, size), np.append(c * (SCALE / max(words, 1)), 1.0)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -30, 30)))
            g = (p - label) * x
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] = zi + g - s * wi
            n[i] = ni + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> np.ndarray:
    """The model's weights, 2 ** BITS + 1 numbers."""

    def prepare(batches):
        for batch in batches:
            off, data = buffers(batch.column(0))
            for i, j in chunks(off):
                f, first, n = features(off[i : j + 1] - off[i], data[off[i] : off[j]])
                flat = f.reshape(-1)
                kept = flat >= 0
                doc = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(first) * f.shape[1])[kept]
                both, count = np.unique((doc << BITS) | flat[kept], return_counts=True)
                ends = np.searchsorted(both, np.arange(j - i + 1, dtype=np.int64) << BITS)
                idx, count = (both & ((1 << BITS) - 1)).astype(np.int32), count.astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), binary_lists(idx, ends), binary_lists(count, ends), pa.array(n, pa.int64())], names=["label", "idx", "count", "n"])

    def learn(batches):
        rows = [(int(y.as_py()), np.frombuffer(x.as_buffer(), np.int32), np.frombuffer(c.as_buffer(), np.int32), int(n.as_py())) for b in batches for y, x, c, n in zip(*b.columns)]
        rows.sort(key=lambda r: (r[0], r[3], r[1].tobytes(), r[2].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).tobytes()], pa.binary())], names=["weights"])

    sample = labelled_sample(docs, labels, label, bound).select("text", "label").mapInArrow(tidy(prepare), "label int, idx binary, count binary, n long")
    return np.frombuffer(sample.repartition(1).mapInArrow(tidy(learn), "weights binary").first()[0], np.float64).copy()


def score_quality(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches):
        w = np.append(sent.value, 0.0)  # the index -1 reads the last weight
        bias = sent.value[-1]
        for batch in batches:
            off, data = buffers(batch.column(1))
            out = [np.zeros(0)]
            for i, j in chunks(off):
                f, first, n = features(off[i : j + 1] - off[i], data[off[i] : off[j]])
                sums = np.concatenate(([0.0], np.cumsum(w[f].sum(1))))
                raw = bias + (sums[first[1:]] - sums[first[:-1]]) * SCALE / np.maximum(n, 1)
                out.append(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
            score = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(tidy(scored), "doc_id long, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, weights).select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLE: dict[str, str] = {}
