"""Heap Lloyd against plain Lloyd's algorithm over whole tables."""

import hashlib
import math

import numpy as np
import pytest

from weftgraph.llm import vector_codes


def plain(rows, parts=16, entries=64, rounds=2):
    """The contract, step by step: rows are (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, -1).transpose(1, 0, 2)
    books = x[:, :entries].copy()
    def nearest(p):
        d = np.array([[int(((a - b) ** 2).sum()) for b in books[p]] for a in x[p]])
        return d.argmin(1), d.min(1)
    for _ in range(rounds):
        for p in range(parts):
            own, _ = nearest(p)
            for e in range(books.shape[1]):
                if (own == e).any():
                    books[p, e] = [int(c) // int((own == e).sum()) for c in x[p][own == e].sum(0)]
    found = [nearest(p) for p in range(parts)]
    error = sum(d for _, d in found)
    labels = {}
    for r, e in zip(kept, error):
        labels[r[2]] = labels.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(v) for v in books.reshape(-1)).encode()).hexdigest()
    return sorted((-1 if r[0] is None else r[0], "".join(f"{c[0][k]:02x}" for c in found), int(error[k]), labels[r[2]], sha) for k, r in enumerate(kept))


def coded(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compress(df, **more).collect())


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(k * 7, [float(v) for v in (rng.normal(size=dims) * spread).astype(np.float32)], int(rng.integers(4))) for k in range(n)]


def test_codes_equal_plain_lloyd(spark):
    rows = vectors(700, 32, 1) + [(3, None, 1), (4, [1.0] * 31 + [None], 1), (5, [float("nan")] * 32, 2), (6, [1.0] * 31 + [float("inf")], 2), (8, [], 1)]
    rows += [(9, rows[0][1], None), (9, rows[0][1], None), (10, [0.0] * 32, None), (None, rows[5][1], 3)] + [(10_000 + k, rows[1][1], 5) for k in range(300)]
    assert coded(spark, rows) == plain(rows)


def test_codes_with_many_rounds_and_one_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 1)  # the labels' sums go by a shuffle
    rows = vectors(300, 16, 2, 0.05) + [(100_000 + k, [0.25] * 16, 1) for k in range(200)]
    assert coded(spark, rows, rounds=6, entries=20) == plain(rows, rounds=6, entries=20)


def test_codes_of_few_rows_and_of_none(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    rows = vectors(5, 16, 3)
    assert coded(spark, rows) == plain(rows)
    clash = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, error int, code string, salt int")
    assert vector_codes.compress(clash).count() == 5


def test_refused_vectors(spark):
    for bad in ([0.5] * 15, [70_000.0] * 16):
        with pytest.raises(ValueError):
            coded(spark, [(1, bad, 1)])
    with pytest.raises(Exception, match="components"):
        coded(spark, vectors(80, 16, 4) + [(99_999, [0.5] * 32, 1)])


def test_heaps_leave_most_parts_alone():
    rng = np.random.default_rng(5)
    x = (np.concatenate([rng.normal(c, 3, size=(500, 4)) for c in range(0, 4000, 1000)])).astype(np.int32)
    books = x[::500].astype(np.int64).reshape(1, 4, 4)
    block, sums = vector_codes.Block.assigned(x, books)
    after = vector_codes.refilled(books, sums)
    drift = vector_codes.drifts(books, after)
    left = sum(len(h) - sum(i >> vector_codes.ROW_BITS <= int(drift[0, e]) for i in h) for e, h in enumerate(block.heaps[0]))
    assert left == len(x) and not block.moved(after, drift).any()
    assert (vector_codes.distances(x, after[0]).argmin(1) == block.codes[:, 0]).all()
