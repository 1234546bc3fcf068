"""Operators that SQL cannot express, against plain loops over small tables."""

import math
import random

import numpy as np
import pytest

from weftgraph.llm import decontamination, quality_classifier


def least_distance(item, text):
    """Edit distance of item to the nearest stretch of text, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        above, row[0] = row[0], 0
        for k, b in enumerate(item, 1):
            above, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, above + (b != c))
        best = min(best, row[-1])
    return best


def test_decontamination_equals_edit_distances_of_all_pairs(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeiournst") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((3, 6, 9, 12, 20, 30))]
    texts = []
    for _, item in items:
        for share in (0.0, 0.04, 0.08, 0.2):
            raw = list(item)
            for _ in range(int(len(raw) * share)):
                raw[rng.randrange(len(raw))] = rng.choice(("", "x", "qq"))
            texts.append(f"{' '.join(word() for _ in range(12))} {''.join(raw)} {' '.join(word() for _ in range(12))}")
    docs = [*enumerate(texts), (len(texts), ""), (len(texts) + 1, None)]
    rows = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows}
    want = {(d, k): n for d, t in docs for k, i in items if (n := least_distance(i, t or "")) <= len(i) // 10}
    assert len(got) == len(rows) and all(want.get(pair) == n for pair, n in got.items())  # nothing beyond reach, distances exact
    assert len(got) >= 0.95 * len(want) and {p for p, n in want.items() if n == 0} <= set(got)


def test_fit_equals_a_plain_loop():
    rng = random.Random(3)
    rows = []
    for k in range(120):
        i = np.array(sorted(rng.sample(range(40), 6)), np.int32)
        rows.append((int(i[0] < 5) if k % 7 else 1, i, np.array([rng.randint(1, 3) for _ in i], np.int32), rng.randint(6, 20)))
    got = quality_classifier.fit(rows, epochs=2)
    alpha, beta, l1, l2, bias = 0.3, 1.0, 1e-3, 1e-2, 1 << quality_classifier.BITS
    z, n = {}, {}

    def weight(f):
        total = z.get(f, 0.0)
        return 0.0 if abs(total) <= l1 else -(total - math.copysign(l1, total)) / ((beta + math.sqrt(n[f])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            label, index, counts, words = rows[k]
            x = {int(f): c * quality_classifier.SCALE / words for f, c in zip(index, counts)} | {bias: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(f) * v for f, v in x.items())))
            for f, v in x.items():
                g, before = (p - label) * v, n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * weight(f) if f in n else g
                n[f] = before + g * g
    for f in (*range(40), bias):
        assert got[f] == pytest.approx(weight(f) if f in n else 0.0, abs=1e-9), f
    assert np.count_nonzero(got) <= 41
