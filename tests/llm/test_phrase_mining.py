"""Collocations against counting by hand."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import common, phrase_mining


def plain(rows, least, top):
    """The contract, step by step: rows are (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, *w[i : i + k]] += 1
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        inside = lambda q: q[0] == lang and len(q) > len(p) and any(q[1:][i : i + len(w)] == w for i in range(len(q) - len(w)))
        if any(inside(q) and 100 * b >= 100 * a for q, b in cand.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = Counter()
    found = []
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= top:
            found.append((r[0], rank[r[0]], *r[1:]))
    return found


def texts(seed=3, n=120):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "ünder", "a", "new", "york", "city", "hall", "中文", "x-1", "b\x00c", "z" * 30]
    line = lambda: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! "]) for _ in range(rng.choice([3, 10, 40])))
    rows = [(line(), rng.choice(["en", "en", "fr", None, "und", ""])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), (" \t", "en"), (rows[0][0], "en"), (rows[0][0], "en"), ("one two three four five six seven " * 20, "fr"), ("only once here", "xx")]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, f int, phrase string").repartition(3)
    return sorted(tuple(r) for r in phrase_mining.mine(df, **more).collect())


@pytest.mark.parametrize("top", [2000, 7])
def test_phrases_equal_counting_by_hand(spark, top):
    want = plain(texts(), 6, top)
    assert mined(spark, texts(), least=6, top=top) == sorted(want) and len(want) >= 20


def test_no_rows_and_null_rows(spark):
    assert mined(spark, [], least=2) == [] and mined(spark, [(None, None), ("a b", "en")], least=2) == []


def test_steps_end_at_pieces_ends(monkeypatch):
    monkeypatch.setattr(phrase_mining, "CHUNK", 40)
    raw = [t.encode() for t, _ in texts() if t] + [b"no break " * 50]
    off, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
    cut = list(phrase_mining.ranges(off, data))
    assert [a for a, _ in cut] == [0, *[b for _, b in cut[:-1]]] and cut[-1][1] == len(data) and len(cut) > 50
    assert all(b in off or phrase_mining.BREAK[data[b - 1]] for _, b in cut)


def test_one_very_long_text(spark):
    rows = [("alpha beta gamma " * 60_000 + ". delta " * 1000, "en")]
    assert mined(spark, rows, least=100) == sorted(plain(rows, 100, 2000))


def test_perfect_hash_is_minimal_and_tells_other_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    found = phrase_mining.PerfectHash(keys)
    assert sorted(found.slots(keys)) == list(range(len(keys)))
    assert (found.slots(keys + np.uint64(1)) >= 0).sum() == np.isin(keys + np.uint64(1), keys).sum()
    assert len(phrase_mining.PerfectHash(keys[:0]).slots(keys)) == len(keys)


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(9_007_199_254_740_993, 90_071_992_547_409_931, 9_007_199_254_740_995, 9_007_199_254_740_997), (100, 10**15 + 7, 3, 7)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(phrase_mining.floor_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_bloom_filter_lets_every_key_through(spark):
    keys = common.mix(np.arange(5000, dtype=np.uint64))
    bits = phrase_mining.bloom_filter(spark.createDataFrame([(int(k),) for k in keys.astype(np.int64)], "key long").repartition(3))
    assert phrase_mining.passes(bits, keys).all() and phrase_mining.passes(bits, common.mix(np.arange(5000, 105_000, dtype=np.uint64))).mean() < 0.05
