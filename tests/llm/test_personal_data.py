"""Personal data: base spans against the patterns as they stand, and what the model adds."""

import hashlib
import random
import re

import pytest

from weftgraph.llm import personal_data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    """[(kind, start, end)] of the base, step by step."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def carded(prefix, n=16):
    return next(prefix + str(k).zfill(n - len(prefix)) for k in range(1000) if luhn(prefix + str(k).zfill(n - len(prefix))))


CARDS = [carded("4111"), carded("5500123412"), carded("601100", 19), carded("4000 1234".replace(" ", ""), 16)]


def texts():
    rng = random.Random(7)
    bits = ["a@b.c", "_d@e.f", "x.y+z@mail-1.example.com", "a@b..c", "@b.c", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.001.1.1", "1.2.3", *CARDS, CARDS[0][:4] + " " + CARDS[0][4:], "-".join(CARDS[1][i : i + 4] for i in range(0, 16, 4)), "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 (415) 555-2671", "+4912345", "+49 30 1234567.", "++33-1.23.45.67.89)", "+", "é", "\U0001f600", "\ue000", "\ue001", "\n", " ", " ", "-", ".", "9", "@", "word", "$0", "\\"]
    rows = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", ".", ","]) for _ in range(rng.choice([1, 5, 30]))) for _ in range(400)]
    return rows + [None, "", "a@b.c_d@e.f", "a@b.c" * 3, "5" * 15 + "\ue0000", f"call +1 (415) 555-2671 {CARDS[0]} now", f"pay {CARDS[0]} 77.1.2.3"]


def found(spark, rows):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, kind int, spans string").repartition(3)
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"], s["text"]) for s in r["spans"]] for r in personal_data.find_personal_data(df).collect()}


def test_base_spans_equal_the_patterns(spark):
    rows = list(enumerate(texts()))
    got = found(spark, rows)
    for k, t in rows:
        assert [s[:3] for s in got[k] if s[3]] == plain(t), t
        assert all((t or "")[a:b].translate({0xE000: "\ue004", 0xE001: "\ue004"}) == x for kind, a, b, _, x in got[k] if kind != "card")
        assert got[k] == sorted(got[k], key=lambda s: (list(PATTERNS).index(s[0]), s[1]))


def test_what_greedy_patterns_lose_is_added_and_plain_numbers_are_not(spark):
    good = [f"write to user{k}@mail.example.com or call +1 (415) 555-{1000 + k} thanks" for k in range(60)] + [f"card {carded('4111' + str(100 + k))} was used" for k in range(60)]
    odd = ["call +1 (415) 555-2671 " + CARDS[0] + " now", "order 1234567890123 and figure 12, page 415", "build 415-555-2671-99 of version 1.2.3.4", "nothing here"]
    got = found(spark, list(enumerate(good + odd)))
    lost = {s[0]: odd[0][s[1] : s[2]] for s in got[120]}
    assert lost == {"phone": "+1 (415) 555-2671", "card": CARDS[0]} and not any(s[3] for s in got[120])
    assert got[121] == got[123] == [] and [s[0] for s in got[122]] == ["ip"]
    assert all(all(s[3] for s in got[k]) and got[k] for k in range(120))


def test_query_columns_null_ids_repeats_and_empty_tables(spark, tmp_path):
    rows = [(1, "me a@b.com"), (1, "me a@b.com"), (None, None), (2, "+1 (415) 555-2671 " + CARDS[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = personal_data.op12_personal_data(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = got.collect()
    assert len(got) == 4 and sum(r["n_email"] for r in got) == 2
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(b"email:3:10" if r["doc_id"] == 1 else b"").hexdigest()
    assert found(spark, []) == {}


def test_very_long_texts(spark):
    rows = [(0, "1 2 " * 300_000), (1, "a." * 200_000 + "a@" + "b." * 200_000 + "c"), (2, "x@y.zz " * 20_000), (3, "+1" + "5" * 500_000), (4, "1." * 300_000)]
    got = found(spark, rows)
    assert {k: len([s for s in v if s[3]]) for k, v in got.items()} == {0: 0, 1: 1, 2: 20_000, 3: 0, 4: 75_000}  # by hand: the patterns as they stand take quadratic time here
    assert [s[1] for s in got[2]] == [7 * k for k in range(20_000)]


@pytest.mark.parametrize("share", [0.2, 0.7])
def test_em_tells_good_labelers_from_bad_ones(share):
    """Planted: five labelers right nine times of ten, one by chance, one silent."""
    rng = random.Random(3)
    truth, seen = {}, {}
    for _ in range(20_000):
        y = rng.random() < share
        v = "".join(("2" if y == (rng.random() < 0.9) else "0") for _ in range(5)) + rng.choice("02") + "1"
        seen[v] = seen.get(v, 0) + 1
        truth[v] = truth.get(v, 0) + y
    post = personal_data.reliabilities([(0, v, n) for v, n in seen.items()])
    assert sum(abs(post["0" + v] - truth[v] / n) * n for v, n in seen.items()) / 20_000 < 0.02
