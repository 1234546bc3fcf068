"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

All work on texts is DataFrame expressions; the driver sees counts of vote patterns and of hashed features only, both of fixed size.

1. Candidates. Base spans are the valid matches of four patterns (email, ip, card, phone); they always stay. Further candidates come from looser forms
   outside the base spans: card numbers and strictly shaped phone numbers that the greedy base patterns lost in a longer run of digits, national
   phone numbers, written-out e-mail addresses, and IPv6 addresses.
2. Votes. Every candidate, base ones too, gets a vote (yes, no, none) from each of seven labelers: three on its form (regular expressions and
   check digits), one gazetteer (top-level domains, calling codes, issuers' numbers, private networks), three on its surroundings.
3. EM. The counts of (kind, votes) are sufficient for a Dawid-Skene model: per kind a prior and, for every labeler, the chances of its votes on
   true and on false spans. The chances start from, and are smoothed towards, those of a labeler that is mostly right.
4. Classifier. A naive Bayes model over hashed features of a span and its neighbours is trained on the posteriors of all candidates. Looser candidates of
   positive log odds are added.

Positions come from texts that are split at their matches; no pattern repeats a group without bound, so that very long matches do not recurse, and
runs are entered at their first character only, so that time grows with the text's length.

Defined results: a null text is empty and has no spans. Every row is judged by itself, repeated ones and null ids too. Texts are read whole. Other columns are dropped,
whatever their names. An empty table gives no rows. Positions are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged

KINDS = ("email", "ip", "card", "phone")
#: Marks inside texts (private-use characters; those of a text itself become OTHER): a separator between digits, the edge of a match, a dot inside a domain, a masked place.
JOINT, EDGE, DOT, MASK, OTHER = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
LOCAL, LABEL, PART = "A-Za-z0-9._%+" + DOT + "-", "A-Za-z0-9-", "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Base patterns; EMAIL is for texts with marked dots, CARD for texts with marked separators.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{JOINT}])[0-9][0-9{JOINT}]{{15,36}}+(?![0-9{JOINT}])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Looser forms.
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,10}(?![A-Za-z])",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
)
BEFORE, AFTER, STEP = 40, 24, 256
#: Forms that a careful writer would use, by kind.
STRICT = (
    r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,10}$",
    r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$|:",
    r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$",
    r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}$",
)
#: Gazetteers: top-level domains; issuers' first digits; calling codes; networks that are nobody's.
TLDS = r"(?i)(?:\.|dot[\])]? ?)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|ca|ch|at|be|nl|pt|pl|se|no|fi|dk|ie|jp|cn|in|br|mx|au|nz)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|30[0-5]|36|38|6011|64[4-9]|65|62)"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-3]|5[09][0-9]|6[7-9][0-9]|8[058][0-9]|9[679][0-9])(?:[^0-9]|[0-9]{7})"
NOBODYS = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^(?:[0-9]\.){3}[0-9]$"
CUES = (r"(?i)\b(?:e-?mail|mail|contact|write|reach|address|courriel|correo)\b", r"(?i)\b(?:ip|host|server|client|address|login|logged|from)\b", r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|payment|karte|carte|tarjeta)\b", r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell|sms|whatsapp|telefon|teléfono|téléphone)\b")
AGAINST = r"(?i)\b(?:version|release|section|chapter|figure|isbn|issn|doi|order|invoice|part|serial|build|page|id)\b[^A-Za-z0-9]{0,3}$|[#$€£§=_/]$"
VOTERS, BUCKETS, ROUNDS = 7, 2048, 40
#: Pseudo-counts of the votes no, none, yes on false and on true spans.
PRIOR = ((4.0, 4.0, 1.0), (1.0, 4.0, 4.0))


def let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.transform(F.array(value), body)[0]


def pieces(text: Column, pattern: str) -> Column:
    """text cut at the matches: every second piece is one."""
    return F.split(F.regexp_replace(text, pattern, EDGE + "$0" + EDGE), EDGE, -1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def starts(cut: Column) -> Column:
    """Where each piece starts: sums inside runs of STEP pieces, and sums of runs."""
    runs = lambda lens: F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / STEP).cast("int")), lambda b: F.slice(lens, b * STEP + 1, STEP))
    heads = lambda rs: F.aggregate(rs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda s, r: F.struct((s["at"] + total(r)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
    inside = lambda rs, hs: F.flatten(F.zip_with(rs, hs, lambda r, h: F.transform(r, lambda _, i: h + total(F.slice(r, F.lit(1), i)))))
    return let(F.transform(cut, F.char_length), lambda lens: let(runs(lens), lambda rs: let(heads(rs), lambda hs: inside(rs, hs))))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def valid(kind: int, text: Column) -> Column:
    """Whether a base match is kept."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return text.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == 2:
        return let(digits(text), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    return F.length(digits(text)).between(8, 15)


def located(cut: Column, kind: int, base: bool) -> Column:
    """Structs (kind, base, start, end, text, before, after) of the valid matches among pieces."""
    at = lambda off: F.transform(cut, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), off[i].alias("start"), (off[i] + F.char_length(x)).alias("end"), F.translate(x, JOINT + DOT, " .").alias("text"), F.when(i > 0, F.right(F.get(cut, i - 1), F.lit(BEFORE))).otherwise("").alias("before"), F.coalesce(F.left(F.get(cut, i + 1), F.lit(AFTER)), F.lit("")).alias("after"), i.alias("i")))
    keep = (lambda s: valid(kind, s["text"])) if base else (lambda s: F.call_function("luhn_check", digits(s["text"]))) if kind == 2 else (lambda s: F.lit(True))
    found = let(starts(cut), lambda off: F.filter(at(off), lambda s: (s["i"] % 2 == 1) & keep(s)))
    return F.when(F.size(cut) > 1, F.transform(found, lambda s: s.dropFields("i"))).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<kind:int,base:boolean,start:int,end:int,text:string,before:string,after:string>>"


def masked(cut: Column, kind: int) -> Column:
    """The text again, its base spans hidden."""
    return F.translate(F.array_join(F.transform(cut, lambda x, i: F.when((i % 2 == 1) & valid(kind, F.translate(x, JOINT + DOT, " .")), F.repeat(F.lit(MASK), F.char_length(x))).otherwise(x)), ""), JOINT + DOT, " .")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of docs(doc_id, text): base spans and looser candidates."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), JOINT + EDGE + DOT + MASK, OTHER * 4)
    rows = docs.select("doc_id", text.alias("t")).select("*", F.col("t").rlike("[0-9]").alias("_digit"))
    plain, none = F.col("t"), F.array(F.lit(""))
    mark_dots = F.regexp_replace(plain, rf"(?<=[{LABEL}])\.(?=[{LABEL}])", DOT)
    mark_joints = F.regexp_replace(plain, "(?<=[0-9])[ -](?=[0-9])", JOINT)
    many = F.col("_digit") & plain.rlike("[0-9](?:[ -]?[0-9]){12}")
    rows = rows.select(
        "doc_id", "t", "_digit", many.alias("_many"), F.when(plain.contains("@"), pieces(mark_dots, EMAIL)).otherwise(none).alias("c0"), F.when(F.col("_digit"), pieces(plain, IP)).otherwise(none).alias("c1"),
        F.when(plain.contains("+"), pieces(plain, PHONE)).otherwise(none).alias("c3"),
    ).select("*", F.when(F.col("_many"), pieces(mark_joints, CARD)).otherwise(none).alias("c2"))
    rest = lambda k, when: F.when(when, pieces(F.when(F.size(f"c{k}") > 1, masked(F.col(f"c{k}"), k)).otherwise(plain), LOOSE[k])).otherwise(none).alias(f"l{k}")
    rows = rows.select("*", rest(0, plain.contains("dot")), rest(1, F.col("_digit") & plain.rlike("(?:[0-9A-Fa-f]{1,4}:){7}")), rest(2, F.col("_many")), rest(3, F.col("_digit") & plain.rlike("[0-9]{3}[ .-]?[0-9]{4}")))
    return rows.select("doc_id", F.concat(*(located(F.col(f"c{k}"), k, True) for k in range(4)), *(located(F.col(f"l{k}"), k, False) for k in range(4))).alias("spans"))


def by_kind(kind: Column, options) -> Column:
    out = F.when(kind == 0, options[0])
    for k in range(1, 4):
        out = out.when(kind == k, options[k])
    return out


def votes(s: Column) -> Column:
    """The labelers' votes on a candidate, as a text of VOTERS digits: 0 no, 1 none, 2 yes."""
    kind, text, before, after = s["kind"], s["text"], s["before"], s["after"]
    vote = lambda yes, no: F.when(yes, "2").when(no, "0").otherwise("1")
    agree = lambda yes: F.when(yes, "2").otherwise("0")
    n = F.length(digits(text))
    return F.concat(
        by_kind(kind, [agree(text.rlike(p)) for p in STRICT]),
        by_kind(kind, [F.lit("1"), agree(text.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$|:")), agree(F.call_function("luhn_check", digits(text))), F.lit("1")]),
        by_kind(kind, [agree(F.length(text).between(6, 100)), vote(text.rlike("[0-9]{2}"), F.lit(False)), agree(n.isin(13, 14, 15, 16, 19)), agree(n.between(8, 15))]),
        by_kind(kind, [agree(text.rlike(TLDS)), vote(F.lit(False), text.rlike(NOBODYS)), agree(digits(text).rlike(ISSUERS)), vote(text.rlike(CALLING), text.startswith("+"))]),
        by_kind(kind, [vote(before.rlike(p), F.lit(False)) for p in CUES]),
        vote(F.lit(False), before.rlike(AGAINST)),
        vote(before.rlike(r"(?:^|[\s,;:(\[<\"'])$") & after.rlike(r"^(?:$|[\s,;:.!?)\]>\"'])"), before.rlike("[A-Za-z0-9._/-]$") | after.rlike("^[A-Za-z0-9_/]")),
    )


def features(s: Column) -> Column:
    """A candidate's hashed features: form, length, the words and the characters beside it."""
    shape = F.left(F.regexp_replace(F.regexp_replace(s["text"], "[A-Za-z]+", "a"), "[0-9]", "9"), F.lit(40))
    beside = lambda c: F.regexp_replace(F.regexp_replace(c, r"[\p{L}]", "a"), "[0-9]", "9")
    said = [
        F.concat(F.lit("s"), shape), F.concat(F.lit("n"), F.length(s["text"]).cast("string")), F.concat(F.lit("p"), F.lower(F.regexp_extract(s["before"], r"(\p{L}+)[^\p{L}]*$", 1))), F.concat(F.lit("f"), F.lower(F.regexp_extract(s["after"], r"^[^\p{L}]*(\p{L}+)", 1))),
        F.concat(F.lit("l"), beside(F.right(s["before"], F.lit(1)))), F.concat(F.lit("r"), beside(F.left(s["after"], F.lit(1)))),
    ]
    return F.array(*(F.pmod(F.xxhash64(s["kind"], x), F.lit(BUCKETS)).cast("int") for x in said))


def reliabilities(patterns: list[tuple[int, str, int]]) -> dict[str, float]:
    """EM over counts of (kind, votes): each pattern's posterior chance of being personal data, by f"{kind}{votes}"."""
    out: dict[str, float] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = sorted((v, n) for k, v, n in patterns if k == kind)
        post = [0.5 + 0.45 * (v.count("2") - v.count("0")) / VOTERS for v, _ in rows]
        for _ in range(ROUNDS):
            weight = [[(1 - p) * n for p, (_, n) in zip(post, rows)], [p * n for p, (_, n) in zip(post, rows)]]
            prior = [math.log((sum(w) + 1) / (sum(map(sum, weight)) + 2)) for w in weight]
            chance = [[[math.log((PRIOR[y][c] + sum(w for w, (v, _) in zip(weight[y], rows) if v[j] == str(c))) / (sum(PRIOR[y]) + sum(weight[y]))) for c in range(3)] for j in range(VOTERS)] for y in range(2)]
            odds = [prior[1] - prior[0] + sum(chance[1][j][int(v[j])] - chance[0][j][int(v[j])] for j in range(VOTERS)) for v, _ in rows]
            post = [1 / (1 + math.exp(-min(max(o, -500), 500))) for o in odds]
        out |= {f"{kind}{v}": p for (v, _), p in zip(rows, post)}
    return out


def span_weights(sums: list[tuple[int, float, float]], yes: float, no: float) -> tuple[list[float], float]:
    """Naive Bayes weights of the buckets and the bias, from soft counts of true and false spans."""
    weights = [math.log((no + BUCKETS / 8) / (yes + BUCKETS / 8))] * BUCKETS
    for bucket, p, n in sums:
        weights[bucket] += math.log((p + 0.125) / (n + 0.125))
    return weights, math.log((yes + 1) / (no + 1))


def train(found: DataFrame) -> tuple[list[float], float]:
    """The span classifier, trained on the labelers' aggregated votes over all candidates of found(spans)."""
    each = found.select(F.explode("spans").alias("s")).select(F.col("s.kind").alias("kind"), votes(F.col("s")).alias("votes"), features(F.col("s")).alias("features"))
    counts = each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 * 3 ** VOTERS rows
    known = reliabilities([(r["kind"], r["votes"], r["n"]) for r in counts])
    if not known:
        return [0.0] * BUCKETS, 0.0
    chance = F.create_map(*(F.lit(x) for k, p in sorted(known.items()) for x in (k, round(p, 12))))
    soft = each.select(F.element_at(chance, F.concat(F.col("kind").cast("string"), F.col("votes"))).alias("p"), F.explode(F.array_append("features", F.lit(BUCKETS))).alias("bucket"))
    # in whole millionths, so that sums do not depend on their order
    sums = soft.groupBy("bucket").agg(F.sum(F.round(F.col("p") * 1_000_000).cast("long")).alias("yes"), F.sum(F.round((1 - F.col("p")) * 1_000_000).cast("long")).alias("no")).collect()  # at most BUCKETS + 1 rows
    rows = [(r["bucket"], r["yes"] / 1e6, r["no"] / 1e6) for r in sums]
    (_, yes, no), = [r for r in rows if r[0] == BUCKETS]
    return span_weights(sorted(r for r in rows if r[0] < BUCKETS), yes, no)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, text, base>>) of every row of docs(doc_id, text), by kind as listed, then start."""
    found = staged(candidates(docs), "spans")
    weights, bias = train(found)
    table = F.array(*map(F.lit, weights))
    score = lambda s: F.aggregate(features(s), F.lit(bias), lambda a, b: a + F.get(table, b))
    kept = F.filter("spans", lambda s: s["base"] | (score(s) > 0))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["kind"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["base"].alias("base"))))
    return found.select("doc_id", F.transform(ordered, lambda s: F.struct(F.get(F.array(*map(F.lit, KINDS)), s["k"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["base"].alias("base"))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(documents(spark, sf_dir)).select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op12_personal_data": op12_personal_data}
ORACLE: dict = {}
