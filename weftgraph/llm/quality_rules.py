"""Quality rules: distribution divergence against language references, beside plain counts.

Each language of the corpus has a reference: the histogram of character classes and of its ``COMMON``
commonest words and all others, over all documents. A document is compared with the Jensen-Shannon distance
(base 2, 0 to 1) to the reference of its own language, out of which its own counts are taken first, and to those of large languages (at least ``LANGUAGE_SHARE``
of all documents), and keeps the nearest. A reference counts only if it rests on ``LEAST_DOCS`` documents and ``LEAST_WORDS`` words other than
the judged one's; where none does, the document is not judged. A document with at least ``MIN_CHARS`` bytes fails when that character distance is over ``CHAR_LIMIT``; one
with at least ``MIN_WORDS`` words when the word distance is over ``WORD_LIMIT``; shorter ones are not judged.

Word counts of references are exact: blocks of documents send each language's distinct words with their counts to buckets
by the word's hash, so that all of a word's counts meet, and each bucket names its commonest words. Of equally
common words the one of the smaller hash comes first.

References of large languages (a thousand at most) go with every task. Any others are a table joined by language: broadcast
up to ``MOST_BROADCAST`` languages, beyond that by a shuffle of the documents of such languages alone.

Defined results: a null text has no words and no lines; documents of a null or empty language have no
reference of their own, so they are not judged beyond the base rules; every
row is judged by itself, repeated rows alike; texts of any length are read whole; other columns are dropped, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, buffers, chunks, distinct, documents, lowered, packed, packed_rising, prefix_sums, range_hashes, shingles, staged, tidy, unpacked, unpacked_rising, words

COMMON = 64
#: Words whose counts a task holds before it sends them, and bytes of text a bucket.
HELD, BUCKET_BYTES = 4_000_000, 64 << 20
MIN_CHARS, MIN_WORDS = 200, 60
CHAR_LIMIT, WORD_LIMIT = 0.28, 0.55
LANGUAGE_SHARE = 1 / 1000
#: Documents and words other than the judged document's that a reference must rest on.
LEAST_DOCS, LEAST_WORDS = 5, 300
#: Languages that are not large up to which their references are broadcast.
MOST_BROADCAST = 10_000
CLASSES = 8
CLASS_OF = np.full(256, 5, np.uint8)  # other marks
CLASS_OF[97:123] = 0
CLASS_OF[65:91] = 1
CLASS_OF[48:58] = 2
CLASS_OF[[ord(c) for c in ".,;:'\"-()?"]] = 3
CLASS_OF[[32, 9, 11, 12]] = 4
CLASS_OF[[10, 13]] = 6
CLASS_OF[128:] = 7
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Documents in one step, so that a step's histograms stay small.
MOST_DOCS = 2000
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_char double, js_word double"


def steps(off: np.ndarray):
    for i, j in chunks(off):
        for k in range(i, j, MOST_DOCS):
            yield k, min(j, k + MOST_DOCS)


class References(tuple):
    """Large languages, their character classes' shares, all common words' hashes (ascending), their shares, and the counts
    of the classes, of the words (others last) and of the documents."""

    #: The other languages' references (lang, chars, words, counts, docs: as many of each class, common words, how many of each and
    #: of all others, documents); None if there is no such language.
    rare: DataFrame | None = None


def references(docs: DataFrame) -> References:

    docs = docs.selectExpr("cast(lang as string) lang", "cast(text as string) text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)

    def count(batches):
        """kind 0: a language's character classes, 1: distinct words and their counts for a bucket, 2: its documents, 3: its words."""
        sums: dict[str, np.ndarray] = {}
        pending: dict[str, list[np.ndarray]] = {}
        held = 0

        def sent(rows):
            cols = list(zip(*rows)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "kind", "key", "n", "words", "counts"])

        def flush():
            rows = []
            for lang, parts in pending.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                to = h % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(ends)):
                    own = order[ends[b] : ends[b + 1]]
                    rows.append((lang, 1, int(b), len(own), packed_rising(h[own]), packed(n[own].astype("<u4"))))
            pending.clear()
            return sent(rows)

        for batch in batches:
            langs = np.array([x or "" for x in batch.column(0).to_pylist()], object)
            off, data = buffers(batch.column(1))
            for i, j in steps(off):
                o, d = off[i : j + 1] - off[i], data[off[i] : off[j]]
                names, idx = np.unique(langs[i:j].astype(str), return_inverse=True)
                hist = np.bincount(np.repeat(idx, np.diff(o)) * CLASSES + CLASS_OF[d], minlength=len(names) * CLASSES).reshape(-1, CLASSES)
                w = words(o, lowered(d))
                own = idx[w.doc]
                for k, lang in enumerate(names.tolist()):
                    part = w.hashes[own == k]
                    sums[lang] = sums.get(lang, 0) + np.append(hist[k], [(idx == k).sum(), len(part)])
                    pending.setdefault(lang, []).append(part)
                held += len(w)
                if held > HELD:
                    yield flush()
                    held = 0
        yield flush()
        yield sent([(lang, 0 if k < CLASSES else k - CLASSES + 2, k, int(n), None, None) for lang, own in sums.items() for k, n in enumerate(own)])

    def commonest(table: pa.Table) -> pa.Table:
        rows, langs = [], np.array(table.column("lang").to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            own = table.take(np.flatnonzero(langs == lang))
            h, at = np.unique(np.concatenate([unpacked_rising(x.as_py()) for x in own.column("words")]), return_inverse=True)
            n = np.bincount(at, np.concatenate([unpacked(x.as_py(), "<u4") for x in own.column("counts")]), len(h)).astype(np.int64)
            key = h.view(np.int64)
            rows += [(lang, 1, int(key[k]), int(n[k])) for k in np.lexsort((key, -n))[:COMMON]]
        cols = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["lang", "kind", "key", "n"])

    counts = staged(docs.mapInArrow(tidy(count), "lang string, kind int, key long, n long, words binary, counts binary"), "counts")
    top = counts.where("kind = 1").groupBy("key").applyInArrow(tidy(commonest), "lang string, kind int, key long, n long")
    sums = counts.where("kind <> 1").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    ranked = top.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "key"))).where(F.col("r") <= COMMON).drop("r").unionByName(sums)
    ranked = staged(ranked.where("lang <> ''"), "references")
    langs = ranked.where("kind = 2").select("lang", F.col("n").alias("docs"))
    total = langs.agg(F.sum("docs").alias("total"))
    large = langs.join(F.broadcast(total)).where(F.col("docs") >= F.col("total") * LANGUAGE_SHARE).select("lang")  # at most 1000
    found = ranked.join(F.broadcast(large), "lang").select("lang", "kind", "key", "n").collect()
    names = sorted({r["lang"] for r in found})
    chars = np.zeros((len(names), CLASSES))
    keys = np.unique(np.array([r["key"] for r in found if r["kind"] == 1], np.int64).view(np.uint64))
    common = np.zeros((len(names), len(keys) + 1))
    totals, n_docs = np.zeros(len(names)), np.zeros(len(names))
    for r in found:
        k = names.index(r["lang"])
        if r["kind"] == 0:
            chars[k, r["key"]] = r["n"]
        elif r["kind"] == 1:
            common[k, np.searchsorted(keys, np.int64(r["key"]).view(np.uint64))] = r["n"]
        elif r["kind"] == 3:
            totals[k] = r["n"]
        else:
            n_docs[k] = r["n"]
    common[:, -1] = totals - common.sum(1)  # its other words
    out = References((names, shares(chars), keys, shares(common), chars, common, n_docs))
    rare = ranked.join(F.broadcast(large), "lang", "left_anti")
    if not rare.isEmpty():
        of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n"))))
        one = rare.groupBy("lang").agg(of(0).alias("c"), of(1).alias("w"), F.sum(F.when(F.col("kind") == 3, F.col("n"))).alias("total"), F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("docs"))
        rest = F.col("total") - F.aggregate("w.n", F.lit(0).cast("long"), lambda x, y: x + y)
        out.rare = one.select("lang", F.col("c.n").alias("chars"), F.col("w.key").alias("words"), F.concat("w.n", F.array(rest)).alias("counts"), "docs")
    return out


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(-1, keepdims=True), 1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of p to q, or to the row of q beside it."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of each row of p to each row of q."""
    return np.stack([divergence(p, ref) for ref in q], axis=1) if len(q) else np.zeros((len(p), 0))


def base_counts(off: np.ndarray, data: np.ndarray) -> tuple:
    """Words, and each document's n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(off) - 1
    w = words(off, data)
    doc = np.repeat(np.arange(n), np.diff(off))
    n_words = np.diff(w.first)
    word_chars = np.bincount(doc[~SPACE[data] & ((data & 0xC0) != 0x80)], minlength=n)
    symbols = np.bincount(doc[SYMBOL[data]], minlength=n)

    cut = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], cut + 1)))
    starts = starts[starts < len(data)]
    bounds = np.append(cut, len(data))
    ends = np.minimum(bounds[np.searchsorted(bounds, starts)], off[np.searchsorted(off, starts, "right")])
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[full], ends[full]
    line_doc = np.searchsorted(off, starts, "right") - 1
    first = np.searchsorted(line_doc, np.arange(n + 1))
    sums = prefix_sums(data)
    _, own = distinct(range_hashes(sums, starts, ends), first)
    dup_lines = np.diff(first) - np.diff(own)

    s, s_first = shingles(w)
    s_doc = np.repeat(np.arange(n), np.diff(s_first))
    whole = n_words[s_doc] >= 5
    at = (w.first[:-1][s_doc] + np.arange(len(s)) - s_first[:-1][s_doc])[whole]
    s, s_doc = s[whole], s_doc[whole]
    order = np.lexsort((s, s_doc))
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = (s[order][1:] == s[order][:-1]) & (s_doc[order][1:] == s_doc[order][:-1])
    twice = at[order[same[1:] | same[:-1]]] if len(s) else at
    cover = np.zeros(len(w) + 6, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    covered = np.cumsum(cover)[: len(w)] > 0
    repeated = np.bincount(w.doc[covered], minlength=n)
    return w, n_words, word_chars, symbols, dup_lines, repeated


def binned(n: int, doc: np.ndarray, low: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each of n documents has each of the keys (ascending) and any other word; doc and low: each word's document and hash."""
    at = np.minimum(np.searchsorted(keys, low), max(len(keys) - 1, 0))
    at = np.where(keys[at] == low, at, len(keys)) if len(keys) else np.zeros(len(low), np.int64)
    return np.bincount(doc * (len(keys) + 1) + at, minlength=n * (len(keys) + 1)).reshape(n, -1)


def to_others(hist: np.ndarray, word: np.ndarray, chars: np.ndarray, common: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of documents (rows of hist and word) to a reference that holds them (counts chars and common of docs documents), each
    without its own counts; infinite where too little is left."""
    own = np.where(common[:-1] > 0, word[:, :-1], 0)  # what the reference does not name is among its others
    left = common - np.column_stack((own, word.sum(1) - own.sum(1)))
    few = (docs - 1 < LEAST_DOCS) | (left.sum(1) < LEAST_WORDS)
    return tuple(np.where(few, np.inf, divergence(shares(x), shares(y))) for x, y in ((hist, chars - hist), (word, left)))


def with_own(docs: DataFrame, refs: References) -> DataFrame:
    """docs with chars, words and counts of their language's reference, null for large languages and none."""
    rare = refs.rare
    if rare is None:
        return docs.selectExpr("*", *(f"cast(null as array<long>) {c}" for c in ("chars", "words", "counts")), "cast(null as long) docs")
    if rare.count() <= MOST_BROADCAST:
        return docs.join(F.broadcast(rare), "lang", "left").select("doc_id", "text", "lang", "chars", "words", "counts", "docs")
    known = F.coalesce("lang", F.lit("")).isin("", *refs[0])
    return with_own(docs.where(known), References(refs)).unionByName(docs.where(~known).join(rare, "lang", "left").select("doc_id", "text", "lang", "chars", "words", "counts", "docs"))


def judge(docs: DataFrame, refs: References) -> DataFrame:
    """The counts, base_failed, kept and the nearest reference's distances of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(refs))

    def run(batches):
        names, chars, keys, common, char_counts, counts_of, n_docs = sent.value
        small = (n_docs < LEAST_DOCS) | (counts_of.sum(1) < LEAST_WORDS)
        for batch in batches:
            off, data = buffers(batch.column(1))
            langs = np.array([x or "" for x in batch.column(2).to_pylist()], str)
            rare = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            judged = np.isin(langs, names) | rare
            parts = [[np.zeros(0, np.int64)] for _ in range(5)] + [[np.zeros(0)] for _ in range(2)]
            for i, j in steps(off):
                o, d = off[i : j + 1] - off[i], data[off[i] : off[j]]
                n = j - i
                w, *counts = base_counts(o, d)
                js_char, js_word = np.zeros(n), np.zeros(n)
                if judged[i:j].any():
                    hist = np.bincount(np.repeat(np.arange(n), np.diff(o)) * CLASSES + CLASS_OF[d], minlength=n * CLASSES).reshape(n, CLASSES)
                    low = range_hashes(prefix_sums(lowered(d)), w.starts, w.ends)
                    word = binned(n, w.doc, low, keys)
                    a, b = (np.column_stack((np.where(small, np.inf, js_distance(shares(x), y)), np.full(n, np.inf))) for x, y in ((hist, chars), (word, common)))  # at last, to a rare language's
                    for k, lang in enumerate(names):
                        own = langs[i:j] == lang
                        if own.any():
                            a[own, k], b[own, k] = to_others(hist[own], word[own], char_counts[k], counts_of[k], n_docs[k])
                    for lang in np.unique(langs[i:j][rare[i:j]]):
                        own = langs[i:j] == lang
                        c, h, m, d = (np.array(batch.column(k)[i + int(np.argmax(own))].as_py(), np.int64) for k in (3, 4, 5, 6))
                        order = np.argsort(h.view(np.uint64))
                        of = own[w.doc]
                        own_words = binned(int(own.sum()), (np.cumsum(own) - 1)[w.doc[of]], low[of], h.view(np.uint64)[order])
                        a[own, -1], b[own, -1] = to_others(hist[own], own_words, c, np.append(m[order], m[-1]), int(d))
                    near = np.argmin(a + b, 1)
                    known = judged[i:j] & np.isfinite(a[np.arange(n), near])
                    js_char = np.where(known & (hist.sum(1) >= MIN_CHARS), a[np.arange(n), near], 0.0)
                    js_word = np.where(known & (counts[0] >= MIN_WORDS), b[np.arange(n), near], 0.0)
                for part, value in zip(parts, [*counts, js_char, js_word]):
                    part.append(value)
            *counts, js_char, js_word = [np.concatenate(p) for p in parts]
            failed = (counts[0] < 10) | (100 * counts[4] > 20 * counts[0])
            kept = ~failed & (js_char <= CHAR_LIMIT) & (js_word <= WORD_LIMIT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept), pa.array(js_char), pa.array(js_word)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    return with_own(docs, refs).mapInArrow(tidy(run), SCHEMA)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, references(docs))


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE: dict[str, str] = {}
