"""Phrase collocation mining: phrases of 2 to 5 words that occur more often than their parts would by chance.

Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into words at blanks and tabs; A-Z are lower-cased, and everything is per language.

1. Apriori-safe candidates. Three scans count 64-bit hashes of words, of pairs whose words are both frequent, and of three to five words
   whose pairs are all frequent. A task sums its own hashes in numpy first; a shuffle by the hash's first bits sums the tasks'. What is frequent
   is known to later scans by a Bloom filter of at most ``MOST_BITS`` bits. Collisions of hashes and false hits can only add candidates.
2. Exact counts. A last scan sends each task's candidate occurrences, with their count and text, to their block of candidates. Every block
   has a minimal perfect hash over its candidates; a key's slot holds the key it stands for, and what differs is no candidate. The blocks' mappers
   turn counts into numpy arrays by ``bincount`` over slots, and those are summed over mappers. Two phrases of one hash are told apart by their texts.
3. Cuts. Both parts of every cut of a candidate are candidates themselves, and their counts are read by a join; scores are computed in decimals.

All that grows with the input (hashes, candidates, phrases) lies in shuffled or written tables; the driver holds Bloom filters only. Two hashes
that collide inside one task's own sums are not told apart (under 1e-7 for a task of a million phrases).

Defined results: a null text is empty; a null language is ``und`` (and joined with one of that name). Repeated rows count each. Texts of any length are read
whole, in steps that end at a piece's end. Other columns are dropped, whatever their names. A language without candidates, and an empty table, give
no rows. Ties in score and count are ordered by the phrase's bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHUNK, buffers, documents, dropped, lowered, mix, packed, packed_rising, packed_strings, prefix_sums, range_hashes, staged, tidy, unpacked, unpacked_rising, unpacked_strings

LONGEST, LEAST, TOP = 5, 100, 2000
BREAK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
BLANK[[*b" \t"]] = True
#: Bits of a Bloom filter, at most and for a key; entries of a task's own sums; bytes of text for one shard of the counts.
MOST_BITS, BITS_A_KEY, MOST_OWN, SHARD_BYTES = 1 << 27, 16, 1 << 21, 8 << 20
#: Mappers of a block of candidates, and parts of a language's ranking.
MAPPERS, SALTS = 4, 64


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys. Each level keeps the keys that are alone in their place and hands the rest on; a
    key's slot is the rank of its place. Slots store their key, so that other keys are told."""

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys.astype(np.uint64))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, used = keys, 0
        while len(left):
            at = self._places(left, len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            self.levels.append((alone, used + np.cumsum(alone) - 1))
            used += int(alone.sum())
            left = left[~alone[at]]
        self.stored = np.zeros(len(keys), np.uint64)
        self.stored[self._slots(keys)] = keys

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._places(keys[rest], level, len(alone))
            out[rest[alone[at]]] = rank[at[alone[at]]]
            rest = rest[~alone[at]]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 for keys that are not stored."""
        out = self._slots(keys)
        return np.where((out >= 0) & (self.stored[out] == keys), out, -1) if len(self.stored) else out

    def __len__(self) -> int:
        return len(self.stored)


def ranges(off: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about CHUNK bytes that end at a piece's end."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + CHUNK, n)
        edge, width = int(off[np.searchsorted(off, end)]), 1 << 12
        while end < edge:
            found = np.flatnonzero(BREAK[data[end : min(end + width, edge)]])
            if len(found):
                edge = end + int(found[0]) + 1
                break
            end, width = min(end + width, edge), 2 * width
        yield at, edge
        at = edge


class Tokens:
    """The words of a byte range: hashes that include the language, places, and pieces."""

    def __init__(self, off: np.ndarray, data: np.ndarray, langs: np.ndarray, lo: int, hi: int):
        first = int(np.searchsorted(off, lo, "right")) - 1
        last = int(np.searchsorted(off, hi))
        edges = np.clip(off[first : last + 1], lo, hi) - lo
        self.data = lowered(data[lo:hi])
        n = len(self.data)
        broken = BREAK[self.data]
        solid = ~(broken | BLANK[self.data])
        edge = np.zeros(n + 1, bool)
        edge[edges] = edge[0] = edge[n] = True
        before = np.concatenate(([False], solid[:-1]))
        after = np.concatenate((solid[1:], [False]))
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        doc = np.repeat(np.arange(len(edges) - 1), np.diff(np.searchsorted(self.starts, edges)))
        self.lang = langs[first + doc]
        self.words = mix(range_hashes(prefix_sums(self.data), self.starts, self.ends) ^ self.lang)
        self.pieces = np.cumsum(broken)[self.starts] + doc  # both rise, so that sums are equal where both are

    def __len__(self) -> int:
        return len(self.starts)

    def longer(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Keys of size words from those of size - 1 words."""
        return mix(keys[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.words[size - 1 :])

    def whole(self, size: int) -> np.ndarray:
        """Which runs of size words lie in one piece."""
        return self.pieces[size - 1 :] == self.pieces[: len(self) - size + 1]

    def text(self, at: int, size: int) -> bytes:
        return b" ".join(self.data[self.starts[at] : self.ends[at + size - 1]].tobytes().split())


def tokens_of(batch: pa.RecordBatch) -> Iterator[tuple[Tokens, dict[int, str]]]:
    off, data = buffers(batch.column("text"))
    names = batch.column("lang").to_pylist()
    kinds = {xxhash.xxh3_64_intdigest((x or "").encode()): x for x in set(names)}
    code = {x: h for h, x in kinds.items()}
    langs = np.array([code[x] for x in names], np.uint64)
    for lo, hi in ranges(off, data):
        yield Tokens(off, data, langs, lo, hi), kinds


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a Bloom filter of two bits a key lets through."""
    mask = np.uint64(8 * len(bits) - 1)
    out = np.ones(len(keys), bool)
    for at in (keys & mask, (keys >> np.uint64(32)) & mask):
        out &= ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


class Own:
    """A task's own sums of keys, handed on in pieces of bounded size."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > MOST_OWN:
            keys, counts = self.total()
            self.parts, self.size = [(keys, counts)], len(keys)
            if self.size > MOST_OWN // 2:
                self.parts, self.size = [], 0
                yield keys, counts

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))


def sharded(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Ranges of ascending keys by their first bits."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    kinds, first = np.unique(shard, return_index=True)
    for k, a, b in zip(kinds.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]):
        yield k, slice(a, b)


def hash_counts(docs: DataFrame, level: int, bits: int, least: int, known: np.ndarray | None) -> DataFrame:
    """(key, f, lang) of frequent hashes: words for level 1, pairs of known words for level 2, and longer phrases of known pairs for level 3.
    Level 1 also has every language's number of words, with a null key."""
    sent = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def keys_of(t: Tokens) -> Iterator[np.ndarray]:
        if level == 1:
            yield t.words
        elif len(t) > 1 and level == 2:
            ok = passes(sent.value, t.words)
            yield t.longer(t.words, 2)[ok[:-1] & ok[1:] & t.whole(2)]
        elif len(t) > 2:
            keys = t.longer(t.words, 2)
            pair = run = t.whole(2) & passes(sent.value, keys)
            for size in range(3, min(LONGEST, len(t)) + 1):
                keys, run = t.longer(keys, size), run[:-1] & pair[size - 2 :]
                yield keys[run]

    @tidy
    def scan(batches):
        own, langs = Own(), {}
        rows = lambda keys, counts: pa.RecordBatch.from_pylist([{"shard": s, "lang": None, "n": None, "keys": packed_rising(keys[r]), "counts": packed(counts[r])} for s, r in sharded(keys, bits)], SHARDS)
        for batch in batches:
            for t, kinds in tokens_of(batch):
                for keys in keys_of(t):
                    for out in own.add(keys):
                        yield rows(*out)
                if level == 1:
                    for h, n in zip(*np.unique(t.lang, return_counts=True)):
                        langs[kinds[int(h)]] = langs.get(kinds[int(h)], 0) + int(n)
        yield rows(*own.total())
        yield pa.RecordBatch.from_pylist([{"shard": -1 - xxhash.xxh32_intdigest(x) % 64, "lang": x, "n": n, "keys": None, "counts": None} for x, n in langs.items()], SHARDS)

    @tidy
    def add(rows: pa.Table) -> pa.Table:
        langs: dict[str, int] = {}
        for x, n in zip(rows["lang"].to_pylist(), rows["n"].to_pylist()):
            if n is not None:
                langs[x] = langs.get(x, 0) + n
        parts = [(unpacked_rising(k), unpacked(c, np.int64)) for k, c in zip(rows["keys"].to_pylist(), rows["counts"].to_pylist()) if k is not None]
        keys, counts = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keys, counts = keys[counts >= least], counts[counts >= least]
        return pa.table({"key": pa.array([*keys.astype(np.int64).tolist(), *[None] * len(langs)], pa.int64()), "f": pa.array([*counts.tolist(), *langs.values()], pa.int64()), "lang": pa.array([*[None] * len(keys), *langs], pa.string())})

    found = docs.mapInArrow(scan, "shard int, lang string, n long, keys binary, counts binary")
    return staged(found.groupBy("shard").applyInArrow(add, "key long, f long, lang string"), "phrases")


SHARDS = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
TEXTS = pa.schema([("block", pa.int32()), ("mapper", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary())])


def bloom_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of keys(key), its pieces made in tasks; of 16 bits a key, at most MOST_BITS."""
    n = keys.count()
    size = min(MOST_BITS, 1 << max(16, math.ceil(math.log2(max(n, 1) * BITS_A_KEY))))
    width = min(size // 8, 1 << 16)

    def own(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in (k & np.uint64(size - 1), (k >> np.uint64(32)) & np.uint64(size - 1)):
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        pieces = bits.reshape(-1, width)
        used = np.flatnonzero(pieces.any(1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed(pieces[k]) for k in used], pa.binary())], ["piece", "bits"])

    def join(rows: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([unpacked(b, np.uint8) for b in rows["bits"].to_pylist()])
        return pa.table({"piece": pa.array([rows["piece"][0].as_py()], pa.int32()), "bits": pa.array([packed(total)], pa.binary())})

    out = np.zeros((size // 8 // width, width), np.uint8)
    for r in keys.select("key").mapInArrow(own, "piece int, bits binary").groupBy("piece").applyInArrow(join, "piece int, bits binary").collect():  # size / 8 bytes in all
        out[r["piece"]] = unpacked(r["bits"], np.uint8)
    return out.reshape(-1)


def labelled(lang: str, text: bytes) -> bytes:
    name = lang.encode()
    return b"%d:" % len(name) + name + text


def unlabelled(text: bytes) -> tuple[str, str]:
    size, _, rest = text.partition(b":")
    return rest[: int(size)].decode(), rest[int(size) :].decode()


def exact_counts(docs: DataFrame, candidates: DataFrame, bits: int, least: int) -> DataFrame:
    """(lang, phrase, words, f) of the candidates(key) that occur at least so often; f is exact."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom_filter(candidates))

    @tidy
    def scan(batches):
        have, counts, texts, mapper = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object), 0

        def rows():
            out = [{"block": b, "mapper": (b + mapper) % MAPPERS, "keys": packed_rising(have[r]), "counts": packed(counts[r]), "texts": packed_strings(texts[r].tolist())} for b, r in sharded(have, bits)]
            return pa.RecordBatch.from_pylist(out, TEXTS)

        for batch in batches:
            for t, kinds in tokens_of(batch):
                keys, ok = t.words, passes(sent.value, t.words)
                for size in range(1, min(LONGEST, len(t)) + 1):
                    if size > 1:
                        keys, ok = t.longer(keys, size), ok[:-1] & ok[1:] & t.whole(size)
                        at = np.flatnonzero(ok)
                        ok = ok.copy()
                        ok[at] = passes(sent.value, keys[at])
                    at = np.flatnonzero(ok)
                    found, first, n = np.unique(keys[at], return_index=True, return_counts=True)
                    place = np.searchsorted(have, found)
                    known = have[np.minimum(place, len(have) - 1)] == found if len(have) else np.zeros(len(found), bool)
                    counts[place[known]] += n[known]
                    fresh = np.flatnonzero(~known)
                    where = at[first[fresh]]
                    new = np.empty(len(fresh), object)
                    new[:] = [labelled(kinds[int(t.lang[w])], t.text(w, size)) for w in where.tolist()]
                    have = np.insert(have, place[fresh], found[fresh])
                    counts, texts = np.insert(counts, place[fresh], n[fresh]), np.insert(texts, place[fresh], new)
                if len(have) > MOST_OWN // 8:
                    yield rows()
                    mapper += 1
                    have, counts, texts = have[:0], counts[:0], texts[:0]
        yield rows()

    @tidy
    def count(wanted: pa.Table, rows: pa.Table) -> pa.Table:
        slot_of = PerfectHash(wanted["key"].to_numpy().astype(np.int64).view(np.uint64))
        owner: list = [None] * len(slot_of)
        slots, weights, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
        for keys, n, said in zip(rows["keys"].to_pylist(), rows["counts"].to_pylist(), rows["texts"].to_pylist()):
            at, n = slot_of.slots(unpacked_rising(keys)), np.array(unpacked(n, np.int64))
            for k, (s, text) in enumerate(zip(at.tolist(), unpacked_strings(said))):
                if s < 0:
                    continue
                if owner[s] is None:
                    owner[s] = text
                elif owner[s] != text:  # two phrases of one hash
                    others[text] = others.get(text, 0) + int(n[k])
                    at[k] = -1
            slots.append(at[at >= 0])
            weights.append(n[at >= 0])
        total = np.bincount(np.concatenate(slots), np.concatenate(weights), len(slot_of)).astype(np.int64)  # exact: below 2 ** 53
        found = [*((x, n) for x, n in zip(owner, total.tolist()) if x is not None), *others.items()]
        pairs = [unlabelled(x) for x, _ in found]
        return pa.table({"lang": pa.array([x for x, _ in pairs], pa.string()), "phrase": pa.array([x for _, x in pairs], pa.string()), "f": pa.array([n for _, n in found], pa.int64())})

    sent_rows = docs.mapInArrow(scan, "block int, mapper int, keys binary, counts binary, texts binary")
    wanted = candidates.select("key", F.call_function("shiftrightunsigned", "key", F.lit(64 - bits)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(MAPPERS - 1))).alias("mapper"))
    partial = wanted.groupBy("block", "mapper").cogroup(sent_rows.groupBy("block", "mapper")).applyInArrow(count, "lang string, phrase string, f long")
    total = partial.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return total.select("lang", "phrase", (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1).alias("words"), "f")


def floor_score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    product = (wide(a) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)")
    return F.call_function("div", (product * n.cast("decimal(18,0)")).cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(38,0)"))


def ranked(phrases: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best candidates of phrases(lang, phrase, words, f)."""
    found = phrases.where("words > 1")
    inner = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))
    # a candidate inside a longer one of the same count is inside one that is a word longer, and as frequent
    covered = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").distinct()
    kept = found.join(covered, ["lang", "phrase", "f"], "left_anti")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("first")).select("*", F.expr("substring(phrase, length(first) + 2)").alias("rest"))
    left, right = (phrases.select("lang", F.col("phrase").alias(x), F.col("f").alias(y)) for x, y in (("first", "l"), ("rest", "r")))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(floor_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    rows = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's best collocations in docs(text, lang)."""
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(size, 1) / SHARD_BYTES)))
    words = hash_counts(docs, 1, bits, least, None)
    pairs = hash_counts(docs, 2, bits, least, bloom_filter(words.where("key is not null")))
    longer = hash_counts(docs, 3, bits, least, bloom_filter(pairs))
    candidates = words.where("key is not null").select("key").unionByName(pairs.select("key")).unionByName(longer.select("key"))
    phrases = staged(exact_counts(docs, candidates, bits, least), "phrases")
    dropped(pairs, longer)
    totals = words.where("key is null").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked(phrases, totals, top)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir))


QUERIES = {"op11_phrase_collocations": op11_phrase_collocations}
ORACLE: dict = {}
