"""LM scoring: an add-one unigram base and a hierarchical Pitman-Yor model of a text's tokens.

Documents are first cut into blocks, a stored row each, so that every later step reads the same blocks. A block sends
each of its distinct tokens' hashes, with the contexts it stands in and its training counts, to a bucket; the bucket sums a token over all blocks, keeps where each block's pairs are in its model, and at last sends back
what scoring them takes; a block adds up its documents. A bucket sees a block's distinct pairs of its tokens and the tokens before
them, however often they occur. The number of buckets grows with the bytes of text. Tokens are told apart by 64-bit hashes.

The model has a restaurant for every distinct preceding token, and all of them share one parent, the unigram restaurant,
whose base is uniform over the training tokens' kinds and one kind for all unknown tokens. Counts come from all training
documents. Seating is sampled by Gibbs steps, in each bucket for its tokens' dishes. A step unseats a dish's customers and seats
them anew: given the rate f at which the restaurant opens tables for it, c customers sit at t tables with a probability in
proportion to S(c, t) f^t, S being the generalised Stirling numbers of the discount, and t is drawn from that
distribution. Its tables are customers of the parent, whose dishes are drawn likewise. All dishes of a bucket are drawn side by side in a sweep, at the rates
that the sweep begins with. Up to EXACT customers the Stirling numbers are exact; beyond that they are saddle-point values, corrected for few tables by
the exact ones of EXACT customers. The seating is stored after each round of BURN_IN sweeps and the next round goes on from it; between rounds the restaurants' totals
are summed by a shuffle, in which a bucket sends and gets its contexts' numbers. The last round stores SAMPLES seatings, a sweep apart, and a
token's probability is the mean of its predictive probabilities under them, each with totals of its own, so that probabilities
add to one in every context. Each stored table is deleted, and its shuffles let go, when nothing reads it any more.

Defined results: a null text is empty, with the end token alone; rows of equal ids are separate documents; a null
doc_id is never held out; without training documents every token has the base's probability, 1; an empty table gives no rows.
Texts of any length are read whole; other columns are dropped, whatever their names. Perplexity is that of a text's tokens under the model.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, chunks, documents, dropped, held_out, lowered, packed, packed_rising, settled, staged, task_key, tidy, unpacked, unpacked_rising, words

END = np.uint64(0x5EED0FE2D0C5E11D)
BLOCK = 16 << 20
#: Discount and strength of the preceding tokens' restaurants and of their parent.
LEAF, ROOT = (0.7, 5.0), (0.6, 10.0)
BURN_IN, SAMPLES, ROUNDS = 3, 4, 2
#: Customers up to which a dish's tables are drawn by exact Stirling numbers; numbers of tables weighed for a larger dish.
EXACT, WEIGHED = 128, 256
#: Bytes of text a bucket.
BUCKET_BYTES = 16 << 20


def block_tokens(batch: pa.RecordBatch, seq: int):
    """Of each block of a batch: key, document range, its distinct tokens' hashes, commonest first, its tokens in order as numbers of these,
    and its documents' numbers of tokens."""
    off, data = buffers(batch.column(1))
    for i, j in chunks(off, BLOCK):
        parts, sizes = [], []
        for x, y in chunks(off[i : j + 1]):
            o = off[i + x : i + y + 1]
            w = words(o - o[0], lowered(data[o[0] : o[-1]]))
            parts.append(np.insert(w.hashes, w.first[1:], END))
            sizes.append(np.diff(w.first) + 1)
        token, code, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # small numbers, which take little room
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        key = hashlib.blake2b(f"{task_key()}/{seq}/{i}/".encode() + token.tobytes(), digest_size=16).digest()
        yield key, (i, j), token[order], place[code], np.concatenate(sizes)


def block_pairs(token: np.ndarray, code: np.ndarray):
    """A block's tokens ascending, its distinct (token, context) pairs as token index * tokens + index of the token before, and
    the pairs of its tokens in order."""
    order = np.argsort(token)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    token, code = token[order], place[code]
    before = np.concatenate((np.searchsorted(token, [END]), code[:-1]))  # each document ends with END
    pair, code = np.unique(code * np.int64(len(token)) + before, return_inverse=True)
    return token, pair, code.astype(np.int32)


def dealt_pairs(token: np.ndarray, pair: np.ndarray, buckets: int):
    """Order of the tokens and of the pairs by bucket, and where each bucket's tokens and pairs begin."""
    to = (token % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    p_order = np.argsort(rank[pair // len(token)], kind="stable")
    steps = np.arange(buckets + 1)
    return order, np.searchsorted(to[order], steps), p_order, np.searchsorted(to[pair // len(token)][p_order], steps)


def part_of(ctx: np.ndarray, parts: int) -> np.ndarray:
    """Where a context's totals are summed; it ascends with the context's hash."""
    return ((ctx >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


@lru_cache(None)
def stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) of discount d, for c and t up to EXACT; S(0, 0) is 1."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(EXACT):
            stay = np.log(np.maximum(c - d * np.arange(EXACT + 1), 0.0)) + out[c]
            out[c + 1] = np.logaddexp(np.append(-np.inf, out[c, :-1]), stay)
    return out


#: Saddle points are looked up by log(u), u = 1 - z.
_LOG_U = -np.exp(np.linspace(np.log(200.0), np.log(1e-7), 40_000))


@lru_cache(None)
def saddles(d: float) -> tuple[np.ndarray, np.ndarray]:
    """For each log u: customers a table where u is the saddle point; customers by the rate of new tables where that is the mode (logarithms)."""
    u, z = np.exp(_LOG_U), -np.expm1(_LOG_U)
    return np.log(d * z) + (d - 1) * _LOG_U - np.log(-np.expm1(d * _LOG_U)), np.log(z) + (d - 1) * _LOG_U


def log_factorial(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) for many customers, but for what depends on c alone: the coefficient of z^c in (1 - (1 - z)^d)^t / (d^t t!)
    at its saddle point."""
    per = c / t
    lu = -np.interp(-np.log(per), -saddles(d)[0], -_LOG_U)
    u, z = np.exp(lu), -np.expm1(lu)
    spread = t * per * np.maximum(1 + z * (1 - d) / u - per, 1e-9)
    return t * (np.log(-np.expm1(d * lu)) - np.log(d)) - c * np.log(z) - 0.5 * np.log(spread) - log_factorial(t)


@lru_cache(None)
def few_tables(d: float) -> np.ndarray:
    """What saddle-point values of t tables lack, for t up to half of EXACT."""
    t = np.arange(1.0, EXACT // 2 + 1)
    lack = stirling(d)[EXACT, 1 : len(t) + 1] - log_stirling(np.full(len(t), float(EXACT)), t, d)
    return np.append(lack - lack[-1], 0.0)


def drawn(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An index of each row, in proportion to the exponentials of its logs."""
    sums = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
    return (sums < rng.random((len(logs), 1)) * sums[:, -1:]).sum(1)


def seated(c: np.ndarray, f: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes of c customers, new tables opening at the rates f: t with a probability in proportion to S(c, t) f^t."""
    out = np.minimum(c, 1)  # none and a lone customer
    order = np.argsort(c, kind="stable")
    size, logf = c[order], np.log(f[order])
    at = int(np.searchsorted(size, 2))
    end = int(np.searchsorted(size, EXACT, "right"))
    while at < end:  # dishes of one size, few enough at a time
        k = int(size[at])
        to = min(int(np.searchsorted(size, k, "right")), at + max(1, (1 << 20) // k))
        out[order[at:to]] = 1 + drawn(stirling(d)[k, 1 : k + 1] + logf[at:to, None] * np.arange(1, k + 1), rng)
        at = to
    for at in range(end, len(size), 1024):
        own, lf = size[at : at + 1024].astype(float), logf[at : at + 1024]
        lu = np.interp(lf - np.log(own), -saddles(d)[1], _LOG_U)
        mode = np.clip(np.exp(lf) * -np.expm1(d * lu) / d, 1, own)
        low = np.floor(np.maximum(mode - 8 * np.sqrt(mode) - 8, 1))
        high = np.minimum(np.ceil(mode + 8 * np.sqrt(mode) + 8), own)
        step = np.ceil((high - low + 1) / WEIGHED)
        t = low[:, None] + step[:, None] * np.arange(WEIGHED)
        inside = t <= high[:, None]
        t = np.minimum(t, high[:, None])
        lack = few_tables(d)
        logs = log_stirling(own[:, None], t, d) + lack[np.minimum(t.astype(np.int64) - 1, len(lack) - 1)] + t * lf[:, None]
        found = t[np.arange(len(own)), drawn(np.where(inside, logs, -np.inf), rng)]
        out[order[at : at + 1024]] = np.minimum(found + np.floor(rng.random(len(own)) * step), high)
    return out


class Seating:
    """The dishes of one bucket: (token, context) pairs, their customers and tables, and the parent's dishes."""

    def __init__(self, tok: np.ndarray, ctx: np.ndarray, customers: np.ndarray, t: np.ndarray | None = None, s: np.ndarray | None = None):
        self.tok, self.ctx, self.c, self.n = tok, ctx, customers, int(tok.max()) + 1
        self.t = np.minimum(self.c, np.ceil(self.c ** LEAF[0]).astype(np.int64)) if t is None else t
        self.up()
        self.s = np.minimum(self.r, np.ceil(self.r ** ROOT[0]).astype(np.int64)) if s is None else s

    def up(self) -> None:
        """A dish's tables in all contexts are its customers in the parent."""
        self.r = np.bincount(self.tok, self.t, self.n).astype(np.int64)

    def parent(self, totals: np.ndarray, kinds: int) -> np.ndarray:
        d, a = ROOT
        return (self.r - d * self.s) / (a + totals[0, -1]) + (a + d * totals[1, -1]) / (a + totals[0, -1]) / (kinds + 1)

    def sweep(self, totals: np.ndarray, kinds: int, rng: np.random.Generator) -> None:
        """Draws all dishes' tables; the bucket's own changes of tables go into totals."""
        d, a = LEAF
        before = np.append(np.bincount(self.ctx, self.t, totals.shape[1] - 1), self.s.sum()), self.r.sum()
        self.t = seated(self.c, (a + d * totals[1, self.ctx]) * self.parent(totals, kinds)[self.tok], d, rng)
        self.up()
        d, a = ROOT
        self.s = seated(self.r, np.full(self.n, (a + d * totals[1, -1]) / (kinds + 1)), d, rng)
        totals[1] += np.append(np.bincount(self.ctx, self.t, totals.shape[1] - 1), self.s.sum()) - before[0]
        totals[0, -1] += self.r.sum() - before[1]

    def probabilities(self, totals: np.ndarray, kinds: int) -> np.ndarray:
        """The predictive probability of each (token, context) pair under this seating."""
        d, a = LEAF
        return (self.c - d * self.t + (a + d * totals[1, self.ctx]) * self.parent(totals, kinds)[self.tok]) / (a + totals[0, self.ctx])


def stored(seatings: list[tuple]) -> dict:
    """What is stored of one or more seatings (tables, the parent's customers and tables) of a bucket, one after another."""
    t, r, s = zip(*seatings)
    return {"t": packed(np.concatenate(t).astype("<u8")), "s": packed(np.concatenate(s).astype("<u8")), "customers": [int(x.sum()) for x in r], "tables": [int(x.sum()) for x in s]}


#: A bucket's model: its contexts' hashes, its (token, context) pairs as token * contexts + context, customers and tables.
STORED = {"bucket": "int", "ctx": "binary", "pair": "binary", "count": "binary", "t": "binary", "s": "binary", "customers": "array<long>", "tables": "array<long>", "kinds": "long", "tokens": "long"}
MERGED = STORED | {"key": "binary", "at": "binary", "asks": "int"}


def schema_of(columns: dict) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


BACK = {"key": "binary", "bucket": "int", "known": "binary", "each": "binary", "score": "binary"}
TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def table_of(columns: dict, rows: list[dict]) -> pa.Table:
    return pa.table({k: pa.array([r.get(k) for r in rows], TYPES[v]) for k, v in columns.items()})


def pairs_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Token and context, as numbers in the bucket, of each of its pairs."""
    n = len(unpacked(row["ctx"], "<u8"))
    pair = unpacked_rising(row["pair"]).astype(np.int64)
    return pair // n, pair % n


def seatings_of(row: dict):
    """The stored seatings of a bucket, one after another."""
    tok, ctx = pairs_of(row)
    count, t, s = (unpacked(row[k], "<u8").astype(np.int64) for k in ("count", "t", "s"))
    n = len(t) // len(tok)
    for x, y in zip(t.reshape(n, -1), s.reshape(n, -1)):
        yield Seating(tok, ctx, count, x, y)


def context_totals(model: DataFrame, parts: int) -> DataFrame:
    """(bucket, part, customers, tables): of the contexts of a bucket, in order, the sums over all buckets; tables of each stored
    seating, one after another."""

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ctx, code = unpacked_rising(row["ctx"]), pairs_of(row)[1]
                sums = [np.stack([np.bincount(code, x, len(ctx)).astype("<u8") for x in unpacked(row[k], "<u8").reshape(-1, len(code))]) for k in ("count", "t")]
                ends = np.searchsorted(part_of(ctx, parts), np.arange(parts + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(ends))
                cols = [[pack(x[..., ends[k] : ends[k + 1]].reshape(-1)) for k in used] for x, pack in ((ctx, packed_rising), (sums[0], packed), (sums[1], packed))]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([row["bucket"]] * len(used), pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["part", "bucket", "ctx", "customers", "tables"])

    def add(table: pa.Table) -> pa.Table:
        ctx = [unpacked_rising(x.as_py()) for x in table.column("ctx")]
        kinds, at = np.unique(np.concatenate(ctx), return_inverse=True)
        each = [np.concatenate([unpacked(x.as_py(), "<u8").reshape(-1, len(c)) for x, c in zip(table.column(k), ctx)], axis=1) for k in ("customers", "tables")]
        sums = [np.stack([np.bincount(at, x, len(kinds)).astype("<u8") for x in own]) for own in each]
        ends = np.cumsum([0, *map(len, ctx)])
        cols = [[packed(x[:, at[a:b]].reshape(-1)) for a, b in zip(ends, ends[1:])] for x in sums]
        return pa.table([table.column("bucket"), table.column("part"), *(pa.array(c, pa.binary()) for c in cols)], names=["bucket", "part", "customers", "tables"])

    sent = model.select("bucket", "ctx", "pair", "count", "t").mapInArrow(tidy(spread), "part int, bucket int, ctx binary, customers binary, tables binary")
    return sent.groupBy("part").applyInArrow(tidy(add), "bucket int, part int, customers binary, tables binary")


def next_round(model: DataFrame, parts: int, seed: int, kinds: int, samples: int = 1, asked: DataFrame | None = None) -> DataFrame:
    """The seating after BURN_IN sweeps under the totals so far, and with more samples those of as many sweeps less one after it;
    if blocks have asked, the answers to them under the model's seatings."""
    final, n = asked is not None, SAMPLES if asked is not None else 1
    up = model.agg(*(F.sum(F.col(k)[i]) for k in ("customers", "tables") for i in range(n))).first()
    up = np.array([float(x or 0) for x in up]).reshape(2, n)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        order = [k for k, part in sorted(enumerate(right.column("part").to_pylist()), key=lambda x: -1 if x[1] is None else x[1]) if part is not None]
        customers, tables = ([unpacked(right.column(k)[x].as_py(), "<u8").astype(float) for x in order] for k in ("customers", "tables"))
        tables = np.concatenate([x.reshape(n, -1) for x in tables], axis=1)
        totals = [np.stack((np.append(np.concatenate(customers), up[0, i]), np.append(tables[i], up[1, i]))) for i in range(n)]
        if not final:
            (seating,), rng, out = seatings_of(row), np.random.default_rng((row["bucket"], seed)), []
            for k in range(BURN_IN + samples - 1):
                seating.sweep(totals[0], kinds, rng)
                if k >= BURN_IN - 1:
                    out.append((seating.t, seating.r, seating.s))
            return table_of(STORED, [row | stored(out)])
        prob = 0.0
        for seating, own in zip(seatings_of(row), totals):
            prob = prob + seating.probabilities(own, kinds) / SAMPLES
        known = np.bincount(seating.tok, seating.c, seating.n).astype("<u8")
        prob, out = np.log10(prob).astype("<f4"), []
        for key, at in zip(right.column("key"), right.column("at")):
            if key.is_valid:
                at = unpacked_rising(at.as_py()).astype(np.int64)
                starts = np.flatnonzero(np.diff(seating.tok[at], prepend=-1))  # a token's pairs stand together
                out.append({"key": key.as_py(), "bucket": row["bucket"], "known": packed(known[seating.tok[at[starts]]]), "each": packed(np.diff(np.append(starts, len(at))).astype("<u4")), "score": packed(prob[at])})
        return table_of(BACK, out)

    right = context_totals(model, parts)
    if asked is not None:
        right = totals_table = staged(right, "totals")
        settled(model.sparkSession)
        right = right.unionByName(asked, allowMissingColumns=True)
    else:
        right = right.selectExpr("*", "cast(null as binary) key", "cast(null as binary) at")
    out = model.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(tidy(run), schema_of(BACK if final else STORED))
    if not final:
        return staged(out, "model")
    out = staged(out, "scores")
    dropped(totals_table)
    return out


def score_documents(docs: DataFrame, held, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs; held is a
    boolean column, true where a document is not learned from."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, size // BUCKET_BYTES)
    n_parts = n_buckets // 4 + 1

    def cut(batches):
        for seq, batch in enumerate(batches):
            for key, (i, j), token, code, sizes in block_tokens(batch, seq):
                ids, learned = (batch.column(c).slice(i, j - i).to_pylist() for c in (0, 2))
                yield pa.RecordBatch.from_pylist([{"key": key, "ids": ids, "held": learned, "sizes": packed(sizes.astype("<i8")), "token": packed(token), "code": packed(code)}], cut_schema)

    def cut_blocks(batches):
        """Of each stored block: key, ids, held, documents' sizes, and its tokens, pairs and the pairs of its tokens in order."""
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield row["key"], row["ids"], row["held"], unpacked(row["sizes"], "<i8"), *block_pairs(unpacked(row["token"], np.uint64), unpacked(row["code"], np.int32))

    def token_parts(batches):
        for key, _, held, sizes, token, pair, code in cut_blocks(batches):
            count = np.bincount(code[np.repeat(~np.asarray(held, bool), sizes)], minlength=len(pair)).astype("<u4")
            order, ends, p_order, p_ends = dealt_pairs(token, pair, n_buckets)
            each = np.bincount(pair // len(token), minlength=len(token)).astype("<u4")[order]
            used = np.flatnonzero(np.diff(ends))
            cols = [[pack(x[e[b] : e[b + 1]]) for b in used] for x, e, pack in ((token[order], ends, packed_rising), (each, ends, packed), (count[p_order], p_ends, packed))]
            before = (pair % len(token))[p_order]
            kinds = [np.unique(before[p_ends[b] : p_ends[b + 1]], return_inverse=True) for b in used]
            cols += [[packed_rising(token[k]) for k, _ in kinds], [packed(c.astype("<u4")) for _, c in kinds]]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(used), pa.binary()), pa.array(used, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["key", "bucket", "token", "each", "count", "ctx", "code"])

    def merge(table: pa.Table) -> pa.Table:
        """A bucket's model and, for each block, where its pairs are in it: pairs go by token, then by context, in both."""
        tokens, contexts = ([unpacked_rising(x.as_py()) for x in table.column(c)] for c in ("token", "ctx"))
        each, codes, counts = ([unpacked(x.as_py(), "<u4") for x in table.column(c)] for c in ("each", "code", "count"))
        token, ctx = np.unique(np.concatenate(tokens)), np.unique(np.concatenate(contexts))
        own = [np.repeat(np.searchsorted(token, t), n) * np.int64(len(ctx)) + np.searchsorted(ctx, x)[c] for t, n, x, c in zip(tokens, each, contexts, codes)]
        pair, at = np.unique(np.concatenate(own), return_inverse=True)
        seating = Seating(pair // len(ctx), pair % len(ctx), np.bincount(at, np.concatenate(counts), len(pair)).astype(np.int64))
        learned = np.bincount(seating.tok, seating.c)
        bucket, ends = table.column("bucket")[0].as_py(), np.cumsum([0, *map(len, own)])
        model = {"bucket": bucket, "asks": 0, "kinds": int((learned > 0).sum()), "tokens": int(learned.sum()), "ctx": packed_rising(ctx), "pair": packed_rising(pair), "count": packed(seating.c.astype("<u8")), **stored([(seating.t, seating.r, seating.s)])}
        asked = [{"bucket": bucket, "asks": 1, "key": key.as_py(), "at": packed_rising(at[a:b])} for key, a, b in zip(table.column("key"), ends, ends[1:])]
        return table_of(MERGED, [model, *asked])

    cut_schema = pa.schema([("key", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((k, pa.binary()) for k in ("sizes", "token", "code"))])
    blocks = staged(own.mapInArrow(tidy(cut), "key binary, ids array<long>, held array<boolean>, sizes binary, token binary, code binary"), "blocks")
    parts = blocks.mapInArrow(tidy(token_parts), "key binary, bucket int, token binary, each binary, count binary, ctx binary, code binary")
    merged = staged(parts.groupBy("bucket").applyInArrow(tidy(merge), schema_of(MERGED)), "merged", "asks")
    settled(spark)
    asked = merged.where("asks = 1").select("bucket", "key", "at")
    model = merged.where("asks = 0").select(*STORED)
    kinds, tokens = (x or 0 for x in model.agg(F.sum("kinds"), F.sum("tokens")).first())
    old = []
    for k in range(ROUNDS):
        model = next_round(model, n_parts, k, kinds, SAMPLES if k == ROUNDS - 1 else 1)
        dropped(merged, only="asks=0") if k == 0 else dropped(*old)
        old = [model]
        settled(spark)

    def whole_blocks(batches):
        for key, ids, held, sizes, token, pair, code in cut_blocks(batches):
            p_order = dealt_pairs(token, pair, n_buckets)[2]
            place = np.empty(len(p_order), np.int32)
            place[p_order] = np.arange(len(p_order), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes.tobytes()], pa.binary()), pa.array([packed(place[code])], pa.binary())], names=["key", "ids", "held", "sizes", "codes"])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy())
        known, each, score = (np.concatenate([np.zeros(0, t), *(unpacked(right.column(c)[int(k)].as_py(), t) for k in order)]) for c, t in (("known", "<u8"), ("each", "<u4"), ("score", "<f4")))
        known, score = np.repeat(known, each).astype(np.float64), score.astype(np.float64)
        out = [[] for _ in range(6)]
        for ids, held, sizes, codes in zip(*(left.column(c) for c in ("ids", "held", "sizes", "codes"))):
            codes, sizes = unpacked(codes.as_py(), np.int32), np.frombuffer(sizes.as_py(), "<i8")
            first = np.cumsum(sizes) - sizes
            n_known = np.add.reduceat((known[codes] > 0).astype(np.int64), first)
            base = np.add.reduceat(np.log10(known + 1)[codes], first) - sizes * np.log10(tokens + kinds + 1)
            for part, value in zip(out, (ids.as_py(), held.as_py(), sizes.tolist(), n_known.tolist(), base.tolist(), np.add.reduceat(score[codes], first).tolist())):
                part += value
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array([tokens] * len(out[0]), pa.int64()), pa.array(out[4], pa.float64()), pa.array(out[5], pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    back = next_round(model, n_parts, ROUNDS, kinds, asked=asked)
    dropped(merged, *old)
    settled(spark)
    whole = blocks.mapInArrow(tidy(whole_blocks), "key binary, ids array<long>, held array<boolean>, sizes binary, codes binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = whole.groupBy("key").cogroup(back.groupBy("key")).applyInArrow(tidy(assemble), schema)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), held_out(F.col("doc_id"), 7))


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
ORACLE: dict[str, str] = {}
