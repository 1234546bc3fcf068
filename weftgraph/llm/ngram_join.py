"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

The global order of 5-word shingles is (class, hash), where the class is the logarithm of a counter of a fixed-size
table that counts every distinct shingle of every document: rare shingles come first. Any total order gives exact
results; a good one keeps prefixes clear of common shingles. The steps:

1. Documents with equal shingle sets are one node, named by its set's key; its smallest doc_id represents it.
2. Two nodes of n and m shingles that link share at least A = ceil(0.75 / 1.75 * (n + m)) of them, so of the first
   n - A + k of the one and the first m - A + k of the other at least k are the same, for every k; k is 1 to 4 and grows with A
   (``shared_needed``). Prefix shingles are dealt to buckets with the set's size and their place in it, and a pair is written only
   where both places fit both sizes. A shingle of more than ``SMALL`` nodes pairs each node with ``HUBS`` hubs
   of like size, those with the fewest rarer shingles before it: copies all resemble the text they were made from. Its
   nodes are kept for step 4, but for those that no other node of the shingle can fit.
   The first round counts the pairs with hubs and, of a shingle of few nodes, those with its first node.
3. Pairs are counted by vertical partitioning: the global order is cut into ``FRAGMENTS`` ranges of about as many shingles,
   each range counts a pair's partial overlap by itself, and the partial overlaps are summed per pair.
4. Links give components. A pair inside one component needs no count, since it can't change a component. Shingles of many
   nodes whose nodes are then in more than one component are taken up again: their fitting pairs across components,
   in blocks of bounded size, and those that the first round left, must share k prefix shingles and are then counted in the same way.
   Every shingle of many nodes that such a pair shares is open, so none is missing from its sum.

Set keys are 64-bit sums of shingle hashes and shingles are 64-bit hashes; buckets carry 40 bits of a shingle, as a
false candidate is rejected by the count. A shingle whose counter is over ``HOT`` is dealt to several buckets by the set's key
and counts as one of many nodes in each of them. A node with many pairs is counted in salted cells of bounded size.

Defined results: a null or empty text has n_shingles 0 and is its own component; each row's set is that of its own text; rows
of one doc_id that have shingles are in one component, and all repeat in the result; a null doc_id has a null component and links with nothing;
other columns are dropped, whatever their names; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import buffers, chunks, distinct, documents, dropped, lowered, mix, packed, shingles, staged, task_key, tidy, unpacked, words

ORDER_BITS = 22
SLICES = 64
FAN_IN = 64
#: Steps of a class for each doubling of a counter.
FINE = 8
SMALL, HUBS = 16, 2
FRAGMENTS = 4
CELL = 1024
BLOCK_NODES = 1024
#: A shingle's nodes that one bucket takes, and prefix shingles of a bucket.
HOT, BUCKET_ROWS = 1 << 15, 1 << 20
HOT_BIT = np.uint32(1 << 31)
#: Rows up to which ids or shingles are broadcast instead of joined by a shuffle.
MOST_BROADCAST = 1_000_000


def document_sets(off, data, size: int = 5):
    """Distinct shingle hashes of each document, ascending, each document's first one, and its set key."""
    s, first = shingles(words(off, lowered(data)), size)
    v, first = distinct(s, first)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(v))))
    return v, first, mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))


def order_classes(docs: DataFrame, size: int = 5) -> np.ndarray:
    """A class for each of 2 ** ORDER_BITS counters: the logarithm of how many distinct shingles of
    documents fell on it. Partial tables are summed FAN_IN at a time, in as many rounds as it takes."""
    width = (1 << ORDER_BITS) // SLICES

    def count(batches):
        table = np.zeros(1 << ORDER_BITS, np.uint32)
        for batch in batches:
            off, data = buffers(batch.column(0))
            for i, j in chunks(off):
                v, _, _ = document_sets(off[i : j + 1] - off[i], data[off[i] : off[j]], size)
                np.add.at(table, (v >> np.uint64(64 - ORDER_BITS)).astype(np.int64), np.uint32(1))
        slices = [packed(table[k * width : (k + 1) * width].astype("<u8")) for k in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array([task_key()] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array(slices, pa.binary())], names=["task", "slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for x in table.column("counts"):
            total += unpacked(x.as_py(), "<u8")
        return pa.table([pa.array([table.column("task")[0].as_py()], pa.int32()), pa.array([table.column("slice")[0].as_py()], pa.int32()), pa.array([packed(total)], pa.binary())], names=["task", "slice", "counts"])

    def classed(batches):
        for batch in batches:
            out = [np.clip(np.round(FINE * np.log2(np.maximum(unpacked(x.as_py(), "<u8"), 1))), 0, 255).astype(np.uint8).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["slice", "classes"])

    schema = "task int, slice int, counts binary"
    own = docs.selectExpr("cast(text as string) text")
    tables, n = own.mapInArrow(tidy(count), schema), max(own.rdd.getNumPartitions(), 1)
    while n > 1:
        n = -(-n // FAN_IN)
        tables = tables.withColumn("task", F.col("task") % n).groupBy("task", "slice").applyInArrow(add, schema)
    out = np.zeros(1 << ORDER_BITS, np.uint8)
    for row in tables.select("slice", "counts").mapInArrow(classed, "slice int, classes binary").collect():  # a fixed number of bytes
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["classes"], np.uint8)
    return out


def order_codes(v: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where shingles stand in the global order."""
    return (classes[(v >> np.uint64(64 - ORDER_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (v >> np.uint64(8))


def fragment_bounds(classes: np.ndarray) -> np.ndarray:
    """Codes that cut the global order into FRAGMENTS ranges of about as many shingles."""
    n = np.bincount(classes, minlength=256)
    ends = np.cumsum(n * np.exp2(np.arange(256) / FINE))
    out = []
    for q in range(1, FRAGMENTS):
        want = ends[-1] * q / FRAGMENTS
        k = int(np.searchsorted(ends, want))
        before = ends[k - 1] if k else 0.0
        out.append((k << 56) + int((want - before) / max(ends[k] - before, 1e-9) * ((1 << 56) - 1)))
    return np.array(out, np.uint64)


def least_overlap(n, m):
    """The shingles that sets of n and m at least share if they link."""
    return -(-75 * (n + m) // 175)


def shared_needed(least):
    """The prefix shingles that a pair must share; prefixes are as much longer."""
    return np.clip(least // 128, 1, 4)


def fitting(n, m, p, q):
    """Whether sets of n and m shingles may link by a shingle at places p and q."""
    least = least_overlap(n, m)
    more = shared_needed(least) - least
    return (np.minimum(n, m) >= least) & (p < n + more) & (q < m + more)


def prefixes(v, first, classes):
    """Of each document, the part that any partner may need: documents, shingles, their places and classes."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    code = order_codes(v, classes)
    order = np.lexsort((code, doc))
    at = np.arange(len(v)) - first[:-1][doc]
    least = (75 * n + 99) // 100  # with the smallest partner
    use = at < (n - least + shared_needed(least))[doc]
    return doc[use], v[order][use], at[use], (code[order][use] >> np.uint64(56)).astype(np.int64)


def node_rows(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_key) of every row of docs."""

    def run(batches):
        for batch in batches:
            off, data = buffers(batch.column(1))
            n, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for i, j in chunks(off):
                _, first, keys = document_sets(off[i : j + 1] - off[i], data[off[i] : off[j]], size)
                n.append(np.diff(first))
                key.append(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(np.concatenate(key).view(np.int64))], names=["doc_id", "n_shingles", "set_key"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, set_key long")


def with_partners(group, n, p):
    """Which rows of a group (ascending, as numbers) another row of the group may fit.

    For a set of n with the shingle at place p, a partner of m must have p < n + k - A(n, m), so m is under a bound; and its
    own bound must be over n. Of the rows with m under the bound, the two with the largest own bounds decide."""
    slack = (4 * n - 7 * p + 28) / 3  # m < slack, from A >= 3 / 7 * (n + m) and k <= 4
    order = np.lexsort((n, group))
    g, m, s = group[order], n[order], slack[order]
    head = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    start = np.flatnonzero(head)[np.cumsum(head) - 1] if len(g) else np.zeros(0, np.int64)
    high = g.astype(np.float64) * 1e9  # groups apart in one running maximum
    best = np.maximum.accumulate(high + np.clip(s, 0, 9e8)) - high
    last = np.searchsorted(high + m, high + np.clip(s, 0, 9e8), "left")  # rows before it have m < slack
    alone = last - start <= 1
    seen = np.where(last > start, best[np.maximum(last - 1, 0)], 0)
    # the row itself is among them only if its own m < slack; then another must fit, which the size alone can't tell
    out = np.zeros(len(g), bool)
    out[order] = (last > start) & (seen > m) & ~(alone & (m < s))
    return out


def shared_prefixes(docs: DataFrame, classes: np.ndarray, buckets: int, size: int = 5) -> DataFrame:
    """Candidate pairs (kind 0: a, b set keys, n shingles shared in this bucket, m how many it takes, first 1, or 2 with
    a hub, for the first round) and the rows of shingles of many nodes (kind 1: a the shingle, b the set key, n its size, m the place)."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)
    salts = np.ceil(np.exp2(np.arange(256) / FINE) / HOT).astype(np.uint64)

    def deal(batches):
        for batch in batches:
            off, data = buffers(batch.column(0))
            for i, j in chunks(off, 4 << 20):
                parts = []
                for x, y in chunks(off[i : j + 1]):
                    o = off[i + x : i + y + 1]
                    v, first, keys = document_sets(o - o[0], data[o[0] : o[-1]], size)
                    doc, token, place, rank = prefixes(v, first, sent.value)
                    parts.append((token, keys[doc], np.diff(first)[doc].astype("<u4"), place.astype("<u4"), rank.astype(np.uint8)))
                token, key, n, place, rank = (np.concatenate(p) for p in zip(*parts))
                mixed, salt = mix(token), salts[rank]
                place = np.where(salt > 1, place | HOT_BIT, place)
                to = ((mixed + (mix(key) % salt) * np.uint64(0x9E3779B1)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[order], np.arange(buckets + 1))
                cut = (mixed >> np.uint64(24))[order]
                cols = [(cut.astype("<u4"), np.ndarray.tobytes), ((cut >> np.uint64(32)).astype(np.uint8), np.ndarray.tobytes), (key[order], np.ndarray.tobytes), (n[order], packed), (place[order], packed)]
                used = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array([put(x[ends[b] : ends[b + 1]]) for b in used], pa.binary()) for x, put in cols)], names=["bucket", "low", "high", "key", "n", "place"])

    def pair_up(table: pa.Table) -> pa.Table:
        low, high, key = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("low", "<u4"), ("high", np.uint8), ("key", np.uint64)))
        n, place = (np.concatenate([unpacked(x.as_py(), "<u4") for x in table.column(c)]) for c in ("n", "place"))
        token = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        salted, place = (place & HOT_BIT) > 0, place & ~HOT_BIT
        order = np.argsort(token, kind="stable")
        t = token[order]
        same = np.zeros(len(t) + 1, bool)
        same[1:-1] = t[1:] == t[:-1]
        order = order[same[1:] | same[:-1] | salted[order]]  # shingles that stand alone go first
        order = order[np.lexsort((key[order], n[order], place[order], token[order]))]
        token, key, n, place, salted = token[order], key[order], n[order].astype(np.int64), place[order].astype(np.int64), salted[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        token, key, n, place, salted = token[keep], key[keep], n[keep], place[keep], salted[keep]
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(token)))
        many = (sizes > SMALL) | salted[starts]
        found = [(np.zeros(0, np.uint64),) * 4]

        def add(x, y, first):
            ok = (key[x] != key[y]) & fitting(n[x], n[y], place[x], place[y])
            x, y, first = x[ok], y[ok], first[ok]
            need = shared_needed(least_overlap(n[x], n[y])).astype(np.uint64)
            found.append((np.minimum(key[x], key[y]), np.maximum(key[x], key[y]), need, first.astype(np.uint64)))

        for d in range(1, SMALL):  # pairs of small groups, by distance in the group
            own = starts[~many & (sizes > d)]
            left = sizes[~many & (sizes > d)] - d
            at = np.repeat(own - (np.cumsum(left) - left), left) + np.arange(left.sum())
            add(at, at + d, np.repeat(own, left) == at)
        large = np.repeat(many, sizes)
        rows = np.flatnonzero(large)
        group = np.repeat(np.arange(len(starts)), sizes)[rows]
        fits = with_partners(group, n[rows], place[rows]) | salted[rows]
        rows, group = rows[fits], group[fits]
        band = (np.log(np.maximum(n[rows], 1)) * 6.5).astype(np.int64)  # sizes within a sixth
        order = np.lexsort((key[rows], place[rows], band, group))
        r = rows[order]
        head = np.ones(len(r), bool)
        head[1:] = (group[order][1:] != group[order][:-1]) | (band[order][1:] != band[order][:-1])
        at = np.flatnonzero(head)[np.cumsum(head) - 1] if len(r) else np.zeros(0, np.int64)
        for h in range(HUBS):
            use = np.flatnonzero(at + h < np.arange(len(r)))
            use = use[at[use] == at[at[use] + h]]
            add(r[at[use] + h], r[use], np.full(len(use), 2))
        a, b, need, first = (np.concatenate(x) for x in zip(*found))
        pairs, shared = np.unique(np.stack([a, b, need, first], 1), axis=0, return_counts=True) if len(a) else (np.zeros((0, 4), np.uint64), np.zeros(0, np.int64))
        kind = np.concatenate((np.zeros(len(pairs), np.int32), np.ones(len(rows), np.int32)))
        values = [(pairs[:, 0], mix(token[rows])), (pairs[:, 1], key[rows]), (shared, n[rows]), (pairs[:, 2], place[rows]), (pairs[:, 3], np.zeros(len(rows)))]
        values = [np.concatenate((x.astype(np.uint64), y.astype(np.uint64))) for x, y in values]
        return pa.table([pa.array(kind), *(pa.array(x.view(np.int64)) for x in values[:2]), *(pa.array(x.astype(np.int32)) for x in values[2:])], names=["kind", "a", "b", "n", "m", "first"])

    dealt = docs.select("text").mapInArrow(tidy(deal), "bucket int, low binary, high binary, key binary, n binary, place binary")
    return dealt.groupBy("bucket").applyInArrow(tidy(pair_up), "kind int, a long, b long, n int, m int, first int")


def overlaps(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, classes: np.ndarray, buckets: int, size: int = 5) -> DataFrame:
    """Links (a, b) among pairs of set keys, by partial overlaps of the fragments of the global order."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((classes, fragment_bounds(classes)))
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("nbr")), F.struct(F.col("b").alias("node"), F.col("a").alias("nbr")))))
    family = ends.groupBy("node").agg(F.min("nbr").alias("nbr")).select(F.col("node").alias("a"), F.least("node", "nbr").alias("family"))
    told = pairs.join(family, "a")  # pairs of one family meet in one cell, so that a document is sent once
    many = told.groupBy("family").count().select("family", F.ceil(F.col("count") / CELL).alias("salts"))
    dealt = staged(told.join(many, "family").select("a", "b", F.pmod(F.xxhash64("family", F.pmod(F.xxhash64("b"), "salts")), F.lit(buckets)).cast("int").alias("cell")), "pairs")
    wanted = dealt.select(F.inline(F.array(F.struct(F.col("a").alias("set_key"), "cell"), F.struct(F.col("b").alias("set_key"), "cell")))).groupBy("set_key").agg(F.collect_set("cell").alias("cells"))
    wanted = staged(wanted.join(nodes, "set_key").select(F.col("rep").alias("doc_id"), "set_key", "cells"), "wanted")
    own = docs.select("doc_id", "text").join(F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted, "doc_id")

    def cut(batches):
        rank, bounds = sent.value
        for batch in batches:
            off, data = buffers(batch.column(1))
            for i, j in chunks(off):
                v, first, keys = document_sets(off[i : j + 1] - off[i], data[off[i] : off[j]], size)
                doc, frag = np.repeat(np.arange(j - i), np.diff(first)), np.searchsorted(bounds, order_codes(v, rank), "right")
                order = np.argsort(doc * FRAGMENTS + frag, kind="stable")
                v, ends = v[order], np.searchsorted((doc * FRAGMENTS + frag)[order], np.arange((j - i) * FRAGMENTS + 1))
                asked, cells, n = batch.column(2).slice(i, j - i).to_pylist(), batch.column(3).slice(i, j - i).to_pylist(), np.diff(first).tolist()
                keys = keys.view(np.int64).tolist()
                rows = [(c, f, keys[d], n[d], v[ends[d * FRAGMENTS + f] : ends[d * FRAGMENTS + f + 1]].tobytes()) for d in range(j - i) if keys[d] == asked[d] for c in cells[d] for f in range(FRAGMENTS)]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], names=["cell", "frag", "set_key", "n", "tokens"])

    def partial(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, order = np.unique(right.column("set_key").to_numpy(), return_index=True)  # a set sent twice counts once
        raw = [right.column("tokens")[int(k)].as_py() for k in order]
        n = right.column("n").to_numpy()[order]
        lens = np.array([len(x) // 8 for x in raw], np.int64)
        _, token = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        first = np.concatenate(([0], np.cumsum(lens)))
        node = np.repeat(np.arange(len(ids)), lens)
        held = (node.astype(np.int64) << 32) | token
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
        small, big = np.where(lens[x] <= lens[y], x, y), np.where(lens[x] <= lens[y], y, x)
        overlap = np.zeros(len(a), np.int64)
        for k, m in chunks(np.concatenate(([0], np.cumsum(lens[small])))):
            own = lens[small[k:m]]
            pair = np.repeat(np.arange(k, m), own)
            at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + first[small[pair]]
            want = (big[pair].astype(np.int64) << 32) | token[at]
            place = np.minimum(np.searchsorted(held, want), max(len(held) - 1, 0))
            overlap[k:m] = np.bincount(pair - k, weights=held[place] == want, minlength=m - k) if len(want) else 0
        return pa.table([pa.array(a), pa.array(b), pa.array(n[x] + n[y]), pa.array(overlap)], names=["a", "b", "n", "overlap"])

    parts = own.select("doc_id", "text", "set_key", "cells").mapInArrow(tidy(cut), "cell int, frag int, set_key long, n long, tokens binary")
    asked = dealt.select("a", "b", "cell", F.explode(F.array(*[F.lit(f) for f in range(FRAGMENTS)])).alias("frag"))
    counted = asked.groupBy("cell", "frag").cogroup(parts.groupBy("cell", "frag")).applyInArrow(tidy(partial), "a long, b long, n long, overlap long")
    total = counted.groupBy("a", "b").agg(F.max("n").alias("n"), F.sum("overlap").alias("overlap"))
    links = staged(total.where("100 * overlap >= 75 * (n - overlap)").select("a", "b"), "links")
    dropped(dealt, wanted)
    return links


def residual_pairs(rows: DataFrame, home: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Fitting pairs (a, b set keys) across components of the nodes that share a shingle of many nodes, once for each such
    shingle, and m, how many prefix shingles they must share; and the staged tables that this reads."""
    shared = own = staged(rows.join(home.select("set_key", "component"), F.col("b") == F.col("set_key")).select(F.col("a").alias("token"), "set_key", "n", F.col("m").alias("place"), "component"), "shared")
    open_ = own.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
    open_ = staged(open_.select("token", F.ceil(F.col("m") / BLOCK_NODES).alias("blocks")), "open")
    own = own.join(F.broadcast(open_) if open_.count() <= MOST_BROADCAST else open_, "token").withColumn("block", F.pmod(F.xxhash64("set_key"), "blocks"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "set_key", "n", "place", "component", "block")

    def cross(table: pa.Table) -> pa.Table:
        comp, n, place, block = (table.column(c).to_numpy().astype(np.int64) for c in ("component", "n", "place", "block"))
        key = table.column("set_key").to_numpy().view(np.uint64)
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in left if len(set(comp.tolist())) > 1 else []:
            ok = (comp[right] != comp[i]) & fitting(n[i], n[right], place[i], place[right])
            ok &= key[right] > key[i] if lo == hi else True
            two.append(right[ok])
            one.append(np.full(len(two[-1]), i))
        x, y = np.concatenate(one), np.concatenate(two)
        need = shared_needed(least_overlap(n[x], n[y])).astype(np.int32)
        return pa.table([pa.array(np.minimum(key[x], key[y]).view(np.int64)), pa.array(np.maximum(key[x], key[y]).view(np.int64)), pa.array(need)], names=["a", "b", "m"])

    return spread.groupBy("token", "lo", "hi").applyInArrow(tidy(cross), "a long, b long, m int"), [shared, open_]


def join_documents(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id is not null")
    rows = staged(node_rows(docs, size), "nodes")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    nodes = staged(full.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "sets")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, total // (3 * BUCKET_ROWS))  # a third of the shingles at most are dealt
    classes = order_classes(named, size)
    found = staged(shared_prefixes(named, classes, buckets, size), "candidates")
    several = full.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("doc_id")
    links = full.join(several, "doc_id", "left_semi").join(nodes, "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))  # rows of one doc_id

    def by_rep(found: DataFrame) -> DataFrame:
        one, two = (nodes.select(F.col("set_key").alias(k), F.col("rep").alias(r)) for k, r in (("a", "x"), ("b", "y")))
        return found.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    told = found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("m").alias("need"), F.max("first").alias("first"))
    pairs = staged(told.where("n >= need and first > 0").select("a", "b"), "pairs")
    links = links.unionByName(by_rep(overlaps(named, nodes, pairs, classes, buckets, size)))
    comps = staged(components(links, "a", "b"), "components")
    home = nodes.join(comps, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    left = found.where("kind = 0 and first < 2").select("a", "b", "n", F.col("m").alias("need"))
    many = found.where("kind = 1").select("a", "b", "n", "m")
    done = [found, pairs]
    if not many.isEmpty():
        across, read = residual_pairs(many, home)
        left, done = left.unionByName(across.select("a", "b", F.lit(1).alias("n"), F.col("m").alias("need"))), done + read
    left = left.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").join(pairs, ["a", "b"], "left_anti")
    one, two = (home.select(F.col("set_key").alias(k), F.col("component").alias(c)) for k, c in (("a", "p"), ("b", "q")))
    more = staged(left.join(one, "a").join(two, "b").where("p <> q").select("a", "b"), "pairs")
    if not more.isEmpty():
        links = links.unionByName(by_rep(overlaps(named, nodes, more, classes, buckets, size)))
        done.append(comps)
        comps = staged(components(links, "a", "b"), "components")
    dropped(more, *done)
    out = rows.join(nodes, "set_key", "left").join(comps, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(documents(spark, sf_dir))


QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join}
ORACLE = {
    "op7_ngram_jaccard_join": r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
e as (select a, b from l union select b, a from l),
c(d, r) as (select distinct a, a from e union select e.b, c.r from c join e on c.d = e.a),
m as (select d, min(r) r from c group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(m.r, w.doc_id)::bigint component_id from w left join n using (doc_id) left join m on m.d = w.doc_id"""
}
