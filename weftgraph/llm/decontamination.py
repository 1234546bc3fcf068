"""Benchmark decontamination: CGK embedding, repeated bit-sampling LSH over anchored windows, exact edit check.

A document is contaminated by an item when some stretch of it is within ``RATE`` of the item's bytes in edit distance,
both lower-cased (A-Z) with each white-space byte a space. The benchmark is a stated query set: it is read in blocks of
at most ``BLOCK_BYTES``, and each block is searched in all documents.

1. Windows and pieces. Of an item's 9-byte strings, one in ``SAMPLED`` is an anchor by its hash, and more where that leaves
   a gap of over ``GAP`` bytes. Pieces of an item start at its anchors, and windows of a document at every place, inside words
   too, where an anchor of the block stands. An item of m bytes within distance k of a stretch shares at least
   m - 8 - 9k of its 9-byte strings with it, so a window is dropped if no range that a stretch over it can lie in has as many
   strings of the block's items; with k = m / 10 no match is lost by that.
2. Embedding. A window and an item are walked with the same random steps (CGK): each output takes the byte under the
   pointer, and the pointer moves on or stays by a random bit of (output, byte). A small edit distance becomes a small
   Hamming distance. A walk of n outputs looks at about n / 2 bytes, so the walks of an item's pieces overlap and
   together see all of it: edits crowded in one part leave the other parts' pieces to find the item.
3. Bit sampling. ``TABLES`` samples of ``BITS`` outputs of each of ``WALKS`` walks are hashed; a window that agrees with
   a piece on any sample is a candidate for the piece's item, begun as far before as the piece's offset. More tables
   raise the recall.
4. Verification. What surrounds a candidate must hold at least m - 8 - 9k of the block's 9-byte strings, then m - 4 - 5k of its own
   item's 5-byte strings, again without loss. Windows of one item that overlap are one region, in which the exact edit distance
   of the item to the best stretch is taken by bit-parallel columns.

Items under ``SMALLEST`` bytes are searched without sketches: of k + 1 pieces of an item one stands unchanged in a stretch
within k edits, so the pieces' exact places are the candidates. Items that allow no edit, under 10 bytes, must be whole words.

Defined results: null documents and items are empty; an empty or blank item is never found; repeated items and rows match by themselves; an empty benchmark or table gives no rows. Texts
of any length are read whole; of equally good stretches the first end counts; other columns are dropped. A null doc_id or item_id stays null. Offsets are bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK, SPACE, buffers, chunks, documents, lowered, mix, prefix_sums, range_hashes, staged, tidy

RATE, GRAM, SMALLEST = 0.1, 9, 48
#: Bytes of the strings that a candidate shares with its own item, and how many of them one vectorised step looks up.
SHORT, STEP = 5, 1 << 18
#: Windows whose walks are taken together.
WALKED = 1 << 14
BLOCK_BYTES = 1 << 20
WALKS, TABLES, BITS = 2, 10, 5
LONGEST_WALK = 160
MIXED = np.uint64(0x9E3779B97F4A7C15)
#: One 9-byte string in so many is an anchor, and bytes of an item at most from one anchor to the next.
SAMPLED, GAP = np.uint64(4), 16
#: Size classes at most; the last one takes all larger items.
MOST_CLASSES = 16
SCHEMA = "doc_id long, item_id long, start long, end long, distance int"


def normal(data: np.ndarray) -> np.ndarray:
    return np.where(SPACE[data], np.uint8(32), lowered(data))


def steps(seed: int = 5) -> np.ndarray:
    """Random bits of (walk, output, byte)."""
    return np.random.default_rng(seed).integers(0, 2, (WALKS, LONGEST_WALK, 256), dtype=np.int64)


def samples(length: int, seed: int = 9) -> np.ndarray:
    """The outputs that each table of each walk takes; half of the tables look at the first half only."""
    rng = np.random.default_rng((seed, length))
    out = np.zeros((WALKS, TABLES, BITS), np.int64)
    for w in range(WALKS):
        for t in range(TABLES):
            out[w, t] = np.sort(rng.choice(length if t % 2 else max(length // 2, BITS), BITS, replace=False))
    return out


def sketches(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all tables' samples of the embeddings of what begins at starts: (starts, WALKS * TABLES)."""
    bits, taken = steps(), samples(length)
    out = np.zeros((WALKS * TABLES, len(starts)), np.uint64)
    for w in range(WALKS):
        uses: dict[int, list[int]] = {}
        for t in range(TABLES):
            for p in taken[w, t]:
                uses.setdefault(int(p), []).append(w * TABLES + t)
        for i in range(0, len(starts), WALKED):  # a slice's walk stays in the processor's cache
            at = starts[i : i + WALKED].copy()
            part = out[:, i : i + WALKED]
            for p in range(max(uses) + 1):
                byte = data.take(at, mode="clip")
                for row in uses.get(p, ()):
                    part[row] <<= np.uint64(8)
                    part[row] |= byte
                at += bits[w, p].take(byte)
        for t in range(TABLES):
            row = w * TABLES + t
            out[row] = mix(out[row] + np.uint64(row + 1) * np.uint64(1 << 48))
    return out


def anchor_strings(grams: np.ndarray) -> np.ndarray:
    """Of an item's 9-byte strings, in order, the anchors."""
    own = np.flatnonzero(grams % SAMPLED == 0)
    edges = np.concatenate(([-1], own, [len(grams)]))
    more = [np.arange(a + GAP, b, GAP) for a, b in zip(edges, edges[1:]) if b - a > GAP]
    return grams[np.concatenate([own, *more]).astype(np.int64)]


def short_strings(data: np.ndarray) -> np.ndarray:
    """The SHORT-byte strings at all offsets, as numbers."""
    out = np.zeros(max(len(data) - SHORT + 1, 0), np.uint64)
    for k in range(SHORT):
        out = (out << np.uint64(8)) | data[k : k + len(out)]
    return out


def best_stretch(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of item to a stretch of text, and the first end of such a stretch (Myers)."""
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[int, int] = {}
    for k, b in enumerate(item):
        eq[b] = eq.get(b, 0) | 1 << k
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, b in enumerate(text):
        x = eq.get(b, 0)
        d0 = ((((x & pv) + pv) ^ pv) | x | mv) & mask
        hp = mv | ~(d0 | pv) & mask
        hn = pv & d0
        score += bool(hp & top) - bool(hn & top)
        if score < best:
            best, end = score, j + 1
        hp, hn = (hp << 1) & mask, (hn << 1) & mask
        pv = hn | ~(d0 | hp) & mask
        mv = hp & d0
    return best, end


class Block:
    """Items of one size class: their 9-byte strings, the tables of their pieces, and their 5-byte strings."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = items
        self.smallest, self.largest = min(len(t) for _, t in items), max(len(t) for _, t in items)
        self.least = max(1, min(len(t) - GRAM + 1 - GRAM * int(RATE * len(t)) for _, t in items))
        raw = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        off = np.cumsum([0] + [len(t) for _, t in items])
        at = np.concatenate([np.arange(a, b - GRAM + 1) for a, b in zip(off, off[1:])])
        owner = np.repeat(np.arange(len(items)), np.diff(off) - GRAM + 1)
        grams = range_hashes(prefix_sums(raw), at, at + GRAM)
        ends = np.cumsum([0] + [len(t) - GRAM + 1 for _, t in items])
        self.grams = np.unique(grams)
        self.anchors = np.unique(np.concatenate([anchor_strings(grams[a:b]) for a, b in zip(ends, ends[1:])]))
        self.length = min(self.smallest - int(RATE * self.smallest), LONGEST_WALK)
        self.bytes = np.array([len(t) for _, t in items], np.int64)
        self.edits = np.array([int(RATE * len(t)) for _, t in items], np.int64)
        offset = at - off[owner]
        use = np.isin(grams, self.anchors) & (offset <= np.maximum(self.bytes[owner] - self.length * 3 // 5, 0))  # a walk still fits
        use = np.flatnonzero(use)
        use = use[np.sort(np.unique(np.stack([owner[use].astype(np.uint64), grams[use]]), axis=1, return_index=True)[1])]  # a string repeated in an item begins one piece
        keys = sketches(raw, at[use], self.length).reshape(-1)
        order = np.argsort(keys, kind="stable")
        piece = use[order % len(use)]
        self.keys, self.owner, self.offset = keys[order], owner[piece].astype(np.int32), offset[piece].astype(np.int32)
        strings = [short_strings(np.frombuffer(t, np.uint8)) for _, t in items]
        size = max(16, int(np.ceil(np.log2(sum(map(len, strings)) * 16))))
        self.own_shift = np.uint64(64 - size)
        self.own = np.zeros(1 << size, bool)
        for k, own in enumerate(strings):
            self.own[self.own_slots(own, np.array([k], np.uint64))] = True
        self.low = np.uint64((1 << max(20, int(np.ceil(np.log2(len(keys) * 16))))) - 1)
        self.few = np.zeros(int(self.low) + 1, bool)
        self.few[(self.keys & self.low).astype(np.int64)] = True

    def own_slots(self, strings: np.ndarray, item) -> np.ndarray:
        """Where the table of own strings keeps them."""
        return (((strings + item * np.uint64(0xD6E8FEB86659FD93)) * MIXED) >> self.own_shift).astype(np.int64)

    def close_enough(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether each byte range lo:hi holds as many of its item's strings as a stretch within reach must."""
        n = np.maximum(hi - lo - SHORT + 1, 0)
        need = np.maximum(1, self.bytes[item] - SHORT + 1 - SHORT * self.edits[item])
        ends = np.cumsum(n)
        out, i = np.zeros(len(n), bool), 0
        while i < len(n):
            done = ends[i] - n[i]
            j = max(i + 1, int(np.searchsorted(ends, done + STEP, "right")))
            at = np.repeat(lo[i:j] - (ends[i:j] - n[i:j] - done), n[i:j]) + np.arange(ends[j - 1] - done)
            strings = np.zeros(len(at), np.uint64)
            for k in range(SHORT):
                strings = (strings << np.uint64(8)) | data[at + k]
            held = self.own[self.own_slots(strings, np.repeat(item[i:j].astype(np.uint64), n[i:j]))]
            total = np.concatenate(([0], np.cumsum(held)))
            out[i:j] = total[ends[i:j] - done] - total[ends[i:j] - n[i:j] - done] >= need[i:j]
            i = j
        return out

    def candidates(self, data, off, hits, grams):
        """(item, document, begin) that the chunk's windows and the items' pieces agree on; hits are the places of the
        class's strings, ascending, and grams what stands there."""
        place = np.minimum(np.searchsorted(self.anchors, grams), len(self.anchors) - 1)
        at = hits[self.anchors[place] == grams]
        home = np.searchsorted(off, at, "right") - 1
        begin, stop = off[home], off[home + 1]
        most = self.largest + int(RATE * self.largest)

        def strings_in(lo, hi):
            return np.searchsorted(hits, hi - GRAM + 1) - np.searchsorted(hits, lo)

        quarter = -(-most // 4)
        fits = np.zeros(len(at), bool)
        for k in range(4):  # a stretch over the window begins in one of four quarters before it
            fits |= strings_in(np.maximum(at - most + k * quarter, begin), np.minimum(at + (k + 1) * quarter, stop)) >= self.least
        at, home = at[fits], home[fits]
        if not len(at):
            return at, at, at
        keys = sketches(data, at, self.length)
        row, col = np.nonzero(self.few[(keys & self.low).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, keys[row, col], "left"), np.searchsorted(self.keys, keys[row, col], "right")
        n = hi - lo
        place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        col = np.repeat(col, n)
        item, home, at = self.owner[place].astype(np.int64), home[col], at[col] - self.offset[place]
        order = np.lexsort((at, home, item))
        item, home, at = item[order], home[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (item[1:] != item[:-1]) | (home[1:] != home[:-1]) | (at[1:] != at[:-1])
        item, home, at = item[new], home[new], at[new]
        lo, hi = self.reach(off, item, home, at)
        kept = strings_in(lo, hi) >= np.maximum(1, self.bytes[item] - GRAM + 1 - GRAM * self.edits[item])
        return item[kept], home[kept], at[kept]

    def reach(self, off, item, home, at):
        """The byte ranges that hold every stretch within reach of the items begun at at."""
        return np.maximum(off[home], at - self.edits[item]), np.minimum(off[home + 1], at + self.bytes[item] + 2 * self.edits[item])

    def regions(self, data, off, hits, grams):
        """(item, document, from, to) of the chunk that may hold a stretch within reach; what overlaps is one region."""
        item, home, at = self.candidates(data, off, hits, grams)
        lo, hi = self.reach(off, item, home, at)
        kept = self.close_enough(data, lo, hi, item)
        item, lo, hi, home = item[kept], lo[kept], hi[kept], home[kept]
        if not len(item):
            return []
        new = np.ones(len(item), bool)  # of one item and document, in order: both ends ascend, so only neighbours need a look
        new[1:] = (item[1:] != item[:-1]) | (home[1:] != home[:-1]) | (lo[1:] >= hi[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(item)) - 1
        return zip(item[first].tolist(), home[first].tolist(), lo[first].tolist(), hi[last].tolist())


class ShortItems:
    """Items under SMALLEST bytes and the pieces of which one must stand unchanged."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items, self.pieces = items, {}
        for k, (_, t) in enumerate(items):
            cuts = np.linspace(0, len(t), int(RATE * len(t)) + 2).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:]):
                raw = np.frombuffer(t[a:b], np.uint8)
                h = int(range_hashes(prefix_sums(raw), np.array([0]), np.array([b - a]))[0])
                self.pieces.setdefault((b - a, len(cuts) == 2), {}).setdefault(h, []).append((k, a))

    def regions(self, data, off):
        """(item, document, from, to) of the chunk that may hold a stretch within reach."""
        sums, found = prefix_sums(data), set()
        edge = np.zeros(len(data) + 1, bool)  # no word goes on over it
        edge[:-1] |= SPACE[data]
        edge[1:] |= SPACE[data]
        edge[off] = True
        for (size, whole), pieces in self.pieces.items():
            at = np.arange(max(len(data) - size + 1, 0))
            at = at[edge[at] & edge[at + size]] if whole else at
            h = range_hashes(sums, at, at + size)
            for k in np.flatnonzero(np.isin(h, np.array(list(pieces), np.uint64))).tolist():
                place = int(at[k])
                home = int(np.searchsorted(off, place, "right")) - 1
                if place + size > off[home + 1]:
                    continue
                for item, a in pieces[int(h[k])]:
                    m = len(self.items[item][1])
                    edits = int(RATE * m)
                    found.add((item, home, max(int(off[home]), place - a - edits), min(int(off[home + 1]), place - a + m + 2 * edits)))
        return sorted(found)


class Items:
    """A block's items by size, and one table that tells which sizes have a 9-byte string."""

    def __init__(self, items: list[tuple[int, bytes]]):
        short = [x for x in items if len(x[1]) < SMALLEST]
        self.short = ShortItems(short) if short else None
        sizes: dict[int, list] = {}
        for x in items:
            if len(x[1]) >= SMALLEST:
                sizes.setdefault(min(int(np.log(len(x[1]) / SMALLEST) / np.log(1.5)), MOST_CLASSES - 1), []).append(x)
        self.blocks = [Block(own) for _, own in sorted(sizes.items())]
        size = max(22, int(np.ceil(np.log2(sum(len(b.grams) for b in self.blocks) * 64 + 1))))
        self.shift = np.uint64(64 - size)
        self.flags = np.zeros(1 << size, np.uint16)
        for k, b in enumerate(self.blocks):
            self.flags[(b.grams >> self.shift).astype(np.int64)] |= np.uint16(1 << k)

    def regions(self, data, off):
        """(block, item, document, from, to) of a chunk of documents."""
        if self.short:
            yield from ((self.short, *x) for x in self.short.regions(data, off))
        if not self.blocks or len(data) < GRAM:
            return
        at = np.arange(len(data) - GRAM + 1)
        grams = range_hashes(prefix_sums(data), at, at + GRAM)
        flags = self.flags.take((grams >> self.shift).view(np.int64))
        at = np.flatnonzero(flags)
        at = at[at + GRAM <= off[np.searchsorted(off, at, "right")]]
        grams, flags = grams[at], flags[at]
        for k, b in enumerate(self.blocks):
            own = np.flatnonzero(flags & np.uint16(1 << k))
            own = own[b.grams[np.minimum(np.searchsorted(b.grams, grams[own]), len(b.grams) - 1)] == grams[own]]
            if len(own) >= b.least:
                yield from ((b, *x) for x in b.regions(data, off, at[own], grams[own]))


def search(docs: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
    """Rows (doc_id, item_id, start, end, distance): for each document and item within reach, its best stretch."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        own = Items(sent.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            off, data = buffers(batch.column(1))
            rows = []
            for i, j in chunks(off, CHUNK >> 1):
                o, d = off[i : j + 1] - off[i], normal(data[off[i] : off[j]])
                raw, best = d.tobytes(), {}
                for block, k, n, lo, hi in own.regions(d, o) if len(d) else ():
                    item_id, item = block.items[k]
                    exact, most = raw.find(item, lo, hi), int(RATE * len(item))
                    if exact >= 0:
                        found = 0, exact, exact + len(item)
                    else:
                        distance, end = best_stretch(item, raw[lo:hi])
                        if distance > most:
                            continue
                        _, back = best_stretch(item[::-1], raw[max(lo, lo + end - len(item) - most) : lo + end][::-1])
                        found = distance, lo + end - back, lo + end
                    key = n, id(block), k
                    if key not in best or found < best[key][1]:
                        best[key] = item_id, found
                for (n, _, _), (item_id, (distance, s, e)) in best.items():
                    rows.append((ids[i + n], item_id, s - int(o[n]), e - int(o[n]), distance))
            cols = list(zip(*sorted(rows, key=lambda r: (str(r[0]), str(r[1]), r[2:])))) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.int32())], names=["doc_id", "item_id", "start", "end", "distance"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, start, end, distance) of all benchmark items against all documents. A benchmark of more than
    one block is searched block by block, so that the driver holds one at a time."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 if size <= BLOCK_BYTES else -(-size // BLOCK_BYTES) * 2
    out = None
    for b in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        items = [(r["item_id"], normal(np.frombuffer(r["text"].encode(), np.uint8)).tobytes()) for r in part.orderBy("item_id", "text").collect()]  # about BLOCK_BYTES at most
        found = search(docs, [x for x in items if x[1].strip()])
        found = found if blocks == 1 else staged(found, "found")
        out = found if out is None else out.unionByName(found)
    return out


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}
ORACLE: dict[str, str] = {}
