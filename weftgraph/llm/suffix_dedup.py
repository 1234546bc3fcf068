"""Suffix-array dedup: bytes covered by a 200-byte string that starts anywhere else are removed.

The corpus's suffix array is built where repeats can be. Every 200-byte window picks an anchor, the 32-byte string
in it with the least hash (the leftmost of equal ones), so equal windows pick equal anchors at equal offsets. An
anchor stands for the run of windows that pick it; the bytes these windows cover are its context. Then:

1. Anchors whose string occurs once are dropped: none of their windows can occur twice.
2. Equal contexts of one anchor that occur twice or more are repeats as a whole.
3. The distinct contexts of an anchor meet in a cell. A cell's text is suffix-sorted in two stages: suffixes smaller
   than their successors are sorted directly, all others are induced by scanning the buckets of first bytes in order.
   Windows that share 200 bytes with their neighbour in the suffix array are repeats.
4. An anchor with over ``CELL_CONTEXTS`` distinct contexts is split into several cells; windows that a cell leaves
   open are then counted over all its cells by a 128-bit hash of their 200 bytes, with partial sums before the shuffle.
5. Repeats' byte ranges go back to every occurrence, and each document drops their union.

Contexts and rows are told apart by 64-bit hashes of their bytes. Defined results: a null text is empty; a text under 200
bytes loses nothing; rows with the same id and text are separate documents, so each repeats the other; other columns are
dropped, whatever their names; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, chunks, documents, dropped, prefix_sums, range_hashes, staged, tidy

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM + 1
DEPTH = LENGTH + 8
CELL_CONTEXTS = 8192
#: Bytes of text in one suffix array.
SORTED = 1 << 20
MOST_BROADCAST = 1_000_000
#: Bytes of documents a cell.
CELL_BYTES = 32 << 20


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of width values, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(off: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """For each anchor: document, first window, windows, hash of its string, hash of its context."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = range_hashes(sums, at, at + gram)
    low = sliding_min((grams & ~np.uint64((1 << 30) - 1)) | at.astype(np.uint64), length - gram + 1)
    pick = (low & np.uint64((1 << 30) - 1)).astype(np.int64)
    sizes = np.diff(off)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    count = np.maximum(sizes - length + 1, 0)
    start = off[:-1][doc] + np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    own = pick[start]
    head = np.ones(len(start), bool)
    head[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    n = np.diff(np.append(first, len(start)))
    l = start[first]
    return doc[first], l - off[:-1][doc[first]], n, grams[own[first]], range_hashes(sums, l, l + n - 1 + length)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first DEPTH bytes or more, by two-stage sorting."""
    n = len(text)
    t = text.astype(np.int16)
    step = np.sign(np.append(t[1:] - t[:-1], np.int16(-1)))
    settled = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(settled[::-1])[::-1]
    small = step[nearest] > 0  # smaller than the successor
    raw = text.tobytes()
    chosen = np.flatnonzero(small)
    chosen = chosen[np.argsort(t[chosen], kind="stable")]
    cut = np.searchsorted(t[chosen], np.arange(257))
    #  one bucket of first bytes at a time, so that few keys are held
    direct = np.array([i for c in np.flatnonzero(np.diff(cut)) for i in sorted(chosen[cut[c] : cut[c + 1]].tolist(), key=lambda i: raw[i : i + DEPTH])], np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([n - 1]))  # the empty suffix comes first and induces the last one
    out = []
    for c in range(256):
        bucket = []
        fresh = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(fresh):  # larger ones of this bucket, each run after the one that it follows
            bucket.append(fresh)
            before = fresh[fresh > 0] - 1
            fresh = before[(t[before] == c) & ~small[before]]
        bucket.append(direct[cut[c] : cut[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[(t[before] > c) & ~small[before]]
        order = np.argsort(t[before], kind="stable")
        before = before[order]
        edges = np.searchsorted(t[before], np.arange(257))
        for x in np.flatnonzero(np.diff(edges)):
            waiting[x].append(before[edges[x] : edges[x + 1]])
    return np.concatenate(out)


def repeated_windows(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the window starts share length bytes with a neighbour among them in the suffix array."""
    is_start = np.zeros(len(text), bool)
    is_start[starts] = True
    order = suffix_array(text)
    order = order[is_start[order]]
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    for k in range(0, length, 8):  # common prefixes of neighbours, eight bytes a time
        if not len(live):
            break
        width = min(8, length - k)
        cols = k + np.arange(width)
        live = live[(text[a[live][:, None] + cols] == text[b[live][:, None] + cols]).all(1)]
    hit = np.zeros(len(text), bool)
    hit[a[live]] = hit[b[live]] = True
    return hit[starts]


def runs_of(flags: np.ndarray) -> np.ndarray:
    """(start, end) of each maximal run of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def anchor_rows(own: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            off, data = buffers(batch.column(1))
            rid = batch.column(0).to_numpy()
            for i, j in chunks(off):
                doc, l, n, h, c = anchors(off[i : j + 1] - off[i], data[off[i] : off[j]])
                yield pa.RecordBatch.from_arrays([pa.array(rid[i:j][doc]), pa.array(l), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], names=["rid", "l", "n", "h", "c"])

    return own.select("rid", "text").mapInArrow(tidy(run), "rid long, l long, n int, h long, c long")


def open_contexts(own: DataFrame, asked: DataFrame) -> DataFrame:
    """(cell, split, h, c, alone, bytes) of the representative contexts: their texts, cut from their documents."""
    wanted = asked.groupBy("rid").agg(F.collect_list(F.struct("cell", "split", "h", "c", "alone", "l", "n")).alias("parts"))
    n = asked.select("rid").distinct().count()
    ids = asked.select("rid").distinct()
    docs = own.select("rid", "text").join(F.broadcast(ids) if n <= MOST_BROADCAST else ids, "rid", "left_semi").dropDuplicates(["rid"]).join(wanted, "rid")

    def run(batches):
        for batch in batches:
            for text, parts in zip(batch.column(1), batch.column(2)):
                raw, parts = (text.as_py() or "").encode(), parts.as_py()
                cols = [[p[k] for p in parts] for k in ("cell", "split", "h", "c", "alone")]
                texts = [raw[p["l"] : p["l"] + p["n"] - 1 + LENGTH] for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_()), pa.array(texts, pa.binary())], names=["cell", "split", "h", "c", "alone", "bytes"])

    return docs.mapInArrow(run, "cell int, split int, h long, c long, alone boolean, bytes binary")


def sort_cell(table: pa.Table) -> pa.Table:
    """Repeated windows of a cell's contexts: (h, c, first, last window) and, of anchors in several cells, all
    windows' hashes, with a window where it is still open."""
    order = np.argsort(table.column("h").to_numpy(), kind="stable")
    h, c, split, alone = (table.column(x).to_numpy()[order] for x in ("h", "c", "split", "alone"))
    texts = [table.column("bytes")[int(k)].as_py() for k in order]
    lens = np.array([len(x) + 1 for x in texts])
    out = [[] for _ in range(5)]
    i = 0
    while i < len(texts):  # whole anchors, up to about SORTED bytes
        j, total = i, 0
        while j < len(texts) and (total < SORTED or h[j] == h[j - 1]):
            total += lens[j]
            j += 1
        text = np.frombuffer(b"\0".join(texts[i:j]) + b"\0", np.uint8)
        begin = np.cumsum(lens[i:j]) - lens[i:j]
        n = lens[i:j] - LENGTH
        starts = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = repeated_windows(text, starts)
        first = np.cumsum(n) - n
        for k in range(j - i):
            flags = hit[first[k] : first[k] + n[k]]
            if alone[i + k]:
                for a, b in runs_of(flags):
                    for part, value in zip(out, (h[i + k], c[i + k], a, b, b"")):
                        part.append(value)
            if split[i + k] > 1:  # other cells may have the partner of an open window, or an open partner
                raw = texts[i + k]
                for w, known in enumerate((flags | (not alone[i + k])).tolist()):
                    at = (-1, -1) if known else (w, w + 1)
                    for part, value in zip(out, (h[i + k], c[i + k], *at, hashlib.blake2b(raw[w : w + LENGTH], digest_size=16).digest())):
                        part.append(value)
        i = j
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=["h", "c", "a", "b", "open"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row of docs."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, size // CELL_BYTES)
    found = anchor_rows(own)
    twice = staged(found.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "anchors")
    n = twice.count()
    live = staged(found.join(F.broadcast(twice) if n <= MOST_BROADCAST else twice, "h", "left_semi"), "live")
    contexts = staged(live.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"), F.first("rid").alias("rid"), F.first("l").alias("l"), F.first("n").alias("n")), "contexts")
    several = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("k").alias("least")).where("kinds > 1 and least = 1").select("h", F.ceil(F.col("kinds") / CELL_CONTEXTS).cast("int").alias("split"))
    asked = contexts.join(several, "h").withColumn("alone", F.col("k") == 1)
    asked = staged(asked.select("rid", "l", "n", "h", "c", "alone", "split", F.pmod(F.xxhash64("h", F.pmod(F.xxhash64("c"), "split")), F.lit(cells)).cast("int").alias("cell")), "asked")
    # An anchor's part is in one cell, so a cell holds whole parts.
    sorted_ = staged(open_contexts(own, asked).groupBy("cell").applyInArrow(tidy(sort_cell), "h long, c long, a long, b long, open binary"), "sorted")
    dropped(twice, asked)
    open_ = sorted_.where("length(open) > 0")
    again = open_.groupBy("open").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("open")
    part = sorted_.where("length(open) = 0").select("h", "c", "a", "b").unionByName(open_.where("a >= 0").join(again, "open", "left_semi").select("h", "c", "a", "b"))
    whole = contexts.where("k > 1").select("h", "c", F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b"))
    ranges = live.join(part.unionByName(whole), ["h", "c"]).select("rid", (F.col("l") + F.col("a")).alias("a"), (F.col("l") + F.col("b") + (LENGTH - 1)).alias("b"))
    cut = ranges.groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("cut"))  # ranges of one text

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for text, cuts in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = (text.as_py() or "").encode()
                cover = np.zeros(len(raw) + 1, np.int64)
                for r in cuts or ():
                    cover[r["a"]] += 1
                    cover[min(r["b"], len(raw))] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for part, value in zip(out, (len(raw), int(gone.sum()), len(runs_of(gone)), hashlib.sha256(kept).hexdigest(), kept)):
                    part.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return own.join(cut, "rid", "left").select("doc_id", "text", "cut").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("kept")


QUERIES = {"op1_suffix_array_dedup": op1_suffix_array_dedup}
ORACLE: dict[str, str] = {}
