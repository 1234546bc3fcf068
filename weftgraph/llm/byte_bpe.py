"""Byte-level BPE by a global shuffle of distinct words.

Documents are cut into blocks. A block's pre-tokens are exploded with their positions: each is the index of
a distinct word of the block, in text order. The block's distinct words go to buckets by their hash; a
bucket encodes every distinct word once, however many blocks have it, and sends the ids back; a block puts
them together by position. Decoding joins ids with the token-byte table, which is the vocabulary file.

A word of any frequency is one row part per block, so no bucket grows with a hot word's occurrences. Blocks are
made twice, for the words and for the ids; a block's key is a digest of its texts, so a block that came out
otherwise the second time fails instead of giving wrong ids.

Merging is done here, by the ranks of the vocabulary file; no tokenizer library is called.

Defined results: a null text is empty and has no ids; repeated rows and ids are rows of their own; an empty
table gives no rows; other columns are dropped, whatever their names; texts and words of any length are encoded whole; of equal ranks the leftmost pair merges first. Texts are Unicode strings, so any text of the table can be encoded.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, chunks, documents, packed, packed_strings, task_key, tidy, unpacked, unpacked_strings

#: Bytes of text in a block.
BLOCK = 8 << 20
#: Bytes of text a bucket of distinct words.
BUCKET_BYTES = 32 << 20
#: Ids that one step decodes.
STEP = 1 << 18
#: Bytes of ids that a task decodes and gives on at a time.
DECODED = 2 << 20
#: Texts whose characters are all below this take an equal pattern of plain classes.
PLAIN = 0x500
PARTS = "key binary, bucket int, words binary"
BACK = "key binary, bucket int, sizes binary, ids binary"
WHOLE = "key binary, rows array<struct<doc_id: long>>, sizes binary, codes binary, place binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: of all neighbouring parts, the pair that makes the token of the least rank is joined, the
    leftmost of equal ones first, until no pair makes a token. The parts begin as single bytes. A heap holds the pairs, so that a word of
    n bytes takes n log n steps; pairs whose parts have changed since are passed over."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins at a byte; 0 where none does any more
    before = list(range(-1, n - 1))
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, stop = heapq.heappop(heap)
        b = end[a]
        if not b or b >= n or end[b] != stop:
            continue
        end[a], end[b] = stop, 0
        if stop < n:
            before[stop] = a
            if (r := ranks.get(word[a : end[stop]])) is not None:
                heapq.heappush(heap, (r, a, end[stop]))
        if a and (r := ranks.get(word[before[a] : stop])) is not None:
            heapq.heappush(heap, (r, before[a], stop))
    return [ranks[word[k : end[k]]] for k in range(n) if end[k]]


def splitter(pattern: str):
    """A function from a text to its matches of pattern, which must be of \\p{L}, \\p{N} and \\s classes.
    Python's own engine reads texts of characters below PLAIN, with those classes spelt out."""
    exact = regex.compile(pattern)

    def spelt(name: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(PLAIN) if regex.match(name, chr(c)))

    letters, numbers, spaces = spelt(r"\p{L}"), spelt(r"\p{N}"), spelt(r"\s")
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    plain = plain.replace(r"(?!\S)", f"(?![^{spaces}])").replace(r"\s", f"[{spaces}]")
    fast, last = re.compile(plain), chr(PLAIN - 1)
    high = re.compile(f"[^\x00-{last}]")
    return lambda text: exact.findall(text) if high.search(text) else fast.findall(text)


def blocks_of(batch: pa.RecordBatch, split, seq: int):
    """(key, rows, words in text order of their first use, sizes, codes) of each block of a batch."""
    off, _ = buffers(batch.column(1))
    texts = batch.column(1)
    for i, j in chunks(off, BLOCK):
        seen: dict[str, int] = {}
        sizes, codes, digest = [], [], hashlib.blake2b(f"{task_key()}/{seq}/{i}".encode(), digest_size=16)
        for text in texts.slice(i, j - i).to_pylist():
            text = text or ""
            found = split(text)
            sizes.append(len(found))
            codes.append(np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int32, len(found)))
            digest.update(text.encode())
            digest.update(b"\xff")
        yield digest.digest(), (i, j), list(seen), np.array(sizes, np.int32), np.concatenate(codes) if codes else np.zeros(0, np.int32)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, buckets: int | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, binary) of every row of docs."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, size // BUCKET_BYTES)

    def by_bucket(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The order of words by bucket, and where each bucket begins in it."""
        to = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % n_buckets
        order = np.argsort(to, kind="stable")
        return order, np.searchsorted(to[order], np.arange(n_buckets + 1))

    def word_parts(batches):
        split = splitter(pattern)
        for seq, batch in enumerate(batches):
            for key, _, words, _, _ in blocks_of(batch, split, seq):
                raw = [w.encode() for w in words]
                order, ends = by_bucket(raw)
                used = np.flatnonzero(np.diff(ends))
                parts = [packed_strings([raw[k] for k in order[ends[b] : ends[b + 1]]]) for b in used]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(used), pa.binary()), pa.array(used, pa.int32()), pa.array(parts, pa.binary())], names=["key", "bucket", "words"])

    def encode_bucket(table: pa.Table) -> pa.Table:
        table_of = ranks.value
        known: dict[bytes, list[int]] = {}
        sizes, ids = [], []
        for part in table.column("words"):
            own = []
            for w in unpacked_strings(part.as_py()):
                got = known.get(w)
                if got is None:
                    got = known[w] = merged(w, table_of)
                own.append(got)
            sizes.append(packed(np.array([len(x) for x in own], "<u4")))
            ids.append(packed(np.array([i for x in own for i in x], "<u4")))
        return pa.table([table.column("key"), table.column("bucket"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["key", "bucket", "sizes", "ids"])

    def whole_blocks(batches):
        split = splitter(pattern)
        for seq, batch in enumerate(batches):
            for key, (i, j), words, sizes, codes in blocks_of(batch, split, seq):
                order, _ = by_bucket([w.encode() for w in words])
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                rows = [{"doc_id": x} for x in batch.column(0).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([rows], pa.list_(pa.struct([("doc_id", pa.int64())]))), pa.array([packed(sizes)], pa.binary()), pa.array([packed(codes)], pa.binary()), pa.array([packed(place)], pa.binary())], names=["key", "rows", "sizes", "codes", "place"])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        out_id, out_ids = [], []
        parts = np.argsort(right.column("bucket").to_numpy())
        n, flat = (np.concatenate([np.zeros(0, "<u4"), *(unpacked(right.column(c)[int(k)].as_py(), "<u4") for k in parts)]) for c in ("sizes", "ids"))
        begin = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        for rows, sizes, codes, place in zip(*(left.column(c) for c in ("rows", "sizes", "codes", "place"))):
            sizes, codes, place = (unpacked(x.as_py(), np.int32) for x in (sizes, codes, place))
            if len(place) != len(n):
                raise RuntimeError("a block's words have no ids: the block was not made alike twice")
            stop = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            for k, row in enumerate(rows.as_py()):
                own = place[codes[stop[k] : stop[k + 1]]]
                lens = n[own].astype(np.int64)
                ends = np.cumsum(lens)
                pos = np.repeat(begin[own] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)
                out_id.append(row["doc_id"])
                out_ids.append(flat[pos].tobytes())
        return pa.table([pa.array(out_id, pa.int64()), pa.array(out_ids, pa.binary())], names=["doc_id", "ids"])

    back = source.mapInArrow(tidy(word_parts), PARTS).groupBy("bucket").applyInArrow(tidy(encode_bucket), BACK)
    whole = source.mapInArrow(tidy(whole_blocks), WHOLE)
    return whole.groupBy("key").cogroup(back.groupBy("key")).applyInArrow(tidy(assemble), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str, texts: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with texts, decoded of every row of encoded; an id outside the
    token-byte table is an error. A task holds the decoded bytes of about DECODED bytes of ids at a time."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches):
        token = [b""] * (max(ranks.value.values(), default=-1) + 1)
        for t, rank in ranks.value.items():
            token[rank] = t
        size = np.array([len(t) for t in token], np.int64)
        first, raw = np.cumsum(size) - size, np.frombuffer(b"".join(token), np.uint8)

        def text_of(ids: np.ndarray) -> bytes:
            """The ids joined with the token-byte table, in order."""
            n = size[ids]
            ends = np.cumsum(n)
            return raw[np.repeat(first[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

        for batch in batches:
            bytes_of = np.cumsum([0] + [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)])
            for i, j in chunks(bytes_of, DECODED):
                ids = [x or b"" for x in batch.column(1).slice(i, j - i).to_pylist()]
                text = [b"".join(text_of(x[k : k + STEP]) for k in range(0, len(x), STEP)) for x in (np.frombuffer(x, "<u4") for x in ids)]
                sha = [[hashlib.sha256(x).hexdigest() for x in side] for side in (ids, text)]
                columns = {"doc_id": batch.column(0).slice(i, j - i), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array(sha[0], pa.string()), "decoded_sha256": pa.array(sha[1], pa.string())}
                yield pa.RecordBatch.from_pydict(columns | ({"decoded": pa.array(text, pa.binary())} if texts else {}))

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded binary" * texts)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    return decode_documents(encode_documents(documents(spark, sf_dir), path, public.PATTERN), path, texts=False)


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLE: dict[str, str] = {}
