"""Suffix-array dedup by prefix-free parsing: bytes of repeated strings are removed from all but the first document.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id.

1. Documents are packed, about ``CHUNK`` bytes together, and written once; in a chunk they are in order of doc_id.
2. Rolling-hash triggers parse every chunk.  Each chunk sends its distinct trigger hashes, 40 bits of each, dealt by
   their leading bits; back comes a bit for each: seen in another document or not.  A trigger in a million documents is
   one entry a chunk.
3. Phrases of triggers seen elsewhere go, distinct ones only and without the trigger's own bytes, to their trigger's
   bucket: the dictionary.  There all strings of 50 bytes in the phrases are sorted (a suffix array of the dictionary), the
   first document of each run of equals is found, and back comes a bit for each string: in an earlier document or not.
4. Each chunk combines the bits with its parse, document by document, into removed runs.

Equal strings have equal triggers at equal places, so no repeat is missed.  Strings are compared by the 64-bit hash of their
trigger's 20 bytes and byte for byte in the other 30, and a chunk's phrases of one trigger are told apart by a 64-bit hash of
their bytes: a repeat is invented with a chance of about 2**-64 a pair.  Buckets hold bounded parts of the hash space; their
number follows the corpus, that of the tasks they are dealt to ends at ``MOST_TASKS``.

Null texts are empty; a null doc_id counts as larger than all others; rows that repeat a doc_id are one document to each
other; texts under 50 bytes lose nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, utf8
from .parsing import SPAN, Parse, around, earlier

CHUNK, LAST = 2 << 20, np.iinfo(np.int64).max
PER_BUCKET = 500_000  # triggers
MOST_TASKS = 1 << 16


def squeeze(x: np.ndarray) -> bytes:
    """Byte planes of an array, compressed: sorted or small numbers take little."""
    planes = np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).reshape(len(x), -1).T) if len(x) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def packed(docs: DataFrame, key: str) -> DataFrame:
    """chunk, n_bytes, ids, sizes, body: texts in order of their ids."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, bool, bytes]] = []
        size = 0

        def done():
            nonlocal number, held, size
            held.sort(key=lambda x: x[0])
            body = b"".join(x[2] for x in held)
            ids, null = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.uint8)
            sizes = np.array([len(x[2]) for x in held], np.int64)
            row = [pa.array([v]) for v in (number, len(body), squeeze(ids), squeeze(null), squeeze(sizes), zstandard.ZstdCompressor(level=3).compress(body))]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays(row, names=["chunk", "n_bytes", "ids", "nulls", "sizes", "body"])

        for batch in batches:
            offsets, raw = utf8(batch.column(1))
            for i, x in enumerate(batch.column(0).to_pylist()):
                held.append((LAST if x is None else x, x is None, raw[offsets[i] : offsets[i + 1]].tobytes()))
                size += int(offsets[i + 1] - offsets[i]) + 64
                if size >= CHUNK:
                    yield done()
        if held:
            yield done()

    return docs.select(F.col(key).cast("bigint"), "text").mapInArrow(apply, "chunk bigint, n_bytes bigint, ids binary, nulls binary, sizes binary, body binary")


class Chunk:
    def __init__(self, row: dict):
        self.number, self.ids, self.nulls = row["chunk"], expand(row["ids"], np.int64), expand(row["nulls"], np.uint8)
        sizes = expand(row["sizes"], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(row["n_bytes"]))), np.uint8)

    def parse(self, answers: pa.Table | None = None) -> Parse:
        if answers is None:
            return Parse(self.offsets, self.raw, self.ids)
        bits = {r["bucket"]: r["bits"] for r in answers.select(["bucket", "bits"]).to_pylist()}

        def wanted(distinct: np.ndarray) -> np.ndarray:
            parts = [np.unpackbits(np.frombuffer(bits[b][8:], np.uint8))[: int.from_bytes(bits[b][:8], "little")] for b in sorted(bits)]
            out = np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)
            if len(out) != len(distinct):
                raise RuntimeError("a chunk's answers don't fit its triggers")
            return out

        return Parse(self.offsets, self.raw, self.ids, wanted)


def bucket_ranges(h: np.ndarray, n_bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes, by their leading bits; every bucket that has some."""
    if not len(h):
        return []
    b = (h >> np.uint64(64 - n_bits)).astype(np.int64) if n_bits else np.zeros(len(h), np.int64)
    begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    return [(int(b[i]), int(i), int(j)) for i, j in zip(begin, [*begin[1:], len(h)], strict=True)]


def _bits(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + np.packbits(x).tobytes()


def removed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (the remaining bytes) of each document."""
    chunks = materialize(packed(docs, key), "chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    n_bits = max(0, int(np.ceil(np.log2(max(1, total / 16 / PER_BUCKET)))))
    tasks = min(1 << n_bits, MOST_TASKS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p = Chunk(row).parse()
                for b, i, j in bucket_ranges(p.distinct, n_bits):
                    # five bytes below the bucket's bits
                    low = (p.distinct[i:j] << np.uint64(n_bits)) >> np.uint64(24)
                    cut = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                    planes = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(cut.T).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (b, row["chunk"], planes, np.packbits(p.several[i:j]).tobytes())], names=["bucket", "chunk", "hashes", "several"])

    def answer(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        values = []
        for r in rows:
            cut = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["hashes"]), np.uint8).reshape(5, -1)
            wide = np.zeros((cut.shape[1], 8), np.uint8)
            wide[:, :5] = cut.T
            values.append(wide.view("<u8").ravel())
        sizes = [len(v) for v in values]
        v = np.concatenate(values)
        hit = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8))[:n] for r, n in zip(rows, sizes, strict=True)]).astype(bool)
        order = np.argsort(v, kind="stable")
        s = v[order]
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.concatenate([begin, [len(s)]]))
        some = np.logical_or.reduceat(hit[order], begin) | (count > 1)
        hit[order] = np.repeat(some, count)
        at = np.concatenate([[0], np.cumsum(sizes)])
        bits = [_bits(hit[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"chunk": [r["chunk"] for r in rows], "bucket": pa.array([r["bucket"] for r in rows], pa.int64()), "bits": pa.array(bits, pa.binary())})

    asked = chunks.mapInArrow(ask, "bucket bigint, chunk bigint, hashes binary, several binary")
    answers = asked.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(answer, "chunk bigint, bucket bigint, bits binary")
    answers = materialize(answers, "seen")

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("bucket", "chunk", "grams", "lefts", "rights", "ranks", "context")}
        for row in left.to_pylist():
            chunk = Chunk(row)
            p = chunk.parse(right)
            one = p.one
            l, r, context = around(chunk.raw, p.place[one], p.first[one], p.last[one])
            at = np.concatenate([[0], np.cumsum(l + r)])
            for b, i, j in bucket_ranges(p.hash[one], n_bits):
                values = (b, row["chunk"], squeeze(p.hash[one][i:j]), squeeze(l[i:j].astype(np.uint8)), squeeze(r[i:j].astype(np.uint8)), squeeze(p.least[i:j]), zstandard.ZstdCompressor(level=3).compress(context[at[i] : at[j]].tobytes()))
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
        return pa.table({k: pa.array(v, pa.int64() if k in ("bucket", "chunk") else pa.binary()) for k, v in out.items()})

    def compare(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        parts = [(expand(r["grams"], np.uint64), expand(r["lefts"], np.uint8).astype(np.int64), expand(r["rights"], np.uint8).astype(np.int64), expand(r["ranks"], np.int64)) for r in rows]
        gram, l, r, rank = (np.concatenate(x) for x in zip(*parts, strict=True))
        context = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x["context"]) for x in rows), np.uint8)
        mask = earlier(gram, l, r, context, rank)
        at = np.concatenate([[0], np.cumsum([len(x[0]) for x in parts])])
        masks = [squeeze(mask[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"chunk": [x["chunk"] for x in rows], "bucket": pa.array([x["bucket"] for x in rows], pa.int64()), "masks": pa.array(masks, pa.binary())})

    told = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tell, "bucket bigint, chunk bigint, grams binary, lefts binary, rights binary, ranks binary, context binary")
    compared = told.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(compare, "chunk bigint, bucket bigint, masks binary")
    replies = answers.select("chunk", "bucket", "bits", F.lit(None).cast("binary").alias("masks")).unionByName(compared.select("chunk", "bucket", F.lit(None).cast("binary").alias("bits"), "masks"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in (key, "n_bytes", "n_removed", "n_spans", "kept")}
        for row in left.to_pylist():
            chunk = Chunk(row)
            heard = right.to_pylist()
            p = chunk.parse(pa.Table.from_pylist([r for r in heard if r["bits"] is not None], schema=right.schema))
            masks = {r["bucket"]: expand(r["masks"], np.uint32) for r in heard if r["masks"] is not None}
            mask = np.concatenate([np.zeros(0, np.uint32), *(masks[b] for b in sorted(masks))])
            count = p.last - p.first + 1
            nth = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(count) else np.zeros(0, np.int64)
            later = np.repeat(p.rank > p.least[p.phrase], count)  # the phrase is in a smaller text of this chunk
            gone = later | (np.repeat(mask[p.phrase], count) >> nth.astype(np.uint32) & 1).astype(bool)
            start = (np.repeat(p.first, count) + nth)[gone]
            edge = np.zeros(len(chunk.raw) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + SPAN, -1)
            covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
            n = np.concatenate([np.zeros(1, np.int32), np.cumsum(covered, dtype=np.int32)])
            opens = covered & ~np.concatenate([[False], covered[:-1]])[: len(covered)]
            opens[chunk.offsets[:-1][chunk.offsets[:-1] < len(covered)]] |= covered[chunk.offsets[:-1][chunk.offsets[:-1] < len(covered)]]
            spans = np.concatenate([np.zeros(1, np.int32), np.cumsum(opens, dtype=np.int32)])
            for i, (a, z) in enumerate(zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)):
                values = (None if chunk.nulls[i] else int(chunk.ids[i]), int(z - a), int(n[z] - n[a]), int(spans[z] - spans[a]), chunk.raw[a:z][~covered[a:z]].tobytes())
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
        return pa.table({k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()})

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(cut, f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def query(spark, sf_dir):
    out = removed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
