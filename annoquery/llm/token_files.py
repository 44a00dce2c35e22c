"""Token-id output in directly addressable codes.

An id is cut into 8-bit chunks, lowest first, one level per chunk. Level k holds the k-th chunk of every id
that has one, a bitmap of which of them continue at level k+1, and a rank directory (how many bits are set
before each 512-bit block). A position's next-level place is its rank, so any token is read without decoding
a block. One *segment* is one file image: a document directory followed by the levels. Segments are stored as
rows of a Parquet folder, which every Hadoop file system can hold and Spark commits atomically.

Empty cases: a null or empty text is a document of the end id alone; an empty table gives no segments and no rows.
Repeated ``doc_id`` values stay separate rows, next to each other. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import encoder, in_groups, staged, task

MAGIC = b"DAC1"
BLOCK = 512
SEGMENTS = "part int, seq long, n_tokens long, image binary"
PER_DOCUMENT = "part int, seq long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """File image of one segment."""
    levels, values = [], ids.astype(np.uint32, copy=False)
    while True:
        more = values > 255
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.int64)
        ranks = (np.cumsum(ones) - ones).astype(np.uint32)
        levels.append((len(values), values.astype(np.uint8).tobytes(), np.packbits(more).tobytes(), ranks.tobytes()))
        if not more.any():
            break
        values = values[more] >> 8
    known = np.array([d is not None for d in doc_ids], np.uint8)
    out = [MAGIC, struct.pack("<QI", len(doc_ids), len(levels)), known.tobytes()]
    out += [np.array([d or 0 for d in doc_ids], np.int64).tobytes(), np.array(lengths, np.uint64).tobytes()]
    for n, chunks, bits, ranks in levels:
        out += [struct.pack("<Q", n), chunks, bits, ranks]
    return b"".join(out)


class Segment:
    """Reader of one file image with random access to tokens and documents."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token segment")
        n_docs, n_levels = struct.unpack_from("<QI", image, 4)
        at = 16
        known = np.frombuffer(image, np.uint8, n_docs, at)
        ids = np.frombuffer(image, np.int64, n_docs, at := at + n_docs)
        self.lengths = np.frombuffer(image, np.uint64, n_docs, at := at + 8 * n_docs).astype(np.int64)
        at += 8 * n_docs
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", image, at)
            chunks = np.frombuffer(image, np.uint8, n, at := at + 8)
            bits = np.frombuffer(image, np.uint8, -(-n // 8), at := at + n)
            ranks = np.frombuffer(image, np.uint32, -(-n // BLOCK), at := at + len(bits))
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, position: int) -> int:
        """Set bits of a level before a position: one directory entry and the bits of one block."""
        _, bits, ranks = self.levels[level]
        block = position // BLOCK
        if block >= len(ranks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        first = block * BLOCK // 8
        return int(ranks[block]) + int(np.unpackbits(bits[first : position // 8 + 1])[: position - first * 8].sum())

    def __getitem__(self, position: int) -> int:
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[position]) << (8 * level)
            if not bits[position // 8] >> (7 - position % 8) & 1:
                break
            position = self._rank(level, position)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids of the positions from start to end: each level gives one run, found by rank."""
        out = np.zeros(max(0, end - start), np.uint32)
        where, a, b = np.arange(len(out)), start, end
        for level, (chunks, bits, _) in enumerate(self.levels):
            if a >= b:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[a // 8 : -(-b // 8)])[a % 8 : a % 8 + b - a].astype(bool)
            where, a = where[more], self._rank(level, a)
            b = a + len(where)
        return out


def encode_segments(docs: DataFrame, tokenizer: str, end_id: int = 2, segment_tokens: int = 1 << 20) -> DataFrame:
    """Segments of all documents in ascending ``doc_id`` order (range-partitioned, sorted in each partition)."""

    @task
    def encode(batches):
        from_file, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, lengths, held, size = [], [], [], 0

        def flush():
            image = pack_segment(doc_ids, lengths, np.concatenate(held))
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": [seq], "n_tokens": [size], "image": pa.array([image], pa.binary())}
            )

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_groups(texts):
                for key, ids in zip(keys[a:b], from_file.encode(texts[a:b])):
                    doc_ids.append(key)
                    lengths.append(len(ids) + 1)
                    held += [ids, np.array([end_id], np.uint32)]
                    size += len(ids) + 1
                    if size >= segment_tokens:
                        yield flush()
                        doc_ids, lengths, held, size, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(encode, SEGMENTS)


def decode_segments(segments: DataFrame) -> DataFrame:
    """Per document: its place in the segment, its token count and the unsigned crc32 of its ids, from the images."""

    def decode(batches):
        for batch in batches:
            for part, seq, image in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "image"))):
                segment = Segment(image)
                ends = np.cumsum(segment.lengths)
                starts = ends - segment.lengths
                crcs = [zlib.crc32(segment.slice(a, b).astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int64()), "doc_id": pa.array(segment.doc_ids, pa.int64()), "local_start": starts, "n_tokens": segment.lengths, "ids_crc32": pa.array(crcs, pa.int64())}
                )

    return segments.select("part", "seq", "image").mapInArrow(decode, PER_DOCUMENT)


def document_directory(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from stored segments; ``start`` counts all ids before the document.

    Sums run within each writing task and then over one row per task, so no single task sees all segments.
    """
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    starts = segments.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("seq_start")).join(parts, "part")
    return decode_segments(segments).join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("part_start") + F.col("seq_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, segment_tokens: int = 1 << 20) -> DataFrame:
    """Write the segments of ``docs`` to ``path`` and return them as read back."""
    encode_segments(docs, tokenizer, end_id, segment_tokens).write.parquet(path)
    return docs.sparkSession.read.schema(SEGMENTS).parquet(path)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents as token segments in the shared folder and return their directory as read back."""
    return document_directory(staged(encode_segments(docs, tokenizer, end_id), "token-files"))
