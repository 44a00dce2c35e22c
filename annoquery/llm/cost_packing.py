"""Cost-balanced packing: sequences of equal length whose attention cost is about equal as well.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention stays within a piece), a sequence the sum over its pieces.
Documents are cut into pieces of at most ``longest`` tokens, so that no piece's square dominates a sequence. Descending by length, each piece goes
to the sequence of lowest cost with room for it. There are tokens / ``capacity`` sequences, rounded down. Pieces that
find no room are cut to fill what room is left, largest first, and the last tokens, fewer than ``capacity``, fill sequences whose sizes are
powers of two. So no token of padding is needed.

The assignment works on counts: pieces of one length are alike, and so are sequences of equal history. The driver holds the
histogram (at most ``longest`` numbers) and the groups of sequences (about as many), whatever the corpus. Pieces then find their place by their rank among
pieces of their length; ranks come from per-task counts, so no length is gathered in one task. Only pieces that are cut again are joined with their ids.

Empty cases: a null or empty text is the end id alone; an empty table gives no rows. Repeated rows are packed each; a null ``doc_id`` is packed like others. Extra columns of ``docs`` are not read.
"""

from __future__ import annotations

import functools
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_tokens import ByteTextEncoder
from .packing import placements
from .shared import in_groups, staged

PIECES = "part int, slot long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def _encoder(path: str) -> ByteTextEncoder:
    return ByteTextEncoder(path)


def cut_pieces(docs: DataFrame, tokenizer: str, longest: int, end_id: int) -> DataFrame:
    """One row per piece with its ids (16 or 32 bits each); ``slot`` is its rank among the pieces of the same length made by the same task."""

    def cut(batches):
        table, part, made = _encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        small = len(table.begins) <= 1 << 16 and end_id < 1 << 16
        try:
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in in_groups(texts):
                    rows = []
                    for key, ids in zip(keys[a:b], table.encode(texts[a:b])):
                        ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                        raw, brief = ids.tobytes(), ids.astype("<u2").tobytes() if small else None
                        for at in range(0, len(ids), longest):
                            n = min(longest, len(ids) - at)
                            own = raw[4 * at : 4 * (at + n)]
                            rows.append((part, int(made[n]), key, at, n, zlib.crc32(own), len(ids), brief[2 * at : 2 * (at + n)] if small else own))
                            made[n] += 1
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                    names = ("part", "slot", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        finally:
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def balance(histogram: dict[int, int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 256) -> tuple[list[list], dict[int, int]]:
    """Groups of equal sequences ``[room, times, {length: pieces}]`` and the pieces, by length, that found no room whole.

    Every step gives one more piece to a whole group, or splits the group for the last pieces of a length. So a length makes one more group at most.
    """
    total = sum(n * c for n, c in histogram.items())
    groups = [[capacity, total // capacity, {}]] if total >= capacity else []
    costs, over = [0.0] * len(groups), {}
    for n in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, more = histogram[n], linear * n + quadratic * n * n
        heap = [(costs[i], i) for i, (room, _, _) in enumerate(groups) if room >= n]
        heapq.heapify(heap)
        while left and heap:
            cost, i = heapq.heappop(heap)
            room, times, held = groups[i]
            if times > left:
                groups.append([room, times - left, dict(held)])
                costs.append(cost)
                groups[i][1] = times = left
            left -= times
            held[n] = held.get(n, 0) + 1
            groups[i][0], costs[i] = room - n, cost + more
            if room - n >= n:
                heapq.heappush(heap, (costs[i], i))
        if left:
            over[n] = left
    return groups, over


def plan(histogram: dict[int, int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 256) -> dict:
    """Where whole pieces go, and the stream of the others with the rooms that it fills.

    ``whole``: per length, rows (first rank, first sequence, offset). ``solid``: per length, pieces placed whole; higher ranks make the stream.
    ``stream``: rows (length, first place in the stream). ``rooms``: rows (place in the stream, first sequence, offset, size), each for consecutive sequences until the next row's place.
    """
    groups, over = balance(histogram, capacity, linear, quadratic)
    whole = placements([(held, times) for _, times, held in groups])
    rooms, first, at = [], 0, 0
    by_room = []
    for room, times, _ in groups:
        if room:
            by_room.append((room, first, times))
        first += times
    for room, begin, times in sorted(by_room, reverse=True):
        rooms.append((at, begin, capacity - room, room))
        at += room * times
    rest = sum(n * c for n, c in over.items()) - at
    for bit in range(capacity.bit_length(), -1, -1):
        if rest >> bit & 1:
            rooms.append((at, first, 0, 1 << bit))
            first, at = first + 1, at + (1 << bit)
    stream, place = [], 0
    for n in sorted(over, reverse=True):
        stream.append((n, place))
        place += n * over[n]
    return {"whole": whole, "solid": {n: histogram[n] - over.get(n, 0) for n in histogram}, "stream": dict(stream), "rooms": np.array(rooms, np.int64).reshape(-1, 4), "end": at}


def pack_balanced(docs: DataFrame, tokenizer: str, capacity: int = 1024, longest: int = 512, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 256, broadcast_rows: int = 500_000) -> DataFrame:
    """Pieces of all documents with the sequence and offset that hold them. The costs' factors are those of the model to train."""
    spark = docs.sparkSession
    pieces = staged(cut_pieces(docs, tokenizer, longest, end_id), "balanced-pieces")
    counts = staged(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "balanced-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `longest` rows
    planned = spark.sparkContext.broadcast(plan(histogram, capacity, linear, quadratic))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    solid = spark.createDataFrame([(n, k) for n, k in planned.value["solid"].items()], "length int, solid long")
    ranked = pieces.drop("ids").join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("slot")).join(F.broadcast(solid), "length")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def put(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths).tolist():
                own, rows = np.flatnonzero(lengths == n), planned.value["whole"][n]
                row = rows[np.searchsorted(rows[:, 0], ranks[own], "right") - 1]
                sequence[own], offset[own] = row[:, 1] + ranks[own] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("length").cast(pa.int64()), batch.column("ids_crc32"), batch.column("doc_tokens"), pa.array(sequence), pa.array(offset)],
                [*columns, "sequence_id", "offset"],
            )

    def cut_again(batches):
        rooms, end = planned.value["rooms"], planned.value["end"]
        edges = np.append(rooms[:, 0], end)
        for batch in batches:
            rows = []
            for key, start, n, tokens, rank, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "place", "ids"))):
                at, raw = rank, np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                while at < rank + n:
                    k = int(np.searchsorted(edges, at, "right")) - 1
                    first, sequence, offset, size = rooms[k].tolist()
                    nth, inside = divmod(at - first, size)
                    take = min(size - inside, rank + n - at)
                    own = raw[4 * (at - rank) : 4 * (at - rank + take)]
                    rows.append((key, start + at - rank, take, zlib.crc32(own), tokens, sequence + nth, offset + inside))
                    at += take
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [*columns, "sequence_id", "offset"])

    placed = ranked.where("rank < solid").select(*columns, "rank").mapInArrow(put, PLACED)
    first = spark.createDataFrame(list(planned.value["stream"].items()), "length int, first long")
    others = ranked.where("rank >= solid").join(F.broadcast(first), "length").select("part", "length", "slot", (F.col("first") + (F.col("rank") - F.col("solid")) * F.col("length")).alias("place"))
    others = staged(others, "balanced-stream")
    others = F.broadcast(others) if others.count() <= broadcast_rows else others
    again = pieces.join(others, ["part", "length", "slot"]).select("doc_id", "start", "length", "doc_tokens", "place", "ids").mapInArrow(cut_again, PLACED)
    return placed.unionAll(again)
