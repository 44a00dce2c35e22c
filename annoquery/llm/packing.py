"""Best-fit packing of token pieces into fixed-length sequences.

The lengths' histogram (at most ``capacity`` numbers, whatever the corpus) defines a configuration linear
program: how often to use each multiset of lengths that fits a sequence, so that every length is covered.
Multiplicative weights solve it: in each round a length's price falls with its covered share, one knapsack dynamic program prices
configurations, and the best one through each open length is used as far as its scarcest length allows. No length is covered beyond its
need, so the solution is feasible. Tokens / ``capacity`` is the dual bound that it is held against. The fractional solution is rounded by running sums, which keep
the total; what rounding leaves goes through the same program in whole steps, and the last few pieces through best fit decreasing.
Where best fit decreasing alone needs fewer sequences, its plan is taken, so the result is never worse than it.
The plan (a table of length, rank range, sequence range and offset) then places every piece by its rank among pieces of its length;
ranks come from per-task counts, so no length is gathered in one task.

Empty cases: a null or empty text is the end id alone; an empty table gives no rows. Repeated rows are packed each. A null ``doc_id`` is packed like others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import encoder, in_groups, staged, task

PIECES = "part int, slot long, doc_id long, piece int, start long, length int, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece; ``slot`` is its rank among the pieces of the same length made by the same task."""

    @task
    def cut(batches):
        from_file, part, made = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_groups(texts):
                rows = []
                for key, ids in zip(keys[a:b], from_file.encode(texts[a:b])):
                    raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        n = len(own) // 4
                        rows.append((part, int(made[n]), key, piece, at // 4, n, zlib.crc32(own)))
                        made[n] += 1
                names = ("part", "slot", "doc_id", "piece", "start", "length", "ids_crc32")
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _price(values: np.ndarray, lengths: np.ndarray, capacity: int, draw: np.random.Generator, slack: float = 1e-3) -> np.ndarray:
    """Knapsack by dynamic programming over the capacity: for every room, a length that starts a filling of most value, or -1.

    Of the lengths whose filling is within ``slack`` of the best, one is drawn, so that rooms spread over many configurations.
    """
    best, choice, drawn = np.zeros(capacity + 1), np.full(capacity + 1, -1), draw.random(capacity + 1)
    for room in range(int(lengths[0]), capacity + 1):
        fit = int(np.searchsorted(lengths, room, "right"))
        worth = best[room - lengths[:fit]] + values[:fit]
        good = np.flatnonzero(worth >= worth.max() * (1 - slack))
        i = int(good[int(drawn[room] * len(good))])
        best[room], choice[room] = worth[i], i
    return choice


def solve_configurations(histogram: dict[int, float], capacity: int = 2048, whole: bool = False, eta: float = 2.0, rest: float = 0.005, least: float = 0.02) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often to use each; no length is covered beyond its need.

    Ends when all but a share ``rest`` of the pieces is covered. ``whole`` allows whole numbers only, and ends when a round
    places less than a share ``least`` of the pieces that are left.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c), np.int64)
    if not len(lengths):
        return []
    need = np.array([histogram[int(n)] for n in lengths], float)
    left, used, draw = need.copy(), [], np.random.default_rng(3)
    while True:
        open_ = np.flatnonzero(left >= 1 if whole else left > need * 1e-6)
        if not len(open_) or left.sum() <= (0 if whole else rest * need.sum()):
            return used
        sizes = lengths[open_]
        choice = _price(sizes / capacity * np.exp(-eta * (1 - left[open_] / need[open_])), sizes, capacity, draw)
        before = left.sum()
        for first in range(len(sizes) - 1, -1, -1):
            places, room = {int(open_[first]): 1}, capacity - int(sizes[first])
            while choice[room] >= 0:
                i = int(open_[choice[room]])
                places[i] = places.get(i, 0) + 1
                room -= int(lengths[i])
            times = min(left[i] / k for i, k in places.items())
            times = int(times) if whole else times
            if times > 0:
                for i, k in places.items():
                    left[i] -= k * times
                used.append(({int(lengths[i]): k for i, k in places.items()}, times))
        if whole and before - left.sum() < least * before:
            return used


def best_fit_decreasing(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on counts: groups of equal bins take a length together, tightest room first."""
    groups: list[list] = []  # room, bins, contents
    for n in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        left = histogram[n]
        for group in sorted((g for g in groups if g[0] >= n), key=lambda g: g[0]):
            if not left:
                break
            room, bins, contents = group
            k = room // n
            whole = min(bins, left // k)
            over = left - whole * k if whole < bins else 0
            left -= whole * k + over
            parts = [[room - k * n, whole, contents | {n: k}]] if whole else []
            if over:
                parts.append([room - over * n, 1, contents | {n: over}])
            if bins - whole - bool(over):
                parts.append([room, bins - whole - bool(over), contents])
            group[:] = parts[0]
            groups += parts[1:]
        if left:
            k = capacity // n
            if left // k:
                groups.append([capacity - k * n, left // k, {n: k}])
            if left % k:
                groups.append([capacity - left % k * n, 1, {n: left % k}])
    return [(contents, bins) for _, bins, contents in groups]


def plan_sequences(histogram: dict[int, int], capacity: int = 2048) -> tuple[list[tuple[dict[int, int], int]], dict]:
    """Whole configuration counts that hold every piece exactly once, and figures of the solution.

    Figures: ``bound`` (sequences that any packing needs), ``fractional`` (the program's value), ``sequences``, and ``by_program``, the share of
    pieces that configurations of the program hold.
    """
    left, out, total, value = dict(histogram), [], 0, 0.0
    solved = solve_configurations(histogram, capacity)
    for configuration, times in solved:
        value += times
        wanted = int(value + 1e-9) - total
        total += wanted
        wanted = int(min(wanted, *(left[n] // k for n, k in configuration.items())))
        if wanted:
            out.append((configuration, wanted))
            for n, k in configuration.items():
                left[n] -= k * wanted
    for configuration, times in solve_configurations(left, capacity, whole=True):
        out.append((configuration, times))
        for n, k in configuration.items():
            left[n] -= k * times
    pieces = sum(histogram.values())
    figures = {"bound": -(-sum(n * c for n, c in histogram.items()) // capacity), "fractional": value, "by_program": 1 - sum(left.values()) / max(1, pieces)}
    out += best_fit_decreasing(left, capacity)
    plain = best_fit_decreasing(histogram, capacity)
    if sum(times for _, times in plain) < sum(times for _, times in out):  # rounding can lose more than the program gains
        out, figures["by_program"] = plain, 0.0
    return out, figures | {"sequences": sum(times for _, times in out)}


def placements(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, offset), by rank; a row's ranks go to consecutive sequences."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for contents, times in plan:
        offset = 0
        for n in sorted(contents, reverse=True):
            for _ in range(contents[n]):
                first = rank.get(n, 0)
                rows.setdefault(n, []).append((first, sequence, offset))
                rank[n] = first + times
                offset += n
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with the sequence and offset that hold them."""
    return place(staged(cut_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Sequence and offset of every piece of ``cut_pieces``. The driver holds only the histogram and its plan."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = pieces.sparkSession.sparkContext.broadcast(placements(plan_sequences(histogram, capacity)[0]))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("slot"))

    def assign(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths).tolist():
                own, rows = np.flatnonzero(lengths == n), plan.value[n]
                row = rows[np.searchsorted(rows[:, 0], ranks[own], "right") - 1]
                sequence[own], offset[own] = row[:, 1] + ranks[own] - row[:, 0], row[:, 2]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays(
                [*kept, batch.column("length").cast(pa.int64()), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(assign, PLACED)
