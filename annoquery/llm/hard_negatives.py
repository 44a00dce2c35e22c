"""Hard negatives by a secondary-sort shuffle.

Anchors go in rounds of about ``round_anchors``, which bounds what is broadcast; every round looks at all rows, in batches. A first look
finds each anchor's positives, the best rows of its label, of which a task sends its own best ones only. A second look packs the anchor's
positives and the rows of other labels within their windows into keys (anchor, descending score, id); a task sends its first ``negatives`` of each window,
as none of its later ones can be returned. ``repartitionAndSortWithinPartitions`` deals the keys by anchor and sorts them by all of the key, and one pass over the
sorted stream opens a window at each positive and emits the negatives that follow. The pass holds the open windows and the last score's first negatives, never an anchor's rows.

A window of a positive of score s holds the rows with ``share * s <= score <= s`` (``share`` in hundredths). Negatives of the
positive's own score count wherever their ids stand. A negative score's window is empty.

Edge cases: rows with a null label, id or vector, or a null or non-finite component, take no part. Shorter vectors are filled with zeros; an
empty one has the score 0 with every row. Scores are exact; those beyond a long's range count as its ends. Rows that repeat an id are separate rows: each repeated anchor is mined once per id,
with its smallest (label, vector), and its other rows are those of other ids; a repeated candidate counts as often as it is there. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_KEY = struct.Struct(">QQQ")
_FLIP = 1 << 63  # turns a long into an unsigned number of the same order


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: float = 256.0, relabel_every: int = 7, n_labels: int = 10) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; components are whole numbers, every ``relabel_every``-th id has the next label."""
    x = F.col(vector).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    key = F.col("vec_id").cast("long")
    label = F.when(F.pmod(key, F.lit(relabel_every)) == 0, (F.col("label").cast("long") + 1) % n_labels).otherwise(F.col("label").cast("long"))
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & ~odd)
    return known.select(key.alias("vec_id"), label.alias("label"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _columns(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and a matrix of a batch of ``whole_vectors``; shorter vectors are filled with zeros."""
    vectors = batch.column("v")
    flat, lengths = vectors.flatten().to_numpy(), np.diff(vectors.offsets.to_numpy())
    matrix = np.zeros((len(lengths), int(lengths.max(initial=0))))
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = flat
    return batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as longs: by floating point while no partial sum can pass 2**53, by whole numbers of any size beyond."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dims
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    return np.clip(whole, -MOST, MOST).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by descending score, then id, in order."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, anchor_every: int = 100, share: int = 80, round_anchors: int = 32_768, vector: str = "embedding", scale: float = 256.0, relabel_every: int = 7, n_labels: int = 10) -> DataFrame:
    """For each anchor and positive, the first negatives of its window, with their rank."""
    vectors = staged(whole_vectors(rows, vector, scale, relabel_every, n_labels), "vectors")
    anchors = vectors.where(F.pmod("vec_id", F.lit(anchor_every)) == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("first")).select("vec_id", "first.label", "first.v")
    anchors = staged(anchors, "anchors")
    rounds = max(1, -(-anchors.count() // round_anchors))
    parts = [_round(vectors, anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r), positives, negatives, share) for r in range(rounds)]
    return functools.reduce(DataFrame.unionAll, parts)


def _round(vectors: DataFrame, anchors: DataFrame, positives: int, negatives: int, share: int) -> DataFrame:
    spark = vectors.sparkSession
    table = anchors.toArrow().combine_chunks()  # a round's anchors
    if not table.num_rows:
        return spark.createDataFrame([], FOUND)
    known = spark.sparkContext.broadcast(_columns(table.to_batches()[0]))

    def nearest(batches):
        a_ids, a_labels, a_matrix = known.value
        best = np.full((2, len(a_ids), positives), LEAST, np.int64)  # scores and ids
        for batch in batches:
            ids, labels, matrix = _columns(batch)
            scores, new = _scores(a_matrix, matrix), np.full((2, len(a_ids), positives), LEAST, np.int64)
            for i in range(len(a_ids)):
                own = np.flatnonzero((labels == a_labels[i]) & (ids != a_ids[i]))
                own = own[_best(scores[i, own], ids[own], positives)]
                new[0, i, : len(own)], new[1, i, : len(own)] = scores[i, own], ids[own]
            both = np.concatenate([best, new], axis=2)
            order = np.lexsort((both[1], -np.maximum(both[0], LEAST + 1)), axis=1)[:, :positives]
            best = np.take_along_axis(both, order[None], axis=2)
        there = best[0] > LEAST
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a_ids, there.sum(axis=1))), pa.array(best[0][there]), pa.array(best[1][there])], ["anchor_id", "score", "id"])

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    ranked = vectors.mapInArrow(nearest, "anchor_id long, score long, id long").withColumn("n", F.row_number().over(order))
    top = staged(ranked.where(F.col("n") <= positives).drop("n"), "positives")
    opened: dict[int, set[int]] = {}
    for anchor, score in zip(*(top.select("anchor_id", "score").distinct().toArrow().column(i).to_pylist() for i in range(2))):  # `positives` for each anchor of the round
        if score >= 0:
            opened.setdefault(anchor, set()).add(score)
    windows = spark.sparkContext.broadcast(opened)

    def keys(batches):
        a_ids, a_labels, a_matrix = known.value
        found: dict[tuple[int, int], list] = {}
        for number, batch in enumerate(batches):
            ids, labels, matrix = _columns(batch)
            scores = _scores(a_matrix, matrix)
            for i, anchor in enumerate(a_ids.tolist()):
                if anchor not in windows.value:
                    continue
                others = np.flatnonzero(labels != a_labels[i])
                own = scores[i, others]
                for s in windows.value[anchor]:
                    inside = others[(own >= -(-share * s // 100)) & (own <= s)]
                    if len(inside):
                        first = inside[_best(scores[i, inside], ids[inside], negatives)]
                        rows = [(-int(scores[i, b]), int(ids[b]), number, int(b)) for b in first]
                        found[i, s] = sorted(found.get((i, s), []) + rows)[:negatives]
        # windows of one anchor overlap: a row is sent once
        sent = {(int(a_ids[i]), *row) for (i, _), rows in found.items() for row in rows}
        yield pa.RecordBatch.from_arrays([pa.array([_packed(a, -down, n) for a, down, n, _, _ in sent], pa.binary())], ["key"])

    stream = vectors.mapInArrow(keys, "key binary").rdd.map(lambda r: (bytes(r["key"]), 0))
    stream = stream.union(top.rdd.map(lambda r: (_packed(r["anchor_id"], r["score"], r["id"]), 1)))
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stream.repartitionAndSortWithinPartitions(n_parts, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(dealt.mapPartitions(lambda part: emitted(part, negatives, share)), FOUND)


def _packed(anchor: int, score: int, key: int) -> bytes:
    return _KEY.pack(anchor + _FLIP, _FLIP - 1 - score, key + _FLIP)


def emitted(stream, negatives: int, share: int):
    """Rows from a stream of sorted (key, 1 for a positive and 0 for a negative)."""
    anchor, windows, level, tied = None, [], None, []
    for key, positive in stream:
        a, down, n = _KEY.unpack(key)
        a, score, n = a - _FLIP, _FLIP - 1 - down, n - _FLIP
        if a != anchor:
            anchor, windows, level = a, [], None
        if score != level:
            level, tied = score, []
        if positive:
            if score >= 0:  # those of its own score with smaller ids have passed
                yield from ((a, n, i, other, score, score) for i, other in enumerate(tied, 1))
                windows.append([n, score, len(tied)])
            continue
        if len(tied) < negatives:
            tied.append(n)
        windows = [w for w in windows if w[2] < negatives and share * w[1] <= 100 * score]
        for w in windows:
            w[2] += 1
            yield a, w[0], w[2], n, w[1], score
