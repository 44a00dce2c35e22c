"""Quality classifier on random-indexing word vectors.

Every word (hashed to ``WORDS`` rows) has a sparse random index vector. Its context vector is the sum of the index vectors of its
neighbours over *all* texts, counted per task and summed by blocks of rows. A document is the mean of its words'
vectors, together with the spread, which goes through a two-layer network trained in numpy on a bounded
sample of labelled training rows; a temperature fitted on a part of them calibrates the probabilities.

Rows whose crc32(doc_id) modulo 5 is 0 are held out: their labels are never used. Null and empty texts are scored like any other
(a zero vector). An empty table gives no rows; repeated rows get the same score; without labels every score is 0.5.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hashed_words, in_groups, staged, task

BITS, DIMS, BLOCKS = 14, 48, 32
WORDS = 1 << BITS


def _rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of all words of texts, and each text's first place; marks at a word's end choose another row, so they count."""
    hashes, edges = hashed_words(texts, plain=False)
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), edges


def _index_vectors() -> np.ndarray:
    """Sparse ternary index vectors: four ones of either sign in each row."""
    draw = np.random.default_rng(11)
    out = np.zeros((WORDS, DIMS), np.float32)
    for row in out:
        row[draw.choice(DIMS, 4, replace=False)] = draw.choice([-1.0, 1.0], 4)
    return out


def word_vectors(docs: DataFrame, reach: int = 2) -> np.ndarray:
    """Unit-length context vectors from all texts."""
    index = docs.sparkSession.sparkContext.broadcast(_index_vectors())

    @task
    def count(batches):
        total = np.zeros((WORDS, DIMS), np.float64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in in_groups(texts):
                flat, edges = _rows(texts[a:b])
                text = np.repeat(np.arange(b - a), np.diff(edges))
                for step in range(1, reach + 1):
                    if len(flat) <= step:
                        continue
                    near = text[step:] == text[:-step]
                    left, right = flat[:-step][near], flat[step:][near]
                    pair, times = np.unique(np.concatenate([left * WORDS + right, right * WORDS + left]), return_counts=True)
                    word = pair // WORDS
                    first = np.flatnonzero(np.diff(word, prepend=-1))
                    if len(pair):
                        total[word[first]] += np.add.reduceat(index.value[pair % WORDS] * times[:, None].astype(np.float32), first, axis=0)
        size = WORDS // BLOCKS
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([total[i * size : (i + 1) * size].astype(np.float32).tobytes() for i in range(BLOCKS)], pa.binary())], ["block", "sums"]
        )

    def add(key, table):
        size = WORDS // BLOCKS
        total = np.zeros((size, DIMS), np.float64)
        for sums in table.column("sums"):
            total += np.frombuffer(sums.as_py(), np.float32).reshape(size, DIMS)
        keys = {c: pa.array([k.as_py()], pa.int32()) for c, k in zip(("block", "part"), key)}
        return pa.table({**keys, "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    # sums of sums, 64 at a time, so that no task ever gets more than 64 of them however many tasks counted
    parts = staged(docs.select("text").mapInArrow(count, "block int, sums binary").withColumn("part", F.spark_partition_id()), "sums")
    most = parts.agg(F.max("part")).first()[0] or 0
    while most >= 64:
        grouped = parts.withColumn("part", F.floor(F.col("part") / 64).cast("int")).groupBy("block", "part")
        parts, most = staged(grouped.applyInArrow(add, "block int, part int, sums binary"), "sums"), most // 64
    rows = parts.withColumn("part", F.lit(0)).groupBy("block", "part").applyInArrow(add, "block int, part int, sums binary").collect()  # BLOCKS rows of fixed size
    out = np.zeros((WORDS, DIMS), np.float32)
    size = WORDS // BLOCKS
    for row in rows:
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["sums"], np.float32).reshape(size, DIMS)
    out -= out.sum(axis=0) * (np.abs(out).sum(axis=1, keepdims=True) / max(1e-9, np.abs(out).sum()))  # without what all words share
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Per text: mean and spread of its words' vectors, and how much neighbouring words' vectors agree."""
    out = np.zeros((len(texts), 2 * DIMS + 2), np.float32)
    flat, edges = _rows(texts)
    for i in range(len(texts)):
        rows = flat[edges[i] : edges[i + 1]]
        if len(rows):
            total, squares = np.zeros(DIMS), np.zeros(DIMS)
            agree = 0.0
            for at in range(0, len(rows), 1 << 16):
                own = vectors[rows[at : at + (1 << 16)]]
                total += own.sum(axis=0)
                squares += (own * own).sum(axis=0)
                agree += float((own[1:] * own[:-1]).sum())
            mean = total / len(rows)
            out[i, :DIMS] = mean
            out[i, DIMS : 2 * DIMS] = np.sqrt(np.maximum(squares / len(rows) - mean**2, 0))
            out[i, 2 * DIMS] = agree / len(rows)
            out[i, 2 * DIMS + 1] = np.log1p(len(rows)) / 10
    return out


class Network:
    """Two layers with a tanh between; logistic loss, Adam, temperature on held-back training rows."""

    def __init__(self, hidden: int = 32, seed: int = 5):
        self.hidden, self.seed, self.temperature = hidden, seed, 1.0
        self.weights = None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3) -> "Network":
        draw = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        n = x.shape[1]
        self.weights = [draw.standard_normal((n, self.hidden)) / np.sqrt(n), np.zeros(self.hidden), draw.standard_normal(self.hidden) / np.sqrt(self.hidden), np.zeros(1)]
        order = draw.permutation(len(x))
        back, train = order[: len(x) // 6], order[len(x) // 6 :]
        m, v, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(epochs):
            draw.shuffle(train)
            for at in range(0, len(train), 256):
                own = train[at : at + 256]
                h = np.tanh(x[own] @ self.weights[0] + self.weights[1])
                error = (1 / (1 + np.exp(-(h @ self.weights[2] + self.weights[3]))) - y[own]) / len(own)
                inner = np.outer(error, self.weights[2]) * (1 - h * h)
                grads = [x[own].T @ inner + 1e-4 * self.weights[0], inner.sum(axis=0), h.T @ error + 1e-4 * self.weights[2], np.array([error.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.weights[i] = self.weights[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(back):
            z = np.tanh(x[back] @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]
            grid = np.exp(np.linspace(-1.5, 2, 71))
            losses = [np.mean(np.logaddexp(0, z / k) - y[back] * z / k) for k in grid]
            self.temperature = float(grid[int(np.argmin(losses))])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        z = np.tanh((x - self.mean) / self.scale @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most_rows: int = 20_000) -> Network:
    """Train on at most about ``most_rows`` labelled rows that are not held out, chosen by a hash of their id."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, most_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @task
    def features(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x = np.concatenate([np.zeros((0, 2 * DIMS + 2), np.float32), *(pooled(texts[a:b], shared.value) for a, b in in_groups(texts))])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), batch.column(1)], ["x", "quality"])

    few = F.broadcast(chosen)  # at most about `most_rows` pairs of numbers
    rows = docs.select("doc_id", "text").join(few, "doc_id").select("text", F.col("quality").cast("int")).mapInArrow(features, "x array<float>, quality int")
    table = staged(rows, "training").toArrow()  # about `most_rows` rows of fixed width
    y = np.asarray(table.column("quality").to_pylist(), float)
    if len(set(y.tolist())) < 2:
        return Network()
    return Network().fit(np.stack(table.column("x").to_numpy()).astype(np.float64), y)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = word_vectors(docs)
    network = fit(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), vectors, most_rows)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    @task
    def work(batches):
        vectors, network = shared.value
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_groups(texts):
                scores = network.score(pooled(texts[a:b], vectors).astype(np.float64))
                out = [None if k is None else zlib.crc32(str(k).encode()) % 5 == 0 for k in keys[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(out, pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
