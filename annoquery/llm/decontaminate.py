"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of ``width`` words, half overlapping. Their TF-IDF vectors (words hashed to ``FEATURES`` places, document
frequencies over all documents) are projected on the leading singular vectors of the matrix of all passages of all documents and the
benchmark, found by a distributed randomised SVD in one pass; the matrix has a column for every word of the benchmark's block and for the commonest
others up to ``vocabulary``. Every passage of every document is then compared with every benchmark passage by cosine in that space.

A leak is near verbatim if the longest common subsequence of the item and the words around a passage reaches ``lcs`` of the item. It is a
paraphrase if the subsequence reaches ``paraphrase``, the item's answer (its last sentence) is there, and the passage was
retrieved: its cosine with the item reaches ``cosine``, or for an item shorter than a passage, in which it is diluted, that times the root
of its share of the width. Only passages are verified near which one of the item's anchors stands: its rarest words, as many as a leak may
lack and one more (*prefix filter*). Each leak has one, so this loses none; near-verbatim leaks are found whatever their cosine.

Items of one word and more are searched for; short ones have a leak where the share of their words reaches the same thresholds, so
up to four words must all be there in order. Null and empty texts match nothing; an empty table gives no rows; repeated rows each
give theirs; a document without ``doc_id`` gives rows with a null ``doc_id``. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hashed_words, in_groups, plain_words, release, settings, staged, task

BITS = 18
FEATURES = 1 << BITS
FEW = {"parquet.block.row.count.limit": "16"}  # groups of texts (about 160 KB each) in a row group, and so in a batch of Spark's reader
GROUPS_AT_ONCE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}
LEAKS = "doc_id long, item_id long, cosine double, lcs double, answer double"


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _hashes(text: str | None) -> np.ndarray:
    return hashed_words([text], plain=True)[0]


def _starts(n: int, width: int) -> np.ndarray:
    """First words of the passages of a text of n words; together they cover it."""
    return np.arange(0, max(1, n - width // 2), width // 2) if n else np.zeros(0, np.int64)


def hashed_features(docs: DataFrame) -> DataFrame:
    """Features of all words of all documents and the words of each, staged: a row for each group of texts, which are hashed once for all passes."""

    @task
    def make(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in in_groups(texts, 1 << 18):
                hashes, edges = hashed_words(texts[a:b], plain=True)
                row = _features(hashes).astype(np.int32), np.diff(edges).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], ["features", "sizes"])

    return staged(docs.select("text").mapInArrow(make, "features binary, sizes binary"), "features", **FEW)


def _groups(batches):
    """(features, sizes) of the rows of ``hashed_features``."""
    for batch in batches:
        for own, sizes in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(own.as_buffer(), np.int32), np.frombuffer(sizes.as_buffer(), np.int32)


def document_frequencies(features: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and the number of documents; over all documents."""

    @task
    def count(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for own, sizes in _groups(batches):
            once = np.unique(np.repeat(np.arange(len(sizes)), sizes) * FEATURES + own)
            np.add.at(total, once % FEATURES, 1)
            n += len(sizes)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": np.append(some, -1), "n": np.append(total[some], n)})

    with settings(features.sparkSession, GROUPS_AT_ONCE):
        rows = features.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # FEATURES + 1 rows at most
    feature, n = rows.column("feature").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(FEATURES)
    out[feature[feature >= 0]] = n[feature >= 0]
    return out, int(n[feature < 0].sum())


class Gram:
    """Sum of A'A times a basis (column of the matrix, column of the basis), where A has a TF-IDF row of unit length for each passage of the texts added.

    Passages are two halves that follow each other, so what a half adds is looked up once for both of its passages.
    """

    def __init__(self, basis: np.ndarray, idf: np.ndarray, column: np.ndarray, half: int):
        self.idf, self.column, self.half = idf.astype(np.float32), column, half
        self.weighted = (basis * idf[:, None]).astype(np.float32)
        self.total, self.n = np.zeros(basis.shape), 0

    def add(self, features: np.ndarray, sizes: np.ndarray, step: int = 4096) -> None:
        """Texts, as the features of all their words and the number of words of each."""
        n_halves = -(-sizes.astype(np.int64) // self.half)
        base, edges = np.cumsum(n_halves) - n_halves, np.cumsum(sizes) - sizes  # first half and first word of each text
        columns = np.full(int(n_halves.sum()) * self.half, len(self.idf) - 1, np.int32)
        columns[np.arange(len(features)) + np.repeat(base * self.half - edges, sizes)] = self.column[features]
        columns, text = columns.reshape(-1, self.half), np.repeat(np.arange(len(sizes)), n_halves)
        follows = np.append(text[1:] == text[:-1], False)[: len(text)]
        passage = follows | (n_halves == 1)[text]  # the halves that start one
        for lo in range(0, len(columns), step):
            hi = min(lo + step, len(columns))
            last = min(hi + 1, len(columns))  # a passage that starts here may end in the next step
            self._add(columns[lo:last], follows[lo:hi], passage[lo:hi])

    def _add(self, columns: np.ndarray, follows: np.ndarray, passage: np.ndarray) -> None:
        n = len(passage)
        first, second = np.arange(n), np.where(follows, np.minimum(np.arange(n) + 1, len(columns) - 1), len(columns))
        halves, buffer = np.zeros((len(columns) + 1, self.weighted.shape[1]), np.float32), np.empty((len(columns), self.weighted.shape[1]), np.float32)
        for j in range(self.half):
            halves[:-1] += np.take(self.weighted, columns[:, j], axis=0, out=buffer, mode="clip")
        vectors = halves[:n] + halves[second]
        vectors *= (passage / np.maximum(self._squares(columns, follows), 1e-12))[:, None].astype(np.float32)
        halves[:] = 0  # from here on what a half's passages add to each of its words
        halves[first] += vectors
        halves[1 : n + 1][follows] += vectors[follows]
        self._scatter(columns, halves)
        self.n += int(passage.sum())

    def _squares(self, columns: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Squared lengths of the passages before they are scaled: each word's weight times the weights of all its places."""
        n, places = len(follows), np.ascontiguousarray(columns.T)
        weight = self.idf[places] ** 2
        own, across = np.zeros(len(columns), np.float32), np.zeros(n, np.float32)
        after = np.full((self.half, n), -1, places.dtype)
        after[:, : len(columns) - 1] = places[:, 1 : n + 1]
        for place, w in zip(places, weight):
            own += w * np.add.reduce(places == place, axis=0, dtype=np.uint8)
            across += w[:n] * np.add.reduce(after == place[:n], axis=0, dtype=np.uint8)
        out = own[:n].copy()
        some = np.flatnonzero(follows)
        out[some] += own[some + 1] + 2 * across[some]
        return out

    def _scatter(self, columns: np.ndarray, halves: np.ndarray) -> None:
        """Add each half's row to all its columns: rows of a column are added in pairs until one is left."""
        flat = columns.ravel().astype(np.uint16 if len(self.idf) <= 1 << 16 else np.uint32)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        order = order[: np.searchsorted(flat, len(self.idf) - 1)]  # less words without a column
        column, n = np.unique(flat[: len(order)], return_counts=True)
        rows, source = order // self.half, halves  # the last row of halves is zero
        while len(column):
            left = _spread_by(np.cumsum(n) - n, (n + 1) // 2, 2)
            alone = left + 1 == np.repeat(np.cumsum(n), (n + 1) // 2)
            right = np.minimum(left + 1, len(rows) - 1)
            summed = source[rows[left]]
            summed += source[np.where(alone, len(source) - 1, rows[right])]
            n = (n + 1) // 2
            ends, one = np.cumsum(n), n == 1
            self.total[column[one]] += summed[ends[one] - 1]
            rows = np.flatnonzero(np.repeat(~one, n))
            source, column, n = np.concatenate([summed, np.zeros_like(summed[:1])]), column[~one], n[~one]

    def result(self) -> np.ndarray:
        return self.total * self.idf[:, None]


def _spread_by(first: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """``n`` numbers from each first one on, ``step`` apart, one range after the other."""
    return np.repeat(first - step * (np.cumsum(n) - n), n) + step * np.arange(int(n.sum()))


def vocabulary_of(df: np.ndarray, item_features: np.ndarray, most: int) -> np.ndarray:
    """Column of each feature: all those of items, and the commonest others up to ``most``; the rest share one column of no weight."""
    kept, own = np.zeros(FEATURES), np.unique(item_features)
    kept[own] = df.max(initial=0) + 1
    chosen = np.argsort(-(kept + df), kind="stable")[: min(max(most, len(own)), FEATURES - 1)]
    chosen = np.sort(chosen[(kept + df)[chosen] > 0])
    column = np.full(FEATURES, len(chosen), np.int32)
    column[chosen] = np.arange(len(chosen), dtype=np.int32)
    return column


def latent_basis(features: DataFrame, items: list, column: np.ndarray, idf: np.ndarray, df: np.ndarray, rank: int, width: int, fit_passages: int, item_weight: float = 100.0) -> np.ndarray:
    """Leading right singular vectors (column, rank) of all passages of all documents and of the benchmark; ``idf`` and ``df`` are by column, 0 at the end.

    Documents take part in one pass (a Nystroem approximation). Its start are the leading vectors of the benchmark's matrix with the document frequencies on
    the diagonal in the documents' place. All passages of documents together weigh as ``fit_passages`` of them, at most their number; those of the benchmark
    weigh ``item_weight`` times as much each, as they are what must be told apart.
    """
    spark, half = features.sparkSession, width // 2
    own = np.concatenate(items).astype(np.int32), np.array(list(map(len, items)), np.int32)

    def of_items(basis: np.ndarray) -> np.ndarray:
        gram = Gram(basis, idf, column, half)
        gram.add(*own)
        return item_weight * gram.result()

    expected = (df * idf**2 * (fit_passages / max(1e-9, (df * idf**2).sum())))[:, None]
    basis = np.random.default_rng(7).standard_normal((len(idf), rank + 16))
    for _ in range(3):
        basis = np.linalg.qr(of_items(basis) + expected * basis)[0]

    shared = spark.sparkContext.broadcast((basis.astype(np.float32), idf, column))
    rows = 1024

    @task
    def part(batches):
        gram = Gram(*shared.value, half)
        for group in _groups(batches):
            gram.add(*group)
        out = gram.result().astype(np.float32)
        for block in range(0, len(out), rows):
            yield pa.RecordBatch.from_pydict({"block": [block], "n": [gram.n], "z": pa.array([out[block : block + rows].tobytes()], pa.binary())})

    def summed(batches):
        totals: dict[int, list] = {}  # blocks of the matrix
        for batch in batches:
            for block, n, z in zip(*(c.to_pylist() for c in batch.columns)):
                known = totals.setdefault(block, [0, 0.0])
                known[0] += n
                known[1] = known[1] + np.frombuffer(z, np.float32).astype(float)
        for block, (n, z) in totals.items():
            yield pa.RecordBatch.from_pydict({"block": [block], "n": [n], "z": pa.array([z.tobytes()], pa.binary())})

    kind = "block long, n long, z binary"
    parts = features.coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(part, kind)  # a matrix of fixed size for each of a bounded number of tasks
    of_docs, n_passages = np.zeros(basis.shape), 0
    with settings(spark, GROUPS_AT_ONCE):
        blocks = parts.repartition(8, "block").mapInArrow(summed, kind).collect()  # the matrix once
    for r in blocks:
        z = np.frombuffer(r["z"]).reshape(-1, basis.shape[1])
        of_docs[r["block"] : r["block"] + len(z)], n_passages = z, r["n"]
    shared.destroy()
    product = of_items(basis) + min(1.0, fit_passages / max(1, n_passages)) * of_docs
    small = basis.T @ product
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    some = values > 1e-9 * values[-1]
    root = product @ (vectors[:, some] / np.sqrt(values[some]))  # its product with its transpose is the approximation
    return np.linalg.svd(root, full_matrices=False)[0][:, :rank].astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & ((1 << len(a)) - 1)
    return len(a) - row.bit_count()


def _answer(text: str) -> np.ndarray:
    """Word hashes of the last sentence that has any."""
    for sentence in reversed(re.split(r"[.!?\n]+", text)):
        if plain_words(sentence):
            return _hashes(sentence)
    return np.zeros(0, np.uint64)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rank: int = 128, width: int = 32, cosine: float = 0.3, lcs: float = 0.8, paraphrase: float = 0.55, answer: float = 0.8, vocabulary: int = 1 << 13, fit_passages: int = 20_000, item_block: int = 20_000
) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer: documents that hold a benchmark item, word for word or nearly so.

    Items are searched for in blocks of ``item_block`` (about 20 MB), each with a basis of its own and in one scan, so what a task holds does not
    grow with the benchmark.
    """
    spark = docs.sparkSession
    features = hashed_features(docs)
    df, n_docs = document_frequencies(features)
    idf = (np.log((n_docs + 1) / (df + 1)) + 0.1) ** 1.5  # more weight to rare words, whose passages are to be told apart
    first, out = None, None
    while True:
        block = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
        block = block if first is None else block.where(F.col("item_id") > first)
        last = block.select("item_id").orderBy("item_id").limit(item_block).agg(F.max("item_id")).first()[0]
        if last is None:
            break
        rows, first = block.where(F.col("item_id") <= last).distinct().orderBy("item_id").collect(), last  # a block
        items = [(r["item_id"], _hashes(r["text"]), _answer(r["text"])) for r in rows]
        items = [x for x in items if len(x[1])]
        if not items:
            continue
        words = [_features(w) for _, w, _ in items]
        column = vocabulary_of(df, np.concatenate(words), vocabulary)
        weight, known = np.zeros(column.max() + 1), np.zeros(column.max() + 1)
        weight[column], known[column] = idf, df
        weight[-1] = known[-1] = 0.0
        basis = latent_basis(features, words, column, weight, known, rank, width, fit_passages)
        weighted = basis * weight[:, None].astype(np.float32)
        search = Search(items, df, column, weighted, width, cosine, lcs, paraphrase, answer)
        shared = spark.sparkContext.broadcast(search)
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_searching(shared), LEAKS)
        out = found if out is None else out.union(found)
    release(features)
    return out if out is not None else spark.createDataFrame([], LEAKS)


def _searching(shared):
    @task
    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_groups(texts, 1 << 18):
                found = shared.value.leaks(texts[a:b])
                if found:
                    rows = [(keys[a + d], *rest) for d, *rest in found]
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "cosine", "lcs", "answer"])

    return run


def _lacking(share: float, n: int) -> int:
    """How many of n a match with at least this share may lack."""
    return int((1 - share) * n + 1e-9)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of ranges, one range after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Search:
    """A block of items, ready to be searched for in texts."""

    def __init__(self, items: list, df: np.ndarray, column: np.ndarray, weighted: np.ndarray, width: int, cosine: float, lcs: float, paraphrase: float, answer: float):
        self.items, self.column, self.weighted = items, column, weighted
        self.width, self.half, self.lcs, self.paraphrase, self.answer = width, width // 2, lcs, paraphrase, answer
        cut = [(i, column[_features(w)[a : a + width]]) for i, (_, w, _) in enumerate(items) for a in _starts(len(w), width)]
        own = np.stack([weighted[p].sum(axis=0) for _, p in cut])
        self.passages = np.ascontiguousarray((own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)).T)
        self.item_of = np.array([i for i, _ in cut])
        self.parts = np.searchsorted(self.item_of, np.arange(len(items) + 1))
        self.most_parts = int(np.diff(self.parts).max())
        self.sizes = np.array([len(w) for _, w, _ in items], np.int64)
        self.least = cosine * np.sqrt(np.minimum(1.0, self.sizes / width))  # a short item is diluted in a passage
        self._anchor(df)
        # distinct words of items and answers, sorted by (item, word), and how many of them a leak holds
        distinct, ending = [np.unique(w) for _, w, _ in items], [np.unique(w) for _, _, w in items]
        self.known = np.unique(np.concatenate([w for _, w, _ in items]))
        number = lambda sets: [np.searchsorted(self.known, w) for w in sets]
        self.word_of, self.n_words = np.concatenate(number(distinct)), np.array(list(map(len, distinct)))
        self.end_of, self.n_ends = np.concatenate(number(ending)), np.array(list(map(len, ending)))
        self.strict = np.maximum(1, self.n_words - [_lacking(lcs, n) for n in self.sizes])
        self.loose = np.maximum(1, self.n_words - [_lacking(paraphrase, n) for n in self.sizes])
        self.ends = self.n_ends - [_lacking(answer, n) for n in self.n_ends]

    def _anchor(self, df: np.ndarray) -> None:
        """Words of which each leak of an item has at least one: sorted hashes, where the items of each start, these items, and which
        of them near-verbatim leaks need."""
        pairs: dict[tuple[int, int], bool] = {}
        for i, (_, words, last) in enumerate(self.items):
            by_rarity = lambda w: sorted(set(w.tolist()), key=lambda h: (df[h >> (64 - BITS)], h))
            rarest, ending = by_rarity(words), by_rarity(last)
            loose = rarest[: _lacking(self.paraphrase, len(words)) + 1], ending[: _lacking(self.answer, len(ending)) + 1]
            pairs |= {(h, i): False for h in min(loose, key=lambda chosen: sum(df[h >> (64 - BITS)] for h in chosen))}
            pairs |= {(h, i): True for h in rarest[: _lacking(self.lcs, len(words)) + 1]}
        ordered = sorted(pairs)
        self.anchors, first = np.unique(np.array([h for h, _ in ordered], np.uint64), return_index=True)
        self.anchor_first, self.anchor_item = np.append(first, len(ordered)), np.array([i for _, i in ordered], np.int64)
        self.anchor_near = np.array([pairs[x] for x in ordered], bool)
        self.marks = np.zeros(1 << 16, bool)
        self.marks[self.anchors & np.uint64(0xFFFF)] = True

    def leaks(self, texts: list) -> list[tuple]:
        """(text, item_id, cosine, lcs, answer) of texts given by their places."""
        hashes, edges = hashed_words(texts, plain=True)
        size = np.diff(edges)
        n_halves = -(-size // self.half)
        base = np.cumsum(n_halves) - n_halves  # first half of each text; texts start at a half
        at = np.arange(len(hashes)) + np.repeat(base * self.half - edges[:-1], size)
        columns = np.full(int(n_halves.sum()) * self.half, self.weighted.shape[0] - 1, np.int32)
        columns[at] = self.column[_features(hashes)]
        doc = np.repeat(np.arange(len(texts)), n_halves)
        anchored = self._anchored(hashes, at, doc, base, n_halves)
        best: dict[tuple[int, int], tuple] = {}
        for lo in range(0, len(doc), 2048):
            hi = min(lo + 2048, len(doc))
            near = self._cosines(columns, doc, lo, hi)
            n = len(self.items)
            own = slice(*np.searchsorted(anchored[0], [lo * n, hi * n]))
            (row, item), needed = np.divmod(anchored[0][own], n), anchored[1][own]
            cosines = np.full(len(row), -1.0, np.float32)
            for k in range(self.most_parts):  # an item's passages, the last one again for those with fewer
                cosines = np.maximum(cosines, near[row - lo, np.minimum(self.parts[item] + k, self.parts[item + 1] - 1)])
            similar = cosines >= self.least[item]
            some = needed | similar
            row, item, cosines, similar = row[some], item[some], cosines[some], similar[some]
            text = doc[row]
            start = (row - base[text]) * self.half
            left = edges[:-1][text] + np.maximum(0, start - self.sizes[item])
            right = edges[:-1][text] + np.minimum(size[text], start + self.width + self.sizes[item])
            for j in self._promising(hashes, left, right, item, similar).tolist():
                key = int(text[j]), int(item[j])
                if score := self._verify(hashes[left[j] : right[j]].tolist(), key[1], bool(similar[j])):
                    share, known, most = best.get(key, (0.0, 0.0, -1.0))
                    best[key] = (*max((share, known), score), max(most, float(cosines[j])))
        return [(d, self.items[i][0], c, s, k) for (d, i), (s, k, c) in sorted(best.items())]

    def _cosines(self, columns: np.ndarray, doc: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Cosines of passages (two halves that follow each other in a text) with all item passages."""
        columns = columns.reshape(-1, self.half)[lo : hi + 1]
        halves, buffer = np.zeros((hi - lo + 1, self.weighted.shape[1]), np.float32), np.empty((len(columns), self.weighted.shape[1]), np.float32)
        for j in range(self.half):
            halves[: len(columns)] += np.take(self.weighted, columns[:, j], axis=0, out=buffer, mode="clip")
        vectors = halves[:-1]
        follows = np.flatnonzero(doc[lo + 1 : hi + 1] == doc[lo : min(hi, len(doc) - 1)])
        vectors[follows] += halves[follows + 1]
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        return vectors @ self.passages

    def _anchored(self, hashes, at, doc, base, n_halves) -> tuple[np.ndarray, np.ndarray]:
        """Sorted row * n_items + item of the passages whose surroundings hold an anchor of the item, and whether one of near-verbatim leaks."""
        some = np.flatnonzero(self.marks[hashes & np.uint64(0xFFFF)])
        found = np.minimum(np.searchsorted(self.anchors, hashes[some]), len(self.anchors) - 1)
        exact = self.anchors[found] == hashes[some]
        some, found = some[exact], found[exact]
        n = self.anchor_first[found + 1] - self.anchor_first[found]
        which = _spread(self.anchor_first[found], n)
        item = self.anchor_item[which]
        place = np.repeat(at[some], n)
        text = doc[place // self.half]
        word, size = place - base[text] * self.half, self.sizes[item]
        low = np.maximum(0, (word - self.width - size) // self.half + 1)
        high = np.minimum(n_halves[text] - 1, (word + size) // self.half)
        n = high - low + 1
        pairs = np.unique((_spread(base[text] + low, n) * len(self.items) + np.repeat(item, n)) * 2 + np.repeat(~self.anchor_near[which], n))
        first = np.append(True, pairs[1:] >> 1 != pairs[:-1] >> 1)[: len(pairs)]
        return pairs[first] >> 1, pairs[first] & 1 == 0

    def _promising(self, hashes, left, right, item, similar, step: int = 512) -> np.ndarray:
        """Candidates whose surroundings hold enough different words of the item, and for a loose match of its answer."""
        number = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        number = np.where(self.known[number] == hashes, number, len(self.known))
        keep = np.zeros(len(item), bool)
        for a in range(0, len(item), step):
            own = slice(a, a + step)
            n = right[own] - left[own]
            pairs = np.repeat(np.arange(len(n)), n) * (len(self.known) + 1) + number[_spread(left[own], n)]
            held = np.zeros(len(n) * (len(self.known) + 1), bool)
            held[pairs] = True
            held = held.reshape(len(n), -1)

            def count(words, sizes):
                first = np.cumsum(sizes) - sizes
                many = sizes[item[own]]
                there = held[np.repeat(np.arange(len(n)), many), words[_spread(first[item[own]], many)]]
                return np.bincount(np.repeat(np.arange(len(n)), many)[there], minlength=len(n))

            words = count(self.word_of, self.n_words)
            keep[own] = words >= self.strict[item[own]]
            loose = similar[own] & (words >= self.loose[item[own]])
            if loose.any():
                keep[own] |= loose & (count(self.end_of, self.n_ends) >= self.ends[item[own]])
        return np.flatnonzero(keep)

    def _verify(self, around: list[int], item: int, similar: bool) -> tuple[float, float] | None:
        """(share of the item in order, share of its answer) if the words around a passage leak the item."""
        _, words, last = self.items[item]
        share = common_subsequence(words.tolist(), around) / len(words)
        ending = set(last.tolist())
        known = len(ending.intersection(around)) / len(ending)
        return (share, known) if share >= self.lcs or similar and share >= self.paraphrase and known >= self.answer else None
