"""Removal of repeated passages with a log-structured fingerprint index.

A window is ``window`` consecutive words of one document. Every window has one fingerprint: the smallest hash
among its ``gram``-word runs, so equal windows share it, and neighbouring windows mostly share it too. That makes
the index several times smaller than one of all windows.

The index is a folder: immutable runs (fingerprint, number of documents), each bucketed and sorted by fingerprint, the
postings (document, fingerprint) they were made of, and a manifest to which every change adds a version. A batch of documents becomes a new run, which is
merge-joined with every older run, without a shuffle as all have the same buckets; what they share, and what several documents of
the batch share, are the candidates. When there are too many runs, those of about the newest one's size or less are merged with it. Postings lead from the
candidates to documents, older ones too, whose windows are then *verified*: whole word sequences are compared by
96 hashed bits, and the smallest ``doc_id`` of each sequence keeps it. Batches come in ascending ``doc_id`` order.

Hot fingerprints and windows: counts combine before their shuffle. Of n rows at most n / t keys have t rows or
more, so the keys above such a t fit a broadcast of proven size; rows of these keys are joined where they are, the rest by shuffle.

Calls that are cut off: files are written before the version of the manifest that names them, and runs that it no longer names are emptied after it.
Until its version is whole, a call has added nothing, and can be made again.

Empty cases: a null or empty text has no words; a text shorter than a window keeps all words; an empty table gives
no rows. A row without ``doc_id`` keeps all its words. Rows that repeat a ``doc_id`` are judged each by its own text;
windows that two such rows share do not count as earlier ones.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WHILE_WRITING, hashed_words, in_groups, release, rolled, settings, shared_dir, staged, task

DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
POSTINGS = "doc_id long, text_hash long, mark long"
MANIFEST = "version long, place int, parts int, run string, buckets int, n long, postings string"
#: A bucket of one file is read in its order, so merge joins of runs need no sort.
SORTED_RUNS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _window_marks(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Fingerprint of each window, as non-negative 48-bit numbers."""
    grams = rolled(hashes, gram, 1)
    width = window - gram + 1
    least, have = grams, 1
    while have < width:
        step = min(have, width - have)
        if len(least) <= step:
            return np.zeros(0, np.int64)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)).astype(np.int64)


def fingerprints(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Distinct (doc_id, text_hash, mark) of all documents."""

    @task
    def make(batches):
        for batch in batches:
            keys, hashed, texts = (batch.column(c).to_pylist() for c in range(3))
            for a, b in in_groups(texts, 1 << 18):
                words, edges = hashed_words(texts[a:b], plain=False)
                out = []
                for i in range(a, b):
                    marks = _window_marks(words[edges[i - a] : edges[i - a + 1]], window, gram)
                    if len(marks):
                        marks = marks[np.flatnonzero(np.diff(marks, prepend=-1))]
                        out.append((i, np.unique(marks)))
                if out:
                    n = [len(m) for _, m in out]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": np.repeat(np.array([keys[i] for i, _ in out], np.int64), n),
                            "text_hash": np.repeat(np.array([hashed[i] for i, _ in out], np.int64), n),
                            "mark": np.concatenate([m for _, m in out]),
                        }
                    )

    return docs.where("doc_id is not null").mapInArrow(make, POSTINGS)


class FingerprintIndex:
    """Runs and postings of the documents added so far, in one folder that later sessions can open again."""

    def __init__(self, spark: SparkSession, path: str, runs: list[tuple[str, int, int]] = (), postings: list[str] = (), most_runs: int = 2, version: int = 0):
        self.spark, self.path, self.most_runs, self.version = spark, path, most_runs, version
        self.runs, self.folders = list(runs), list(postings)  # runs: folder, number of buckets, rows
        self.dead: list[tuple[str, int, int]] = []  # merged runs that the last version may still name

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "FingerprintIndex":
        """The index as its newest whole version names it."""
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").orderBy("version", "place")  # a row for each run and call, and each version
        versions: dict[int, list] = {}
        for r in rows.collect():
            versions.setdefault(r["version"], []).append(r)
        newest = max(v for v, own in versions.items() if len(own) == own[0]["parts"])
        own = versions[newest]
        return cls(spark, path, [(r["run"], r["buckets"], r["n"]) for r in own if r["run"]], [r["postings"] for r in own if r["postings"]], version=newest)

    def _table(self, run: tuple[str, int, int]) -> DataFrame:
        """A run as a table that knows its buckets and order."""
        name = "run_" + run[0].rpartition("-")[2]
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (mark BIGINT, n BIGINT) USING parquet CLUSTERED BY (mark) SORTED BY (mark) INTO {run[1]} BUCKETS LOCATION '{run[0]}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, int, int]:
        name = uuid.uuid4().hex
        folder = f"{self.path}/run-{name}"
        with settings(self.spark, WHILE_WRITING | SORTED_RUNS):
            rows.select("mark", "n").write.bucketBy(buckets, "mark").sortBy("mark").option("path", folder).saveAsTable(f"run_{name}")
        return folder, buckets, self.spark.table(f"run_{name}").count()

    def _save(self) -> None:
        """Add a version to the manifest in one commit, then drop the runs that it no longer names."""
        self.version += 1
        named = [(r, buckets, n, None) for r, buckets, n in self.runs] + [(None, None, None, b) for b in self.folders]
        rows = [(self.version, place, len(named), *row) for place, row in enumerate(named)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        dead, self.dead = self.dead, []
        for run in dead:
            release(self._table(run))
            self.spark.sql(f"DROP TABLE run_{run[0].rpartition('-')[2]}")

    def postings(self) -> DataFrame:
        parts = [self.spark.read.schema(f"{POSTINGS}, batch int").parquet(folder).drop("batch") for folder in self.folders]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out

    def add(self, marks: DataFrame, cuts: list[int] = ()) -> DataFrame:
        """Add postings (doc_id, text_hash, mark), one batch for each range of ``doc_id`` that the cuts make.

        Returns (mark, n) of the fingerprints that several documents hold, old or new; n may be too high, never too low.
        """
        folder, cuts = f"{self.path}/postings-{uuid.uuid4().hex}", sorted(cuts)
        batch = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
        with settings(self.spark, WHILE_WRITING | {"spark.sql.maxConcurrentOutputFileWriters": str(len(cuts) + 1)}):
            marks.withColumn("batch", batch).write.partitionBy("batch").parquet(folder)
        self.folders.append(folder)
        parts = [self._add_run(self.spark.read.schema(f"{POSTINGS}, batch int").parquet(folder).where(F.col("batch") == i)) for i in range(len(cuts) + 1)]
        self._save()
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return staged(out.groupBy("mark").agg(F.sum("n").alias("n")), "candidates")

    def _add_run(self, marks: DataFrame) -> DataFrame:
        """A batch becomes a run; merge joins with the older runs give what they share."""
        buckets = self.runs[0][1] if self.runs else max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        run = self._write(marks.groupBy("mark").agg(F.count("*").alias("n")), buckets)
        new = self._table(run)
        shared = new.where("n > 1")
        for old in self.runs:
            shared = shared.unionAll(merged(new, self._table(old), "inner"))
        with settings(self.spark, SORTED_RUNS):
            shared = staged(shared, "shared")
        self.runs.append(run)
        if len(self.runs) > self.most_runs:
            self.compact()
        return shared

    def compact(self, factor: int = 4) -> None:
        """Merge the newest runs into one, bucket by bucket: as many as have at most ``factor`` times the rows of those after them, two at least."""
        if len(self.runs) < 2:
            return
        first, size = len(self.runs) - 2, self.runs[-1][2] + self.runs[-2][2]
        while first and self.runs[first - 1][2] <= factor * size:
            first, size = first - 1, size + self.runs[first - 1][2]
        merging, kept = self.runs[first:], self.runs[:first]
        whole = self._table(merging[0])
        for other in merging[1:]:
            whole = merged(whole, self._table(other), "full")
        self.runs = [*kept, self._write(whole, merging[0][1])]
        self.dead += merging


def merged(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """(mark, n) of two runs by a merge join, with the numbers of documents added up."""
    l, r = left.hint("merge").alias("l"), right.alias("r")
    n = F.coalesce("l.n", F.lit(0)) + F.coalesce("r.n", F.lit(0))
    return l.join(r, F.col("l.mark") == F.col("r.mark"), how).select(F.coalesce("l.mark", "r.mark").alias("mark"), n.alias("n"))


def _join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], over: int = 1, most_hot: int = 100_000) -> DataFrame:
    """Join rows with a table of unique keys and their counts ``n``: frequent keys, at most ``most_hot``, by broadcast, others by shuffle.

    The counts may be up to ``over`` times too high. Of n rows, at most ``most_hot`` keys are in over * n / most_hot or more.
    """
    least = max(1000, -(-over * rows.count() // most_hot))
    hot = F.broadcast(staged(keyed.where(F.col("n") >= least).drop("n"), "hot"))
    rest = rows.join(hot.select(*on), on, "left_anti").join(keyed.where(F.col("n") < least).drop("n"), on)
    return rows.join(hot, on).unionByName(rest)


def _verified_windows(docs: DataFrame, hits: DataFrame, window: int, gram: int) -> DataFrame:
    """(w1, w2, doc_id, text_hash, pos) of the windows whose fingerprint other documents hold."""

    def make(batches):
        for batch in batches:
            keys, hashed, marks = (batch.column(c) for c in (0, 1, 3))
            texts = batch.column(2).to_pylist()
            for a, b in in_groups(texts, 1 << 18):
                words, edges = hashed_words(texts[a:b], plain=False)
                for i in range(a, b):
                    own = words[edges[i - a] : edges[i - a + 1]]
                    pos = np.flatnonzero(np.isin(_window_marks(own, window, gram), np.asarray(marks[i].values)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rolled(own, window, 2)[pos].view(np.int64)),
                            pa.array((rolled(own, window, 3)[pos] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                            pa.array(np.full(len(pos), keys[i].as_py(), np.int64)),
                            pa.array(np.full(len(pos), hashed[i].as_py(), np.int64)),
                            pa.array(pos.astype(np.int32)),
                        ],
                        ["w1", "w2", "doc_id", "text_hash", "pos"],
                    )

    @task
    def joined(batches):
        held, rows = [], 0
        for batch in make(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    per_doc = hits.groupBy("doc_id", "text_hash").agg(F.collect_list("mark").alias("marks"))  # a document's own fingerprints
    return docs.join(per_doc, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "marks").mapInArrow(
        joined, "w1 long, w2 int, doc_id long, text_hash long, pos int"
    )


def repeated_windows(docs: DataFrame, index: FingerprintIndex, earlier: DataFrame | None = None, window: int = 13, gram: int = 4, batches: int = 3, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, text_hash, pos) of the windows whose words also start a window in a document of smaller ``doc_id``.

    ``docs`` have doc_id, text_hash and text, ``earlier``, the documents that the index knows already, doc_id and text. New documents
    enter it in ``batches`` ranges of ``doc_id``.
    """
    places = [i / batches for i in range(1, batches)]
    cuts = docs.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", places, 0.01) if places else []
    candidates = index.add(fingerprints(docs, window, gram), sorted({int(c) for c in cuts}))
    hits = staged(_join_counted(index.postings(), candidates, ["mark"], over=batches + index.most_runs), "hits")
    everything = docs
    if earlier is not None:  # only texts of documents with candidates are read
        wanted = hits.select("doc_id").distinct()
        everything = docs.unionAll(earlier.join(F.broadcast(wanted) if hits.count() <= broadcast_rows else wanted, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("text_hash"), "text"))
    found = staged(_verified_windows(everything, hits, window, gram), "windows")
    release(hits)
    sequences = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    sequences = staged(sequences.where("first < last").drop("last"), "sequences")
    repeats = _join_counted(found, sequences, ["w1", "w2"]).where("doc_id > first").select("doc_id", "text_hash", "pos")
    repeats = staged(repeats, "repeats")
    release(found, sequences)
    return repeats


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of the documents whose whole text a document of smaller ``doc_id`` has."""
    named = docs.where("doc_id is not null").select("doc_id", "text_hash", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    named = staged(named, "named")
    first = named.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return staged(named.join(first, "sha").where("doc_id > first").select("doc_id", "text_hash").distinct(), "copies")


def remove_repeats(docs: DataFrame, window: int = 13, gram: int = 4, batches: int = 3, broadcast_rows: int = 500_000, index: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Per document: words, words removed, and the kept words joined by one space, with their digest.

    ``index`` names a folder for the fingerprint index, by default a new one in the shared folder. Called again with it, and with the
    documents of the calls before as ``earlier``, only the new ``docs`` are read, judged and returned.

    All windows of a later copy of a whole text are repeats, so such copies skip the index. They are taken out by a
    broadcast of their ids while there are at most ``broadcast_rows`` (16 bytes each), by a shuffled join beyond.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    before = earlier if earlier is None else earlier.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    copies = later_copies(keyed)
    few = copies.count() <= broadcast_rows
    others = keyed.join(F.broadcast(copies) if few else copies, ["doc_id", "text_hash"], "left_anti")
    folder = index or f"{shared_dir(spark)}/annoquery/index-{uuid.uuid4().hex}"
    stored = FingerprintIndex(spark, folder) if earlier is None else FingerprintIndex.open(spark, folder)
    repeats = repeated_windows(others, stored, before, window, gram, batches, broadcast_rows)
    starts = repeats.distinct().groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("starts"))
    per_doc = starts.withColumn("copy", F.lit(False)).union(copies.select("doc_id", "text_hash", F.array().cast("array<int>"), F.lit(True)))

    @task
    def cut(batches_):
        for batch in batches_:
            rows, kept = [], []
            for key, text, starts, copy in zip(*(batch.column(c) for c in range(4))):
                words = words_of(text.as_py())
                n = len(words)
                if copy.as_py():
                    words = words if n < window else []
                elif starts.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    at = np.asarray(starts.values)
                    edge[at] += 1
                    np.subtract.at(edge, at + window, 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                whole = b" ".join(words)
                rows.append((key.as_py(), n, n - len(words), hashlib.sha256(whole).hexdigest()))
                kept.append(whole.decode("utf-8", "surrogatepass"))
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    joined = keyed.join(per_doc, ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts", "copy")
    return joined.mapInArrow(cut, f"{DIGEST}, kept_text string")
