"""Helpers shared by the text operators: staged tables and whole-text tokenization."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only on one machine, as in tests, and only where the setting is absent, a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-annoquery-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


#: While a staged table is written: small batches of texts for Python, and shuffle files that go when the write has ended.
WHILE_WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, label: str, rows: int = 2000, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    Python gets at most ``rows`` rows in a batch; ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/annoquery/{label}-{uuid.uuid4().hex}"
    with settings(spark, WHILE_WRITING | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Empty staged tables that no later step reads, as they only take up disk."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            df.sparkSession.range(0).write.mode("overwrite").parquet(folder)


def task(function):
    """A function of Arrow batches after whose task the Python worker keeps no table of texts: workers serve many tasks and stages."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            for known in _ENCODERS.values():
                known.clear()
            pa.default_memory_pool().release_unused()

    return run


class _Slots(dict):
    """Chunk of text -> slot; an unknown chunk gets the next slot and is queued for encoding."""

    def __init__(self):
        super().__init__()
        self.queued: list[bytes] = []
        self.total = 0

    def __missing__(self, chunk: bytes) -> int:
        slot = self[chunk] = self.total
        self.total += 1
        self.queued.append(chunk)
        return slot


class TextEncoder:
    """Token ids of whole texts by a word-level BPE file of the tokenizers library.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    chunks between ASCII white space, in order. Each distinct chunk goes through the library once and
    is kept in a table of at most ``most`` chunks (then the table starts anew), which bounds the memory.
    Chunks of letters with trailing ASCII punctuation skip the splitting pattern, whose result for them is known.
    """

    _LETTERS_THEN_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.most = most
        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer(self.whole.model)
        self.words.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.slots = _Slots()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)

    def _encode_queued(self):
        queued, self.slots.queued = self.slots.queued, []
        if not queued:
            return
        first = self.slots.total - len(queued)
        parts, plain, counts, other = self._LETTERS_THEN_MARKS, [], [], []
        plain_at, other_at = [], []
        for at, text in enumerate(b"\n".join(queued).decode("utf-8", "replace").split("\n")):
            if text.isalpha() and text.lower().isalpha():
                plain.append(text)
                counts.append(1)
                plain_at.append(at)
            elif (found := parts.fullmatch(text)) and found[1].isalpha() and found[1].lower().isalpha():
                plain += found.groups()
                counts.append(2)
                plain_at.append(at)
            else:
                other.append(text)
                other_at.append(at)
        lengths = np.zeros(len(queued), np.int64)
        flat, order = np.zeros(0, np.uint32), np.asarray(plain_at + other_at, np.int64)
        if plain:
            flat = np.asarray(self.words.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[flat]) + 1
            if len(ends) != sum(counts):
                raise ValueError("the vocabulary does not mark word ends")
            lengths[plain_at] = np.diff(ends[np.cumsum(counts) - 1], prepend=0)
        if other:
            rest = [e.ids for e in self.whole.encode_batch_fast(other, add_special_tokens=False)]
            lengths[other_at] = list(map(len, rest))
            flat = np.concatenate([flat, np.fromiter((i for ids in rest for i in ids), np.uint32)])
        ordered = lengths[order]
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.slots.total > len(self.length):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.length[first + order] = ordered
        self.start[first + order] = self.used + np.cumsum(ordered) - ordered
        self.used += len(flat)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text; null and empty texts give empty arrays."""
        if self.slots.total > self.most:
            self.clear()
        slot = self.slots.__getitem__
        words = [np.fromiter(map(slot, (text or "").encode("utf-8", "replace").split()), np.int64) for text in texts]
        self._encode_queued()
        out = []
        for w in words:
            lengths = self.length[w]
            total = int(lengths.sum())
            shift = self.start[w] - (np.cumsum(lengths) - lengths)
            out.append(self.ids[np.repeat(shift, lengths) + np.arange(total)])
        return out


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """This worker's encoder for a tokenizer file; ``task`` empties its table at the end of a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def in_groups(values: list, most_chars: int = 1 << 20):
    """Consecutive slices (start, end) of texts with about ``most_chars`` characters each, one text at least."""
    start, size = 0, 0
    for i, v in enumerate(values):
        size += len(v or "")
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)


_ODD = np.uint64(0x9E3779B97F4A7C15)  # 2**64 divided by the golden ratio, an odd number that mixes well


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


_FACTORS = mixed(np.arange(1, 4097, dtype=np.uint64) * _ODD) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MARK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _hashed(raw: bytes, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``raw``: a sum of its bytes times factors of their places, then mixed."""
    flat = np.frombuffer(raw, np.uint8)
    inside = ~between[flat]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edges[::2], np.diff(edges)[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    factors = _FACTORS[place] if sizes.max() <= len(_FACTORS) else mixed((place.astype(np.uint64) + np.uint64(1)) * _ODD) | np.uint64(1)
    return mixed(np.add.reduceat(factors * (flat[inside].astype(np.uint64) + np.uint64(1)), at)), starts


def hashed_words(texts: list[str | None], plain: bool, most_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 64-bit hashes of all words of texts, one text after the other, and the place of each text's first one (plus the end).

    ``plain`` words are those of ``plain_words``; others are runs of anything but ASCII white space. Long input goes in slices.
    """
    between = _MARK if plain else _SPACE
    raws = [((t or "").lower() if plain else t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join([*raws, b""])
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
    hashes, counts, at = [], np.zeros(len(raws) + 1, np.int64), 0
    while at < len(joined):
        end = at + most_bytes
        while end < len(joined) and not between[joined[end]]:
            end += 1
        own, starts = _hashed(joined[at:end], between)
        hashes.append(own)
        counts[1:] += np.searchsorted(starts, ends - at)
        at = end
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def rolled(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words; empty if there are fewer."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    factors = mixed(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed)) | np.uint64(1)
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total += hashes[j : j + size] * factors[j]
    return mixed(total)


_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_SPACED = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words: runs of anything but ASCII marks and white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def without(docs: DataFrame, ids: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` less those whose ``doc_id`` is in ``ids``; the ids are broadcast while they are few, else both sides are shuffled."""
    ids = staged(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, "doc_id", "left_anti").select(*docs.columns)
