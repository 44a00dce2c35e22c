"""Source divergence audit: how far the sources of a language are apart in their words, and which words tell them.

The vocabulary, the terms in at least ``least_docs`` documents of a language, is held as minimal acyclic transducers that give a term's
ordinal in byte order. They are built in tasks, one for each ``shard_terms`` terms or so; one at a time is broadcast, which
bounds its size, and all texts stream through it for recounting. Beyond that many terms there are more shards and as many passes. Ordinals stand for terms in every later step, also where ties are
broken, and the transducer turns the reported ones back into terms.

Counts meet in chunks of ordinals, each a matrix of sources by terms of at most ``cells`` cells; a chunk gives its part of every pair's sum and the best terms of each source.
All arithmetic is in whole numbers. Terms are counted per task before any shuffle, so a hot source or language is no hot key.

Edge cases: null texts, languages and sources are ''. A group without terms has every term zero times. A language without kept terms has pairs of value 0 and no terms. Repeated
rows are documents each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_groups, staged
from .transducer import Transducer

SHARD = "shard long, first_lang string, n_first long, last_lang string, n_last long, base binary, owner binary, target binary, output binary, final binary, below binary"
#: Letters in lower case, bytes beyond ASCII as they are, anything else a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _spaced(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def _prefix(lang: str) -> bytes:
    """A language in front of its terms: keeps the order of languages, and none is the beginning of another."""
    return lang.encode("utf-8", "surrogatepass").replace(b"\0", b"\0\xff") + b"\0\0"


def document_frequencies(named: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(lang, term, n): in how many documents of the language; a task sends its sums once it holds ``most`` terms, and at its end."""

    def count(batches):
        held: dict[str, Counter] = {}

        def rows():
            for lang, terms in held.items():
                keys = list(terms)
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(keys, pa.binary()), pa.array(list(terms.values()), pa.int64())], ["lang", "term", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                held.setdefault(lang, Counter()).update(set(_spaced(text.as_py()).split()))
                if sum(map(len, held.values())) > most:
                    yield from rows()
        yield from rows()

    return named.select("lang", "text").mapInArrow(count, "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def build_shards(kept: DataFrame, shard_terms: int) -> DataFrame:
    """One row per transducer over (lang, term), with how many terms its first and last language have in it."""
    shards = max(1, -(-kept.count() // shard_terms))
    number = F.lit(0).cast("long")
    if shards > 1:  # cuts by a sample of a bounded size; every term is in the shard of its range
        sample = sorted((r["lang"], bytes(r["term"])) for r in kept.sample(min(1.0, 1000 / shard_terms), seed=5).collect())
        for lang, term in {sample[len(sample) * i // shards] for i in range(1, shards) if sample}:
            number += F.when((F.col("lang") > lang) | (F.col("lang") == lang) & (F.col("term") >= F.lit(term)), 1).otherwise(0)

    def build(key, table):
        order = sorted(zip(table.column("lang").to_pylist(), table.column("term").to_pylist()), key=lambda x: (_prefix(x[0]), x[1]))
        langs = Counter(lang for lang, _ in order)
        made = Transducer.build(_prefix(lang) + term for lang, term in order)
        first, last = order[0][0], order[-1][0]
        row = {"shard": key[0].as_py(), "first_lang": first, "n_first": langs[first], "last_lang": last, "n_last": langs[last]} | made.arrays()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 6]
        return pa.table({name: pa.array([value], kind) for (name, value), kind in zip(row.items(), kinds)})

    return kept.withColumn("shard", number).groupBy("shard").applyInArrow(build, SHARD)


def recount(texts: DataFrame, known, most: int = 4_000_000) -> DataFrame:
    """(gid, ordinal, n) of all words of (gid, lang, text) that the broadcast transducer knows; ordinals count from the language's first term."""

    def stream(batches):
        machine, first_lang, before = known.value
        gids: dict[int, int] = {}
        keys, counts, new = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def reduced():
            flat, had = np.concatenate([keys, *(k for k, _ in new)]), np.concatenate([counts, *(n for _, n in new)])
            whole, at = np.unique(flat, return_inverse=True)
            new.clear()
            return whole, np.bincount(at, had, len(whole)).astype(np.int64)

        def rows():
            names = np.array(list(gids), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names[keys >> 40]), pa.array(keys & ((1 << 40) - 1)), pa.array(counts)], ["gid", "ordinal", "n"])

        for batch in batches:
            langs, ids = np.array(batch.column("lang").to_pylist(), object), batch.column("gid").to_pylist()
            for lang in dict.fromkeys(langs):
                state, _ = machine.state(_prefix(lang))
                own = np.flatnonzero(langs == lang) if state >= 0 else []
                texts_ = batch.column("text").take(pa.array(own, pa.int64())).to_pylist()
                for a, b in in_groups(texts_, 1 << 19):
                    raw = [_spaced(t) for t in texts_[a:b]]
                    flat = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
                    edges = np.flatnonzero(np.diff(flat != 32, prepend=False, append=False))
                    starts, ends = edges[::2], edges[1::2]
                    words, ordinals = machine.ordinals(flat, starts, ends, state)
                    text_of = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts[words], "right")
                    group = np.array([gids.setdefault(ids[i], len(gids)) for i in own[a:b]], np.int64)
                    new.append(np.unique((group[text_of] << 40) + ordinals + (before if lang == first_lang else 0), return_counts=True))
                    if sum(len(k) for k, _ in new) > most:
                        keys, counts = reduced()
                        if len(keys) > most:
                            yield rows()
                            keys, counts = keys[:0], counts[:0]
        keys, counts = reduced()
        yield rows()

    return texts.mapInArrow(stream, "gid long, ordinal long, n long")


def _shares(counts: np.ndarray, total: np.ndarray, terms: int, prior: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + prior) / (total + prior * terms)), by a long division in steps of thousands, as the product may pass a long."""
    below = np.broadcast_to(total + prior * terms, counts.shape)
    rest, out = counts + prior, np.zeros_like(counts)
    out, rest = np.divmod(rest, below)
    while scale > 1:
        step = min(scale, 1000)
        part, rest = np.divmod(rest * step, below)
        out, scale = out * step + part, scale // step
    return 1 + out


def _chunk(width: int, top: int, prior: int, scale: int):
    """Function of a chunk's counts and its language's groups: parts of the pairs' sums, and each source's first terms."""

    def score(key, counts, groups):
        chunk, terms = key[1].as_py(), groups.column("terms")[0].as_py()
        gids = groups.column("gid").to_numpy()
        order = np.argsort(gids)
        gids, totals = gids[order], groups.column("n_group").to_numpy()[order]
        matrix = np.zeros((len(gids), min(width, terms - chunk * width)), np.int64)
        matrix[np.searchsorted(gids, counts.column("gid").to_numpy()), counts.column("ordinal").to_numpy() - chunk * width] = counts.column("n").to_numpy()
        p = _shares(matrix, totals[:, None], terms, prior, scale)
        q = _shares(matrix.sum(axis=0), groups.column("n_lang").to_numpy()[:1], terms, prior, scale)
        out = []
        for i, gid in enumerate(gids.tolist()):
            apart = np.abs(p - p[i]).sum(axis=1)
            others = np.flatnonzero(gids != gid)
            out.append((np.full(len(others), gid), np.zeros(len(others), bool), gids[others], apart[others]))
            over = p[i] - q
            told = np.flatnonzero((matrix[i] > 0) & (over > 0))
            told = told[np.lexsort((told, -over[told]))[:top]]
            out.append((np.full(len(told), gid), np.ones(len(told), bool), told + chunk * width, over[told]))
        return pa.table(dict(zip(("gid", "term", "other", "value"), (np.concatenate(c) for c in zip(*out)))))

    return score


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, prior: int = 5, scale: int = 1_000_000_000, shard_terms: int = 1_000_000, cells: int = 1 << 22, broadcast_rows: int = 500_000) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): pairs of sources by their distance, and the ``top`` terms of each source. ``scale`` is a power of ten."""
    spark = docs.sparkSession
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = staged(document_frequencies(named).where(F.col("n") >= least_docs).select("lang", "term"), "terms")
    groups = staged(named.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    small = groups.count() <= broadcast_rows
    hint = F.broadcast if small else lambda df: df
    shards = staged(build_shards(kept, shard_terms), "transducers")
    texts = named.join(hint(groups), ["lang", "source"]).select("gid", "lang", "text")
    machines, last, had = [], None, 0
    for row in shards.select("shard", "first_lang", "n_first", "last_lang", "n_last").orderBy("shard").collect():  # one short row for each shard
        before = had if row["first_lang"] == last else 0
        had = row["n_last"] + (before if row["first_lang"] == row["last_lang"] else 0)
        last = row["last_lang"]
        one = shards.where(F.col("shard") == row["shard"]).collect()[0].asDict()
        machines.append(spark.sparkContext.broadcast((Transducer.of(one), row["first_lang"], before)))
    empty = spark.createDataFrame([], "gid long, ordinal long, n long")
    counted = functools.reduce(DataFrame.unionAll, (recount(texts, m) for m in machines), empty)
    counted = staged(counted.groupBy("gid", "ordinal").agg(F.sum("n").alias("n")), "counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = groups.join(counted.groupBy("gid").agg(F.sum("n").alias("n")), "gid", "left").join(sizes, "lang", "left").na.fill(0, ["n", "terms"])
    of_lang = totals.groupBy("lang").agg(F.min("gid").alias("lid"), F.sum("n").alias("n_lang"), F.count("*").alias("n_sources"))
    info = staged(totals.withColumnRenamed("n", "n_group").join(of_lang, "lang"), "sources")
    width = max(64, min(1 << 14, cells // max(1, info.agg(F.max("n_sources")).first()[0] or 1)))
    entries = counted.join(hint(info.select("gid", "lid")), "gid").withColumn("chunk", F.floor(F.col("ordinal") / width))
    spread = info.toDF(*info.columns).where("terms > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("terms") - 1) / width))))
    scored = entries.groupBy("lid", "chunk").cogroup(spread.select("lid", "chunk", "gid", "n_group", "n_lang", "terms").groupBy("lid", "chunk"))
    scored = staged(scored.applyInArrow(_chunk(width, top, prior, scale), "gid long, term boolean, other long, value long"), "scored")

    own, other = info.select("lid", "gid", "lang", "source"), info.select("lid", F.col("gid").alias("other"), F.col("source").alias("item"))
    apart = scored.where("not term").groupBy("gid", "other").agg(F.sum("value").alias("value"))
    pairs = own.join(other, "lid").where("gid <> other").join(apart, ["gid", "other"], "left").na.fill(0, ["value"])
    rank = lambda *by: F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), *by))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank("item").alias("rank"))
    best = scored.where("term").withColumn("rank", rank("other")).where(F.col("rank") <= top).join(hint(own), "gid")
    best = best.select("lang", "source", F.col("other").alias("ordinal"), "value", "rank")
    return functools.reduce(DataFrame.unionAll, (_decoded(best, m) for m in machines), pairs)


def _decoded(best: DataFrame, known) -> DataFrame:
    """The rows whose ordinals are in the broadcast transducer, with their terms."""

    def decode(batches):
        machine, first_lang, before = known.value
        for batch in batches:
            rows = []
            for lang, source, ordinal, value, rank in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "ordinal", "value", "rank"))):
                state, first = machine.state(_prefix(lang))
                local = ordinal - (before if lang == first_lang else 0)
                if state >= 0 and 0 <= local < machine.below[state]:
                    rows.append((lang, source, "term", machine.term(first + local)[len(_prefix(lang)) :].decode("utf-8", "surrogatepass"), value, rank))
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["lang", "source", "part", "item", "value", "rank"])

    return best.mapInArrow(decode, "lang string, source string, part string, item string, value long, rank int")
