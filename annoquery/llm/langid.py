"""Language identification by Bayesian evidence fusion.

Evidence: the text (hashed byte trigrams, one model per declared language, counted over all documents), the declared
language, the suffix of addresses in the text, and the host. What a declared language or suffix says about the true
one is learnt from all rows by grouped counts of text-only decisions. Host priors are smoothed in a hierarchy:
host counts towards their suffix's distribution, suffix counts towards the global one. Trigrams of a text depend
on each other, so the text counts as at most ``effective`` independent ones.

A language has a model if it is among the ``most_languages`` most declared values; rarer values count as what they say about these
languages, as every declared value does, so tables stay bounded whatever the column holds.

A row is rejected (``kept`` false) if it has no word characters, or if no language reaches ``least`` probability.
Null or empty texts have no text evidence and are rejected; null declarations and hosts are the values '' of their own.
An empty table gives no rows. Repeated rows are judged each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_groups, staged, task

BUCKETS = 1 << 14
SCORED = "id long, host string, declared string, suffix string, grams long, scores array<double>"


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of texts, one after the other, and each text's first place (plus the end)."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    grams = (flat[:-2] << np.uint32(16)) | (flat[1:-1] << np.uint32(8)) | flat[2:]
    buckets = ((grams * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    for back in (1, 2):  # trigrams that would cross into the next text
        cross = ends - back
        buckets[cross[cross >= ends - sizes]] = BUCKETS
    return buckets, np.concatenate([[0], ends])


def train(items: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (bucket, language) from all items with a declared language."""

    @task
    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            declared, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_groups(texts):
                own = np.array(declared[a:b], object)
                for language in set(declared[a:b]):
                    buckets, _ = _trigrams([t for t, d in zip(texts[a:b], own) if d == language])
                    held.setdefault(language, np.zeros(BUCKETS + 1, np.int64))
                    held[language] += np.bincount(buckets, minlength=BUCKETS + 1)
        for language, counts in held.items():
            some = np.flatnonzero(counts[:BUCKETS])
            yield pa.RecordBatch.from_pydict({"language": [language] * len(some), "bucket": some.astype(np.int32), "n": counts[some]})

    counted = items.where("said <> ''").select("said", "text").mapInArrow(count, "language string, bucket int, n long")
    rows = counted.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows a language
    languages, at = np.unique(rows.column("language").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    table = np.full((BUCKETS, len(languages)), 0.5)
    table[rows.column("bucket").to_numpy(), at] += rows.column("n").to_numpy()
    languages = languages.tolist()
    return languages, np.log(table / table.sum(axis=0))


def score(items: DataFrame, languages: list[str], table: np.ndarray, effective: int) -> DataFrame:
    """Text log-likelihoods of every item, scaled to at most ``effective`` trigrams; one narrow pass over the texts."""
    shared = items.sparkSession.sparkContext.broadcast(np.vstack([table, np.zeros((1, len(languages)))]))

    @task
    def make(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_groups(texts):
                buckets, edges = _trigrams(texts[a:b])
                totals = np.zeros((b - a, len(languages)))
                full = np.flatnonzero(np.diff(edges))
                for at in range(len(languages)):
                    if len(full):
                        totals[full, at] = np.add.reduceat(shared.value[buckets, at], edges[full])
                grams = np.maximum(np.diff(edges) - 2, 0)
                totals *= (np.minimum(grams, effective) / np.maximum(grams, 1))[:, None]
                worded = [bool(t) and any(c.isalpha() for c in t) for t in texts[a:b]]
                kept = [batch.column(c).slice(a, b - a) for c in ("id", "host", "declared", "suffix")]
                rows = pa.array(list(totals), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.where(worded, grams, 0)), rows], ["id", "host", "declared", "suffix", "grams", "scores"])

    return items.select("id", "host", "declared", "suffix", "text").mapInArrow(make, SCORED)


def _log_table(rows: DataFrame, key: str, parent: list[float], strength: float) -> DataFrame:
    """Per value of ``key``: smoothed language distribution as an array of log-probabilities ratios to the parent."""
    n = len(parent)
    counts = rows.groupBy(key).agg(*[F.sum(F.when(F.col("best") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(n)], F.count("*").alias("n"))
    return counts.select(key, *[((F.col(f"n{i}") + F.lit(strength * parent[i])) / (F.col("n") + F.lit(strength))).alias(f"{key}_{i}") for i in range(n)])


def identify(items: DataFrame, effective: int = 60, least: float = 0.6, strength: float = 20.0, broadcast_rows: int = 100_000, most_languages: int = 64) -> DataFrame:
    """id, language, probability, text_language, declared, kept. ``items`` has id, text, declared, suffix, host."""
    items = items.select(F.col("id").cast("long").alias("id"), "text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("declared", "suffix", "host")])
    counted = items.where("declared <> ''").groupBy("declared").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "declared").limit(most_languages)
    known = [r["declared"] for r in counted.collect()]  # at most `most_languages` rows
    items = items.withColumn("said", F.when(F.col("declared").isin(known) if known else F.lit(False), F.col("declared")).otherwise(""))
    languages, table = train(items)
    n = len(languages)
    out = "id long, language string, probability double, text_language string, declared string, kept boolean"
    if not n:
        return items.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("probability"), F.lit("und").alias("text_language"), "declared", F.lit(False).alias("kept")).to(
            items.sparkSession.createDataFrame([], out).schema
        )
    rows = score(items, languages, table, effective)
    rows = staged(rows.withColumn("best", (F.array_position("scores", F.array_max("scores")) - 1).cast("int")), "scored")
    worded = rows.where("grams > 0")
    totals = {r["best"]: r["n"] for r in worded.groupBy("best").agg(F.count("*").alias("n")).collect()}  # one row a language
    every = sum(totals.values()) + n
    world = [(totals.get(i, 0) + 1) / every for i in range(n)]
    suffixes = _log_table(worded, "suffix", world, strength)
    says = _log_table(worded, "declared", world, 1.0)
    hosts = worded.groupBy("host").agg(*[F.sum(F.when(F.col("best") == i, 1).otherwise(0)).alias(f"h{i}") for i in range(n)], F.count("*").alias("h"))

    def small(df: DataFrame) -> DataFrame:
        df = staged(df, "evidence")
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    joined = rows.join(small(suffixes), "suffix", "left").join(small(says), "declared", "left").join(small(hosts), "host", "left")
    logs = []
    for i in range(n):
        p = F.lit(world[i])
        of_suffix = F.coalesce(F.col(f"suffix_{i}"), p)
        of_host = (F.coalesce(F.col(f"h{i}"), F.lit(0)) + strength * of_suffix) / (F.coalesce(F.col("h"), F.lit(0)) + strength)
        of_declared = F.when(F.col("declared") == "", p).otherwise(F.coalesce(F.col(f"declared_{i}"), p))
        logs.append(F.get("scores", F.lit(i)) + F.log(of_host) + F.log(of_declared) - F.log(p))
    joined = joined.select("id", "declared", "grams", "best", F.array(*logs).alias("logs")).withColumn("top", F.array_max("logs"))
    total = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    names = F.array(*map(F.lit, languages))
    judged = joined.select(
        "id", "grams", "declared", F.get(names, F.array_position("logs", F.col("top")).cast("int") - 1).alias("language"), (1 / total).alias("probability"), F.get(names, F.col("best")).alias("text_language")
    )
    kept = (F.col("grams") > 0) & (F.col("probability") >= least)
    return judged.select(
        "id",
        F.when(F.col("grams") > 0, F.col("language")).otherwise("und").alias("language"),
        F.when(F.col("grams") > 0, F.col("probability")).otherwise(0.0).alias("probability"),
        F.when(F.col("grams") > 0, F.col("text_language")).otherwise("und").alias("text_language"),
        "declared",
        kept.alias("kept"),
    )


def document_items(docs: DataFrame) -> DataFrame:
    """Items of the documents table: ``lang`` is the declared language, ``source`` the host, suffixes come from addresses in the text."""
    suffix = F.lower(F.regexp_extract("text", r"(?:@|https?://)[\w.-]+\.([A-Za-z]{2,})\b", 1))
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), suffix.alias("suffix"), F.col("source").alias("host"))


def page_items(pages: DataFrame) -> DataFrame:
    """Items of the pages table: markup language, address suffix and host; the text is what stands outside tags."""
    host = F.lower(F.regexp_extract("url", r"^\w+://([^/:?#]+)", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", r"<html[^>]*\blang=[\"']?([A-Za-z]{2})", 1))
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), declared.alias("declared"), F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("suffix"), host.alias("host"))
