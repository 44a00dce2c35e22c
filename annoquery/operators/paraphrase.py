"""Merge of paraphrases into a corpus, fail-closed: nothing is published while a rule is broken.

Corpus: position, id, image_id, language, target_ids, query and other columns. Results: source_sample_id, source_fingerprint, language,
review_status, generator_model, paraphrases. An original always stays; a paraphrase goes if the same image, language and targets have had its words before it, by
position, an original before its paraphrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources import publish

#: In the order in which they are looked for.
PROBLEMS = ("unknown_sample", "repeated_sample", "repeated_result", "unreviewed", "language", "fingerprint")


def identity(query: Column) -> Column:
    """Words of a query as compared: white space collapsed, without regard to case, also of letters that have two small forms or none that is capital."""
    small = F.lower(F.trim(F.regexp_replace(query, r"(?U)\s+", " ")))
    return F.replace(F.replace(small, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def joined(base: DataFrame, results: DataFrame, fingerprint: Column, allow_unreviewed: bool = False) -> DataFrame:
    """Samples with their result (or null) and ``problem``, the first rule that a pair breaks. Results without a sample are rows as well."""
    own = base.withColumn("_print", fingerprint).groupBy("id").agg(F.count("*").alias("_bases"), F.min_by(F.struct("*"), "position").alias("b"))
    made = results.groupBy("source_sample_id").agg(F.count("*").alias("_results"), F.min(F.struct("source_fingerprint", "language", "review_status", "generator_model", "paraphrases")).alias("r"))
    rows = own.join(made, F.col("id") == F.col("source_sample_id"), "full")
    rules = {
        "unknown_sample": F.col("id").isNull(),
        "repeated_sample": F.col("_bases") > 1,
        "repeated_result": F.col("_results") > 1,
        "unreviewed": F.col("r").isNotNull() & ~F.col("r.review_status").eqNullSafe("reviewed") & ~F.lit(allow_unreviewed),
        "language": F.col("r").isNotNull() & ~F.col("r.language").eqNullSafe(F.col("b.language")),
        "fingerprint": F.col("r").isNotNull() & ~F.col("r.source_fingerprint").eqNullSafe(F.col("b._print")),
    }
    problem = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in PROBLEMS:
        problem = problem.when(rules[name], name)
    return rows.select(F.coalesce("id", "source_sample_id").alias("id"), "b", "r", problem.alias("problem"))


def problems(pairs: DataFrame) -> DataFrame:
    """(id, problem) of the pairs that break a rule."""
    return pairs.where("problem is not null").select("id", "problem")


def expanded(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Originals (place 0) and paraphrases (place from 1), with ``kept`` false for those that were there before; of a pair with a problem, one row that names it."""
    every = F.concat(F.array(F.col("b.query")), F.coalesce("r.paraphrases", F.array().cast("array<string>")))
    rows = pairs.select("b", "r", "problem", F.posexplode(F.when(F.col("problem").isNull(), every).otherwise(F.array(F.lit(None).cast("string")))).alias("place", "text"))
    key = Window.partitionBy("b.image_id", "b.language", F.array_sort("b.target_ids"), identity(F.col("text"))).orderBy("b.position", "place")  # equal queries on the same targets
    rows = rows.withColumn("kept", F.col("problem").isNull() & ((F.row_number().over(key) == 1) | (F.col("place") == 0)))
    suffix = F.lpad(F.col("place").cast("string"), 2, "0")
    again = F.col("place") > 0
    new = {"id": F.when(again, F.concat("b.id", F.lit("-llm-"), suffix)).otherwise(F.col("b.id")), "query": F.col("text")}
    kept = [new.get(c, F.col(f"b.{c}")).alias(c) for c in columns]
    review = F.when((F.col("place") == 0) & F.col("r").isNotNull(), F.col("r.review_status").eqNullSafe("reviewed"))
    return rows.select(*kept, "place", F.when(again, "llm_paraphrase").otherwise("template").alias("method"), F.when(again, F.col("b.id")).alias("source_sample_id"), F.when(again, F.col("r.generator_model")).alias("generator_model"), "kept", "problem", review.alias("reviewed"))


def publish_merge(base: DataFrame, results: DataFrame, fingerprint: Column, path: str, least: int = 1, allow_unreviewed: bool = False) -> dict[str, int]:
    """Write the merged corpus and return its counters. All rules are counted in the pass that writes; the output takes its place only if none is broken and it has ``least`` rows."""
    spark, seen, written = base.sparkSession, Observation(), publish.aside(path)
    ok, again = F.col("problem").isNull(), F.col("place") > 0
    counters = {p: F.col("problem") == p for p in PROBLEMS} | {"base": ok & ~again, "rows": F.col("kept"), "skipped": ok & ~F.col("kept"), "paraphrases": F.col("kept") & again, "reviewed_results": F.col("reviewed"), "unreviewed_results": ~F.col("reviewed")}
    rows = expanded(joined(base, results, fingerprint, allow_unreviewed), base.columns).observe(seen, *[F.count_if(c).alias(name) for name, c in counters.items()])
    try:
        rows.where("kept").drop("kept", "place", "problem", "reviewed").write.json(written)
        found = seen.get
        broken = {p: found[p] for p in PROBLEMS if found[p]}
        if broken:
            raise ValueError(f"rules are broken: {broken}")
        if found["rows"] < least:
            raise ValueError(f"{found['rows']} rows; {least} are needed")
        publish.replace(spark, written, path)
    except Exception:
        publish.drop(spark, written)
        raise
    return found


def result_problems(jobs: DataFrame, results: DataFrame, models: list[str]) -> DataFrame:
    """(source_sample_id, problem): every rule that a generated result breaks against its job (source_sample_id, source_fingerprint, language, requested)."""
    own = jobs.select("source_sample_id", F.col("source_fingerprint").alias("j_print"), F.col("language").alias("j_language"), "requested").withColumn("known", F.lit(True))
    rows = results.join(own, "source_sample_id", "left")
    known = F.col("known").isNotNull()
    rules = {
        "unknown_job": ~known,
        "fingerprint": known & ~F.col("source_fingerprint").eqNullSafe(F.col("j_print")),
        "language": known & ~F.col("language").eqNullSafe(F.col("j_language")),
        "reviewed": ~F.col("review_status").eqNullSafe("unreviewed"),
        "model": ~F.coalesce(F.col("generator_model").isin(models), F.lit(False)),
        "too_many": known & (F.size("paraphrases") > F.col("requested")),
        "none": F.coalesce(F.size("paraphrases"), F.lit(0)) < 1,
    }
    return rows.select("source_sample_id", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("problem"))
