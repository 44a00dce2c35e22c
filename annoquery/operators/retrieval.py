"""Same-image candidate retrieval on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rank_candidates(queries: DataFrame, regions: DataFrame) -> DataFrame:
    """Every candidate region of a query's image with its cosine and rank; ties by region id."""
    pairs = queries.select("image_id", "query_id", F.col("label").alias("q_label"), F.col("embedding").alias("q")).join(regions.select("image_id", "region_id", "label", F.col("embedding").alias("r")), "image_id")
    scored = pairs.select("query_id", "region_id", (F.col("label") == F.col("q_label")).alias("positive"), F.round(cosine("q", "r"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "region_id")))


def retrieval_metrics(ranked: DataFrame) -> DataFrame:
    """Per query: positives, rank of the first one, and whether the top as many are exactly them."""
    positives = ranked.withColumn("targets", F.sum(F.col("positive").cast("int")).over(Window.partitionBy("query_id")))
    inside = F.sum((F.col("positive") & (F.col("rank") <= F.col("targets"))).cast("int"))
    return positives.groupBy("query_id").agg(F.max("targets").cast("long").alias("targets"), F.min(F.when(F.col("positive"), F.col("rank"))).cast("long").alias("first_rank"), (inside == F.max("targets")).alias("exact_set"))


def positive_pairs(queries: DataFrame, regions: DataFrame) -> DataFrame:
    """(query_id, ann_id) where a query (query_id, target_ids) names a region (ann_id): the positive cells of the matrix, as a table."""
    named = queries.select("query_id", F.explode(F.array_distinct("target_ids")).alias("ann_id"))
    return named.join(regions.select("ann_id").distinct(), "ann_id", "left_semi").select("query_id", "ann_id")


def matrix_problems(queries: DataFrame, regions: DataFrame) -> DataFrame:
    """(kind, id, problem): queries without targets or with targets that are no regions, regions of no query, and ids that rows repeat."""
    named = queries.select("query_id", F.explode(F.array_distinct("target_ids")).alias("ann_id"))
    known = regions.select("ann_id").distinct()
    problem = lambda rows, kind, key, name: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.lit(name).alias("problem"))
    twice = lambda rows, key: rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return (
        problem(queries.where(F.coalesce(F.size("target_ids"), F.lit(0)) < 1), "query", "query_id", "no_target")
        .unionAll(problem(named.join(known, "ann_id", "left_anti").select("query_id").distinct(), "query", "query_id", "unknown_target"))
        .unionAll(problem(known.join(named, "ann_id", "left_anti"), "region", "ann_id", "no_query"))
        .unionAll(problem(twice(queries, "query_id"), "query", "query_id", "repeated"))
        .unionAll(problem(twice(regions, "ann_id"), "region", "ann_id", "repeated"))
    )


def unique_targets(rows: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Targets (image_id, ann_id, fields) once each, and the (image_id, ann_id) whose repeated rows differ."""
    each = rows.groupBy("image_id", "ann_id").agg(F.min(F.struct(*fields)).alias("low"), F.max(F.struct(*fields)).alias("high"))
    same = F.col("low").eqNullSafe(F.col("high"))
    return each.where(same).select("image_id", "ann_id", "low.*"), each.where(~same).select("image_id", "ann_id")
