"""Annotation ETL: taxonomy mapping, image-level drops, subsets, renumbering, audit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import checkpointed


def map_category(rows: DataFrame, taxonomy: dict[str, str], ambiguous: set[str], parts: set[str]) -> DataFrame:
    """Adds ``target`` (null if unmapped) and ``reason`` (why a row is not mapped). The taxonomy is a fixed small table."""
    name = F.trim(F.regexp_replace(F.lower("category"), r"\s+", " "))
    lookup = F.create_map(*[F.lit(v) for pair in taxonomy.items() for v in pair])
    target = F.try_element_at(lookup, name)
    reason = F.when(name.isin(sorted(ambiguous)), "ambiguous_main_apparel").when(name.isin(sorted(parts)), "garment_part").when(target.isNull(), "unknown")
    return rows.withColumn("target", target).withColumn("reason", reason)


def drop_ambiguous_images(mapped: DataFrame) -> DataFrame:
    """All annotations of images without an ambiguous one."""
    bad = mapped.where(F.col("reason") == "ambiguous_main_apparel").select("image_id").distinct()
    return mapped.join(bad, "image_id", "left_anti")


def audit_counts(mapped: DataFrame) -> DataFrame:
    """Per target class (or drop reason): annotations and images, from one aggregate."""
    label = F.coalesce("target", F.concat(F.lit("dropped:"), "reason"))
    return mapped.groupBy(label.alias("label")).agg(F.count("*").alias("annotations"), F.countDistinct("image_id").alias("images"), F.sum(F.col("iscrowd").cast("long")).alias("crowd"))


def images_with(rows: DataFrame, condition: Column) -> DataFrame:
    """All annotations of the images where some annotation meets a condition."""
    return rows.join(rows.where(condition).select("image_id").distinct(), "image_id", "left_semi")


def first_images_per_class(rows: DataFrame, n: int) -> DataFrame:
    """Distinct union of the first n image ids of every class."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy("image_id"))
    return rows.select("category", "image_id").distinct().withColumn("rn", rank).where(F.col("rn") <= n).select("image_id").distinct()


def renumber(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Dense numbers 1..n in a global order without one task seeing all rows.

    Rows are range-partitioned, sorted and checkpointed with their place in the partition, so a recomputed task can't
    draw other ranges; per-partition counts give the offsets. Columns may be names or expressions.
    """
    place = F.monotonically_increasing_id()  # partition in the upper 31 bits, row in the lower 33
    kept = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    kept = kept.select(*rows.columns, F.shiftright("_place", 33).alias("_part"), F.col("_place").bitwiseAND((1 << 33) - 1).alias("_row"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = kept.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_row") + 1).drop("_part", "_row", "_offset")
