"""Choice of images that meet requirements on their annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_images_that_meet(images: DataFrame, annotations: DataFrame, requirements: DataFrame) -> DataFrame:
    """(concept, image_id, alternative): the first image by file name that has all that the earliest possible alternative asks for; no row where none has.

    Requirements are (concept, alternative, category, n). An image meets an alternative if it meets as many of its rows as there are.
    """
    wanted = requirements.groupBy("concept", "alternative").agg(F.count("*").alias("rows"))
    counts = annotations.groupBy("image_id", "category").agg(F.count("*").alias("have"))
    met = counts.join(F.broadcast(requirements), "category").where("have >= n").groupBy("concept", "alternative", "image_id").agg(F.count("*").alias("met"))
    whole = met.join(F.broadcast(wanted), ["concept", "alternative"]).where("met = rows").join(images.select("image_id", "file_name"), "image_id")
    best = whole.groupBy("concept").agg(F.min(F.struct("alternative", "file_name", "image_id")).alias("m"))
    return best.select("concept", "m.image_id", "m.alternative")


def targets_of(chosen: DataFrame, annotations: DataFrame, pick: DataFrame) -> DataFrame:
    """(concept, ann_id): targets in the chosen images; ``pick`` (concept, category, rule) takes all of a category, the ``rightmost`` or the ``lowest`` by its box's centre, the first on ties."""
    rows = annotations.join(F.broadcast(chosen.join(pick, "concept").withColumnRenamed("category", "wanted")), "image_id").where("category = wanted")
    at = F.when(F.col("rule") == "rightmost", F.col("x0") + F.col("x1")).when(F.col("rule") == "lowest", F.col("y0") + F.col("y1"))
    one = rows.where("rule <> 'all'").groupBy("concept").agg(F.max(F.struct(at.alias("at"), (-F.col("ann_id")).alias("down"))).alias("m")).select("concept", (-F.col("m.down")).alias("ann_id"))
    return rows.where("rule = 'all'").select("concept", "ann_id").unionAll(one)
