"""Rows of saved predictions: thresholds, boxes from masks, crop offsets, clamped scores, COCO results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masks import mask_area, tight_box
from .scoring import above_thresholds

BOX = ("x0", "y0", "x1", "y1")


def moved_polygons(polygons: Column, dx: Column | float, dy: Column | float) -> Column:
    """Polygons (x, y, x, y ...) of a crop in the coordinates of its image."""
    dx, dy = (F.lit(v) if isinstance(v, (int, float)) else v for v in (dx, dy))
    return F.transform(polygons, lambda p: F.transform(p, lambda v, i: v.cast("double") + F.when(i % 2 == 0, dx).otherwise(dy)))


def instance_rows(instances: DataFrame, runs: DataFrame, thresholds: dict[str, float], default: float, dx: Column | float = 0.0, dy: Column | float = 0.0) -> DataFrame:
    """Instances (pred_id, category, score, box) that reach their class's threshold, the bound included. A box without a size gives way to the mask's; boxes are moved by a crop's offset.

    ``runs`` are the masks' row runs by ``pred_id``. An instance with neither a box nor a mask has null corners.
    """
    kept = above_thresholds(instances, thresholds, default)
    mask = tight_box(runs, ["pred_id"]).select("pred_id", *(F.col(c).cast("double").alias(f"m_{c}") for c in BOX))
    valid = F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.lit(False))
    shift = {"x": F.lit(dx) if isinstance(dx, (int, float)) else dx, "y": F.lit(dy) if isinstance(dy, (int, float)) else dy}
    corners = [(F.when(valid, F.col(c)).otherwise(F.col(f"m_{c}")) + shift[c[0]]).alias(c) for c in BOX]
    return kept.join(mask, "pred_id", "left").select(*[c for c in kept.columns if c not in BOX], *corners)


def mask_regions(regions: DataFrame, runs: DataFrame, key: str, least: int, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Regions (key, confidence, ...) whose mask has ``least`` pixels or more, with the mask's box, moved, and the confidence between 0 and 1."""
    sized = mask_area(runs, [key]).where(F.col("pixels") >= least).join(tight_box(runs, [key]), key)
    moved = [(F.col(c).cast("double") + (dx if c[0] == "x" else dy)).alias(c) for c in BOX]
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence")
    rest = [c for c in regions.columns if c not in (*BOX, "confidence", key)]
    return regions.select(key, "confidence", *rest).join(sized, key).select(key, *rest, clamped, "pixels", *moved)


def coco_results(predictions: DataFrame, category_ids: Column) -> DataFrame:
    """COCO result rows of predictions (image_id, regions array of label, confidence, box, mask): regions without a polygon of six numbers, a box of positive size or a category go."""
    rows = predictions.select("image_id", F.explode("regions").alias("r")).withColumn("segmentation", F.filter("r.mask", lambda p: F.size(p) >= 6))
    w, h = F.col("r.box.x1") - F.col("r.box.x0"), F.col("r.box.y1") - F.col("r.box.y0")
    named = rows.withColumn("category_id", category_ids).where((F.size("segmentation") > 0) & (w > 0) & (h > 0) & F.col("category_id").isNotNull())
    return named.select("image_id", "category_id", F.array(F.col("r.box.x0"), F.col("r.box.y0"), w, h).alias("bbox"), F.col("r.confidence").alias("score"), "segmentation")


def item_conversion(images: DataFrame, items: DataFrame) -> DataFrame:
    """One row of counters: images (those without items as well), annotations, and items that are skipped for want of a class, a polygon or a box (``target``, ``polygons``, ``bbox``)."""
    fit = F.col("target").isNotNull() & (F.coalesce(F.size("polygons"), F.lit(0)) > 0) & F.col("bbox").isNotNull()
    known = items.join(images.select("image_id"), "image_id", "left_semi")
    return images.agg(F.count("*").alias("images")).join(known.agg(F.count_if(fit).alias("annotations"), F.count_if(~fit).alias("skipped")), F.lit(True))
