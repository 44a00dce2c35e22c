"""Outcomes of grounding cases and the reports over them; each rate has the denominator of the rows it applies to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import percent
from .masks import rectangle_masks, union_masks, with_common


def case_outcomes(cases: DataFrame, targets: DataFrame, regions: DataFrame, matches: DataFrame) -> DataFrame:
    """cases (case_id, status, expected) with counts of targets, regions and matches, and what passed.

    Unlabelled cases are not scored (null), negative ones pass without any region, the others if every target is matched.
    An expected count, where there is one, must be met as well.
    """
    out = cases
    for name, rows in (("targets", targets), ("regions", regions), ("matched", matches)):
        out = out.join(rows.groupBy("case_id").agg(F.count("*").alias(name)), "case_id", "left")
    positive = F.col("status").isin("mask", "box")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("case_id", "status", "expected", n("regions"), *[F.when(positive, n(c)).otherwise(0).alias(c) for c in ("targets", "matched")])
    count_passed = F.when(F.col("expected").isNotNull(), F.col("regions") == F.col("expected"))
    recalled = F.when(F.col("status") == "negative", F.col("regions") == 0).when(positive, F.col("matched") == F.col("targets"))
    out = out.withColumn("count_passed", count_passed).withColumn("recall_passed", recalled)
    return out.withColumn("query_passed", F.when(positive, F.col("recall_passed") & F.coalesce("count_passed", F.lit(True))).otherwise(F.col("recall_passed")))


def by_axes(rows: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """Each row once overall and once for every value of every axis; an axis is an array, as a row can be in several groups."""
    one = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("axis"), v.cast("string").alias("value")))
    groups = F.concat(one("overall", F.array(F.lit("all"))), *[F.coalesce(one(k, v), F.array()) for k, v in axes.items()])
    return rows.withColumn("g", F.explode(groups)).select("*", "g.axis", "g.value").drop("g")


def case_report(outcomes: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """Success rates of ``case_outcomes`` by axis: of scored, positive, negative and count-checked cases, and the pooled match counts."""
    rate = lambda condition, of: percent(F.count_if(condition & of), F.count_if(of))
    scored, positive, negative = F.col("status") != "unlabelled", F.col("status").isin("mask", "box"), F.col("status") == "negative"
    total = lambda c: F.sum(F.when(positive, F.col(c)).otherwise(0))
    return by_axes(outcomes, axes).groupBy("axis", "value").agg(
        F.count("*").alias("cases"),
        F.count_if(scored).alias("scored"),
        rate(F.col("query_passed"), scored).alias("query_success"),
        rate(F.col("recall_passed"), positive).alias("target_recall"),
        rate(F.col("count_passed"), F.col("expected").isNotNull()).alias("count_success"),
        rate(F.col("regions") > 0, negative).alias("false_positives"),
        rate(F.col("regions") == 0, F.lit(True)).alias("empty"),
        percent(total("matched"), total("regions")).alias("precision"),
        percent(total("matched"), total("targets")).alias("recall"),
    )


def first_region_outcomes(targets: DataFrame, regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, targets, regions, iou, passed: the region of highest score against the union of the targets' masks.

    The threshold must be exceeded; images without a region stay, with an IoU of 0.
    """
    of_image = Window.partitionBy("image_id")
    ranked = regions.withColumn("rank", F.row_number().over(of_image.orderBy(F.desc("score"), "pred_id"))).withColumn("regions", F.count("*").over(of_image))
    blocks = F.when(F.expr("x1 > x0 and y1 > y0"), F.array(*[F.col(c).cast("int") for c in ("y0", "y1", "x0", "x1")]))
    own = F.when(F.expr("x1 > x0 and y1 > y0"), F.expr("cast((x1 - x0) * (y1 - y0) as bigint)"))
    first = ranked.where("rank = 1").select("image_id", "regions", own.alias("own"), blocks.alias("first"))
    whole = union_masks(targets.select("image_id", blocks.alias("blocks")), ["image_id"]).select("image_id", F.col("masks").alias("targets"), F.col("pixels").alias("area"), F.col("blocks").alias("whole"))
    cases = with_common(whole.join(first, "image_id", "left"), "first", "whole")
    iou = F.when(F.col("common") > 0, F.round(F.col("common") / (F.col("own") + F.col("area") - F.col("common")), 9))
    out = cases.select("image_id", "targets", F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce(iou, F.lit(0.0)).alias("iou"))
    return out.withColumn("passed", F.col("iou") > threshold)


def acceptance_report(outcomes: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """Pass rate and mean IoU of ``first_region_outcomes`` by axis."""
    return by_axes(outcomes, axes).groupBy("axis", "value").agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), percent(F.count_if("passed"), F.count("*")).alias("accuracy"), F.round(100 * F.avg("iou"), 6).alias("mean_iou")
    )


def variant_scores(rows: DataFrame) -> DataFrame:
    """rows (variant, iou, predicted_area, target_area): recalls, mean IoU and median area ratio of each variant; misses have an IoU of 0."""
    return rows.groupBy("variant").agg(
        F.count("*").alias("queries"),
        F.count_if(F.col("iou") >= 0.5).alias("recall50_count"),
        percent(F.count_if(F.col("iou") >= 0.5), F.count("*")).alias("recall50"),
        percent(F.count_if(F.col("iou") >= 0.75), F.count("*")).alias("recall75"),
        F.round(F.avg("iou"), 6).alias("mean_iou"),
        F.round(F.median(F.col("predicted_area") / F.col("target_area")), 6).alias("median_area_ratio"),
    )


def macro_recall(overlaps: DataFrame, by: str, least: float = 92.0) -> DataFrame:
    """One row: the mean over classes of their recall at IoU 0.5, in percent, against a required value; null without classes."""
    each = overlaps.groupBy(by).agg((100 * F.count_if(F.col("best") >= 0.5) / F.count("*")).alias("recall"))
    return each.agg(F.count("recall").alias("classes"), F.round(F.avg("recall"), 6).alias("macro_recall"), (F.avg("recall") >= least).alias("accepted"))


def crop_coverage(targets: DataFrame, crops: DataFrame, ks: list[int], pixels: int) -> DataFrame:
    """image_id, ann_id, k, coverage, crop_area: the share of a target that the first k crops of its image cover together,
    and the share of the image's pixels in them. crops have image_id, rank and corners inside the image."""
    nested = crops.where("image_id is not null").withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank"))))
    blocks = F.array(*[F.col(c).cast("int") for c in ("y0", "y1", "x0", "x1")])
    union = union_masks(nested.where("x1 > x0 and y1 > y0").select("image_id", "k", blocks.alias("blocks")), ["image_id", "k"], 1).select("image_id", "k", F.col("pixels").alias("cropped"), F.col("blocks").alias("crop"))
    own = rectangle_masks(targets, "ann_id").select("image_id", "ann_id", "pixels", "blocks")
    out = with_common(own.join(union, "image_id"), "blocks", "crop")
    return out.select("image_id", "ann_id", "k", F.round(F.col("common") / F.col("pixels"), 9).alias("coverage"), F.round(F.col("cropped") / pixels, 9).alias("crop_area"))


def coverage_summary(rows: DataFrame) -> DataFrame:
    """Of ``crop_coverage``, by k: the share of targets covered by half and by nine tenths, and the mean area of the crops."""
    share = lambda x: percent(F.count_if(F.col("coverage") >= x), F.count("*"))
    return rows.groupBy("k").agg(F.count("*").alias("targets"), share(0.5).alias("c50"), share(0.9).alias("c90"), F.round(100 * F.avg("crop_area"), 6).alias("mean_crop_area"))
