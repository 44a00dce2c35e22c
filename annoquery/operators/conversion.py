"""Conversion of annotations to a COCO bundle: validated boxes and masks, dense ids, counters, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .etl import renumber


def valid_xywh(box: Column) -> Column:
    """The box as doubles if it has four numbers and a positive size, else null."""
    numbers = F.transform(box, lambda v: v.try_cast("double"))
    ok = (F.size(box) == 4) & ~F.exists(numbers, lambda v: v.isNull()) & (F.get(numbers, F.lit(2)) > 0) & (F.get(numbers, F.lit(3)) > 0)
    return F.when(ok, numbers)


def xyxy_to_xywh(box: Column) -> Column:
    """Corners to origin and size; null unless there are four numbers and a positive size."""
    at = lambda i: F.get(box, F.lit(i))
    return F.when(F.size(box) == 4, valid_xywh(F.array(at(0), at(1), at(2) - at(0), at(3) - at(1))))


def mask_area_or_box(area: Column, box: Column) -> Column:
    """A positive area, else width times height of an xywh box."""
    return F.when(area > 0, area.cast("double")).otherwise(F.get(box, F.lit(2)) * F.get(box, F.lit(3)))


def valid_polygons(polygons: Column) -> Column:
    """Polygons of an even number of at least six numbers; null if none is left."""
    good = F.filter(polygons, lambda p: (F.size(p) >= 6) & (F.size(p) % 2 == 0) & ~F.exists(p, lambda v: v.isNull()))
    return F.when(F.size(good) > 0, good)


def loose_polygons(polygons: Column) -> Column:
    """Polygons with at least six numbers once missing ones are dropped, whatever their parity."""
    return F.filter(F.transform(polygons, lambda p: F.array_compact(p)), lambda p: F.size(p) >= 6)


def safe_path(name: Column) -> Column:
    """Whether a file name stays inside its folder: not absolute and without parent steps."""
    return ~name.rlike(r"^/|(^|/)\.\.(/|$)")


def category_name(annotations: DataFrame, categories: DataFrame, key: str = "category_id") -> DataFrame:
    """Adds ``category``: the name of the category, or <unknown:id>."""
    named = annotations.join(categories.select(F.col("id").alias(key), "name"), key, "left")
    return named.withColumn("category", F.coalesce("name", F.concat(F.lit("<unknown:"), F.col(key).cast("string"), F.lit(">")))).drop("name")


def first_images(images: DataFrame, n: int | None) -> DataFrame:
    """The first n images by file name, then id as text; all for None."""
    if n is not None and n < 0:
        raise ValueError("a limit can't be negative")
    return images if n is None else images.orderBy("file_name", F.col("image_id").cast("string")).limit(n)


def coco_ids(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images that keep an annotation, with dense ``new_image_id`` in name order, and their annotations with dense ids in image, then source order."""
    kept = images.join(annotations.select("image_id").distinct(), "image_id", "left_semi").withColumn("text_id", F.col("image_id").cast("string"))
    numbered = renumber(kept, ["file_name", "text_id"], "new_image_id").drop("text_id")
    rows = annotations.join(numbered.select("image_id", "new_image_id"), "image_id")
    return numbered, renumber(rows, ["new_image_id", "ann_id"], "new_ann_id")


def conversion_counters(mapped: DataFrame, kept: DataFrame, classes: list[str]) -> DataFrame:
    """(counter, n): input and output rows, reasons for drops, and annotations of each class, zeros included."""
    before = mapped.agg(
        F.count("*").alias("annotations_in"), F.countDistinct("image_id").alias("images_in"), F.count_if("iscrowd").alias("crowd_in"),
        *[F.count_if(F.col("reason") == r).alias(f"dropped_{r}") for r in ("ambiguous_main_apparel", "garment_part", "unknown")],
    )
    after = kept.agg(F.count("*").alias("annotations_out"), F.countDistinct("image_id").alias("images_out"), *[F.count_if(F.col("target") == c).alias(f"class_{c}") for c in classes])
    return before.unpivot([], before.columns, "counter", "n").unionAll(after.unpivot([], after.columns, "counter", "n"))


def integrity_problems(records: DataFrame, annotations: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(sample_id, ann_id, problem) of records' targets (sample_id, image_id, ann_id, label, x0..y1) against their source annotations."""
    corners = ("x0", "y0", "x1", "y1")
    source = annotations.groupBy("ann_id").agg(F.count("*").alias("n"), F.min(F.struct("image_id", "category", *corners)).alias("s"))
    both = records.join(source, "ann_id", "left")
    moved = F.greatest(*[F.abs(F.col(c) - F.col(f"s.{c}")) for c in corners]) > tolerance
    rules = {"missing": F.col("n").isNull(), "repeated": F.col("n") > 1, "other_image": F.col("s.image_id") != F.col("image_id"), "other_label": F.col("s.category") != F.col("label"), "moved": moved}
    return both.select("sample_id", "ann_id", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("problem"))


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids that more than one row has, with how many."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def containers(parts: DataFrame, garments: DataFrame, coverage: Column) -> DataFrame:
    """(part, garment) of the parts that lie in exactly one garment of their image. ``coverage`` is a condition on both."""
    inside = parts.join(garments, "image_id").where(coverage)
    return inside.groupBy("part").agg(F.count("*").alias("n"), F.min("garment").alias("garment")).where("n = 1").select("part", "garment")


def extrema(rows: DataFrame, width: float, height: float, least: float = 0.05) -> DataFrame:
    """(image_id, category, modifier, ann_id, ambiguous): the outermost row in each of four directions of groups of at least two.

    ``ambiguous`` where the next one is closer than a share ``least`` of the axis; ties go by ``ann_id``.
    """
    centres = {"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2}
    item = lambda c, sign: F.struct((sign * centres[c]).alias("at"), F.col("ann_id"))
    two = lambda c, sign: F.slice(F.array_sort(F.collect_list(item(c, sign))), 1, 2)
    groups = rows.groupBy("image_id", "category").agg(*[two(c, sign).alias(name) for name, c, sign in (("left", "x", 1), ("right", "x", -1), ("upper", "y", 1), ("lower", "y", -1))], F.count("*").alias("n")).where("n > 1")
    each = F.array(*[F.struct(F.lit(name).alias("modifier"), F.col(name).alias("two"), F.lit(float(size)).alias("size")) for name, size in (("left", width), ("right", width), ("upper", height), ("lower", height))])
    out = groups.select("image_id", "category", F.explode(each).alias("e"))
    gap = F.get("e.two", F.lit(1))["at"] - F.get("e.two", F.lit(0))["at"]
    return out.select("image_id", "category", "e.modifier", F.get("e.two", F.lit(0))["ann_id"].alias("ann_id"), (gap < least * F.col("e.size")).alias("ambiguous"))


def expected_counts(actual: DataFrame, quota: DataFrame) -> DataFrame:
    """(axis, value, required, have) where the counts (axis, value, n) differ from a quota (axis, value, required), on either side."""
    both = quota.join(actual, ["axis", "value"], "full").select("axis", "value", F.coalesce("required", F.lit(0)).alias("required"), F.coalesce("n", F.lit(0)).alias("have"))
    return both.where("required <> have")


def repeat_sources(sources: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Union of sources, each row as often as its source's factor says, with ``source`` and ``copy``."""
    out = None
    for name, (rows, times) in sources.items():
        part = rows.withColumn("source", F.lit(name)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))) if times > 0 else rows.limit(0).withColumn("source", F.lit(name)).withColumn("copy", F.lit(0))
        out = part if out is None else out.unionByName(part)
    return out


def epoch_batches(ids: DataFrame, key: str, epochs: int, batch: int, seed: str) -> DataFrame:
    """(epoch, batch, key): every epoch holds each id once, in an order of its own; the numbering is without one task for all ids."""
    rows = ids.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    rows = rows.withColumn("at", F.sha2(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col(key).cast("string")), 256))
    size = ids.agg(F.count("*").alias("size"))  # one row
    numbered = renumber(rows, ["epoch", "at", key], "place").join(F.broadcast(size), F.lit(True))
    return numbered.select("epoch", F.floor(F.pmod(F.col("place") - 1, F.col("size")) / batch).cast("long").alias("batch"), key)
