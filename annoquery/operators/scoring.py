"""Scores and choices over pairs, candidates and saved predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import box
from ..functions.text import percent, stable_rank
from .etl import renumber


def above_thresholds(predictions: DataFrame, thresholds: dict[str, float], default: float) -> DataFrame:
    """Predictions that reach the threshold of their category, or the default; missing scores count as 0."""
    table = F.create_map(*[F.lit(v) for pair in thresholds.items() for v in pair]) if thresholds else F.create_map(F.lit(""), F.lit(default))
    return predictions.where(F.coalesce("score", F.lit(0.0)) >= F.coalesce(F.try_element_at(table, F.col("category")), F.lit(default)))


def inside_subject(predictions: DataFrame, subjects: DataFrame, least: float = 0.05) -> DataFrame:
    """Predictions whose centre lies in their image's subject (image_id, s_x0..s_y1) and that overlap it by a share of their own area."""
    both = predictions.join(subjects, "image_id")
    centre = lambda k: (F.col(f"{k}0") + F.col(f"{k}1")) / 2
    held = centre("x").between(F.col("s_x0"), F.col("s_x1")) & centre("y").between(F.col("s_y0"), F.col("s_y1"))
    return both.where(held & (box.coverage("", "s_") >= least)).select(*predictions.columns)


def suppress_duplicates(boxes: DataFrame, least: float = 0.7, most: int = 2) -> DataFrame:
    """Of each image, boxes by falling score that overlap no kept box by ``least`` or more, up to ``most``; one small array an image."""
    fields = ("pred_id", "x0", "y0", "x1", "y1")
    item = F.struct((-F.col("score")).alias("k"), *fields)
    side = lambda a, b, c: F.greatest(F.lit(0.0), F.least(a[f"{c}1"], b[f"{c}1"]) - F.greatest(a[f"{c}0"], b[f"{c}0"]))
    area = lambda a: (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    iou = lambda a, b: side(a, b, "x") * side(a, b, "y") / (area(a) + area(b) - side(a, b, "x") * side(a, b, "y"))
    groups = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.slice("items", 1, 0)
    fold = F.aggregate("items", none, lambda kept, x: F.when((F.size(kept) >= most) | F.exists(kept, lambda m: F.round(iou(m, x), 9) >= least), kept).otherwise(F.concat(kept, F.array(x))))
    return groups.select("image_id", F.posexplode(fold).alias("place", "b")).select("image_id", "place", "b.pred_id")


def without_conflicts(boxes: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes less the ``whole_id`` of conflicts, and per category how many were there, taken and kept."""
    gone = conflicts.select(F.col("whole_id").alias("pred_id")).distinct().withColumn("gone", F.lit(True))
    marked = boxes.join(gone, "pred_id", "left")
    report = marked.groupBy("category").agg(F.count("*").alias("before"), F.count("gone").alias("suppressed"), F.count_if(F.col("gone").isNull()).alias("after"))
    return marked.where("gone is null").drop("gone"), report


def spatial_choice(boxes: DataFrame, modifier: Column) -> DataFrame:
    """The one box of each query that its direction names: outermost by centre, then surer; all boxes for queries without one."""
    cx, cy = F.col("x0") + F.col("x1"), F.col("y0") + F.col("y1")
    rank = F.when(modifier == "left", cx).when(modifier == "right", -cx).when(modifier == "upper", cy).when(modifier == "lower", -cy)
    order = Window.partitionBy("query_id").orderBy("place", F.desc("score"), "pred_id")
    return boxes.withColumn("place", rank).withColumn("rn", F.row_number().over(order)).where("place is null or rn = 1").drop("place", "rn")


def best_of_class(boxes: DataFrame) -> DataFrame:
    """The surest prediction of each category, the smaller id on ties; combines before the shuffle."""
    best = F.max(F.struct("score", (-F.col("pred_id")).alias("id"))).alias("b")
    return boxes.groupBy("category").agg(best).select("category", (-F.col("b.id")).alias("pred_id"), "b.score")


def detected_and_missed(truth: DataFrame, predictions: DataFrame, seed: str) -> DataFrame:
    """Per category one image with a prediction of it and one without, the first by hash, with all reasons of an image together."""
    images = truth.select("image_id", "category").distinct()
    seen = predictions.select("image_id", "category").distinct().withColumn("seen", F.lit("detected"))
    marked = images.join(seen, ["image_id", "category"], "left").withColumn("status", F.coalesce("seen", F.lit("missed")))
    first = marked.groupBy("category", "status").agg(F.min(F.struct(stable_rank(seed, "image_id").alias("h"), "image_id")).alias("m"))
    return first.groupBy(F.col("m.image_id").alias("image_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "category", "status"))), ",").alias("reasons"))


def retrieval_report(ranked: DataFrame, axis: Column) -> DataFrame:
    """By axis value, and for all and for queries with a negative candidate: top-1, exact set, mean reciprocal rank. ``ranked`` has query_id, positive, rank."""
    positives = F.count_if("positive")
    each = ranked.groupBy("query_id", axis.alias("value")).agg(positives.alias("targets"), F.min(F.when(F.col("positive"), F.col("rank"))).alias("first"), F.collect_list(F.when(F.col("positive"), F.col("rank"))).alias("ranks"), F.count("*").alias("n"))
    each = each.withColumn("exact", F.array_max("ranks") <= F.col("targets")).withColumn("scope", F.explode(F.when(F.col("n") > F.col("targets"), F.array(F.lit("all"), F.lit("competitive"))).otherwise(F.array(F.lit("all")))))
    return each.groupBy("scope", "value").agg(F.count("*").alias("queries"), percent(F.count_if(F.col("first") == 1), F.count("*")).alias("top1"), percent(F.count_if("exact"), F.count("*")).alias("exact_set"), F.round(F.avg(1 / F.col("first")), 6).alias("mrr"))


def negative_pair_audit(rows: DataFrame) -> DataFrame:
    """One row of ordered pair counts of (image_id, label) rows: same image, other image with the other or the same label, and images with several rows.

    All from group sizes, without making the pairs.
    """
    n = rows.groupBy("image_id", "label").agg(F.count("*").alias("n"))
    square = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("s"))
    by_image = n.groupBy("image_id").agg(F.sum("n").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("image"), F.sum("m").alias("rows"), F.count_if(F.col("m") > 1).alias("competitive_images"))
    out = by_image.join(square(n, "label").withColumnRenamed("s", "label"), how="cross").join(n.agg(F.sum(F.col("n") * F.col("n")).alias("both")), how="cross")  # one row each
    return out.select((F.col("image") - F.col("rows")).alias("same_image"), (F.col("rows") * F.col("rows") - F.col("image") - F.col("label") + F.col("both")).alias("other_label"), (F.col("label") - F.col("both")).alias("same_label"), "competitive_images")


def contrastive_loss(pairs: DataFrame, temperature: float = 0.07) -> DataFrame:
    """One row: symmetric multi-positive InfoNCE over (query_id, region_id, positive, score), by log-sum-exp in both directions."""
    x = F.col("score") / temperature

    def one_way(key: str) -> DataFrame:
        top = pairs.groupBy(key).agg(F.max(x).alias("top"))
        sums = pairs.join(top, key).groupBy(key, "top").agg(F.sum(F.exp(x - F.col("top"))).alias("all"), F.sum(F.when(F.col("positive"), F.exp(x - F.col("top")))).alias("some"))
        return sums.where("some > 0").agg(F.avg(F.log("all") - F.log("some")).alias(f"by_{key}"), F.count("*").alias(f"n_{key}"))

    both = one_way("query_id").join(one_way("region_id"), how="cross")  # one row each
    return both.select("n_query_id", "n_region_id", F.round((F.col("by_query_id") + F.col("by_region_id")) / 2, 6).alias("loss"))


def embedding_parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: largest and mean absolute error and mean cosine of two tables (key, embedding) on their common keys."""
    both = left.select(key, F.col("embedding").alias("a")).join(right.select(key, F.col("embedding").alias("b")), key)
    error = F.zip_with("a", "b", lambda p, q: F.abs(p.cast("double") - q.cast("double")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    product = lambda p, q: total(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")))
    rows = both.select(F.array_max(error).alias("most"), (total(error) / F.size("a")).alias("mean"), F.try_divide(product("a", "b"), F.sqrt(product("a", "a")) * F.sqrt(product("b", "b"))).alias("cosine"))
    return rows.agg(F.count("*").alias("n"), F.round(F.max("most"), 6).alias("max_error"), F.round(F.avg("mean"), 6).alias("mean_error"), F.round(F.avg("cosine"), 6).alias("mean_cosine"))


def donors(rows: DataFrame, key: str, image: str, label: str, seed: str, attributes: str | None = None, needs: Column | None = None) -> DataFrame:
    """(key, donor): for each row another row of its label in another image, each equally likely by hash; null where there is none.

    Where ``needs`` holds, the donor has the row's ``attributes`` as well.
    """
    plain = _of_other_images(rows, key, image, [label], seed)
    if attributes is None:
        return plain
    strict = _of_other_images(rows.where(F.col(attributes).isNotNull()), key, image, [label, attributes], seed).withColumnRenamed("donor", "strict")
    marked = rows.select(key, F.coalesce(needs, F.lit(False)).alias("needs"))
    return marked.join(plain, key, "left").join(strict, key, "left").select(key, F.when(F.col("needs"), F.col("strict")).otherwise(F.col("donor")).alias("donor"))


def _of_other_images(rows: DataFrame, key: str, image: str, by: list[str], seed: str) -> DataFrame:
    """A group's rows stand in one order in which those of an image follow each other. A row's donor is, by its hash, one of the places after its image's, round the group."""
    hashed = rows.select(key, image, *by, stable_rank(seed, image).alias("_i"), stable_rank(seed, key).alias("_k"))
    placed = renumber(hashed, [*by, "_i", image, "_k", key], "_place")
    groups = placed.groupBy(*by).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    images = placed.groupBy(*by, image).agg(F.max("_place").alias("_last"), F.count("*").alias("_own"))
    others = F.col("_n") - F.col("_own")
    draw = F.when(others > 0, F.conv(F.substring("_k", 1, 8), 16, 10).cast("bigint") % others)
    target = F.col("_first") + (F.col("_last") - F.col("_first") + 1 + draw) % F.col("_n")
    receivers = placed.join(groups, by, "left").join(images, [*by, image], "left").select(key, target.alias("_place"))
    return receivers.join(placed.select("_place", F.col(key).alias("donor")), "_place", "left").select(key, "donor")


def quantile_masks(cells: DataFrame, key: str, quantiles: list[float]) -> DataFrame:
    """(key, quantile, threshold, kept): per score map and quantile, the interpolated threshold and how many cells reach it."""
    points = F.percentile("score", F.array(*map(F.lit, quantiles)))
    cut = cells.groupBy(key).agg(points.alias("t")).select(key, F.explode(F.arrays_zip(F.array(*map(F.lit, quantiles)).alias("q"), "t")).alias("z"))
    cut = cut.select(key, F.col("z.q").alias("quantile"), F.col("z.t").alias("threshold"))
    return cells.join(cut, key).groupBy(key, "quantile", "threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("kept"))


def next_with_status(rows: DataFrame, after: int, status: str) -> DataFrame:
    """One row: the id of the next row with a status after a place, wrapping at the end; null if there is none."""
    n = rows.agg(F.max("place").alias("top"))
    wanted = rows.where(F.col("status") == status).join(n, how="cross")  # one row
    return wanted.agg(F.min_by("place", F.pmod(F.col("place") - after - 1, F.col("top") + 1)).alias("place"))


def stage_latency(rows: DataFrame, target: float) -> DataFrame:
    """Rows, mean and p95 of (route, stage, ms) by route and stage, by route, and over all, and whether p95 keeps the target."""
    out = rows.rollup("route", "stage").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.percentile("ms", F.lit(0.95)), 6).alias("p95_ms"))
    return out.select(F.coalesce("route", F.lit("all")).alias("route"), F.coalesce("stage", F.lit("all")).alias("stage"), "n", "mean_ms", "p95_ms", (F.col("p95_ms") <= target).alias("met"))
