"""Prediction evaluation: pairwise overlap, one-to-one matching, summaries, sweeps, average precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import box
from ..functions.text import percent
from .etl import renumber


def prefixed(rows: DataFrame, prefix: str, keep: tuple[str, ...] = ("image_id", "category")) -> DataFrame:
    return rows.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in rows.columns])


def iou_pairs(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Overlapping (prediction, annotation) pairs of the same image and category with their IoU."""
    pairs = prefixed(predictions, "p_").join(prefixed(truth, "g_"), ["image_id", "category"])
    return pairs.withColumn("iou", F.round(box.iou("p_", "g_"), 9)).where("iou > 0")


def _in_turn(pairs: Column) -> Column:
    """Those of the sorted pairs (k, p, g) whose prediction and annotation no earlier one took."""
    empty = F.array().cast("array<struct<k:double,p:bigint,g:bigint>>")
    taken = lambda acc, x, side: F.exists(acc, lambda m: m[side] == x[side])
    return F.aggregate(pairs, empty, lambda acc, x: F.when(taken(acc, x, "p") | taken(acc, x, "g"), acc).otherwise(F.concat(acc, F.array(x))))


def _pair() -> Column:
    return F.struct((-F.col("iou")).alias("k"), F.col("p_pred_id").alias("p"), F.col("g_ann_id").alias("g"))


def greedy_match(pairs: DataFrame, least: float = 0.5, keys: tuple[str, ...] = ("image_id", "category")) -> DataFrame:
    """One-to-one matches in each group by falling IoU, ties by prediction then annotation; the pairs of a group are folded as one small array."""
    items = F.array_sort(F.collect_list(_pair()))
    grouped = pairs.where(F.col("iou") >= least).groupBy(*keys).agg(items.alias("items")).select(*keys, F.explode(_in_turn(F.col("items"))).alias("m"))
    return grouped.select(*keys, F.col("m.p").alias("pred_id"), F.col("m.g").alias("ann_id"), (-F.col("m.k")).alias("iou"))


def match_summary(truth: DataFrame, predictions: DataFrame, matches: DataFrame, by: str) -> DataFrame:
    """Per group: counts, precision, recall, F1, mean and median IoU of matches and the mean over all targets, and the shares of IoU 0.85, in percent; null on an empty denominator."""
    g = truth.groupBy(by).agg(F.count("*").alias("gt"))
    p = predictions.groupBy(by).agg(F.count("*").alias("pred"))
    m = matches.groupBy(by).agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"), F.median("iou").alias("median_iou"), F.sum("iou").alias("total"), F.count_if(F.col("iou") >= 0.85).alias("high"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = g.join(p, by, "full").join(m, by, "full").select(by, zero("gt"), zero("pred"), zero("matched"), zero("high"), "mean_iou", "median_iou", "total")
    return rows.select(
        by, "gt", "pred", "matched",
        percent(F.col("matched"), F.col("pred")).alias("precision50"),
        percent(F.col("matched"), F.col("gt")).alias("recall50"),
        percent(2 * F.col("matched"), F.col("gt") + F.col("pred")).alias("f1"),
        F.round(100 * F.col("mean_iou"), 4).alias("matched_iou"),
        F.round(100 * F.col("median_iou"), 4).alias("median_iou"),
        F.when(F.col("gt") > 0, F.round(100 * F.coalesce("total", F.lit(0.0)) / F.col("gt"), 4)).alias("all_gt_iou"),
        percent(F.col("high"), F.col("matched")).alias("matched85"),
        percent(F.col("high"), F.col("gt")).alias("all_gt85"),
    )


def top_k(predictions: DataFrame, k: int, by: tuple[str, ...] = ("image_id", "category")) -> DataFrame:
    """The k best-scored predictions of each group, ties by id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "pred_id")
    return predictions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def operating_points(predictions: DataFrame, truth: DataFrame, thresholds: list[float], ks: list[int], least: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and macro recall at every (threshold, top-k) point, with one-to-one matches of the point's own predictions.

    IoU is computed once, and the pairs of a group are kept and sorted once for all points. ``best_f1`` and ``best_macro`` mark the first point of the highest value.
    """
    points = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(int(k)).alias("k")) for t in thresholds for k in ks])
    inside = lambda row, p: (row["score"] >= p["threshold"]) & (row["rank"] <= p["k"])
    ranked = predictions.withColumn("rank", F.row_number().over(Window.partitionBy("image_id", "category").orderBy(F.desc("score"), "pred_id")))
    row = {c: F.col(c) for c in ("score", "rank")}
    counted = ranked.select(F.explode(F.filter(points, lambda p: inside(row, p))).alias("p")).groupBy("p.threshold", "p.k").agg(F.count("*").alias("pred"))
    pairs = iou_pairs(ranked, truth.select("image_id", "category", "ann_id", "x0", "y0", "x1", "y1")).where(F.col("iou") >= least)
    items = F.array_sort(F.collect_list(F.struct(_pair().alias("pair"), F.col("p_score").alias("score"), F.col("p_rank").alias("rank"))))
    own = lambda p: F.transform(F.filter("items", lambda x: inside(x, p)), lambda x: x["pair"])
    found = F.transform(points, lambda p: F.struct(p["threshold"].alias("threshold"), p["k"].alias("k"), F.size(_in_turn(own(p))).alias("m")))
    matches = pairs.groupBy("image_id", "category").agg(items.alias("items")).select("category", F.explode(found).alias("f"))
    sizes = truth.groupBy("category").agg(F.count("*").alias("size"))
    by_class = matches.groupBy("f.threshold", "f.k", "category").agg(F.sum("f.m").alias("m")).join(sizes, "category")
    totals = by_class.groupBy("threshold", "k").agg(F.sum("m").alias("matched"), F.sum(F.col("m") / F.col("size")).alias("recalls"))
    n_truth = sizes.agg(F.sum("size").alias("gt"), F.count("*").alias("classes"))
    out = counted.join(totals, ["threshold", "k"], "left").join(n_truth, how="cross").withColumn("matched", F.coalesce("matched", F.lit(0)))  # one row
    out = out.select(
        "threshold", "k", "pred", "matched",
        percent(F.col("matched"), F.col("pred")).alias("precision"), percent(F.col("matched"), F.col("gt")).alias("recall"),
        percent(2 * F.col("matched"), F.col("pred") + F.col("gt")).alias("f1"),
        percent(F.coalesce("recalls", F.lit(0.0)), F.col("classes")).alias("macro_recall"),
    )
    first = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "threshold", "k")) == 1  # noqa: E731  # one row for each point
    return out.withColumn("best_f1", first("f1")).withColumn("best_macro", first("macro_recall"))


def average_precision(predictions: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """101-point interpolated AP per category, from score-ordered cumulative precision; 0 without predictions, null without targets.

    Places in the order come from range partitions, so no task sees a whole category.
    """
    hits = matches.select("pred_id", F.lit(True).alias("hit"))
    order = ["category", F.desc("score"), "pred_id"]
    ranked = renumber(predictions.select("category", "score", "pred_id"), order, "seen").join(hits, "pred_id", "left")
    started = ranked.groupBy("category").agg((F.min("seen") - 1).alias("earlier"))
    found = renumber(ranked.where("hit"), ["seen"], "tps")  # precision is highest at hits, so the curve needs no other rows
    skipped = found.groupBy("category").agg((F.min("tps") - 1).alias("skipped"))
    n = truth.groupBy("category").agg(F.count("*").alias("gt"))
    curve = found.join(started, "category").join(skipped, "category").join(n, "category")
    tps, seen = F.col("tps") - F.col("skipped"), F.col("seen") - F.col("earlier")
    curve = curve.select("category", "gt", (tps / seen).alias("precision"), F.floor(tps * 100 / F.col("gt")).alias("reach"))
    best = curve.groupBy("category", "gt", "reach").agg(F.max("precision").alias("precision"))  # at most 101 rows a category
    right = Window.partitionBy("category").orderBy(F.desc("reach")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = best.withColumn("envelope", F.max("precision").over(right))
    below = F.lag("reach", 1, -1).over(Window.partitionBy("category").orderBy("reach"))
    steps = steps.withColumn("points", F.col("reach") - below)
    area = steps.groupBy("category").agg(F.round(100 * F.sum(F.col("envelope") * F.col("points")) / 101, 6).alias("ap"))
    every = n.join(predictions.select("category").distinct(), "category", "full").join(area, "category", "left")
    return every.select("category", F.when(F.col("gt").isNotNull(), F.coalesce("ap", F.lit(0.0))).alias("ap"))


def summary_by_axes(rows: DataFrame, axes: dict[str, Column], value: Column) -> DataFrame:
    """One report over several axes: every row counts once under each of its (axis, value) pairs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("axis"), c.cast("string").alias("value")) for name, c in axes.items()]))
    return rows.select(pairs.alias("a"), value.alias("v")).groupBy("a.axis", "a.value").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


def latency_summary(rows: DataFrame, by: str) -> DataFrame:
    """Mean, median, p95, extremes and rate of ``ms`` per group."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.median("ms"), 6).alias("median_ms"),
        F.round(F.percentile("ms", F.lit(0.95)), 6).alias("p95_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.round(1000 / F.avg("ms"), 6).alias("per_second"),
    )


def composite_conflicts(boxes: DataFrame, whole: str, upper: str, lowers: list[str], least_union: float = 0.8, least_cover: float = 0.8, margin: float = 0.0) -> DataFrame:
    """Boxes of class ``whole`` that an upper and a lower piece of the same image explain better; the best such pair for each.

    boxes: image_id, pred_id, category, score and corners. Equal pairs go by the smaller ids. The pieces must lie in the whole
    box, the upper one with the higher centre, and their common box must match it; their mean score must reach its score.
    """
    columns = ["pred_id", "score", "x0", "y0", "x1", "y1"]
    side = lambda p, names: boxes.where(F.col("category").isin(names)).select("image_id", *[F.col(c).alias(f"{p}{c}") for c in columns])
    pairs = side("d_", [whole]).join(side("t_", [upper]), "image_id").where(box.coverage("t_", "d_") >= least_cover)
    pairs = pairs.join(side("l_", lowers), "image_id").where((box.coverage("l_", "d_") >= least_cover) & (F.col("t_y0") + F.col("t_y1") < F.col("l_y0") + F.col("l_y1")))
    common = [F.least(f"t_{c}", f"l_{c}").alias(f"u_{c}") for c in ("x0", "y0")] + [F.greatest(f"t_{c}", f"l_{c}").alias(f"u_{c}") for c in ("x1", "y1")]
    scored = pairs.select("*", *common).withColumn("union_iou", F.round(box.iou("d_", "u_"), 9)).withColumn("gap", F.round((F.col("t_score") + F.col("l_score")) / 2 - F.col("d_score"), 9))
    good = scored.where((F.col("union_iou") >= least_union) & (F.col("gap") >= margin))
    best = F.max(F.struct("gap", "union_iou", (-F.col("t_pred_id")).alias("t"), (-F.col("l_pred_id")).alias("l"))).alias("b")
    return good.groupBy(F.col("d_pred_id").alias("whole_id")).agg(best).select("whole_id", (-F.col("b.t")).alias("upper_id"), (-F.col("b.l")).alias("lower_id"), "b.gap", "b.union_iou")


def primary_subject(boxes: DataFrame, width: float, height: float, least_score: float = 0.7, least_area: float = 0.005, center_bias: float = 0.5) -> DataFrame:
    """The large, sure and central box of each image: the highest area * score / (1 + bias * distance of the centres in half frames)."""
    clip = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), c))
    inside = boxes.where(F.col("score") >= least_score).select("image_id", "pred_id", "score", *[clip(F.col(c), width if c[0] == "x" else height).alias(c) for c in ("x0", "y0", "x1", "y1")])
    off = lambda k, size: ((F.col(f"{k}0") + F.col(f"{k}1")) / 2 - size / 2) / max(size / 2, 1.0)
    ranked = inside.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (box.area("") / (width * height) >= least_area))
    rank = F.round(box.area("") * F.col("score") / (1 + center_bias * F.hypot(off("x", width), off("y", height))), 6)
    best = F.max(F.struct(rank.alias("rank"), "score", (-F.col("pred_id")).alias("id"))).alias("b")
    return ranked.groupBy("image_id").agg(best).select("image_id", (-F.col("b.id")).alias("pred_id"), "b.rank")


def best_overlaps(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Each annotation with the IoU of the prediction that overlaps it best, 0 if none does."""
    best = iou_pairs(predictions, truth).groupBy(F.col("g_ann_id").alias("ann_id")).agg(F.max("iou").alias("best"))
    return truth.join(best, "ann_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def proposal_recall(overlaps: DataFrame, by: str) -> DataFrame:
    """Recall at IoU 0.5 and 0.75 and mean best IoU, in percent per group."""
    share = lambda x: percent(F.count_if(F.col("best") >= x), F.count("*"))
    return overlaps.groupBy(by).agg(F.count("*").alias("targets"), share(0.5).alias("recall50"), share(0.75).alias("recall75"), F.round(100 * F.avg("best"), 6).alias("mean_best"))


def contrast_sets(rows: DataFrame, by: str, scored: Column, passed: Column) -> DataFrame:
    """A set passes if all its scored members do; null if none is scored."""
    return rows.groupBy(by).agg(F.count_if(scored).alias("scored"), F.bool_and(F.when(scored, passed)).alias("passed"))


def threshold_scan(patches: DataFrame, thresholds: list[float]) -> DataFrame:
    """patches (query_id, prob, target): recall at IoU 0.5 and mean IoU of each threshold over the queries with both kinds of patches; ``best`` marks the chosen one."""
    hit = [F.count_if((F.col("prob") >= t) & F.col("target")) / F.count_if((F.col("prob") >= t) | F.col("target")) for t in thresholds]
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), i.alias("iou")) for t, i in zip(thresholds, hit)])
    queries = patches.groupBy("query_id").agg(each.alias("e"), F.bool_or("target").alias("some"), F.bool_and("target").alias("every")).where("some and not every")
    table = queries.select(F.explode("e").alias("e")).groupBy("e.threshold").agg(F.count("*").alias("queries"), percent(F.count_if(F.col("e.iou") >= 0.5), F.count("*")).alias("recall50"), F.round(100 * F.avg("e.iou"), 6).alias("mean_iou"))
    top = table.agg(F.max(F.struct("recall50", "mean_iou", "threshold")).alias("b")).select(F.col("b.threshold").alias("chosen"))
    return table.join(F.broadcast(top), how="cross").select("threshold", "queries", "recall50", "mean_iou", (F.col("threshold") == F.col("chosen")).alias("best"))  # one row


def top_patches(patches: DataFrame, fraction: float) -> DataFrame:
    """The patches of highest probability of each query: a fraction of them, at least one; ties by patch."""
    whole = Window.partitionBy("query_id")
    ranked = patches.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("prob"), "patch"))).withColumn("size", F.count("*").over(whole))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.rint(F.col("size") * fraction))).select("query_id", "patch", F.col("rank").cast("long").alias("rank"))
