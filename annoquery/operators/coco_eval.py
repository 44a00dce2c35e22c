"""Average precision as COCO defines it: score-ordered matching over ten IoUs and four areas, with ignored targets.

For each image and category, detections are taken by score, at most ``max_dets``. Each takes the free target of largest IoU that reaches
the threshold; targets that count go before ignored ones (crowd, or outside the area), crowd targets stay free. What matches an ignored target, or
matches nothing and lies outside the area, is ignored itself. Targets ignored everywhere leave a category without a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks, box
from ..sources.views import checkpointed

IOUS = [0.5 + 0.05 * i for i in range(10)]
#: Names and bounds of the areas, both ends inclusive.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}


def box_pairs(detections: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(pred_id, ann_id, iou, iscrowd, size) of overlapping boxes of an image and category; against crowd targets, the share of the detection that they cover."""
    sides = ("x0", "y0", "x1", "y1")
    a = detections.select("image_id", "category", "pred_id", *(F.col(c).alias(f"p_{c}") for c in sides))
    b = truth.select("image_id", "category", "ann_id", "iscrowd", F.col("area").alias("size"), *(F.col(c).alias(f"t_{c}") for c in sides))
    value = F.when(F.col("iscrowd"), box.coverage("p_", "t_")).otherwise(box.iou("p_", "t_"))
    return a.join(b, ["image_id", "category"]).select("pred_id", "ann_id", F.round(value, 9).alias("iou"), "iscrowd", "size").where(F.col("iou") >= least)


def _match(found: list[tuple[float, bool, list]], bounds: tuple[float, float], least: float) -> list[tuple[bool, bool]]:
    """(hit, ignored) of detections in score order; each has its area and candidates (iou, target, crowd, area of the target)."""
    taken, out, (low, high) = set(), [], bounds
    for area, candidates in found:
        free = [(not (crowd or not low <= size <= high), iou, target, crowd) for iou, target, crowd, size in candidates if iou >= least and (crowd or target not in taken)]
        if not free:
            out.append((False, not low <= area <= high))
            continue
        counts, _, target, _ = max(free)
        taken.add(target)
        out.append((counts, not counts))
    return out


def _judge(rows: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of hits and of ignored detections (row, area) of whole groups, in score order.

    Detections without candidates, or with one that is no other's, stand for themselves; only the others are matched one after the other.
    """
    area = rows.column("area").to_numpy()
    lists = rows.column("candidates").combine_chunks()
    n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    iou, target, crowd, size = lists.flatten().flatten()
    iou, target, crowd, size = iou.to_numpy(zero_copy_only=False), target.to_numpy(zero_copy_only=False), crowd.fill_null(False).to_numpy(zero_copy_only=False), size.to_numpy(zero_copy_only=False)
    owner, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    order = np.lexsort((target, group[owner]))
    same = (target[order][1:] == target[order][:-1]) & (group[owner][order][1:] == group[owner][order][:-1])
    contested = np.zeros(len(owner), bool)
    contested[order] = np.append(same, False)[: len(order)] | np.append(False, same)[: len(order)]
    alone = np.flatnonzero((n == 1) & (np.bincount(owner, contested, len(n)) == 0))
    rest = np.flatnonzero(n > 0)
    rest = rest[~np.isin(rest, alone)]
    least = np.array([min(i, 1 - 1e-10) - 1e-9 for i in IOUS])
    reached = (1 << np.searchsorted(least, iou[start[alone]], "right")) - 1
    hits, ignored = np.zeros((len(n), len(AREAS)), np.int32), np.zeros((len(n), len(AREAS)), np.int32)
    bounds = list(AREAS.values())
    for k, (low, high) in enumerate(bounds):
        ignored[:, k] = np.where((area >= low) & (area <= high), 0, (1 << len(IOUS)) - 1)
        at = start[alone]
        counts = ~crowd[at] & (size[at] >= low) & (size[at] <= high)
        hits[alone, k] = np.where(counts, reached, 0)
        ignored[alone, k] = ignored[alone, k] & ~reached | np.where(counts, 0, reached)
    hits[rest], ignored[rest] = 0, 0
    for part in np.split(rest, np.flatnonzero(np.diff(group[rest])) + 1) if len(rest) else []:
        found = [(area[r], [(iou[c], target[c], crowd[c], size[c]) for c in range(start[r], start[r] + n[r])]) for r in part]
        for k in range(len(bounds)):
            for t, bound in enumerate(least):
                for r, (hit, off) in zip(part, _match(found, bounds[k], bound)):
                    hits[r, k] |= int(hit) << t
                    ignored[r, k] |= int(off) << t
    return hits, ignored


def judged(detections: DataFrame, truth: DataFrame, pairs: DataFrame, max_dets: int = 100) -> DataFrame:
    """(category, pred_id, score, hits, ignored): two arrays with the bits of all IoUs for each area. Detections beyond ``max_dets`` are left out."""
    best = Window.partitionBy("image_id", "category").orderBy(F.desc("score"), "pred_id")
    kept = detections.withColumn("n", F.row_number().over(best)).where(F.col("n") <= max_dets).select("image_id", "category", "pred_id", "score", F.col("area").cast("double").alias("area"))
    if "size" not in pairs.columns:
        pairs = pairs.join(truth.select("ann_id", "iscrowd", F.col("area").alias("size")), "ann_id")
    candidates = pairs.withColumn("size", F.col("size").cast("double")).groupBy("pred_id").agg(F.collect_list(F.struct("iou", "ann_id", "iscrowd", "size")).alias("candidates"))
    rows = kept.join(candidates, "pred_id", "left").repartition("image_id", "category").sortWithinPartitions("image_id", "category", F.desc("score"), "pred_id")

    def fold(batches):
        held = None  # the rows of the last group, which may go on

        def done(table, group):
            hits, ignored = _judge(table, group)
            lists = (pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * len(AREAS)), pa.array(b.ravel())) for b in (hits, ignored))
            fixed = [table.column(c).combine_chunks() for c in ("category", "pred_id", "score")]
            return pa.RecordBatch.from_arrays([*fixed, *lists], ["category", "pred_id", "score", "hits", "ignored"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not len(table):
                continue
            new = np.zeros(len(table), bool)
            for c in ("image_id", "category"):
                codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            group = np.cumsum(new)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield done(table.slice(0, last), group[:last])
            held = table.slice(last)
        if held is not None:
            yield done(held, np.zeros(len(held), np.int64))

    return rows.mapInArrow(fold, "category string, pred_id long, score double, hits array<int>, ignored array<int>")


def _counted(batches):
    """For the rows of each range and category in turn: (range, category, whether it begins, hit, tps, seen), the last three by row and area and IoU, added up from the first row."""
    last, tps, seen = None, 0, 0
    for batch in batches:
        parts, names = batch.column("part").to_numpy(), batch.column("category")
        codes = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
        bits = [(blocks.of_lists(batch.column(c))[0].reshape(-1, len(AREAS), 1) >> np.arange(len(IOUS)) & 1).reshape(len(batch), len(AREAS) * len(IOUS)) for c in ("hits", "ignored")]
        edges = np.flatnonzero((codes[1:] != codes[:-1]) | (parts[1:] != parts[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(batch)]):
            if a == b:
                continue
            key = (int(parts[a]), names[a].as_py())
            new = key != last
            last, tps, seen = key, *((0, 0) if new else (tps, seen))
            counts = 1 - bits[1][a:b]
            hit = bits[0][a:b] * counts
            sums = np.cumsum(hit, axis=0) + tps, np.cumsum(counts, axis=0) + seen
            tps, seen = sums[0][-1], sums[1][-1]
            yield *key, new, hit, *sums


def _numbered(part: int, category: str | None, kind: np.ndarray, tps: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    k, t = np.divmod(kind, len(IOUS))
    n = len(kind)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array([category], pa.string()).take(pa.array(np.zeros(n, np.int64))), pa.array(k.astype(np.int32)), pa.array(t.astype(np.int32)), pa.array(tps), pa.array(seen)], ["part", "category", "k", "t", "tps", "seen"])


def _totals(batches):
    """Counts of each range's part of a category, by area and IoU."""
    every, held = np.arange(len(AREAS) * len(IOUS)), None
    for part, category, new, _, tps, seen in _counted(batches):
        if new and held is not None:
            yield _numbered(*held)
        held = (part, category, every, tps[-1], seen[-1])
    if held is not None:
        yield _numbered(*held)


def _hits(batches):
    """Each hit by area and IoU, with the counts of its range's part of the category up to it."""
    for part, category, _, hit, tps, seen in _counted(batches):
        row, kind = np.nonzero(hit)
        yield _numbered(part, category, kind, tps[row, kind], seen[row, kind])


def average_precisions(detections: DataFrame, truth: DataFrame, pairs: DataFrame, max_dets: int = 100) -> DataFrame:
    """(category, area, iou, ap): 101-point interpolated precision in percent; null where a category has no target that counts.

    The score order is cut into ranges; each range's counts, with those of the ranges before, give its part of the curves. Two ranges may share a category, and no task needs all of one.
    """
    marked = judged(detections, truth, pairs, max_dets)
    order = ["category", F.desc("score"), "pred_id"]
    ranged = checkpointed(marked.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "category", "hits", "ignored"))
    of = ["category", "k", "t"]
    counted = "part int, category string, k int, t int, tps long, seen long"
    before = Window.partitionBy(*of).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.mapInArrow(_totals, counted)
    earlier = sums.select("part", *of, F.coalesce(F.sum("seen").over(before), F.lit(0)).alias("seen0"), F.coalesce(F.sum("tps").over(before), F.lit(0)).alias("tps0"))
    gt = [F.count_if((~F.col("iscrowd")) & (F.col("area") >= low) & (F.col("area") <= high)) for low, high in AREAS.values()]
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("area"), F.lit(k).alias("k"), F.col("g")[k].alias("gt")) for k, name in enumerate(AREAS)]))
    known = truth.select("category", "iscrowd", "area").unionByName(sums.select("category", F.lit(True).alias("iscrowd"), F.lit(0.0).alias("area")))  # categories of detections too, without a target
    n = known.groupBy("category").agg(F.array(*gt).alias("g")).select("category", kinds.alias("e")).select("category", "e.*")
    # a few rows for each category, and for each range that begins inside one
    running = ranged.mapInArrow(_hits, counted).join(F.broadcast(earlier), ["part", *of]).join(F.broadcast(n.where("gt > 0").drop("area")), ["category", "k"])
    tps, seen = F.col("tps") + F.col("tps0"), F.col("seen") + F.col("seen0")
    curve = running.select(*of, (tps / seen).alias("precision"), F.floor(tps * 100 / F.col("gt")).alias("reach"))
    best = curve.groupBy(*of, "reach").agg(F.max("precision").alias("precision"))  # at most 101 rows
    right = Window.partitionBy(*of).orderBy(F.desc("reach")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = best.withColumn("envelope", F.max("precision").over(right)).withColumn("points", F.col("reach") - F.lag("reach", 1, -1).over(Window.partitionBy(*of).orderBy("reach")))
    area = steps.groupBy(*of).agg(F.round(100 * F.sum(F.col("envelope") * F.col("points")) / 101, 6).alias("ap"))
    every = n.select("*", F.explode(F.array(*map(F.lit, range(len(IOUS))))).alias("t"))
    out = every.join(area, of, "left")
    return out.select("category", "area", F.round(0.5 + 0.05 * F.col("t"), 2).alias("iou"), F.when(F.col("gt") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def coco_summary(precisions: DataFrame) -> DataFrame:
    """One row with AP, AP50, AP75, AP85, AP90 and the AP of small, medium and large targets: means over the categories that have a value."""
    mean = lambda name, ok: F.round(F.avg(F.when(ok, F.col("ap"))), 6).alias(name)
    every = F.col("area") == "all"
    return precisions.agg(mean("ap", every), *(mean(f"ap{t}", every & (F.col("iou") == t / 100)) for t in (50, 75, 85, 90)), *(mean(f"ap_{a}", F.col("area") == a) for a in ("small", "medium", "large")))
