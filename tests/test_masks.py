"""Stored masks against their pixels, and COCO matching against cases worked out by hand."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annoquery.functions import blocks, box, text
from annoquery.operators import coco_eval, conversion, masks, rle, scoring
from annoquery.plans.queries import QUERIES
from annoquery.sources import views

DATA = "/root/testdata/sf0.001"


def test_codes_and_row_runs_of_random_masks():
    draw = random.Random(3)
    for _ in range(500):
        h, w = draw.randint(1, 9), draw.randint(1, 9)
        pixels = np.random.RandomState(draw.randrange(10**6)).rand(h, w) < draw.choice([0.1, 0.5, 0.9, 1.1, -1])
        flat = pixels.T.ravel()
        counts = np.diff(np.r_[0, np.flatnonzero(np.diff(np.r_[False, flat])), flat.size]).tolist()
        assert rle.counts_of(rle.text_of(counts)) == counts
        drawn = np.zeros((h, w), bool)
        for y, a, b in zip(*rle.row_runs(np.array(counts), h)):
            assert b > a and not drawn[y, a:b].any() and (a == 0 or not pixels[y, a - 1]) and (b == w or not pixels[y, b])
            drawn[y, a:b] = True
        assert (drawn == pixels).all()


def test_a_known_code():
    # the counts 6, 1, 40, 4, 5, 4, 5, 4, 21 of a 9 x 10 mask
    assert rle.text_of([6, 1, 40, 4, 5, 4, 5, 4, 21]) == "61X13mN000`0" and rle.counts_of("61X13mN000`0") == [6, 1, 40, 4, 5, 4, 5, 4, 21]
    assert rle.counts_of("o") is None and rle.counts_of("é") is None and rle.counts_of("") == []


def test_broken_masks_give_no_runs(spark):
    rows = [(1, [2, 3], [1, 2, 3]), (2, [2], [6]), (3, [2, 3], [1, 2]), (4, [2, 3], [7, -1]), (5, None, [6]), (6, [2, 3], None), (7, [0, 3], []), (8, [2, None], [2])]
    table = spark.createDataFrame(rows, "ann_id int, size array<int>, counts array<long>").withColumn("image_id", F.lit("i"))
    faults = {r[0]: r[1] for r in table.select("ann_id", rle.fault(F.col("size"), F.col("counts"))).collect()}
    assert faults == {1: None, 2: "size", 3: "fill", 4: "counts", 5: "size", 6: "counts", 7: "size", 8: "size"}
    assert sorted(tuple(r) for r in rle.rle_runs(table, "ann_id").collect()) == [("i", 1, 0, 1, 2), ("i", 1, 1, 0, 1)]
    assert [tuple(r) for r in masks.tight_box(rle.rle_runs(table, "ann_id"), ["ann_id"]).collect()] == [(1, 0, 0, 2, 2)]


def _precision(spark, detections, truth):
    detections, truth = ([tuple(float(v) if i > 1 else v for i, v in enumerate(r)) for r in rows] for rows in (detections, truth))
    found = spark.createDataFrame(detections, "pred_id long, score double, x0 double, y0 double, x1 double, y1 double").selectExpr("1L AS image_id", "'c' AS category", "*", "(x1 - x0) * (y1 - y0) AS area")
    known = spark.createDataFrame(truth, "ann_id long, iscrowd boolean, x0 double, y0 double, x1 double, y1 double").selectExpr("1L AS image_id", "'c' AS category", "*", "(x1 - x0) * (y1 - y0) AS area")
    return {(r["area"], r["iou"]): r["ap"] for r in coco_eval.average_precisions(found, known, coco_eval.box_pairs(found, known)).collect()}


def test_coco_matches_by_score_and_not_by_overlap(spark):
    # the first detection by score takes the one target, though the second overlaps it better
    ap = _precision(spark, [(1, 0.9, 0, 0, 10, 6), (2, 0.8, 0, 0, 10, 10)], [(1, False, 0, 0, 10, 10)])
    assert ap["all", 0.5] == 100.0 and ap["all", 0.75] == 50.0
    # nothing of medium size counts: no result, not 0
    assert ap["medium", 0.5] is None and ap["small", 0.5] == 100.0


def test_coco_crowd_targets_take_any_number_and_count_for_nothing(spark):
    ap = _precision(spark, [(1, 0.9, 0, 0, 10, 10), (2, 0.8, 20, 20, 30, 30), (3, 0.7, 22, 22, 32, 32)], [(1, False, 0, 0, 10, 10), (2, True, 20, 20, 60, 60)])
    assert ap["all", 0.5] == 100.0
    assert _precision(spark, [], [(1, False, 0, 0, 10, 10)])["all", 0.5] == 0.0


def test_every_row_of_other_images_can_be_a_donor(spark):
    rows = spark.range(2000).selectExpr("id", "id div 10 AS image", "'x' AS label", "id % 2 AS kind")
    found = scoring.donors(rows, "id", "image", "label", "s").collect()
    assert len(found) == 2000 and all(r["donor"] // 10 != r["id"] // 10 for r in found) and len({r["donor"] for r in found}) > 1000
    strict = scoring.donors(rows, "id", "image", "label", "s", "kind", F.col("id") < 1000).collect()
    assert all(r["donor"] % 2 == r["id"] % 2 for r in strict if r["id"] < 1000)
    assert scoring.donors(rows.where("image = 3"), "id", "image", "label", "s").where("donor is not null").count() == 0


def test_small_rules(spark):
    one = spark.range(1)
    assert tuple(one.select(box.letterbox(F.lit(1), F.lit(1000), 224)).first()[0])[1:] == (1, 224, 111, 0)
    a, b = F.lit(1).alias("a"), F.struct(F.lit(None).cast("string").alias("z"), F.lit("é").alias("b")).alias("c")
    assert one.select(text.fingerprint(a, b) == text.fingerprint(b, a)).first()[0]
    assert one.select(text._canonical(F.struct(b, a))).first()[0] == '{"a":1,"c":{"b":"é","z":null}}'
    named = spark.createDataFrame([("left2",), ("left_side",), ("the left, one",), ("左侧left",), ("right and left",)], "q string").select(text.spatial_modifier("q")).collect()
    assert [r[0] for r in named] == [None, None, "left", "left", None]
    boxes = spark.createDataFrame([(["1", "x", "2", "3"],), (["1", "2", "3", "4"],)], "b array<string>").select(conversion.valid_xywh(F.col("b"))).collect()
    assert [r[0] for r in boxes] == [None, [1.0, 2.0, 3.0, 4.0]]


def test_counts_beyond_63_bits_are_a_fault(spark):
    table = spark.createDataFrame([(1, [2, 3], [2**62, 2**62]), (2, [2, 3], [2**62, 2**62, 2**62, 2**62 + 6]), (3, [2, 3], [0, 6])], "ann_id int, size array<int>, counts array<long>")
    assert sorted(tuple(r) for r in table.select("ann_id", rle.fault(F.col("size"), F.col("counts"))).collect()) == [(1, "fill"), (2, "fill"), (3, None)]
    assert [tuple(r) for r in rle.rle_areas(table, "ann_id").collect()] == [(3, 6)]


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_areas_are_made_without_a_function_for_each_count(spark):
    assert "lambda" not in _plan(QUERIES["rle_mask_areas"](spark, DATA))


@pytest.mark.parametrize("name", ["stored_mask_boxes", "stored_mask_faults"])
def test_stored_masks_are_made_without_a_function_for_each_count(spark, name):
    assert "lambda" not in _plan(QUERIES[name](spark, DATA))


def test_detections_matched_at_once_equal_those_matched_in_turn():
    draw = random.Random(5)
    for _ in range(60):
        rows, group = [], []
        for g in range(draw.randint(1, 6)):
            for _ in range(draw.randint(1, 4)):
                targets = draw.sample(range(4), draw.choice([0, 0, 1, 1, 2, 3]))
                rows.append({"area": draw.choice([10.0, 1024.0, 5000.0, 1e4]), "candidates": [{"iou": draw.choice([0.5, 0.7, 0.95, 1.0]), "ann_id": t, "iscrowd": t == 3, "size": 900.0 * (t + 1) ** 2} for t in targets] or None})
                group.append(g)
        kind = pa.list_(pa.struct([("iou", pa.float64()), ("ann_id", pa.int64()), ("iscrowd", pa.bool_()), ("size", pa.float64())]))
        table = pa.table({"area": [r["area"] for r in rows], "candidates": pa.array([r["candidates"] for r in rows], kind)})
        hits, ignored = coco_eval._judge(table, np.array(group))
        for g in set(group):
            at = [i for i, x in enumerate(group) if x == g]
            found = [(rows[i]["area"], [tuple(c.values()) for c in rows[i]["candidates"] or []]) for i in at]
            for k, bounds in enumerate(coco_eval.AREAS.values()):
                for t, least in enumerate(coco_eval.IOUS):
                    assert [(bool(hits[i, k] >> t & 1), bool(ignored[i, k] >> t & 1)) for i in at] == coco_eval._match(found, bounds, min(least, 1 - 1e-10) - 1e-9)


def test_precisions_shuffle_no_row_for_each_threshold(spark):
    assert "MapInArrow _hits" in _plan(QUERIES["coco_average_precision"](spark, DATA))


def _shuffles(rows):
    """Shuffles that a query made, without those that were read again."""
    rows.collect()
    return len(re.findall(r"^[\s:+-]*Exchange hashpartitioning", rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0], re.M))


@pytest.mark.parametrize("name, most", [("mask_iou_pairs", 1), ("union_mask_area", 1), ("crop_coverage", 3)])
def test_rows_that_lie_by_image_are_not_shuffled_again(spark, name, most):
    assert _shuffles(QUERIES[name](spark, DATA)) <= most


def test_lines_settle_ties_and_keep_null_keys(spark, tmp_path):
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    rows = [(o, n, p, 1, 1.0, 1.0, 0.0, 0.0, "R", s) for o, n, p, s in [(1, 1, 5, "O"), (1, 1, 5, "F"), (1, 1, 6, "A"), (1, 2, 9, "F"), (1, None, 3, "O"), (1, None, 2, "F"), (None, None, 1, "O"), (None, 1, 1, "F"), (2, 1, 8, "O")]]
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = views.lines(spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 1, 5, "F"), (1, 2, 9, "F"), (1, None, 2, "F"), (None, None, 1, "O"), (None, 1, 1, "F"), (2, 1, 8, "O")], key=str)


def test_unions_equal_their_pixels_and_need_no_rows():
    draw = np.random.RandomState(7)
    for _ in range(200):
        owner = np.sort(draw.randint(0, 4, draw.randint(1, 12)))
        y, x0 = draw.randint(-3, 9, (2, len(owner)))
        mask = (owner, y, y + draw.randint(1, 6, len(owner)), x0, x0 + draw.randint(1, 6, len(owner)))
        known = {(o, r, c) for o, a, b, u, v in zip(*mask) for r in range(a, b) for c in range(u, v)}
        drawn = [(o, r, c) for o, a, b, u, v in zip(*blocks.joined(mask)) for r in range(a, b) for c in range(u, v)]
        assert len(drawn) == len(known) and set(drawn) == known
        assert [c.tolist() for c in blocks.joined(mask)] == [c.tolist() for c in blocks.stacked(*blocks.united(*blocks.opened(*mask)))]
    high = 1 << 40
    tall = tuple(np.array(v, np.int64) for v in ([0, 0], [0, high], [2 * high, 3 * high], [0, 5], [10, 20]))
    assert [c.tolist() for c in blocks.joined(tall)] == [[0, 0, 0], [0, high, 2 * high], [high, 2 * high, 3 * high], [0, 0, 5], [10, 20, 20]]


def test_operating_points_keep_pairs_once_for_all_points(spark):
    assert not re.search(r"Aggregate \[threshold#\d+, k#\d+, image_id", _plan(QUERIES["operating_point_scan"](spark, DATA)))
