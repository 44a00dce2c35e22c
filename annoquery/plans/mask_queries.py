"""Registered queries of stored masks and of COCO evaluation, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import coco_eval, conversion, masks, prediction_rows, rle
from ..sources import coco_bundle, indexes
from ..sources.views import SQL, annotations, predictions, shared_folder, table
from .more_queries import box_counts
from .queries import query

HEIGHT, WIDTH = 250, 200


def _stored(spark, sf_dir):
    """Run-length masks of the annotations' boxes: as text for even ids, plain for odd ones."""
    counts = box_counts(HEIGHT, WIDTH)
    rows = annotations(spark, sf_dir).select("image_id", "ann_id", F.array(F.lit(HEIGHT), F.lit(WIDTH)).alias("size"), counts.alias("plain"))
    return rows.withColumn("text", rle.encoded(F.when(F.col("ann_id") % 2 == 0, F.col("plain"))))


def _decoded(rows):
    return rows.withColumn("counts", F.coalesce(rle.decoded("text"), F.when(F.col("text").isNull(), F.col("plain")))).drop("text", "plain")


@query(
    f"""WITH {SQL} SELECT a.ann_id AS rle_id, b.ann_id AS polygon_id, round(c / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - c), 9) AS iou
    FROM v_ann a JOIN v_ann b ON a.image_id = b.image_id, LATERAL (SELECT greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS c) WHERE c > 0"""
)
def rle_polygon_iou(spark, sf_dir):
    """Run-length masks against polygon masks, pixel by pixel: those of one shape have an IoU of 1."""
    stored = rle.rle_masks(_decoded(_stored(spark, sf_dir)), "ann_id").withColumnRenamed("ann_id", "rle_id")
    quad = F.array(F.array("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1"))
    drawn = masks.polygon_masks(annotations(spark, sf_dir).select("image_id", F.col("ann_id").alias("polygon_id"), quad.alias("polygons")), "polygon_id")
    return masks.mask_iou(stored, drawn, "rle_id", "polygon_id").select("rle_id", "polygon_id", "iou")


@query(f"WITH {SQL} SELECT ann_id, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1 FROM v_ann")
def stored_mask_boxes(spark, sf_dir):
    return rle.rle_boxes(_decoded(_stored(spark, sf_dir)), "ann_id")


@query(
    f"""WITH {SQL} SELECT ann_id, CASE ann_id % 7 WHEN 0 THEN 'size' WHEN 1 THEN 'fill' WHEN 2 THEN 'counts' END AS fault FROM v_ann WHERE ann_id % 7 < 3"""
)
def stored_mask_faults(spark, sf_dir):
    """Masks with a size of one number, one pixel too few, or a text that is cut off."""
    rows, kind = _stored(spark, sf_dir), F.col("ann_id") % 7
    rows = rows.withColumn("size", F.when(kind == 0, F.array(F.lit(HEIGHT))).otherwise(F.col("size")))
    rows = rows.withColumn("plain", F.when(kind == 1, F.concat("plain", F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))).otherwise(F.col("plain")))
    rows = rows.withColumn("text", F.when(kind == 2, F.lit("o")).when(kind != 1, F.col("text")))
    rows = _decoded(rows)
    return rows.select("ann_id", rle.fault(F.col("size"), F.col("counts")).alias("fault")).where("fault is not null")


_COCO = f"""WITH RECURSIVE {SQL}, v_det AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM v_pred),
    d AS (SELECT image_id, category, pred_id, score, area, row_number() OVER (PARTITION BY image_id, category ORDER BY score DESC, pred_id) AS rn FROM v_det),
    x AS (SELECT p.pred_id, t.ann_id, t.iscrowd, t.area AS size, (p.x1 - p.x0) * (p.y1 - p.y0) AS pa, greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0)) AS c FROM v_pred p JOIN v_ann t ON p.image_id = t.image_id AND p.category = t.category),
    y AS (SELECT pred_id, list({{'o': round(CASE WHEN iscrowd THEN c / pa ELSE c / (pa + size - c) END, 9), 'id': ann_id, 'crowd': iscrowd, 'size': size}}) AS cand FROM x WHERE c > 0 GROUP BY 1),
    k AS (SELECT * FROM (VALUES ('all', 0, 1e10), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 1e10)) a(kind, low, high), (SELECT unnest(range(10))::INT AS t)),
    r AS (SELECT d.*, coalesce(cand, []) AS cand, kind, low, high, t FROM d LEFT JOIN y USING (pred_id), k WHERE rn <= 100),
    w AS (SELECT image_id, category, kind, t, 0::BIGINT AS rn, []::BIGINT[] AS taken, NULL::BIGINT AS pred_id, NULL::DOUBLE AS score, false AS hit, true AS off FROM (SELECT DISTINCT image_id, category, kind, t FROM r)
      UNION ALL SELECT image_id, category, kind, t, rn, CASE WHEN m.id IS NULL THEN taken ELSE list_append(taken, m.id) END, pred_id, score, coalesce(m.counts, false), CASE WHEN m.id IS NULL THEN area < low OR area > high ELSE NOT m.counts END
      FROM (SELECT r.image_id, r.category, r.kind, r.t, r.rn, taken, r.pred_id, r.score, r.area, low, high,
          list_max(list_transform(list_filter(cand, lambda c: c.o >= 0.5 + 0.05 * r.t - 1e-9 AND (c.crowd OR NOT list_contains(taken, c.id))), lambda c: {{'counts': NOT c.crowd AND c.size BETWEEN low AND high, 'o': c.o, 'id': c.id}})) AS m
        FROM w JOIN r ON w.image_id = r.image_id AND w.category = r.category AND w.kind = r.kind AND w.t = r.t AND r.rn = w.rn + 1)),
    s AS (SELECT category, kind, t, hit, row_number() OVER v AS seen, sum(hit::INT) OVER v AS tps FROM w WHERE NOT off AND rn > 0 WINDOW v AS (PARTITION BY category, kind, t ORDER BY score DESC, pred_id ROWS UNBOUNDED PRECEDING)),
    n AS (SELECT category, kind, count(*) AS gt FROM v_ann JOIN (SELECT DISTINCT kind, low, high FROM k) ON area BETWEEN low AND high WHERE NOT iscrowd GROUP BY 1, 2),
    g AS (SELECT category, kind, t, unnest(range(101)) AS point FROM n, (SELECT unnest(range(10))::INT AS t)),
    a AS (SELECT g.category, g.kind, g.t, point, max(tps / seen) AS best FROM g JOIN n USING (category, kind) LEFT JOIN s ON s.category = g.category AND s.kind = g.kind AND s.t = g.t AND hit AND tps * 100 >= point * gt GROUP BY ALL),
    v_ap AS (SELECT c.category, kind AS area, round(0.5 + 0.05 * t, 2)::DOUBLE AS iou, (SELECT round(100 * sum(coalesce(best, 0)) / 101, 6) FROM a WHERE a.category = c.category AND a.kind = k.kind AND a.t = k.t) AS ap FROM (SELECT category FROM v_ann UNION SELECT category FROM v_pred) c, k)"""


def _precisions(spark, sf_dir):
    truth = annotations(spark, sf_dir)
    found = predictions(spark, sf_dir).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return coco_eval.average_precisions(found, truth, coco_eval.box_pairs(found, truth))


@query(_COCO + " SELECT category, area, iou, ap FROM v_ap")
def coco_average_precision(spark, sf_dir):
    return _precisions(spark, sf_dir)


@query(
    _COCO
    + """ SELECT round(avg(ap) FILTER (area = 'all'), 6) AS ap, round(avg(ap) FILTER (area = 'all' AND iou = 0.5), 6) AS ap50, round(avg(ap) FILTER (area = 'all' AND iou = 0.75), 6) AS ap75, round(avg(ap) FILTER (area = 'all' AND iou = 0.85), 6) AS ap85,
    round(avg(ap) FILTER (area = 'all' AND iou = 0.9), 6) AS ap90, round(avg(ap) FILTER (area = 'small'), 6) AS ap_small, round(avg(ap) FILTER (area = 'medium'), 6) AS ap_medium, round(avg(ap) FILTER (area = 'large'), 6) AS ap_large FROM v_ap"""
)
def coco_evaluation(spark, sf_dir):
    return coco_eval.coco_summary(_precisions(spark, sf_dir))


_BUNDLE = f"""WITH {SQL}, k AS (SELECT * FROM v_ann WHERE category = 'SMALL'), i AS (SELECT image_id, row_number() OVER (ORDER BY lpad(image_id::VARCHAR, 8, '0'), image_id::VARCHAR) AS n FROM (SELECT DISTINCT image_id FROM k)),
    a AS (SELECT row_number() OVER (ORDER BY n, ann_id) AS id, n AS image_id, ann_id AS source_id, [x0, y0, x1 - x0, y1 - y0] AS bbox, iscrowd::INT AS iscrowd, area FROM k JOIN i USING (image_id))"""


@query(_BUNDLE + " SELECT * FROM a")
def coco_document(spark, sf_dir):
    """The annotations of a COCO document of one class, as read back from the document that many tasks wrote."""
    kept = annotations(spark, sf_dir).where("category = 'SMALL'")
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("file_name"))
    numbered, rows = conversion.coco_ids(images, kept)
    lists = {
        "images": numbered.select(F.col("new_image_id").alias("id"), F.concat("file_name", F.lit(".jpg")).alias("file_name"), F.lit(200).alias("width"), F.lit(200).alias("height")),
        "annotations": rows.select(F.col("new_ann_id").alias("id"), F.col("new_image_id").alias("image_id"), F.col("ann_id").alias("source_id"), F.array("x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("bbox"), F.col("iscrowd").cast("int").alias("iscrowd"), "area"),
        "categories": spark.createDataFrame([(1, "small")], "id long, name string"),
    }
    path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    coco_bundle.write_bundle(path, lists)
    return coco_bundle.read_list(spark, path, "annotations", "id long, image_id long, source_id long, bbox array<double>, iscrowd int, area double")


def _samples(spark, sf_dir):
    """Images with their annotations as items."""
    rows = annotations(spark, sf_dir).withColumn("i", F.struct(F.col("ann_id"), F.col("category").alias("category_name"), F.col("line").alias("category_id"), F.lit(1).alias("style"), F.array("x0", "y0", "x1", "y1").alias("bounding_box")))
    return rows.groupBy("image_id").agg(F.array_sort(F.collect_list("i")).alias("items"), F.max("status").alias("split"), F.lit("{}").alias("raw_attributes"))  # an image's annotations


@query(f"WITH {SQL} SELECT image_id, count(*) AS items, count(*) FILTER (category = 'SMALL') AS small FROM v_ann GROUP BY 1 HAVING count(*) FILTER (category = 'SMALL') > 0")
def index_scan(spark, sf_dir):
    """Three indexes in one commit, of which one is without rows; then a scan of one with a filter on its nested categories."""
    path = f"{shared_folder(spark)}/indexes-{uuid.uuid4().hex}"
    questions = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    indexes.build_indexes(spark, path, {"samples": indexes.index_record(_samples(spark, sf_dir)), "questions": questions, "validation": None})
    found = indexes.read_index(spark, path, "samples", "image_id long, items array<struct<category_name string>>", "SMALL")
    return found.select("image_id", F.size("items").cast("long").alias("items"), F.size(F.filter("items", lambda i: i["category_name"] == "SMALL")).cast("long").alias("small"))


@query(
    f"""WITH {SQL} SELECT pred_id, score, x0 + 10 AS x0, y0 + 20 AS y0, x1 + 10 AS x1, y1 + 20 AS y1 FROM v_pred WHERE score >= CASE category WHEN 'LARGE' THEN 0.9 ELSE 0.75 END"""
)
def instance_predictions(spark, sf_dir):
    """A quarter of the boxes have no width; their masks give them back."""
    found = predictions(spark, sf_dir)
    runs = masks.rectangle_runs(found, "pred_id")
    flat = found.withColumn("x1", F.when(F.col("pred_id") % 4 == 0, F.col("x0")).otherwise(F.col("x1")))
    return prediction_rows.instance_rows(flat, runs, {"LARGE": 0.9}, 0.75, 10.0, 20.0).select("pred_id", "score", "x0", "y0", "x1", "y1")


@query(f"WITH {SQL} SELECT pred_id, greatest(0, least(1, score * 1.5 - 0.25)) AS confidence, ((x1 - x0) * (y1 - y0))::BIGINT AS pixels, x0 - 5 AS x0, y0 AS y0, x1 - 5 AS x1, y1 AS y1 FROM v_pred WHERE (x1 - x0) * (y1 - y0) >= 300")
def mask_region_rows(spark, sf_dir):
    found = predictions(spark, sf_dir)
    regions = found.select("pred_id", (F.col("score") * 1.5 - 0.25).alias("confidence"))
    return prediction_rows.mask_regions(regions, masks.rectangle_runs(found, "pred_id"), "pred_id", 300, dx=-5.0)


@query(
    f"""WITH {SQL} SELECT image_id, CASE category WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 END AS category_id, score, [x0, y0, x1 - x0 - 4, y1 - y0] AS bbox, [[x0 + 7, y0 - 3, x1 + 7, y0 - 3, x1 + 7, y1 - 3]] AS segmentation
    FROM v_pred WHERE category IN ('SMALL', 'LARGE') AND x1 - x0 > 4 AND pred_id % 5 <> 0"""
)
def coco_result_rows(spark, sf_dir):
    """Regions with a short polygon beside a whole one, for every fifth the short one alone."""
    short, whole = F.array(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y0")), F.array("x0", "y0", "x1", "y0", "x1", "y1")
    polygons = prediction_rows.moved_polygons(F.when(F.col("pred_id") % 5 == 0, F.array(short)).otherwise(F.array(short, whole)), 7.0, -3.0)
    region = F.struct(F.col("category").alias("label"), F.col("score").alias("confidence"), F.struct("x0", "y0", (F.col("x1") - 4).alias("x1"), "y1").alias("box"), polygons.alias("mask"))
    rows = predictions(spark, sf_dir).groupBy("image_id").agg(F.collect_list(region).alias("regions"))  # an image's regions
    label = F.col("r.label")
    return prediction_rows.coco_results(rows, F.when(label == "SMALL", 1).when(label == "LARGE", 2))


@query(
    f"""WITH {SQL}, f AS (SELECT category IN ('SMALL', 'LARGE') AND x1 - x0 > 5 AND ann_id % 3 <> 0 AS ok FROM v_ann WHERE image_id IN (SELECT o_orderkey FROM orders))
    SELECT (SELECT count(*) FROM orders) AS images, count(*) FILTER (ok) AS annotations, count(*) FILTER (NOT ok) AS skipped FROM f"""
)
def item_conversion_counters(spark, sf_dir):
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    polygons = F.when(F.col("ann_id") % 3 == 0, F.array(F.array("x0", "y0"))).otherwise(F.array(F.array("x0", "y0", "x1", "y0", "x1", "y1")))
    items = annotations(spark, sf_dir).select("image_id", F.when(F.col("category").isin("SMALL", "LARGE"), F.lower("category")).alias("target"), conversion.loose_polygons(polygons).alias("polygons"), conversion.xyxy_to_xywh(F.array("x0", "y0", F.col("x1") - 5, "y1")).alias("bbox"))
    return prediction_rows.item_conversion(images, items)
