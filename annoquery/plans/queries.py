"""Registered queries of the annotation operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import box, text
from ..operators import conversion, etl, evaluate, governance, grounding, masks, reports, retrieval, sampling
from ..sources import views
from ..sources.views import SQL, annotations, predictions, table

TAXONOMY = {"medium": "top", "standard": "dress", "large": "outerwear"}
AMBIGUOUS, PARTS = {"promo"}, {"small"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def put(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return put


_MAPPED = f"""WITH {SQL}, v_map AS (SELECT *, CASE lower(category) WHEN 'medium' THEN 'top' WHEN 'standard' THEN 'dress' WHEN 'large' THEN 'outerwear' END AS target,
    CASE lower(category) WHEN 'promo' THEN 'ambiguous_main_apparel' WHEN 'small' THEN 'garment_part' WHEN 'economy' THEN 'unknown' END AS reason FROM v_ann),
    v_kept AS (SELECT * FROM v_map WHERE image_id NOT IN (SELECT image_id FROM v_map WHERE reason = 'ambiguous_main_apparel'))"""


def _mapped(spark, sf_dir):
    return etl.map_category(annotations(spark, sf_dir), TAXONOMY, AMBIGUOUS, PARTS)


@query(_MAPPED + " SELECT coalesce(target, 'dropped:' || reason) AS label, count(*) AS annotations, count(DISTINCT image_id) AS images, sum(iscrowd::BIGINT)::BIGINT AS crowd FROM v_kept GROUP BY 1")
def class_audit(spark, sf_dir):
    return etl.audit_counts(etl.drop_ambiguous_images(_mapped(spark, sf_dir)))


@query(_MAPPED + " SELECT image_id, ann_id, target FROM v_kept WHERE target IS NOT NULL")
def mapped_annotations(spark, sf_dir):
    return etl.drop_ambiguous_images(_mapped(spark, sf_dir)).where("target is not null").select("image_id", "ann_id", "target")


@query(f"WITH {SQL} SELECT image_id, ann_id FROM v_ann WHERE image_id IN (SELECT image_id FROM v_ann WHERE category = 'SMALL' AND NOT iscrowd)")
def class_replay_subset(spark, sf_dir):
    return etl.images_with(annotations(spark, sf_dir), (F.col("category") == "SMALL") & ~F.col("iscrowd")).select("image_id", "ann_id")


@query(f"WITH {SQL} SELECT image_id, count(*) AS n FROM v_ann WHERE image_id IN (SELECT image_id FROM v_ann WHERE category = 'LARGE' AND area > 0 AND area < 1024) GROUP BY 1")
def small_object_subset(spark, sf_dir):
    kept = etl.images_with(annotations(spark, sf_dir), (F.col("category") == "LARGE") & (F.col("area") > 0) & (F.col("area") < 1024))
    return kept.groupBy("image_id").agg(F.count("*").alias("n"))


@query(f"WITH {SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY image_id) AS rn FROM (SELECT DISTINCT category, image_id FROM v_ann)) SELECT DISTINCT image_id FROM r WHERE rn <= 50")
def first_images_per_class(spark, sf_dir):
    return etl.first_images_per_class(annotations(spark, sf_dir), 50)


@query("SELECT o_orderkey AS image_id, row_number() OVER (ORDER BY lpad(o_orderkey::VARCHAR, 8, '0'), o_orderkey::VARCHAR) AS new_id FROM orders")
def dense_image_ids(spark, sf_dir):
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("file_name"))
    return etl.renumber(images, ["file_name", "image_id"], "new_id").select("image_id", "new_id")


_PAIRS = f"""WITH {SQL}, v_pairs AS (SELECT * FROM (SELECT p.image_id, p.category, pred_id, ann_id, round(
    greatest(0, least(p.x1, g.x1) - greatest(p.x0, g.x0)) * greatest(0, least(p.y1, g.y1) - greatest(p.y0, g.y0)) /
    ((p.x1 - p.x0) * (p.y1 - p.y0) + (g.x1 - g.x0) * (g.y1 - g.y0) - greatest(0, least(p.x1, g.x1) - greatest(p.x0, g.x0)) * greatest(0, least(p.y1, g.y1) - greatest(p.y0, g.y0))), 9) AS iou
    FROM v_pred p JOIN v_ann g ON p.image_id = g.image_id AND p.category = g.category) WHERE iou > 0)"""


@query(_PAIRS + " SELECT pred_id, ann_id, iou FROM v_pairs")
def box_iou_pairs(spark, sf_dir):
    return evaluate.iou_pairs(predictions(spark, sf_dir), annotations(spark, sf_dir)).select(F.col("p_pred_id").alias("pred_id"), F.col("g_ann_id").alias("ann_id"), "iou")


def greedy_sql(source: str, keys: str, name: str) -> str:
    """Common table expressions that match one to one: the ordered pairs of a group are walked, with lists of what is taken."""
    same = " AND ".join(f"o.{k} = w.{k}" for k in keys.split(", "))
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY iou DESC, pred_id, ann_id) AS rn FROM {source}),
    {name}_w AS (SELECT {keys}, rn, [pred_id] AS ps, [ann_id] AS gs FROM {name}_o WHERE rn = 1 UNION ALL
      SELECT {", ".join("o." + k for k in keys.split(", "))}, o.rn, CASE WHEN list_contains(ps, pred_id) OR list_contains(gs, ann_id) THEN ps ELSE list_append(ps, pred_id) END,
        CASE WHEN list_contains(ps, pred_id) OR list_contains(gs, ann_id) THEN gs ELSE list_append(gs, ann_id) END FROM {name}_w w JOIN {name}_o o ON {same} AND o.rn = w.rn + 1),
    {name}_l AS (SELECT * FROM {name}_w QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY rn DESC) = 1),
    {name} AS (SELECT * FROM (SELECT {keys}, unnest(ps) AS pred_id, unnest(gs) AS ann_id FROM {name}_l) JOIN (SELECT {keys}, pred_id, ann_id, iou FROM {name}_o) USING ({keys}, pred_id, ann_id))"""


_MATCH = _PAIRS.replace("WITH", "WITH RECURSIVE", 1) + ", v_good AS (SELECT p.image_id, p.category, pred_id, ann_id, iou FROM v_pairs JOIN v_pred p USING (pred_id) WHERE iou >= 0.5), " + greedy_sql("v_good", "image_id, category", "v_match")


@query(_MATCH + " SELECT pred_id, ann_id, iou FROM v_match")
def greedy_matches(spark, sf_dir):
    return evaluate.greedy_match(evaluate.iou_pairs(predictions(spark, sf_dir), annotations(spark, sf_dir))).select("pred_id", "ann_id", "iou")


@query(
    _MATCH
    + """, g AS (SELECT category, count(*) AS gt FROM v_ann GROUP BY 1), p AS (SELECT category, count(*) AS pred FROM v_pred GROUP BY 1),
    m AS (SELECT category, count(*) AS matched, avg(iou) AS mean_iou, median(iou) AS median_iou, sum(iou) AS total, count(*) FILTER (iou >= 0.85) AS high FROM v_match GROUP BY 1),
    r AS (SELECT category, coalesce(gt, 0) AS gt, coalesce(pred, 0) AS pred, coalesce(matched, 0) AS matched, mean_iou, median_iou, total, coalesce(high, 0) AS high FROM g FULL JOIN p USING (category) FULL JOIN m USING (category))
    SELECT category, gt, pred, matched, round(100.0 * (matched::DOUBLE / nullif(pred, 0)), 6) AS precision50, round(100.0 * (matched::DOUBLE / nullif(gt, 0)), 6) AS recall50, round(100.0 * ((2 * matched)::DOUBLE / nullif(gt + pred, 0)), 6) AS f1,
    round(100 * mean_iou, 4) AS matched_iou, round(100 * median_iou, 4) AS median_iou, CASE WHEN gt > 0 THEN round(100 * coalesce(total, 0) / gt, 4) END AS all_gt_iou, round(100.0 * (high::DOUBLE / nullif(matched, 0)), 6) AS matched85, round(100.0 * (high::DOUBLE / nullif(gt, 0)), 6) AS all_gt85 FROM r"""
)
def match_summary_by_category(spark, sf_dir):
    p, g = predictions(spark, sf_dir), annotations(spark, sf_dir)
    return evaluate.match_summary(g, p, evaluate.greedy_match(evaluate.iou_pairs(p, g)), "category")


@query(
    _MATCH
    + """, h AS (SELECT category, score, pred_id, pred_id IN (SELECT pred_id FROM v_match) AS tp FROM v_pred), n AS (SELECT category, count(*) AS gt FROM v_ann GROUP BY 1),
    c AS (SELECT category, gt, sum(tp::INT) OVER w AS tps, count(*) OVER w AS seen FROM h JOIN n USING (category) WINDOW w AS (PARTITION BY category ORDER BY score DESC, pred_id ROWS UNBOUNDED PRECEDING)),
    pts AS (SELECT category, i, max(tps::DOUBLE / seen) AS precision FROM c JOIN (SELECT unnest(range(101)) AS i) r ON tps * 100 >= i * gt GROUP BY 1, 2), a AS (SELECT category, sum(precision) AS total FROM pts GROUP BY 1)
    SELECT category, CASE WHEN gt IS NOT NULL THEN round(100 * coalesce(total, 0) / 101, 6) END AS ap FROM (SELECT DISTINCT category FROM v_pred UNION SELECT category FROM n) LEFT JOIN n USING (category) LEFT JOIN a USING (category)"""
)
def average_precision_by_category(spark, sf_dir):
    p, g = predictions(spark, sf_dir), annotations(spark, sf_dir)
    return evaluate.average_precision(p, g, evaluate.greedy_match(evaluate.iou_pairs(p, g)))


@query(
    _PAIRS.replace("WITH", "WITH RECURSIVE", 1)
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, category ORDER BY score DESC, pred_id) AS rank FROM v_pred),
    grid AS (SELECT threshold::DOUBLE AS threshold, k FROM (VALUES (0.0), (0.25), (0.5), (0.8)) t(threshold), (VALUES (1), (3), (100)) k(k)),
    v_in AS (SELECT threshold, k, r.image_id, r.category, pred_id, ann_id, iou FROM v_pairs JOIN ranked r USING (pred_id) JOIN grid ON score >= threshold AND rank <= k WHERE iou >= 0.5), """
    + greedy_sql("v_in", "threshold, k, image_id, category", "v_point")
    + """, c AS (SELECT threshold, k, count(*) AS pred FROM ranked JOIN grid ON score >= threshold AND rank <= k GROUP BY 1, 2), n AS (SELECT category, count(*) AS size FROM v_ann GROUP BY 1),
    b AS (SELECT threshold, k, category, count(*) AS m, any_value(size) AS size FROM v_point JOIN n USING (category) GROUP BY 1, 2, 3), t AS (SELECT threshold, k, sum(m) AS matched, sum(m::DOUBLE / size) AS recalls FROM b GROUP BY 1, 2),
    o AS (SELECT threshold, k, pred, coalesce(matched, 0)::BIGINT AS matched, (SELECT sum(size) FROM n) AS gt, coalesce(recalls, 0) / (SELECT count(*) FROM n) AS macro FROM c LEFT JOIN t USING (threshold, k)),
    f AS (SELECT threshold, k, pred, matched, round(100.0 * (matched::DOUBLE / pred), 6) AS precision, round(100.0 * (matched::DOUBLE / gt), 6) AS recall, round(100.0 * ((2 * matched)::DOUBLE / (pred + gt)), 6) AS f1, round(100 * macro, 6) AS macro_recall FROM o)
    SELECT *, row_number() OVER (ORDER BY f1 DESC, threshold, k) = 1 AS best_f1, row_number() OVER (ORDER BY macro_recall DESC, threshold, k) = 1 AS best_macro FROM f"""
)
def operating_point_scan(spark, sf_dir):
    return evaluate.operating_points(predictions(spark, sf_dir), annotations(spark, sf_dir), [0.0, 0.25, 0.5, 0.8], [1, 3, 100])


@query(f"WITH {SQL} SELECT pred_id, rank FROM (SELECT pred_id, row_number() OVER (PARTITION BY image_id, category ORDER BY score DESC, pred_id) AS rank FROM v_pred) WHERE rank <= 2")
def top_predictions(spark, sf_dir):
    return evaluate.top_k(predictions(spark, sf_dir), 2).select("pred_id", "rank")


@query(
    f"""WITH {SQL}, g AS (SELECT image_id, ann_id AS garment, greatest(0, x0 - 40) AS gx0, greatest(0, y0 - 40) AS gy0, least(200, x1 + 40) AS gx1, least(200, y1 + 40) AS gy1 FROM v_ann WHERE line = 1),
    c AS (SELECT ann_id AS part, garment, count(*) OVER (PARTITION BY ann_id) AS n FROM v_ann a JOIN g USING (image_id) WHERE line <> 1
      AND greatest(0, least(x1, gx1) - greatest(x0, gx0)) * greatest(0, least(y1, gy1) - greatest(y0, gy0)) / ((x1 - x0) * (y1 - y0)) >= 0.8)
    SELECT part, garment FROM c WHERE n = 1"""
)
def part_containers(spark, sf_dir):
    rows = annotations(spark, sf_dir)
    grown = [F.greatest(F.lit(0.0), F.col(c) - 40).alias(f"g_{c}") for c in ("x0", "y0")] + [F.least(F.lit(200.0), F.col(c) + 40).alias(f"g_{c}") for c in ("x1", "y1")]
    garments = rows.where("line = 1").select("image_id", F.col("ann_id").alias("garment"), *grown)
    parts = rows.where("line <> 1").select("image_id", F.col("ann_id").alias("part"), *[F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")])
    return conversion.containers(parts, garments, box.coverage("p_", "g_") >= 0.8)


@query(
    f"""WITH {SQL}, c AS (SELECT image_id, category, ann_id, (x0 + x1) / 2 AS cx, row_number() OVER w AS rn, lead((x0 + x1) / 2) OVER w AS nxt FROM v_ann WINDOW w AS (PARTITION BY image_id, category ORDER BY (x0 + x1) / 2, ann_id))
    SELECT image_id, category, ann_id AS leftmost FROM c WHERE rn = 1 AND nxt - cx >= 10"""
)
def leftmost_regions(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("image_id", "category").orderBy("cx", "ann_id")
    rows = annotations(spark, sf_dir).withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("rn", F.row_number().over(order)).withColumn("nxt", F.lead("cx").over(order))
    return rows.where("rn = 1 and nxt - cx >= 200 * 0.05").select("image_id", "category", F.col("ann_id").alias("leftmost"))


@query(f"WITH {SQL}, p AS (SELECT p.image_id, pred_id, ann_id, greatest(0, least(p.x1, g.x1) - greatest(p.x0, g.x0)) * greatest(0, least(p.y1, g.y1) - greatest(p.y0, g.y0)) AS i, (p.x1 - p.x0) * (p.y1 - p.y0) + (g.x1 - g.x0) * (g.y1 - g.y0) AS s FROM v_pred p JOIN v_ann g ON p.image_id = g.image_id) SELECT image_id, pred_id, ann_id, round(i / (s - i), 9) AS iou FROM p WHERE i > 0")
def mask_iou_pairs(spark, sf_dir):
    left = masks.rectangle_masks(predictions(spark, sf_dir), "pred_id")
    right = masks.rectangle_masks(annotations(spark, sf_dir), "ann_id")
    return masks.mask_iou(left, right, "pred_id", "ann_id")


@query(f"WITH {SQL}, px AS (SELECT DISTINCT image_id, x, unnest(generate_series(y0::INT, y1::INT - 1)) AS y FROM (SELECT image_id, y0, y1, unnest(generate_series(x0::INT, x1::INT - 1)) AS x FROM v_ann)) SELECT image_id, count(*) AS pixels FROM px GROUP BY 1")
def union_mask_area(spark, sf_dir):
    return masks.union_masks(masks.rectangle_masks(annotations(spark, sf_dir), "ann_id"), ["image_id"]).select("image_id", "pixels")


def _corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source")


@query(
    """WITH c AS (SELECT doc_id, lang || '/' || source AS stratum FROM documents), n AS (SELECT stratum, count(*) AS n FROM c GROUP BY 1),
    f AS (SELECT level, sum(count(*)) OVER (ORDER BY level) AS filled FROM (SELECT unnest(range(1, n + 1)) AS level FROM n) GROUP BY level),
    l AS (SELECT coalesce(max(level), 0) AS level, coalesce(max(filled), 0) AS filled FROM f WHERE filled <= 300),
    q AS (SELECT stratum, least(n, level) + CASE WHEN n > level AND row_number() OVER (ORDER BY n <= level, stratum) <= 300 - filled THEN 1 ELSE 0 END AS quota FROM n, l),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256(concat('seed', chr(0), doc_id::VARCHAR)), doc_id) AS rank FROM c)
    SELECT doc_id, r.stratum, rank FROM r JOIN q USING (stratum) WHERE rank <= quota"""
)
def balanced_sample(spark, sf_dir):
    stratum = F.concat_ws("/", "lang", "source")
    return sampling.balanced_subset(_corpus(spark, sf_dir), stratum, "doc_id", 300, "seed").select("doc_id", "stratum", "rank")


@query(
    """WITH h AS (SELECT 'd/' || doc_id AS path, sha256(text) AS sha, doc_id FROM documents), e AS (SELECT path FROM h WHERE doc_id % 7 = 0),
    m AS (SELECT h.*, path IN (SELECT path FROM e) OR sha IN (SELECT sha FROM h WHERE path IN (SELECT path FROM e)) AS out FROM h),
    f AS (SELECT sha, min(path) AS first FROM m WHERE NOT out GROUP BY 1)
    SELECT path, CASE WHEN out THEN 'excluded' WHEN path <> first THEN 'duplicate' ELSE 'candidate' END AS status FROM m LEFT JOIN f USING (sha)"""
)
def holdout_inventory(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha"), "doc_id")
    return governance.holdout_status(files.select("path", "sha"), files.where("doc_id % 7 = 0").select("path")).select("path", "status")


@query("SELECT conv_id, turn FROM conversations j WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations r WHERE r.role = 'assistant' AND r.conv_id = j.conv_id AND r.turn = j.turn + 1)")
def pending_jobs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    results = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return governance.pending(turns.where("role = 'user'").select("conv_id", "turn"), results, ["conv_id", "turn"])


@query("SELECT user_id AS image_id, event_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_decisions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), "event_id", "ts", F.col("event_type").alias("status"))
    return governance.latest_decision(rows, "image_id").select("image_id", "event_id", "status")


@query(
    """WITH w AS (SELECT event_type AS route, value AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
    SELECT route, count(*) AS n, round(avg(ms), 6) AS mean_ms, round(median(ms), 6) AS median_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, min(ms) AS min_ms, max(ms) AS max_ms, round(1000 / avg(ms), 6) AS per_second FROM w WHERE rn > 1 GROUP BY 1"""
)
def warm_latency(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("route"), F.col("value").alias("ms"), F.struct("ts", "event_id").alias("at"))
    cold = rows.groupBy("user_id").agg(F.min("at").alias("at"))
    return evaluate.latency_summary(rows.join(cold, ["user_id", "at"], "left_anti"), "route")


@query(
    """WITH v AS (SELECT vec_id, vec_id // 10 AS image_id, embedding::DOUBLE[] AS e, label FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, r.vec_id AS region_id, q.label = r.label AS positive, round(list_dot_product(q.e, r.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(r.e, r.e))), 6) AS score FROM v q JOIN v r USING (image_id) WHERE q.vec_id % 2 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, region_id) AS rank, sum(positive::INT) OVER (PARTITION BY query_id) AS targets FROM s)
    SELECT query_id, max(targets)::BIGINT AS targets, min(CASE WHEN positive THEN rank END) AS first_rank, sum((positive AND rank <= targets)::INT) = max(targets) AS exact_set FROM k GROUP BY 1"""
)
def candidate_retrieval(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 10).alias("image_id"), "embedding", "label")
    return retrieval.retrieval_metrics(retrieval.rank_candidates(v.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "region_id")))


@query(
    """WITH t AS (SELECT l_orderkey AS query_id, l_discount * 10 >= 0.5 AS p, l_tax >= 0.04 AS t FROM lineitem)
    SELECT query_id, count(*) AS patches, round(sum((p AND t)::INT)::DOUBLE / sum((p OR t)::INT), 9) AS iou FROM t GROUP BY 1 HAVING bool_or(t) AND NOT bool_and(t)"""
)
def patch_iou(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_discount") * 10 >= 0.5).alias("p"), (F.col("l_tax") >= 0.04).alias("t"))
    iou = F.round(F.count_if(F.col("p") & F.col("t")) / F.count_if(F.col("p") | F.col("t")), 9)
    return rows.groupBy("query_id").agg(F.count("*").alias("patches"), iou.alias("iou"), F.bool_or("t").alias("fg"), F.bool_and("t").alias("all")).where("fg and not all").select("query_id", "patches", "iou")


@query(
    f"""WITH {SQL}, r AS (SELECT *, CASE WHEN area < 1024 THEN 'small' WHEN area < 9216 THEN 'medium' ELSE 'large' END AS bucket FROM v_ann)
    SELECT a.axis, a.value, count(*) AS n, round(avg(area), 6) AS mean FROM (SELECT area, unnest([{{'axis': 'category', 'value': category}}, {{'axis': 'bucket', 'value': bucket}}, {{'axis': 'crowd', 'value': iscrowd::VARCHAR}}]) AS a FROM r) GROUP BY 1, 2"""
)
def report_by_axes(spark, sf_dir):
    bucket = F.when(F.col("area") < 1024, "small").when(F.col("area") < 9216, "medium").otherwise("large")
    return evaluate.summary_by_axes(annotations(spark, sf_dir), {"category": F.col("category"), "bucket": bucket, "crowd": F.col("iscrowd")}, F.col("area"))


@query(
    f"""WITH {SQL}, h AS (SELECT category AS value, count(DISTINCT image_id) AS n FROM v_ann WHERE NOT iscrowd GROUP BY 1),
    q AS (SELECT * FROM (VALUES ('PROMO', 5000), ('SMALL', 500), ('OTHER', 10)) t(value, required))
    SELECT value, required::BIGINT AS required, coalesce(n, 0) AS have, greatest(required - coalesce(n, 0), 0) AS deficit, coalesce(n, 0) >= required AS met FROM q LEFT JOIN h USING (value)"""
)
def quota_supply(spark, sf_dir):
    have = annotations(spark, sf_dir).where("not iscrowd").groupBy(F.col("category").alias("value")).agg(F.countDistinct("image_id").alias("n"))
    quota = spark.createDataFrame([("PROMO", 5000), ("SMALL", 500), ("OTHER", 10)], "value string, required long")
    return governance.quota_gaps(have, quota)


def _values(rows) -> str:
    """Rows as SQL VALUES."""
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


#: Views for the records that name regions: every line is a part, lines numbered 1 are the garments.
_PARTS = f"""WITH {SQL}, v_names AS (SELECT * FROM (VALUES {_values((i, en, zh) for i, (en, zh, _) in enumerate(grounding.PARTS))}) t(i, label, label_zh)),
    v_garments AS (SELECT image_id, CASE category WHEN 'MEDIUM' THEN 'top' WHEN 'STANDARD' THEN 'dress' WHEN 'LARGE' THEN 'outerwear' END AS garment,
      CASE category WHEN 'MEDIUM' THEN '上衣' WHEN 'STANDARD' THEN '连衣裙' WHEN 'LARGE' THEN '外套' END AS garment_zh FROM v_ann WHERE line = 1),
    v_parts AS (SELECT a.image_id, ann_id, label, label_zh, garment, garment_zh FROM v_ann a JOIN v_names ON i = ann_id % 19 LEFT JOIN v_garments g ON g.image_id = a.image_id WHERE line <> 1),
    v_plain AS (SELECT image_id, label, label_zh, NULL AS garment, NULL AS garment_zh, count(*) AS n, array_to_string(list_sort(list(ann_id)), '-') AS ids FROM v_parts GROUP BY 1, 2, 3),
    v_related AS (SELECT image_id, label, label_zh, garment, garment_zh, count(*) AS n, array_to_string(list_sort(list(ann_id)), '-') AS ids FROM v_parts WHERE garment IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
    v_groups AS (SELECT * FROM v_plain UNION ALL SELECT * FROM v_related),
    v_named AS (SELECT *, CASE WHEN n = 1 THEN label_zh ELSE '所有' || label_zh END AS zh, CASE WHEN n = 1 THEN 'the ' || label ELSE 'all ' || label || 's' END AS en, coalesce('relation-' || garment, 'basic') AS template FROM v_groups),
    v_both AS (SELECT *, unnest(['zh', 'en']) AS language FROM v_named),
    v_records AS (SELECT image_id || '-' || label || '-' || template || '-' || language || '-' || ids AS sample_id, image_id, label, language, n,
      CASE WHEN language = 'zh' THEN coalesce('这件' || garment_zh || '上的', '这件衣服的') || zh ELSE en || ' on the ' || CASE WHEN garment IS NULL THEN 'garment' WHEN garment = 'top' THEN 'top garment' ELSE garment END END AS query FROM v_both)"""
_GARMENTS = {"MEDIUM": ("top", "上衣"), "STANDARD": ("dress", "连衣裙"), "LARGE": ("outerwear", "外套")}


def _records(spark, sf_dir):
    rows = annotations(spark, sf_dir)
    pick = lambda i, names: F.try_element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v[i])]), F.col("category"))
    garments = rows.where("line = 1").select("image_id", pick(0, _GARMENTS).alias("garment"), pick(1, _GARMENTS).alias("garment_zh"))
    name = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in grounding.PARTS]), (F.col("ann_id") % 19 + 1).cast("int"))
    parts = rows.where("line <> 1").select("image_id", "ann_id", name(0).alias("label"), name(1).alias("label_zh"))
    return grounding.expressions(parts.join(garments, "image_id", "left"))


@query(_PARTS + " SELECT sample_id, image_id, label, language, query, n FROM v_records")
def grounding_records(spark, sf_dir):
    return _records(spark, sf_dir)


_TERMS = ", ".join(f"({i}, {p}, '{label}', '{term}')" for i, (label, _, term, p) in enumerate(grounding.TERMS))


@query(
    _PARTS
    + f""", t AS (SELECT * FROM (VALUES {_TERMS}) t(i, priority, region, term)), q AS (SELECT DISTINCT query FROM v_records),
    b AS (SELECT query, arg_max({{'region': region, 'term': term}}, (length(term), priority, -i)) AS best FROM q JOIN t ON contains(lower(query), term) GROUP BY 1)
    SELECT query, coalesce(best.region, 'custom') AS region, coalesce(best.term, query) AS term FROM q LEFT JOIN b USING (query)"""
)
def resolved_prompts(spark, sf_dir):
    found = _records(spark, sf_dir).select("query").distinct().withColumn("p", grounding.resolve_prompt("query"))
    return found.select("query", F.col("p.label").alias("region"), F.col("p.term").alias("term"))


@query(
    "SELECT role, count(*) AS turns, count(*) FILTER (regexp_matches(text, '[()（）\\[\\]]')) AS brackets, count(*) FILTER (regexp_matches(text, '[?？]')) AS questions, "
    "count(*) FILTER (regexp_matches(text, '[\"“”「」]')) AS quotes FROM conversations GROUP BY 1"
)
def unclean_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("r", grounding.unclean_reasons("text"))
    broken = lambda name: F.count_if(F.array_contains("r", name))
    return rows.groupBy("role").agg(F.count("*").alias("turns"), broken("brackets").alias("brackets"), broken("question").alias("questions"), broken("quotes").alias("quotes"))


@query(
    f"""WITH {SQL}, d AS (SELECT * FROM v_pred WHERE category = 'STANDARD'), t AS (SELECT * FROM v_pred WHERE category = 'MEDIUM'), l AS (SELECT * FROM v_pred WHERE category IN ('SMALL', 'LARGE')),
    p AS (SELECT d.*, t.pred_id AS t_id, l.pred_id AS l_id, least(t.x0, l.x0) AS ux0, least(t.y0, l.y0) AS uy0, greatest(t.x1, l.x1) AS ux1, greatest(t.y1, l.y1) AS uy1, round((t.score + l.score) / 2 - d.score, 9) AS gap
      FROM d JOIN t ON t.image_id = d.image_id AND greatest(0, least(t.x1, d.x1) - greatest(t.x0, d.x0)) * greatest(0, least(t.y1, d.y1) - greatest(t.y0, d.y0)) >= 0.1 * ((t.x1 - t.x0) * (t.y1 - t.y0))
      JOIN l ON l.image_id = d.image_id AND greatest(0, least(l.x1, d.x1) - greatest(l.x0, d.x0)) * greatest(0, least(l.y1, d.y1) - greatest(l.y0, d.y0)) >= 0.1 * ((l.x1 - l.x0) * (l.y1 - l.y0))
      WHERE t.y0 + t.y1 < l.y0 + l.y1),
    i AS (SELECT *, greatest(0, least(x1, ux1) - greatest(x0, ux0)) * greatest(0, least(y1, uy1) - greatest(y0, uy0)) AS c FROM p),
    u AS (SELECT *, round(c / ((x1 - x0) * (y1 - y0) + (ux1 - ux0) * (uy1 - uy0) - c), 9) AS union_iou FROM i)
    SELECT pred_id AS whole_id, t_id AS upper_id, l_id AS lower_id, gap, union_iou FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY gap DESC, union_iou DESC, t_id, l_id) AS rn FROM u WHERE union_iou >= 0.1 AND gap >= 0) WHERE rn = 1"""
)
def composite_conflicts(spark, sf_dir):
    return evaluate.composite_conflicts(predictions(spark, sf_dir), "STANDARD", "MEDIUM", ["SMALL", "LARGE"], 0.1, 0.1)


@query(
    f"""WITH {SQL}, c AS (SELECT image_id, pred_id, score, greatest(0, least(200, x0)) AS x0, greatest(0, least(200, y0)) AS y0, greatest(0, least(200, x1)) AS x1, greatest(0, least(200, y1)) AS y1 FROM v_pred WHERE score >= 0.7),
    r AS (SELECT image_id, pred_id, score, round((x1 - x0) * (y1 - y0) * score / (1 + 0.5 * sqrt(pow(((x0 + x1) / 2 - 100) / 100, 2) + pow(((y0 + y1) / 2 - 100) / 100, 2))), 6) AS rank
      FROM c WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) / 40000 >= 0.005)
    SELECT image_id, pred_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rank DESC, score DESC, pred_id) AS rn FROM r) WHERE rn = 1"""
)
def primary_subjects(spark, sf_dir):
    return evaluate.primary_subject(predictions(spark, sf_dir), 200, 200)


_BEST = _PAIRS + ", m AS (SELECT ann_id, max(iou) AS iou FROM v_pairs GROUP BY 1), b AS (SELECT a.*, coalesce(iou, 0) AS best FROM v_ann a LEFT JOIN m USING (ann_id))"


@query(_BEST + " SELECT category, count(*) AS targets, round(100.0 * (count_if(best >= 0.5)::DOUBLE / count(*)), 6) AS recall50, round(100.0 * (count_if(best >= 0.75)::DOUBLE / count(*)), 6) AS recall75, round(100 * avg(best), 6) AS mean_best FROM b GROUP BY 1")
def proposal_recall(spark, sf_dir):
    return evaluate.proposal_recall(evaluate.best_overlaps(predictions(spark, sf_dir), annotations(spark, sf_dir)), "category")


@query(_BEST + " SELECT image_id, count(*) FILTER (NOT iscrowd) AS scored, bool_and(CASE WHEN NOT iscrowd THEN best >= 0.5 END) AS passed FROM b GROUP BY 1")
def contrast_sets(spark, sf_dir):
    best = evaluate.best_overlaps(predictions(spark, sf_dir), annotations(spark, sf_dir))
    return evaluate.contrast_sets(best, "image_id", ~F.col("iscrowd"), F.col("best") >= 0.5)


@query(
    """WITH t AS (SELECT l_orderkey AS query_id, round(l_discount * 10, 6) AS prob, l_tax >= 0.04 AS target FROM lineitem),
    q AS (SELECT threshold, query_id, count_if(prob >= threshold AND target)::DOUBLE / count_if(prob >= threshold OR target) AS iou FROM t, (VALUES (0.2), (0.4), (0.5), (0.8)) g(threshold) GROUP BY 1, 2 HAVING bool_or(target) AND NOT bool_and(target)),
    s AS (SELECT threshold::DOUBLE AS threshold, count(*) AS queries, round(100.0 * (count_if(iou >= 0.5)::DOUBLE / count(*)), 6) AS recall50, round(100 * avg(iou), 6) AS mean_iou FROM q GROUP BY 1)
    SELECT *, row_number() OVER (ORDER BY recall50 DESC, mean_iou DESC, threshold DESC) = 1 AS best FROM s"""
)
def threshold_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.round(F.col("l_discount") * 10, 6).alias("prob"), (F.col("l_tax") >= 0.04).alias("target"))
    return evaluate.threshold_scan(rows, [0.2, 0.4, 0.5, 0.8])


@query(
    f"""WITH {SQL}, r AS (SELECT l_orderkey AS query_id, l_linenumber AS patch, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS rank, count(*) OVER (PARTITION BY l_orderkey) AS size FROM v_lines)
    SELECT query_id, patch, rank FROM r WHERE rank <= greatest(1, round_even(size * 0.25, 0))"""
)
def top_area_patches(spark, sf_dir):
    return evaluate.top_patches(views.lines(spark, sf_dir).select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("patch"), F.col("l_discount").alias("prob")), 0.25)


@query(
    """WITH r AS (SELECT doc_id, unnest([CASE WHEN coalesce(NOT (trim(text) <> ''), TRUE) THEN 'text' END, CASE WHEN coalesce(length(text) <> n_chars, TRUE) THEN 'n_chars' END,
    CASE WHEN coalesce(lang NOT IN ('en', 'de'), TRUE) THEN 'language' END, CASE WHEN coalesce(NOT regexp_full_match(source, '[a-z0-9][a-z0-9_-]*'), TRUE) THEN 'source' END]) AS rule FROM documents) SELECT * FROM r WHERE rule IS NOT NULL"""
)
def record_violations(spark, sf_dir):
    rules = {"text": F.trim("text") != "", "n_chars": F.length("text") == F.col("n_chars"), "language": F.col("lang").isin("en", "de"), "source": F.col("source").rlike("^[a-z0-9][a-z0-9_-]*$")}
    return governance.violations(table(spark, sf_dir, "documents"), "doc_id", rules)


@query(
    """WITH s AS (SELECT l_orderkey AS id, count(*) AS n, min(l_linestatus) AS least, max(l_linestatus) AS most FROM lineitem GROUP BY 1),
    b AS (SELECT coalesce(o_orderkey, id) AS id, o_orderkey, o_orderstatus, n, least, most FROM orders FULL JOIN s ON id = o_orderkey),
    p AS (SELECT id, unnest([CASE WHEN o_orderkey IS NULL THEN 'unknown' END, CASE WHEN n IS NULL THEN 'missing' END, CASE WHEN n > 1 THEN 'repeated' END,
      CASE WHEN o_orderkey IS NOT NULL AND n IS NOT NULL AND (least IS DISTINCT FROM o_orderstatus OR most IS DISTINCT FROM o_orderstatus) THEN 'changed' END]) AS problem FROM b) SELECT * FROM p WHERE problem IS NOT NULL"""
)
def sheet_differences(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    sheet = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("status"))
    return governance.sheet_differences(plan, sheet, "id", ["status"])


@query(
    """WITH c AS (SELECT source AS value, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT value, unnest(range(n)) AS pos FROM c)
    SELECT row_number() OVER (ORDER BY sha256('slots-v1:source:' || value || ':' || pos), value, pos) AS slot, value FROM r"""
)
def quota_slots(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n"))
    return governance.spread_slots(counts, "source", "slots-v1")


_CASES = _PAIRS.replace("WITH", "WITH RECURSIVE", 1) + """, v_case AS (SELECT p.image_id, p.category, pred_id, ann_id, iou FROM v_pairs JOIN v_pred p USING (pred_id) JOIN (SELECT ann_id FROM v_ann WHERE NOT iscrowd) USING (ann_id) WHERE iou >= 0.5 AND score >= 0.6), """ + greedy_sql("v_case", "image_id, category", "v_match") + """, cases AS (SELECT DISTINCT image_id AS case_id, CASE image_id % 5 WHEN 0 THEN 'negative' WHEN 1 THEN 'unlabelled' WHEN 2 THEN 'mask' ELSE 'box' END AS status,
    CASE WHEN image_id % 3 > 0 THEN 1 + image_id % 4 END AS expected FROM v_ann),
    t AS (SELECT image_id AS case_id, count(*) AS targets FROM v_ann WHERE NOT iscrowd GROUP BY 1), r AS (SELECT image_id AS case_id, count(*) AS regions FROM v_pred WHERE score >= 0.6 GROUP BY 1),
    m AS (SELECT image_id AS case_id, count(*) AS matched FROM v_match GROUP BY 1),
    n AS (SELECT case_id, status, expected, coalesce(regions, 0) AS regions, status IN ('mask', 'box') AS positive,
      CASE WHEN status IN ('mask', 'box') THEN coalesce(targets, 0) ELSE 0 END AS targets, CASE WHEN status IN ('mask', 'box') THEN coalesce(matched, 0) ELSE 0 END AS matched
      FROM cases LEFT JOIN t USING (case_id) LEFT JOIN r USING (case_id) LEFT JOIN m USING (case_id)),
    p AS (SELECT *, CASE WHEN expected IS NOT NULL THEN regions = expected END AS count_passed, CASE WHEN status = 'negative' THEN regions = 0 WHEN positive THEN matched = targets END AS recall_passed FROM n),
    o AS (SELECT *, CASE WHEN positive THEN recall_passed AND coalesce(count_passed, true) ELSE recall_passed END AS query_passed FROM p)"""


def _outcomes(spark, sf_dir):
    truth, found = annotations(spark, sf_dir).where("not iscrowd"), predictions(spark, sf_dir).where("score >= 0.6")
    matched = evaluate.greedy_match(evaluate.iou_pairs(found, truth)).select(F.col("image_id").alias("case_id"))
    case = F.col("image_id").alias("case_id")
    status = F.when(F.expr("image_id % 5 = 0"), "negative").when(F.expr("image_id % 5 = 1"), "unlabelled").when(F.expr("image_id % 5 = 2"), "mask").otherwise("box")
    cases = annotations(spark, sf_dir).select(case, status.alias("status"), F.when(F.expr("image_id % 3 > 0"), F.expr("1 + image_id % 4")).alias("expected")).distinct()
    return reports.case_outcomes(cases, truth.select(case), found.select(case), matched)


@query(_CASES + " SELECT case_id, status, expected, regions, targets, matched, count_passed, recall_passed, query_passed FROM o")
def case_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query(
    _CASES
    + """, a AS (SELECT *, 'overall' AS axis, 'all' AS value FROM o UNION ALL SELECT *, 'status', status FROM o UNION ALL SELECT *, 'dimension', unnest(CASE WHEN targets > 1 THEN ['counted', 'several'] ELSE ['counted'] END) FROM o WHERE expected IS NOT NULL)
    SELECT axis, value, count(*) AS cases, count(*) FILTER (status <> 'unlabelled') AS scored, round(100.0 * ((count(*) FILTER (query_passed AND status <> 'unlabelled'))::DOUBLE / nullif(count(*) FILTER (status <> 'unlabelled'), 0)), 6) AS query_success,
    round(100.0 * ((count(*) FILTER (recall_passed AND positive))::DOUBLE / nullif(count(*) FILTER (positive), 0)), 6) AS target_recall,
    round(100.0 * ((count(*) FILTER (count_passed))::DOUBLE / nullif(count(expected), 0)), 6) AS count_success,
    round(100.0 * ((count(*) FILTER (status = 'negative' AND regions > 0))::DOUBLE / nullif(count(*) FILTER (status = 'negative'), 0)), 6) AS false_positives,
    round(100.0 * ((count(*) FILTER (regions = 0))::DOUBLE / count(*)), 6) AS empty,
    round(100.0 * (sum(matched)::DOUBLE / nullif(sum(CASE WHEN positive THEN regions ELSE 0 END), 0)), 6) AS precision, round(100.0 * (sum(matched)::DOUBLE / nullif(sum(targets), 0)), 6) AS recall FROM a GROUP BY 1, 2"""
)
def case_report(spark, sf_dir):
    several = F.when(F.col("targets") > 1, F.array(F.lit("counted"), F.lit("several"))).otherwise(F.array(F.lit("counted")))
    return reports.case_report(_outcomes(spark, sf_dir), {"status": F.array("status"), "dimension": F.when(F.col("expected").isNotNull(), several)})


_FIRST = f"""WITH {SQL}, t AS (SELECT * FROM v_ann), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id) AS rn FROM v_pred) WHERE rn = 1),
    px AS (SELECT DISTINCT image_id, x, unnest(generate_series(y0::INT, y1::INT - 1)) AS y FROM (SELECT image_id, y0, y1, unnest(generate_series(x0::INT, x1::INT - 1)) AS x FROM t)),
    u AS (SELECT image_id, count(*) AS area, count(*) FILTER (x >= x0 AND x < x1 AND y >= y0 AND y < y1) AS common, any_value((x1 - x0) * (y1 - y0)) AS own FROM px LEFT JOIN top USING (image_id) GROUP BY 1),
    o AS (SELECT image_id, n.targets, coalesce(r.regions, 0) AS regions, coalesce(round(common / (area + own - common), 9), 0.0) AS iou, coalesce(round(common / (area + own - common), 9), 0.0) > 0.5 AS passed
      FROM (SELECT image_id, count(*) AS targets FROM t GROUP BY 1) n LEFT JOIN u USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS regions FROM v_pred GROUP BY 1) r USING (image_id))"""


@query(_FIRST + " SELECT image_id, targets, regions, iou, passed FROM o")
def first_region_outcomes(spark, sf_dir):
    return reports.first_region_outcomes(annotations(spark, sf_dir), predictions(spark, sf_dir))


@query(
    _FIRST
    + """, a AS (SELECT *, 'overall' AS axis, 'all' AS value FROM o UNION ALL SELECT *, 'cardinality', CASE WHEN targets > 1 THEN 'several' ELSE 'one' END FROM o UNION ALL SELECT *, 'novelty', (image_id % 2)::VARCHAR FROM o)
    SELECT axis, value, count(*) AS cases, count(*) FILTER (passed) AS passed, round(100.0 * ((count(*) FILTER (passed))::DOUBLE / count(*)), 6) AS accuracy, round(100 * avg(iou), 6) AS mean_iou FROM a GROUP BY 1, 2"""
)
def acceptance_report(spark, sf_dir):
    rows = reports.first_region_outcomes(annotations(spark, sf_dir), predictions(spark, sf_dir))
    return reports.acceptance_report(rows, {"cardinality": F.array(F.when(F.col("targets") > 1, "several").otherwise("one")), "novelty": F.array(F.expr("image_id % 2"))})


@query(
    f"""WITH {SQL}, b AS (SELECT v AS variant, a.area AS target_area, a.x0 AS gx0, a.y0 AS gy0, a.x1 AS gx1, a.y1 AS gy1, p.x0 - v * (p.x1 - p.x0) AS px0, p.y0 - v * (p.y1 - p.y0) AS py0, p.x1 + v * (p.x1 - p.x0) AS px1, p.y1 + v * (p.y1 - p.y0) AS py1
      FROM v_ann a JOIN v_pred p ON a.ann_id = p.pred_id, (VALUES (0.0::DOUBLE), (0.125::DOUBLE), (0.25::DOUBLE)) t(v)),
    s AS (SELECT *, greatest(0, least(px1, gx1) - greatest(px0, gx0)) * greatest(0, least(py1, gy1) - greatest(py0, gy0)) AS i, (px1 - px0) * (py1 - py0) AS predicted_area FROM b),
    q AS (SELECT *, round(i / (predicted_area + (gx1 - gx0) * (gy1 - gy0) - i), 9) AS iou FROM s)
    SELECT variant, count(*) AS queries, count(*) FILTER (iou >= 0.5) AS recall50_count, round(100.0 * ((count(*) FILTER (iou >= 0.5))::DOUBLE / count(*)), 6) AS recall50, round(100.0 * ((count(*) FILTER (iou >= 0.75))::DOUBLE / count(*)), 6) AS recall75,
    round(avg(iou), 6) AS mean_iou, round(median(predicted_area / target_area), 6) AS median_area_ratio FROM q GROUP BY 1"""
)
def box_growth_sweep(spark, sf_dir):
    """Predicted boxes, grown by a share of their size on each side, against their own annotations."""
    truth = annotations(spark, sf_dir).select("ann_id", F.col("area").alias("target_area"), *[F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = predictions(spark, sf_dir).withColumnRenamed("pred_id", "ann_id").join(truth, "ann_id").withColumn("variant", F.explode(F.array(F.lit(0.0), F.lit(0.125), F.lit(0.25))))
    grow = lambda c, sign: (F.col(c) + sign * F.col("variant") * (F.col(f"{c[0]}1") - F.col(f"{c[0]}0"))).alias(f"p_{c}")
    grown = pairs.select("variant", "target_area", "g_x0", "g_y0", "g_x1", "g_y1", grow("x0", -1), grow("y0", -1), grow("x1", 1), grow("y1", 1))
    return reports.variant_scores(grown.withColumn("iou", F.round(box.iou("p_", "g_"), 9)).withColumn("predicted_area", F.expr("(p_x1 - p_x0) * (p_y1 - p_y0)")))


@query(_PAIRS + ", b AS (SELECT category, coalesce(max(iou), 0) AS best FROM v_ann LEFT JOIN v_pairs USING (ann_id, category) GROUP BY category, v_ann.ann_id), c AS (SELECT category, 100.0 * (count(*) FILTER (best >= 0.5))::DOUBLE / count(*) AS recall FROM b GROUP BY 1) SELECT count(*) AS classes, round(avg(recall), 6) AS macro_recall, avg(recall) >= 92 AS accepted FROM c")
def macro_recall(spark, sf_dir):
    return reports.macro_recall(evaluate.best_overlaps(predictions(spark, sf_dir), annotations(spark, sf_dir)), "category")


@query(
    f"""WITH {SQL}, c AS (SELECT * FROM (SELECT image_id, greatest(0, x0) AS x0, greatest(0, y0) AS y0, least(200, x1) AS x1, least(200, y1) AS y1, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id) AS rank FROM v_pred) JOIN (VALUES (1), (3)) t(k) ON rank <= k WHERE x1 > x0 AND y1 > y0),
    px AS (SELECT DISTINCT image_id, k, x, unnest(generate_series(y0::INT, y1::INT - 1)) AS y FROM (SELECT image_id, k, y0, y1, unnest(generate_series(x0::INT, x1::INT - 1)) AS x FROM c)),
    a AS (SELECT g.ann_id, k, any_value(g.area) AS target, count(*) AS area, count(*) FILTER (x >= g.x0 AND x < g.x1 AND y >= g.y0 AND y < g.y1) AS common FROM px JOIN v_ann g USING (image_id) GROUP BY 1, 2),
    o AS (SELECT k, round(common / target, 9) AS coverage, round(area / 40000, 9) AS crop_area FROM a)
    SELECT k, count(*) AS targets, round(100.0 * ((count(*) FILTER (coverage >= 0.5))::DOUBLE / count(*)), 6) AS c50, round(100.0 * ((count(*) FILTER (coverage >= 0.9))::DOUBLE / count(*)), 6) AS c90, round(100 * avg(crop_area), 6) AS mean_crop_area FROM o GROUP BY 1"""
)
def crop_coverage(spark, sf_dir):
    clipped = [F.greatest(F.lit(0.0), c).alias(c) for c in ("x0", "y0")] + [F.least(F.lit(200.0), c).alias(c) for c in ("x1", "y1")]
    crops = evaluate.top_k(predictions(spark, sf_dir), 3, ("image_id",)).select("image_id", "rank", *clipped).where("x1 > x0 and y1 > y0")
    return reports.coverage_summary(reports.crop_coverage(annotations(spark, sf_dir), crops, [1, 3], 200 * 200))


from . import corpus_queries, decision_queries, mask_queries, more_queries  # noqa: E402,F401  register the rest
