"""Registered queries of paraphrase merges, image selection and crops, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import crops, paraphrase, retrieval, selection, statistics
from ..sources.views import SQL, annotations, table
from .queries import query

_CORPUS = """WITH c AS (SELECT doc_id AS position, 'd' || doc_id AS id, doc_id // 10 AS image_id, lang AS language, [doc_id // 20, doc_id % 2] AS target_ids, substr(coalesce(text, ''), 1, 12) AS query, source AS label FROM documents),
    r AS (SELECT CASE WHEN position % 50 = 9 THEN 'x' || position ELSE id END AS source_sample_id, CASE WHEN position % 35 = 6 THEN 'zz' ELSE language END AS language, CASE WHEN position % 25 = 4 THEN 'unreviewed' ELSE 'reviewed' END AS review_status,
      position % 30 = 2 AS altered, ['  ' || query, query || ' again', 'Same  words', 'same words'] AS paraphrases, position AS p FROM c WHERE position % 3 <> 0),
    j AS (SELECT coalesce(c.id, r.source_sample_id) AS sid, c.*, r.source_sample_id, r.paraphrases, CASE WHEN c.id IS NULL THEN 'unknown_sample' WHEN review_status <> 'reviewed' THEN 'unreviewed' WHEN r.language <> c.language THEN 'language' WHEN altered THEN 'fingerprint' END AS problem FROM c FULL JOIN r ON c.id = r.source_sample_id)"""
_WHITE = r"lower(trim(regexp_replace(q, '\s+', ' ', 'g')))"


def _pairs(spark, sf_dir):
    """Documents as samples, with results of which some have a fault."""
    n = F.col("position")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("position"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.floor(F.col("doc_id") / 10).alias("image_id"), F.col("lang").alias("language"),
        F.array(F.floor(F.col("doc_id") / 20), F.col("doc_id") % 2).alias("target_ids"), F.substring(F.coalesce("text", F.lit("")), 1, 12).alias("query"), F.col("source").alias("label"),
    )
    mark = text.fingerprint("id", "image_id", "query", "language", "target_ids", "label")
    results = docs.where("position % 3 <> 0").select(
        F.when(n % 50 == 9, F.concat(F.lit("x"), n.cast("string"))).otherwise(F.col("id")).alias("source_sample_id"), F.when(n % 30 == 2, "old").otherwise(mark).alias("source_fingerprint"),
        F.when(n % 35 == 6, "zz").otherwise(F.col("language")).alias("language"), F.when(n % 25 == 4, "unreviewed").otherwise("reviewed").alias("review_status"), F.lit("model-1").alias("generator_model"),
        F.array(F.concat(F.lit("  "), "query"), F.concat("query", F.lit(" again")), F.lit("Same  words"), F.lit("same words")).alias("paraphrases"),
    )
    return paraphrase.joined(docs, results, mark), docs.columns


@query(_CORPUS + " SELECT sid AS id, problem FROM j WHERE problem IS NOT NULL")
def paraphrase_problems(spark, sf_dir):
    return paraphrase.problems(_pairs(spark, sf_dir)[0])


@query(
    _CORPUS
    + f""", e AS (SELECT j.*, unnest(list_concat([query], coalesce(paraphrases, []))) AS q, unnest(range(1 + len(coalesce(paraphrases, [])))) AS place FROM j WHERE problem IS NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY image_id, language, list_sort(target_ids), {_WHITE} ORDER BY position, place) AS rn FROM e)
    SELECT CASE WHEN place > 0 THEN id || '-llm-0' || place ELSE id END AS id, q AS query, CASE WHEN place > 0 THEN 'llm_paraphrase' ELSE 'template' END AS method, CASE WHEN place > 0 THEN id END AS source_sample_id FROM k WHERE rn = 1 OR place = 0"""
)
def paraphrase_merge(spark, sf_dir):
    pairs, columns = _pairs(spark, sf_dir)
    return paraphrase.expanded(pairs, columns).where("kept").select("id", "query", "method", "source_sample_id")


_NEEDS = [("pair", 1, "SMALL", 4), ("pair", 1, "LARGE", 3), ("pair", 2, "SMALL", 2), ("pair", 2, "LARGE", 2), ("lone", 1, "MEDIUM", 1), ("never", 1, "PROMO", 99), ("third", 1, "none", 1), ("third", 2, "PROMO", 2), ("third", 2, "SMALL", 1), ("third", 2, "LARGE", 1)]
_PICK = [("pair", "SMALL", "rightmost"), ("lone", "MEDIUM", "all"), ("third", "PROMO", "lowest")]
_CHOSEN = f"""WITH {SQL}, q AS (SELECT * FROM (VALUES {", ".join(map(str, _NEEDS))}) t(concept, alternative, category, n)), h AS (SELECT image_id, category, count(*) AS have FROM v_ann GROUP BY 1, 2),
    m AS (SELECT concept, alternative, image_id FROM h JOIN q USING (category) WHERE have >= n GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM q z WHERE z.concept = q.concept AND z.alternative = q.alternative)),
    c AS (SELECT concept, alternative, image_id FROM m QUALIFY row_number() OVER (PARTITION BY concept ORDER BY alternative, lpad(image_id::VARCHAR, 8, '0')) = 1)"""


def _chosen(spark, sf_dir):
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("file_name"))
    return selection.first_images_that_meet(images, annotations(spark, sf_dir), spark.createDataFrame(_NEEDS, "concept string, alternative int, category string, n int"))


@query(_CHOSEN.replace("HAVING count(*) = (SELECT count(*) FROM q z WHERE z.concept = q.concept AND z.alternative = q.alternative)", "HAVING count(*) = any_value(need)").replace("t(concept, alternative, category, n))", "t(concept, alternative, category, n)), qn AS (SELECT *, count(*) OVER (PARTITION BY concept, alternative) AS need FROM q)").replace("FROM h JOIN q USING", "FROM h JOIN qn USING") + " SELECT concept, image_id, alternative FROM c")
def images_that_meet(spark, sf_dir):
    return _chosen(spark, sf_dir)


_GRID = """WITH RECURSIVE e AS (SELECT vec_id, 200 + vec_id % 100 AS w, 160 AS h, unnest(embedding) AS score, unnest(range(64)) AS i FROM embeddings),
    g AS (SELECT *, i // 8 AS y, i % 8 AS x, least(224, greatest(1, round_even(w * least(224.0::DOUBLE / w, 224.0::DOUBLE / h), 0))) AS rw, least(224, greatest(1, round_even(h * least(224.0::DOUBLE / w, 224.0::DOUBLE / h), 0))) AS rh FROM e),
    p AS (SELECT *, (x + 0.5::DOUBLE) * 224 / 8 - floor((224 - rw) / 2) AS px, (y + 0.5::DOUBLE) * 224 / 8 - floor((224 - rh) / 2) AS py FROM g),
    c AS (SELECT *, px * w / rw AS cx, py * h / rh AS cy, greatest(1, round_even(0.3::DOUBLE * greatest(w, h), 0)) AS side FROM p WHERE px >= 0 AND px < rw AND py >= 0 AND py < rh),
    b AS (SELECT vec_id, cx, cy, least(w - least(side, w), greatest(0, round_even(cx - least(side, w) / 2, 0))) AS x0, least(h - least(side, h), greatest(0, round_even(cy - least(side, h) / 2, 0))) AS y0, least(side, w) AS bw, least(side, h) AS bh,
      row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, y, x) AS rn FROM c),
    k AS (SELECT vec_id, 0::BIGINT AS rn, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS held FROM (SELECT DISTINCT vec_id FROM b) UNION ALL
      SELECT b.vec_id, b.rn, CASE WHEN len(held) < 3 AND len(list_filter(held, lambda m: m.x0 <= cx AND cx < m.x1 AND m.y0 <= cy AND cy < m.y1)) = 0 THEN list_append(held, {'x0': b.x0::DOUBLE, 'y0': b.y0::DOUBLE, 'x1': (b.x0 + bw)::DOUBLE, 'y1': (b.y0 + bh)::DOUBLE}) ELSE held END FROM k JOIN b ON b.vec_id = k.vec_id AND b.rn = k.rn + 1),
    l AS (SELECT vec_id, arg_max(held, rn) AS held FROM k GROUP BY 1), o AS (SELECT vec_id, unnest(range(1, 1 + len(held)))::INT AS rank, unnest(held) AS m FROM l)"""


@query(_GRID + " SELECT vec_id, rank, m.x0::INT AS x0, m.y0::INT AS y0, m.x1::INT AS x1, m.y1::INT AS y1 FROM o")
def score_map_crops(spark, sf_dir):
    """Vectors as score maps of 8 x 8 patches."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", (200 + F.col("vec_id") % 100).cast("int").alias("width"), F.lit(160).alias("height"), F.posexplode("embedding").alias("i", "score"))
    cells = cells.select("vec_id", "width", "height", "score", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"))
    return crops.peak_crops(cells, "vec_id", (8, 8), 224, 0.3, 3)


@query(
    "WITH e AS (SELECT vec_id // 2 AS map_id, vec_id % 2 * 4 AS o, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings) SELECT map_id, o + i // 8 AS y, o + i % 8 AS x, max(least(1, greatest(0, v + 0.5))) AS score FROM e GROUP BY ALL"
)
def fused_score_maps(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("map_id"), (F.col("vec_id") % 2 * 4).alias("crop_y"), F.posexplode("embedding").alias("i", "v"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v").cast("double") + 0.5))
    return crops.fused(cells.select("map_id", "crop_y", F.col("crop_y").alias("crop_x"), F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("bigint").alias("x"), score.alias("score")), "map_id")


@query(
    """WITH e AS (SELECT '{"type":"' || event_type || '","props":' || props || ',"tags":["a",' || event_id % 3 || ']}' AS t, event_type, (props->>'k')::INT AS k, event_id FROM events),
    x AS (SELECT 'type' AS path, 'string' AS kind, '"' || event_type || '"' AS v FROM e UNION ALL SELECT 'props', 'object', NULL FROM e UNION ALL SELECT 'tags', 'array', NULL FROM e UNION ALL SELECT 'props.k', 'bigint', k::VARCHAR FROM e
      UNION ALL SELECT 'tags[]', 'string', '"a"' FROM e UNION ALL SELECT 'tags[]', 'bigint', (event_id % 3)::VARCHAR FROM e UNION ALL SELECT '!', 'broken', NULL FROM e WHERE event_id % 10 = 0)
    SELECT path, kind, count(*) AS n, count(DISTINCT v) AS values, min(v) AS least, max(v) AS most FROM x GROUP BY 1, 2"""
)
def record_fields(spark, sf_dir):
    """Fields of JSON records made of the events; some texts are cut off."""
    text_ = F.concat(F.lit('{"type":"'), "event_type", F.lit('","props":'), "props", F.lit(',"tags":["a",'), (F.col("event_id") % 3).cast("string"), F.lit("]}"))
    events = table(spark, sf_dir, "events")
    broken = events.where("event_id % 10 = 0").select(F.substring(text_, 1, 9).alias("t"))
    return statistics.field_statistics(events.select(text_.alias("t")).unionAll(broken), "t")


@query(
    f"""WITH {SQL}, s AS (SELECT image_id, max(status) AS split, CASE WHEN image_id % 3 = 0 THEN 'web' ELSE 'shop' END AS source, list(category) AS c FROM v_ann GROUP BY image_id),
    i AS (SELECT split, unnest(c) AS k FROM s), g AS (SELECT split, k, count(*) AS n FROM i GROUP BY 1, 2), h AS (SELECT split, source AS k, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT split, count(*) AS samples, sum(len(c))::BIGINT AS items, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM g WHERE g.split = s.split) AS categories, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM h WHERE h.split = s.split) AS sources FROM s GROUP BY split"""
)
def dataset_statistics(spark, sf_dir):
    rows = annotations(spark, sf_dir).groupBy("image_id").agg(F.max("status").alias("split"), F.collect_list(F.struct(F.col("category").alias("category_name"))).alias("items"))  # an image's annotations
    rows = rows.withColumn("source", F.when(F.col("image_id") % 3 == 0, "web").otherwise("shop"))
    listed = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return statistics.index_statistics(rows).select("split", "samples", "items", listed("categories"), listed("sources"))


_MATRIX = """WITH q AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 9 = 0 THEN []::BIGINT[] ELSE [vec_id, vec_id + 1, vec_id] END AS target_ids FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, [vec_id] FROM embeddings WHERE vec_id % 51 = 0), r AS (SELECT vec_id AS ann_id FROM embeddings WHERE vec_id % 7 <> 0),
    n AS (SELECT DISTINCT query_id, t AS ann_id FROM (SELECT query_id, unnest(target_ids) AS t FROM q))"""


def _matrix(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"))
    n = F.col("query_id")
    named = v.where("query_id % 3 = 0").withColumn("target_ids", F.when(n % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.array(n, n + 1, n)))
    return named.unionAll(v.where("query_id % 51 = 0").withColumn("target_ids", F.array("query_id"))), v.where("query_id % 7 <> 0").withColumnRenamed("query_id", "ann_id")


@query(_MATRIX + " SELECT query_id, ann_id FROM n WHERE ann_id IN (SELECT ann_id FROM r)")
def region_positives(spark, sf_dir):
    return retrieval.positive_pairs(*_matrix(spark, sf_dir)).distinct()


@query(
    _MATRIX
    + """ SELECT 'query' AS kind, query_id AS id, 'no_target' AS problem FROM q WHERE len(target_ids) = 0 UNION ALL SELECT DISTINCT 'query', query_id, 'unknown_target' FROM n WHERE ann_id NOT IN (SELECT ann_id FROM r)
    UNION ALL SELECT 'region', ann_id, 'no_query' FROM r WHERE ann_id NOT IN (SELECT ann_id FROM n) UNION ALL SELECT 'query', query_id, 'repeated' FROM q GROUP BY query_id HAVING count(*) > 1"""
)
def region_matrix_problems(spark, sf_dir):
    return retrieval.matrix_problems(*_matrix(spark, sf_dir))
