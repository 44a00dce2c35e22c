"""Paraphrase merges, image selection and crops on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from annoquery.functions import text
from annoquery.operators import crops, paraphrase, retrieval, selection, statistics

BASE = "position long, id string, image_id long, language string, target_ids array<long>, query string"
RESULT = "source_sample_id string, source_fingerprint string, language string, review_status string, generator_model string, paraphrases array<string>"
MARK = text.fingerprint


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(0, "a", 1, "en", [1, 2], "Red  Shirt"), (1, "b", 1, "en", [2, 1], "the shirt"), (2, "c", 1, "en", [1], "x"), (3, "d", 2, "de", [9], "straße")], BASE)


@pytest.fixture(scope="module")
def results(spark, base):
    prints = {r["id"]: r["p"] for r in base.select("id", MARK("id", "query").alias("p")).collect()}
    return lambda *rows: spark.createDataFrame([(i, prints.get(i, "?"), lang, status, "m", words) for i, lang, status, words in rows], RESULT)


GOOD = [("a", "en", "reviewed", ["red shirt", "THE shirt", "a red one"]), ("b", "en", "reviewed", ["a  Red one", "new"]), ("c", "en", "reviewed", ["the shirt"]), ("d", "de", "reviewed", ["STRASSE", "gasse"])]


def test_merge_keeps_originals_and_first_paraphrases(spark, base, results, tmp_path):
    path = str(tmp_path / "merged")
    found = paraphrase.publish_merge(base, results(*GOOD), MARK("id", "query"), path)
    # an original stays although a paraphrase had its words before; other targets are no repeats
    assert sorted((r["id"], r["query"]) for r in spark.read.json(path).collect()) == sorted(
        [("a", "Red  Shirt"), ("a-llm-02", "THE shirt"), ("a-llm-03", "a red one"), ("b", "the shirt"), ("b-llm-02", "new"), ("c", "x"), ("c-llm-01", "the shirt"), ("d", "straße"), ("d-llm-02", "gasse")]
    )
    assert {k: found[k] for k in ("base", "rows", "skipped", "paraphrases", "reviewed_results", "unreviewed_results")} == {"base": 4, "rows": 9, "skipped": 3, "paraphrases": 5, "reviewed_results": 4, "unreviewed_results": 0}


@pytest.mark.parametrize("fault", list(paraphrase.PROBLEMS) + ["least"])
def test_every_fault_stops_the_publication(spark, base, results, tmp_path, fault):
    path = str(tmp_path / "merged")
    paraphrase.publish_merge(base, results(), MARK("id", "query"), path)
    own, made, mark = base, results(*GOOD), MARK("id", "query")
    if fault == "unknown_sample":
        made = results(*GOOD, ("z", "en", "reviewed", ["w"]))
    if fault == "repeated_sample":
        own = base.unionAll(base.where("id = 'c'"))
    if fault == "repeated_result":
        made = results(*GOOD, GOOD[0])
    if fault == "unreviewed":
        made = results(*GOOD[1:], ("a", "en", "unreviewed", ["w"]))
    if fault == "language":
        made = results(*GOOD[1:], ("a", "fr", "reviewed", ["w"]))
    if fault == "fingerprint":
        mark = MARK("id", F.concat("query", F.lit("!")).alias("query"))
    with pytest.raises(ValueError, match="rows" if fault == "least" else fault):
        paraphrase.publish_merge(own, made, mark, path, least=100 if fault == "least" else 1)
    assert spark.read.json(path).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["merged"]
    if fault == "unreviewed":
        assert paraphrase.publish_merge(own, made, mark, path, allow_unreviewed=True)["unreviewed_results"] == 1


def test_generated_results_against_their_jobs(spark):
    jobs = spark.createDataFrame([("a", "p", "en", 2)], "source_sample_id string, source_fingerprint string, language string, requested int")
    rows = spark.createDataFrame([("a", "p", "en", "unreviewed", "m", ["x"]), ("a", "q", "fr", "reviewed", "n", ["x", "y", "z"]), ("b", "p", "en", "unreviewed", None, [])], RESULT)
    found = sorted(map(tuple, paraphrase.result_problems(jobs, rows, ["m"]).collect()))
    assert found == sorted([("a", p) for p in ("fingerprint", "language", "reviewed", "model", "too_many")] + [("b", p) for p in ("unknown_job", "model", "none")])


def test_first_image_by_alternative_then_name(spark):
    images = spark.createDataFrame([(1, "b.jpg"), (2, "a.jpg"), (3, "c.jpg")], "image_id long, file_name string")
    marks = spark.createDataFrame([(1, "shoe", 1, 0.0, 5.0), (1, "shoe", 2, 4.0, 1.0), (1, "hat", 3, 1.0, 1.0), (2, "shoe", 4, 1.0, 1.0), (3, "shoe", 5, 1.0, 1.0), (3, "shoe", 6, 1.0, 1.0), (3, "hat", 7, 0.0, 0.0)], "image_id long, category string, ann_id long, x0 double, y0 double")
    marks = marks.withColumn("x1", F.col("x0") + 1).withColumn("y1", F.col("y0") + 1)
    needs = spark.createDataFrame([("p", 1, "shoe", 9), ("p", 2, "shoe", 2), ("p", 2, "hat", 1), ("q", 1, "shoe", 1), ("r", 1, "hat", 2)], "concept string, alternative int, category string, n int")
    chosen = selection.first_images_that_meet(images, marks, needs)
    assert sorted(map(tuple, chosen.collect())) == [("p", 1, 2), ("q", 2, 1)]
    pick = spark.createDataFrame([("p", "shoe", "rightmost"), ("q", "shoe", "all")], "concept string, category string, rule string")
    assert sorted(map(tuple, selection.targets_of(chosen, marks, pick).collect())) == [("p", 2), ("q", 4)]
    lowest = spark.createDataFrame([("p", "shoe", "lowest")], "concept string, category string, rule string")
    assert [tuple(r) for r in selection.targets_of(chosen, marks, lowest).collect()] == [("p", 1)]


def test_peak_crops_equal_a_plain_cover(spark):
    draw, rows, wanted = random.Random(2), [], []
    for key in range(40):
        width, height = draw.randint(20, 300), draw.randint(20, 300)
        cells = [(key, y, x, draw.choice([0.1, 0.2, draw.random()]), width, height) for y in range(6) for x in range(5)]
        rows += cells
        scale = 100 / max(width, height)
        rw, rh = max(1, round(width * scale)), max(1, round(height * scale))
        held = []
        for _, y, x, s, *_ in sorted(cells, key=lambda c: (-c[3], c[1], c[2])):
            px, py = (x + 0.5) * 100 / 5 - (100 - rw) // 2, (y + 0.5) * 100 / 6 - (100 - rh) // 2
            if not (0 <= px < rw and 0 <= py < rh) or len(held) == 4:
                continue
            cx, cy, side = px * width / rw, py * height / rh, max(1, round(0.4 * max(width, height)))
            w, h = min(side, width), min(side, height)
            a, b = min(width - w, max(0, round(cx - w / 2))), min(height - h, max(0, round(cy - h / 2)))
            if not any(p <= cx < q and r <= cy < t for p, r, q, t in held):
                held.append((a, b, a + w, b + h))
        wanted += [(key, i, *crop) for i, crop in enumerate(held, 1)]
    table = spark.createDataFrame(rows, "m long, y int, x int, score double, width int, height int").repartition(3)
    assert sorted(map(tuple, crops.peak_crops(table, "m", (6, 5), 100, 0.4, 4).collect())) == wanted


def test_fused_maps_refuse_scores_out_of_range(spark):
    maps = spark.createDataFrame([(1, 0, 0, 0, 0, 0.5), (1, 0, 0, 1, 0, 0.2), (1, 0, 1, 0, 0, 0.7)], "m long, crop_x int, crop_y int, y int, x int, score double")
    assert sorted(map(tuple, crops.fused(maps, "m").collect())) == [(1, 0, 0, 0.5), (1, 1, 0, 0.7)]
    with pytest.raises(Exception, match="between 0 and 1"):
        crops.fused(maps.withColumn("score", F.lit(1.5)), "m").collect()


def test_fields_of_nested_records(spark):
    rows = spark.createDataFrame([('{"a": {"b": [1, {"c": null}]}, "t": true}',), ('{"a": 2}',), ("{",), (None,), ("[]",)], "t string")
    found = {(r["path"], r["kind"]): (r["n"], r["values"]) for r in statistics.field_statistics(rows, "t", depth=4).collect()}
    assert found["!", "broken"] == (1, 0) and found["a", "object"] == (1, 0) and found["a", "bigint"] == (1, 1) and found["a.b[]", "bigint"] == (1, 1) and found["t", "boolean"] == (1, 1)
    assert found["a.b[].c", "void"][0] == 1 and statistics.field_statistics(rows.limit(0), "t").count() == 0


def test_unique_targets_and_those_that_differ(spark):
    rows = spark.createDataFrame([(1, 7, "hat", 0.0), (1, 7, "hat", 0.0), (1, 8, "hat", 0.0), (1, 8, "cap", 0.0), (2, 7, None, 1.0), (2, 7, None, 1.0)], "image_id int, ann_id int, label string, x0 double")
    once, differ = retrieval.unique_targets(rows, ["label", "x0"])
    assert sorted(map(tuple, once.collect())) == [(1, 7, "hat", 0.0), (2, 7, None, 1.0)] and [tuple(r) for r in differ.collect()] == [(1, 8)]
