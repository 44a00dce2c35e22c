"""Readers, writers and the streaming jobs on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from annoquery.operators import conversion
from annoquery.plans import decision_queries
from annoquery.sources import coco_bundle, files, indexes, publish
from annoquery.streaming import decisions, jobs


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "q": "x"}\n\n{broken\n')
    rows = files.jsonl(spark, str(tmp_path), "id int, q string").collect()
    assert [(r.id, r.valid) for r in rows if r.valid] == [(1, True)]
    assert sum(not r.valid for r in rows) == 2


def test_coco(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.jpg"}, None], "annotations": []}))
    assert [tuple(r) for r in files.coco_list(spark, str(tmp_path), "images", "id int, file_name string").collect()] == [(1, "a.jpg")]
    assert files.coco_list(spark, str(tmp_path), "annotations", "id int").count() == 0


def test_csv_and_paths(spark, tmp_path):
    (tmp_path / "q.csv").write_text("﻿image_id,attribute\na.jpg,\nb.jpg,neck\n", encoding="utf-8")
    assert [r.cells for r in files.csv_map(spark, str(tmp_path / "q.csv")).collect()] == [{"image_id": "a.jpg"}, {"image_id": "b.jpg", "attribute": "neck"}]
    (tmp_path / "p.txt").write_text("# comment\n\n a/b.jpg \nc.jpg\n")
    assert [r.path for r in files.path_list(spark, str(tmp_path / "p.txt")).collect()] == ["a/b.jpg", "c.jpg"]


def test_images(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.jpg").write_bytes(b"12345")
    rows = files.images(spark, str(tmp_path)).collect()
    assert [(r.path.rpartition("/")[2], r.length) for r in rows] == [("x.jpg", 5)]


def test_gate(spark, tmp_path):
    assert files.write_gated(spark.range(3), str(tmp_path / "ok"), 2) == 3
    with pytest.raises(ValueError):
        files.write_gated(spark.range(1), str(tmp_path / "few"), 2)


def test_stream_jobs_once(spark, tmp_path):
    source, out = tmp_path / "jobs", [str(tmp_path / n) for n in ("results", "failures", "checkpoint")]
    spark.range(4).withColumn("text", F.concat(F.lit("t"), "id")).write.parquet(str(source))
    made = lambda batch: batch.withColumn("error", F.when(F.col("id") == 2, "bad"))

    def go():
        jobs.run_jobs(spark.readStream.schema("id long, text string").parquet(str(source)), made, *out).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out[0]).collect()), sorted(r.id for r in spark.read.parquet(out[1]).collect())

    assert go() == ([0, 1, 3], [2])
    spark.range(4, 6).withColumn("text", F.lit("u")).write.mode("append").parquet(str(source))
    assert go() == ([0, 1, 3, 4, 5], [2])


def test_stream_decisions(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:01:00' ts, 'kept' status union all select timestamp'2024-01-01 00:02:00', 'kept' union all select timestamp'2024-01-01 02:00:00', 'kept'")
    rows.coalesce(1).write.parquet(str(tmp_path / "d"))
    stream = jobs.decision_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "d")))
    stream.writeStream.format("memory").queryName("decision_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("decision_counts").collect()) == [1, 2]


def test_gate_leaves_the_old_output_and_no_folder(spark, tmp_path):
    files.write_gated(spark.range(3), str(tmp_path / "out"), 2)
    with pytest.raises(ValueError):
        files.write_gated(spark.range(1), str(tmp_path / "out"), 2)
    assert spark.read.json(str(tmp_path / "out")).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_list_digest_keeps_order_and_repeats(spark):
    digest = lambda *v: files.list_digest(spark.createDataFrame(list(enumerate(v)), "p int, v string").repartition(3), "v", "p").first()[0]
    assert digest("a", "b") == hashlib.sha256(b"a\nb\n").hexdigest() and len({digest("a", "b"), digest("b", "a"), digest("b", "a", "a")}) == 3
    assert digest() == hashlib.sha256(b"").hexdigest()


def test_row_numbers_of_csv_and_parquet(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("v\n" + "".join(f"{name}{i}\n" for i in range(20)))
    rows = files.with_row_index(spark.read.csv(str(tmp_path), header=True)).collect()
    assert sorted((r["file"], r["row_index"], r["v"]) for r in rows) == [(f"{n}.csv", i, f"{n}{i}") for n in "ab" for i in range(20)]
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert sorted(r["row_index"] for r in files.with_row_index(spark.read.parquet(str(tmp_path / "p"))).collect()) == list(range(5))


def _bundle(spark, n):
    images = spark.range(1, n + 1).selectExpr("id", "id || '.jpg' AS file_name")
    marks = spark.range(1, 3 * n + 1).selectExpr("id", "id % 5 AS image_id", "array(1.5D, null) AS bbox", "'],\"x\":[' AS name").repartition(7)
    return {"images": images, "annotations": marks, "categories": spark.createDataFrame([(1, "é")], "id long, name string")}


def test_coco_document_of_many_parts(spark, tmp_path):
    path, lists = str(tmp_path / "doc"), _bundle(spark, 40)
    listing = spark.range(1, 41).selectExpr("'/x/' || id || '.jpg' AS path")
    assert coco_bundle.write_bundle(path, lists, listing) == {"images": 40, "annotations": 120, "categories": 1}
    parts = sorted((tmp_path / "doc").glob("part-*"))
    whole = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
    assert [a["id"] for a in whole["annotations"]] == list(range(1, 121)) and whole["categories"] == [{"id": 1, "name": "é"}] and whole["annotations"][0]["bbox"] == [1.5, None]
    back = coco_bundle.read_list(spark, path, "annotations", "id long, image_id long, bbox array<double>, name string")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, lists["annotations"].collect()), key=lambda r: r[0])
    before = {p.name: p.read_bytes() for p in (tmp_path / "doc").iterdir()}
    with pytest.raises(FileNotFoundError, match="7.jpg"):  # a conversion needs every image's file
        coco_bundle.write_bundle(path, lists, listing.where("path not like '%/7.jpg'"))
    with pytest.raises(ValueError):
        coco_bundle.write_bundle(path, lists, least=1000)
    broken = lists | {"annotations": lists["annotations"].withColumn("name", F.expr("if(id = 77, raise_error('lost'), name)"))}
    with pytest.raises(Exception, match="lost"):
        coco_bundle.write_bundle(path, broken)
    assert {p.name: p.read_bytes() for p in (tmp_path / "doc").iterdir()} == before and [p.name for p in tmp_path.iterdir()] == ["doc"]
    assert coco_bundle.write_bundle(path, _bundle(spark, 2))["annotations"] == 6  # an audit looks for no files
    assert coco_bundle.read_list(spark, path, "images", "id long").count() == 2


def test_a_move_that_fails_brings_the_old_folder_back(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "x").write_text("1")
    with pytest.raises(OSError):
        publish.replace(spark, str(tmp_path / "never"), str(tmp_path / "old"))
    assert (tmp_path / "old" / "x").read_text() == "1"


SAMPLE = "id long, items array<struct<category_name string, category_id int, style int, bounding_box array<int>>>, raw_attributes string, annotation_path string"


def test_indexes_of_one_manifest(spark, tmp_path):
    path = str(tmp_path / "indexes")
    samples = spark.createDataFrame([(1, [("top", 1, 0, [1, 2, 3, 4])], "x", "a.json"), (2, [], "x", None), (3, [("skirt", 2, 0, None), ("top", 1, 0, None)], "x", None)], SAMPLE).repartition(3)
    counts = indexes.build_indexes(spark, path, {"train": indexes.index_record(samples), "validation": None, "questions": spark.range(5)})
    assert counts == {"train": 3, "validation": 0, "questions": 5}
    read = lambda *a, **k: sorted(r["id"] for r in indexes.read_index(spark, path, *a, **k).collect())
    assert read("train", "id long") == [1, 2, 3] and read("train", "id long", "top") == [1, 3] and read("validation", "id long") == [] and len(read("questions", "id long", limit=2)) == 2
    assert "raw_attributes" not in indexes.read_index(spark, path, "train", "id long, raw_attributes string").where("raw_attributes is not null").columns or indexes.read_index(spark, path, "train", "raw_attributes string").where("raw_attributes is not null").count() == 0
    with pytest.raises(Exception, match="no index 'test'"):
        read("test", "id long")
    with pytest.raises(ValueError):
        read("train", "id long", limit=-1)
    # another index in a second commit; the others stay
    assert indexes.build_indexes(spark, path, {"validation": spark.range(2)}) == {"train": 3, "validation": 2, "questions": 5}
    before = indexes.manifest(path)
    broken = spark.range(50).repartition(5).withColumn("v", F.expr("if(id = 33, raise_error('lost'), 1)"))
    with pytest.raises(Exception, match="lost"):
        indexes.build_indexes(spark, path, {"train": broken})
    assert indexes.manifest(path) == before and read("train", "id long") == [1, 2, 3]


def test_a_commit_that_fails_leaves_the_manifest(tmp_path):
    path = str(tmp_path)
    writer = indexes.IndexWriter({"path": path, "indexes": "a"})
    writer.commit([writer.write([("a", "{}")])])
    before = indexes.manifest(path)
    second = indexes.IndexWriter({"path": path, "indexes": "a"})
    message = second.write([("a", "{}"), ("a", "{}")])
    with pytest.raises(KeyError):
        second.commit([message, indexes.Parts({"b": ["x", 1]})])
    assert indexes.manifest(path) == before
    second.abort([message, None])
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted([before["indexes"]["a"]["parts"][0]["part"], "manifest-000000000001.json"])


def test_decision_stream_equals_batch_over_a_restart(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    worklist, made = decision_queries.worklist_and_decisions(spark, "/root/testdata/sf0.001")
    wanted = sorted(map(tuple, decisions.outcomes(worklist, made).collect()), key=str)
    source, out, kept = str(tmp_path / "in"), str(tmp_path / "out"), {k: spark.conf.get(k, None) for k in decisions.STORE}
    for k, v in decisions.STORE.items():
        spark.conf.set(k, v)
    try:
        worklist = spark.createDataFrame(worklist.collect(), worklist.schema)
        for low, high in ((0, 400), (400, 700), (700, 10**9)):  # each start goes on from the checkpoint
            events.where(f"event_id >= {low} and event_id < {high}").coalesce(1).write.mode("append").parquet(source)
            stream = decisions.outcome_stream(worklist, decision_queries.decisions_of(spark.readStream.schema(events.schema).parquet(source)))
            stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.parquet(out)
    assert sorted(map(tuple, found.collect()), key=str) == wanted
    states = {r["status"]: r["n"] for r in decisions.progress(worklist, found).collect()}
    assert sum(states.values()) == worklist.count()


def test_prediction_lists(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"image_id": 1, "score": 0.5}, {"image_id": 2}]')
    (tmp_path / "bad.json").write_text('[{"image_id": 1}, 7]')
    (tmp_path / "object.json").write_text('{"image_id": 1}')
    assert sorted(map(tuple, files.prediction_list(spark, str(tmp_path / "good.json"), "image_id int, score double").collect())) == [(1, 0.5), (2, None)]
    for name in ("bad", "object"):
        with pytest.raises(Exception):
            assert files.prediction_list(spark, str(tmp_path / f"{name}.json"), "image_id int").collect() is None


def test_reports_have_no_numbers_without_an_end(spark):
    rows = spark.sql("SELECT 1 AS n, double('NaN') AS a, float('inf') AS b, 0.5D AS c, 'x' AS d")
    assert json.loads(files.report(rows).first()[0]) == {"n": 1, "a": None, "b": None, "c": 0.5, "d": "x"}


def test_screening_tables_and_their_edits(spark, tmp_path):
    plan = spark.createDataFrame([(f"{i}.jpg", f"s{i}", 4, 5, "pending", {"hem": 2} if i else None, None, None, None, None, None) for i in range(5)], "image_path string, image_sha256 string, width int, height int, screening_status string, regions map<string,int>, weak map<string,int>, rejection_reason string, screened_by string, screened_at timestamp, notes string")
    files.screening_table(plan).write.csv(str(tmp_path / "t"), header=True)
    table = spark.read.csv(str(tmp_path / "t"), header=True)
    assert len(table.columns) == 21 and files.screening_changes(plan, table).count() == 0
    edited = table.where("image_path <> '0.jpg'").withColumn("width", F.expr("if(image_path = '1.jpg', '9', width)")).withColumn("regions_hem", F.expr("if(image_path = '2.jpg', 'two', regions_hem)"))
    edited = edited.unionAll(table.where("image_path = '3.jpg'")).unionAll(table.where("image_path = '4.jpg'").withColumn("image_path", F.lit("9.jpg")))
    assert sorted(map(tuple, files.screening_changes(plan, edited).collect())) == [("0.jpg", "missing"), ("1.jpg", "identity"), ("2.jpg", "count"), ("3.jpg", "repeated"), ("9.jpg", "unknown")]
    with pytest.raises(ValueError, match="notes"):
        files.screening_changes(plan, table.drop("notes"))


def test_sidecars_and_inventory(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "annos").mkdir()
    for stem in ("b", "a", "c"):
        (tmp_path / "img" / f"{stem}.jpg").write_bytes(stem.encode())
    (tmp_path / "annos" / "a.json").write_text('{"item2": {"style": 1}, "source": "shop", "item1": {"style": 0}, "pair_id": 3}')
    images, cars = files.image_inventory(spark, str(tmp_path / "img")), files.sidecars(spark, str(tmp_path / "annos"))
    assert {r["path"].rpartition("/")[2]: (r["length"], r["sha"]) for r in images.collect()}["b.jpg"] == (1, hashlib.sha256(b"b").hexdigest())
    joined = {r["stem"]: r for r in files.images_with_sidecars(images, cars, 2).collect()}
    assert joined.keys() == {"a", "b"} and joined["b"]["items"] is None and [i["key"] for i in joined["a"]["items"]] == ["item1", "item2"]
    assert json.loads(joined["a"]["items"][0]["value"]) == {"style": 0} and joined["a"]["metadata"] == {"source": "shop", "pair_id": "3"}


def test_response_coverage(spark):
    cases, responses = (spark.createDataFrame([(i,) for i in ids], "case_id string") for ids in ("abc", "bccd"))
    assert sorted(map(tuple, files.response_coverage(cases, responses, "case_id").collect())) == [("a", "missing"), ("d", "unexpected")]


def test_paths_names_and_strata(spark):
    names = spark.createDataFrame([("a/b.jpg",), ("/a.jpg",), ("a/../b",), ("..",), ("a..b/c",)], "n string")
    assert [r[0] for r in names.select(conversion.safe_path(F.col("n"))).collect()] == [True, False, False, False, True]
    marks, kinds = spark.createDataFrame([(1, 5), (2, 9)], "ann_id int, category_id int"), spark.createDataFrame([(5, "hat")], "id int, name string")
    assert sorted((r["ann_id"], r["category"]) for r in conversion.category_name(marks, kinds).collect()) == [(1, "hat"), (2, "<unknown:9>")]
