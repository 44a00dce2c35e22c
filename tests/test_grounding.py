"""Expressions, prompts and answers: fixed cases."""

from pyspark.sql import functions as F

from annoquery.operators import governance, grounding


def test_prompts(spark):
    rows = spark.createDataFrame([("  The LOWER  hem",), ("左边的领口线",), ("collar",), ("red stripe",), (" ",), (None,)], "q string")
    found = [r.p and (r.p.label, r.p.term) for r in rows.select(grounding.resolve_prompt("q").alias("p")).collect()]
    assert found == [("hem", "lower hem"), ("neckline", "领口线"), ("collar", "collar"), ("custom", "red stripe"), None, None]


def test_scope_and_language(spark):
    rows = spark.createDataFrame([("What clothes are in it", "en"), ("the 领口", "en"), ("领口", "zh"), ("", "zh"), (None, "en"), ("x", "fr")], "q string, l string")
    found = rows.select(grounding.asks_for_region("q"), grounding.in_language("q", "l")).collect()
    assert [tuple(r) for r in found] == [(False, True), (True, False), (True, True), (False, False), (False, None), (True, None)]


def test_attributes(spark):
    rows = spark.createDataFrame([("collar", "round (neck)", 1), ("pocket", "round (neck)", 1), ("pocket", "flap (pocket)", 2), ("bow", "red", 2)], "l string, a string, n int")
    found = [r[0] for r in rows.select(grounding.attribute_phrase(F.col("l"), F.col("a"), F.col("n"))).collect()]
    assert found == ["the round collar", None, "all flap pockets", "all bows with red"]


def test_answers(spark):
    rows = spark.createDataFrame([('```json\n["a  b", "a b", " ", "c"]\n```',), ("nothing",), (None,)], "r string")
    assert [r[0] for r in rows.select(grounding.parse_answers("r")).collect()] == [["a b", "c"], None, None]


def test_unclean(spark):
    rows = spark.createDataFrame([("the the collar (left)?",), ("the left collar",), (None,)], "t string")
    assert [r[0] for r in rows.select(grounding.unclean_reasons("t")).collect()] == [["brackets", "repeated_word", "question"], [], ["blank"]]


def test_violations_and_slots_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, value string, n long")
    assert governance.violations(none, "id", {"n": F.col("n") > 0}).count() == 0
    assert governance.spread_slots(none, "axis", "seed").count() == 0
    one = spark.createDataFrame([(1, None, None)], "id long, value string, n long")
    assert [tuple(r) for r in governance.violations(one, "id", {"n": F.col("n") > 0}).collect()] == [(1, "n")]


def test_expressions_hold_no_table_of_all_groups(spark):
    parts = spark.createDataFrame([(1, 12, "hood", "帽兜", "top", "上衣"), (1, 11, "hood", "帽兜", "top", "上衣"), (2, 21, "bow", "蝴蝶结", None, None)], "image_id long, ann_id long, label string, label_zh string, garment string, garment_zh string")
    found = grounding.expressions(parts)
    plan = found.select("query").distinct()._jdf.queryExecution().sparkPlan().toString()
    assert " ObjectHashAggregate(keys=[image_id" in plan and " HashAggregate(keys=[image_id" not in plan
    assert sorted((r["sample_id"], r["n"]) for r in found.where("language = 'en'").collect()) == [("1-hood-basic-en-11-12", 2), ("1-hood-relation-top-en-11-12", 2), ("2-bow-basic-en-21", 1)]
