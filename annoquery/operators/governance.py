"""Hold-out independence, job queues, decisions and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .etl import renumber


def holdout_status(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """files (path, sha): ``status`` candidate, excluded (by path or by the content of an excluded path) or duplicate (first path wins)."""
    by_path = excluded.select("path").distinct().withColumn("by_path", F.lit(True))
    shas = files.join(by_path, "path", "left_semi").select("sha").distinct().withColumn("by_sha", F.lit(True))
    marked = files.join(by_path, "path", "left").join(shas, "sha", "left").withColumn("out", F.col("by_path").isNotNull() | F.col("by_sha").isNotNull())
    firsts = marked.where("not out").groupBy("sha").agg(F.min("path").alias("first"))
    status = F.when(F.col("out"), "excluded").when(F.col("path") != F.col("first"), "duplicate").otherwise("candidate")
    return marked.join(firsts, "sha", "left").select("path", "sha", status.alias("status"))


def pending(jobs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that have no result yet."""
    return jobs.join(results.select(*keys).distinct(), keys, "left_anti")


def latest_decision(decisions: DataFrame, key: str) -> DataFrame:
    """The last decision of each key by time, then id; a plain aggregate that combines before the shuffle."""
    return decisions.groupBy(key).agg(F.max_by(F.struct("event_id", "ts", "status"), F.struct("ts", "event_id")).alias("d")).select(key, "d.event_id", "d.ts", "d.status")


def quota_gaps(have: DataFrame, quota: DataFrame) -> DataFrame:
    """have (value, n), quota (value, required): deficits and whether a quota is met."""
    rows = quota.join(have, "value", "left").select("value", "required", F.coalesce("n", F.lit(0)).alias("have"))
    return rows.withColumn("deficit", F.greatest(F.col("required") - F.col("have"), F.lit(0))).withColumn("met", F.col("have") >= F.col("required"))


def first_of_identity(rows: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """First row of each identity."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*identity).orderBy(*order))).where("_rn = 1").drop("_rn")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a record breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def sheet_differences(plan: DataFrame, sheet: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """How a filled-in sheet departs from its plan: (key, problem) with unknown, missing, repeated and changed fixed columns."""
    same = F.struct(*fixed)
    filled = sheet.groupBy(key).agg(F.count("*").alias("n"), F.min(same).alias("least"), F.max(same).alias("most"))
    both = plan.select(key, same.alias("planned"), F.lit(True).alias("known")).join(filled, key, "full")
    changed = F.col("known") & (~F.col("least").eqNullSafe(F.col("planned")) | ~F.col("most").eqNullSafe(F.col("planned"))) & F.col("n").isNotNull()
    problems = {"unknown": F.col("known").isNull(), "missing": F.col("n").isNull(), "repeated": F.col("n") > 1, "changed": changed}
    return both.select(key, F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in problems.items()]))).alias("problem"))


def spread_slots(counts: DataFrame, axis: str, seed: str) -> DataFrame:
    """counts (value, n): n rows a value with a slot number from 1 in a seeded order that mixes the values."""
    rows = counts.where("n > 0").select("value", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("at"))
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.lit(axis), F.col("value").cast("string"), F.col("at").cast("string")), 256)
    return renumber(rows.withColumn("digest", digest), ["digest", "value", "at"], "slot").select("slot", "value")
