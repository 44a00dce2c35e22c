"""Deterministic balanced sampling by hashed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_rank


def hashed_order(rows: DataFrame, stratum: list[str], seed: str, key: str) -> DataFrame:
    """Adds ``rank``: the place of a row in its stratum by seeded hash."""
    order = Window.partitionBy(*stratum).orderBy(stable_rank(seed, key), key)
    return rows.withColumn("rank", F.row_number().over(order))


def water_fill(counts: DataFrame, total: int) -> DataFrame:
    """Quotas for strata (stratum, n): equal shares, capped by n, leftovers to the first strata in order.

    ``counts`` has one row a stratum. The level is the largest one whose filled sum stays within the total.
    """
    levels = counts.select(F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(total)).cast("int"))).alias("level")).groupBy("level").agg(F.count("*").alias("width"))
    filled = levels.withColumn("filled", F.sum("width").over(Window.orderBy("level")))
    level = filled.where(F.col("filled") <= total).agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"), F.coalesce(F.max("filled"), F.lit(0)).alias("filled"))
    base = counts.join(F.broadcast(level), how="cross")  # one row
    more = F.row_number().over(Window.orderBy(F.when(F.col("n") > F.col("level"), 0).otherwise(1), "stratum"))
    quota = F.least("n", "level") + F.when((F.col("n") > F.col("level")) & (more <= F.lit(total) - F.col("filled")), 1).otherwise(0)
    return base.withColumn("quota", quota.cast("long")).select("stratum", "n", "quota")


def balanced_subset(rows: DataFrame, stratum: Column, key: str, total: int, seed: str) -> DataFrame:
    """About equal numbers from every stratum, ``total`` rows in all: the first ones by hash."""
    rows = rows.withColumn("stratum", stratum)
    quotas = water_fill(rows.groupBy("stratum").agg(F.count("*").alias("n")), total)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))  # no task orders a whole stratum: each salt keeps its first rows
    first = hashed_order(salted, ["stratum", "_salt"], seed, key).where(F.col("rank") <= total).drop("rank", "_salt")
    return hashed_order(first, ["stratum"], seed, key).join(quotas.select("stratum", "quota"), "stratum").where(F.col("rank") <= F.col("quota"))


def round_robin(rows: DataFrame, tier: Column, stratum: Column, key: str, limit: int, seed: str) -> DataFrame:
    """By tier, one row of each stratum per pass, up to a limit."""
    ranked = hashed_order(rows.withColumn("tier", tier).withColumn("stratum", stratum), ["tier", "stratum"], seed, key)
    return ranked.orderBy("tier", "rank", "stratum", key).limit(limit)
