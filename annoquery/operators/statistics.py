"""Statistics of free-form records and of dataset indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_statistics(rows: DataFrame, text: str, depth: int = 3) -> DataFrame:
    """(path, kind, n, values, least, most): the fields of JSON texts to a depth, with their kinds, how often they occur, and how many different simple values they have, from the least to the most as text; elements of arrays have the path ``name[]``.

    Texts that don't parse are counted under the path ``!``. Counts combine before the shuffle.
    """
    parsed = rows.select(F.try_parse_json(text).alias("v"), F.col(text).isNotNull().alias("given"))
    broken = parsed.where("given and v is null").select(F.lit("!").alias("path"), F.lit("broken").alias("kind"), F.lit(None).cast("string").alias("value"))
    level, levels = parsed.where("v is not null").select(F.lit("").alias("path"), "v"), [broken]
    for _ in range(depth):
        level.createOrReplaceTempView("_annoquery_level")
        inner = rows.sparkSession.sql("SELECT path, e.pos, e.key, e.value AS v FROM _annoquery_level, LATERAL variant_explode(v) AS e")
        name = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "key"))
        level = inner.select(name.alias("path"), "v")
        kind = F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0)
        simple = ~kind.isin("OBJECT", "ARRAY")
        levels.append(level.select("path", F.lower(kind).alias("kind"), F.when(simple, F.to_json("v")).alias("value")))
        level = level.where(~simple)
    every = reduce(DataFrame.unionAll, levels)
    counts = every.groupBy("path", "kind", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("path", "kind").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("values"), F.sum("n").alias("n"))
    return few.select("path", "kind", "n", "values", "least", "most")


def index_statistics(samples: DataFrame, split: str = "split", source: str = "source") -> DataFrame:
    """(split, samples, items, without_items, categories, sources) of records with ``items`` (category_name): nested counts as maps, which hold one entry for each category or source.

    Maps come from counts per key, so no record list is gathered.
    """
    counts = samples.groupBy(split).agg(F.count("*").alias("samples"), F.sum(F.coalesce(F.size("items"), F.lit(0))).cast("bigint").alias("items"), F.count_if(F.coalesce(F.size("items"), F.lit(0)) < 1).alias("without_items"))

    def nested(rows: DataFrame, key: Column, name: str) -> DataFrame:
        each = rows.select(split, key.alias("k")).where("k is not null").groupBy(split, "k").agg(F.count("*").alias("n"))
        return each.groupBy(split).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    categories = nested(samples.select(split, F.explode("items").alias("i")), F.col("i.category_name"), "categories")
    return counts.join(categories, split, "left").join(nested(samples, F.col(source), "sources"), split, "left")

