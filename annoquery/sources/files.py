"""Readers and writers of annotation files, through Spark's own sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import publish


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Validated JSON lines: adds ``valid`` (the line parses and is not blank)."""
    rows = spark.read.text(path)
    return rows.select(F.from_json("value", schema).alias("r"), F.col("value").alias("line"), (F.try_parse_json("value").isNotNull()).alias("valid")).select("r.*", "line", "valid")


def coco_list(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One list (images, annotations, categories) of a COCO document."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{name} array<struct<{schema}>>").alias("d"))
    return whole.select(F.explode(f"d.{name}").alias("r")).where("r is not null").select("r.*")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path and length of image files; their bytes are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def csv_map(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows as a map of non-empty cells; a byte-order mark before the header is dropped."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    cells = F.map_from_arrays(F.array(*map(F.lit, rows.columns)), F.array(*[F.col(c) for c in rows.columns]))
    return rows.select(F.map_filter(cells, lambda _, v: v.isNotNull()).alias("cells"))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths, one a line, without blank lines and comments."""
    rows = spark.read.text(path).select(F.trim("value").alias("path"))
    return rows.where((F.col("path") != "") & ~F.col("path").startswith("#"))


def write_gated(rows: DataFrame, path: str, least: int) -> int:
    """Write JSON lines, if there are at least ``least`` rows; returns their number.

    Rows are written aside, counted as they are written, and moved into place. With too few of them the job fails, and what was at ``path`` before stays.
    """
    spark, seen, written = rows.sparkSession, Observation(), publish.aside(path)
    try:
        rows.observe(seen, F.count("*").alias("n")).write.json(written)
        if seen.get["n"] < least:
            raise ValueError(f"{seen.get['n']} rows written; {least} are needed")
        publish.replace(spark, written, path)
    except Exception:
        publish.drop(spark, written)
        raise
    return seen.get["n"]


def with_row_index(rows: DataFrame) -> DataFrame:
    """Adds ``file`` and ``row_index``, from 0 in each file: the reader's own row numbers for Parquet; for others places in their files, which must not be split (``wholetext``, compressed or below a split's size)."""
    own = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    try:
        return rows.select("*", F.col("_metadata.row_index").alias("row_index"), F.col("_metadata.file_name").alias("file"))
    except AnalysisException:
        pass
    at = F.monotonically_increasing_id()
    numbered = own.withColumn("_at", at)
    first = numbered.groupBy("file").agg(F.min("_at").alias("_first"), F.max("_start").alias("_split"))
    joined = numbered.join(first, "file")
    whole = F.when(F.col("_split") > 0, F.raise_error(F.lit("a file is split; its rows have no known places"))).otherwise(F.col("_at") - F.col("_first"))
    return joined.select(*rows.columns, whole.alias("row_index"), "file")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar documents with keys of their own: stem, ``items`` (each key that starts with ``item`` and its object, in key order) and ``metadata`` (the rest)."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1).alias("stem"), F.from_json("value", "map<string,string>").alias("m"))
    is_item = lambda k, _: k.startswith("item")
    items = F.array_sort(F.map_entries(F.map_filter("m", is_item)))
    return text.select("stem", items.alias("items"), F.map_filter("m", lambda k, v: ~is_item(k, v)).alias("metadata"))


def images_with_sidecars(images: DataFrame, sidecars: DataFrame, limit: int | None = None) -> DataFrame:
    """Images in path order, the first ``limit`` of them, with their sidecar of the same stem where there is one."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    some = images.withColumn("stem", stem)
    return (some if limit is None else some.orderBy("path").limit(limit)).join(sidecars, "stem", "left")


def image_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of image files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha"))


def list_digest(rows: DataFrame, column: str, place: str) -> DataFrame:
    """One row: the digest of all lines in the order of ``place``, repeats included, each ended by a line feed; of nothing, if there are none.

    A digest over an ordered list needs the list whole: that of a hold-out fits one row.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(column).alias("v"))))
    return rows.agg(F.sha2(F.array_join(F.transform(listed, lambda r: F.concat(r["v"], F.lit("\n"))), ""), 256).alias("digest"))


def response_coverage(cases: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """(key, problem): cases without a response, and responses without a case."""
    both = cases.select(key, F.lit(True).alias("c")).join(responses.select(key, F.lit(True).alias("r")).distinct(), key, "full")
    return both.where("c is null or r is null").select(key, F.when(F.col("c").isNull(), "unexpected").otherwise("missing").alias("problem"))


def prediction_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file that is one flat list of objects; anything else in it ends the job. Fields that a row lacks are null."""
    rows = spark.read.schema("value string").text(path, wholetext=True)
    listed = rows.select(F.explode(F.from_json("value", "array<variant>", {"mode": "FAILFAST"})).alias("v"))
    checked = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.to_json("v")).otherwise(F.raise_error(F.lit("a prediction is no object")).cast("string"))
    return listed.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def report(rows: DataFrame) -> DataFrame:
    """JSON texts of report rows, in which numbers that are not finite are null."""
    finite = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes]
    return rows.select(F.to_json(F.struct(*finite), {"ignoreNullFields": "false"}).alias("report"))


#: The columns of a screening table before and after its counts, and the names of the counts.
SCREENING = ["image_path", "image_sha256", "width", "height", "screening_status"], ["rejection_reason", "screened_by", "screened_at", "notes"]
SCREENING_COUNTS = {"regions": ["collar", "cuff", "hem", "pocket", "shoulder", "waist", "pattern", "decoration"], "weak": ["zipper", "rivet", "neckline", "pocket"]}


def screening_table(plan: DataFrame) -> DataFrame:
    """The 21 columns of a screening CSV: maps of counts become columns, absent counts 0 and absent texts empty."""
    before, after = SCREENING
    counts = [F.coalesce(F.try_element_at(F.col(m), F.lit(n)), F.lit(0)).alias(f"{m}_{n}") for m, names in SCREENING_COUNTS.items() for n in names]
    return plan.select(*before, *counts, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in after))


def screening_changes(plan: DataFrame, table: DataFrame) -> DataFrame:
    """(image_path, problem) of an edited screening table (all columns text) against its plan: other columns, rows that are new, gone or repeated, changed identity, counts that are no numbers."""
    want = screening_table(plan).columns
    if table.columns != want:
        raise ValueError(f"the columns differ: {', '.join(sorted(set(want) ^ set(table.columns))) or 'in their order'}")
    own = plan.select("image_path", *(F.col(c).cast("string").alias(f"p_{c}") for c in ("image_sha256", "width", "height"))).withColumn("planned", F.lit(True))
    edited = table.withColumn("times", F.count("*").over(Window.partitionBy("image_path"))).withColumn("there", F.lit(True))  # rows of one image
    both = own.join(edited, "image_path", "full")
    numbers = [c for c in want if c.startswith(("regions_", "weak_"))]
    bad = F.exists(F.array(*numbers), lambda v: F.coalesce(v.try_cast("int") < 0, F.lit(True)))
    rules = {
        "unknown": F.col("planned").isNull(),
        "missing": F.col("there").isNull(),
        "repeated": F.col("times") > 1,
        "identity": F.col("planned") & F.col("there") & ~(F.col("image_sha256").eqNullSafe(F.col("p_image_sha256")) & F.col("width").eqNullSafe(F.col("p_width")) & F.col("height").eqNullSafe(F.col("p_height"))),
        "count": F.col("there") & bad,
    }
    return both.select("image_path", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("problem")).distinct()
