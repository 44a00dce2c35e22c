"""One COCO document, written by many tasks.

The document is a folder of text parts; in the order of their names they are one JSON text, with one object on each line. Objects
are ordered by their dense ids, and the first of a list has no comma, so no task needs to know its neighbours. Reading takes the
lines one by one, so a document of any size is read by many tasks as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import publish

LISTS = ("images", "annotations", "categories")


def missing_files(images: DataFrame, listing: DataFrame) -> DataFrame:
    """Images (file_name) without a file in a listing (path)."""
    return images.join(listing.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name")).distinct(), "file_name", "left_anti")


def document_lines(lists: dict[str, DataFrame]) -> DataFrame:
    """(section, id, line) of a document; every list has a dense ``id`` from 1."""
    heads = [(2 * i, 0, ("{" if i == 0 else "],") + f'"{name}":[') for i, name in enumerate(lists)] + [(2 * len(lists), 0, "]}")]
    spark = next(iter(lists.values())).sparkSession
    parts = [spark.createDataFrame(heads, "section int, id long, line string")]
    for i, rows in enumerate(lists.values()):
        text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        parts.append(rows.select(F.lit(2 * i + 1).alias("section"), F.col("id").cast("long").alias("id"), F.concat(F.when(F.col("id") == 1, "").otherwise(","), text).alias("line")))
    return reduce(DataFrame.unionAll, parts)


def write_bundle(path: str, lists: dict[str, DataFrame], listing: DataFrame | None = None, least: int = 0) -> dict[str, int]:
    """Write a document and return the length of each list.

    With a ``listing`` of files, the job is refused while an image has none; without one (an audit), nothing is looked for. It is also
    refused with fewer than ``least`` annotations. A refused or failed job leaves what was at ``path``.
    """
    spark = next(iter(lists.values())).sparkSession
    if listing is not None:
        gone = [r["file_name"] for r in missing_files(lists["images"], listing).select("file_name").orderBy("file_name").limit(5).collect()]
        if gone:
            raise FileNotFoundError(f"images without a file, the first ones: {', '.join(gone)}")
    written = publish.aside(path)
    try:
        rows = document_lines(lists)
        rows.repartitionByRange("section", "id").sortWithinPartitions("section", "id").select("line").write.text(written)
        counts = {name: read_list(spark, written, name, "id long").count() for name in lists}
        if counts.get("annotations", 0) < least:
            raise ValueError(f"{counts.get('annotations', 0)} annotations; {least} are needed")
        publish.replace(spark, written, path)
    except Exception:
        publish.drop(spark, written)
        raise
    return counts


def read_list(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One list of a document that ``write_bundle`` wrote; only its lines are parsed.

    Lines of a list stand between its head and the next one. A part's lines are in order, so a line's list is that of the last head before it, in its
    part or an earlier one.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    heads = lines.where(F.col("value").rlike(r'^(\{|\],)"\w+":\[$|^\]\}$'))  # a few lines
    found = sorted((r["file"], r["block"], r["at"], r["value"]) for r in heads.collect())
    begin = next(i for i, h in enumerate(found) if f'"{name}":[' in h[3])
    after = lambda h: (F.col("file") > h[0]) | (F.col("file") == h[0]) & ((F.col("block") > h[1]) | (F.col("block") == h[1]) & (F.col("at") > h[2]))
    own = lines.where(after(found[begin]) & ~after(found[begin + 1]) & ~F.col("value").isin([h[3] for h in found]))
    return own.select(F.from_json(F.regexp_replace("value", "^,", ""), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
