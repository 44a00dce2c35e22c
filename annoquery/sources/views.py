"""Annotation-shaped views over the star-schema tables, and plain readers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a temporary one serves on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-annoquery-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return rows.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, line number), the first by the other columns.

    Rows are dealt and sorted by order, so that what is grouped or joined by image needs no second shuffle. The last two columns only
    settle ties, and let all views of a query read the same shuffle.
    """
    own = F.struct("l_linenumber")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    return rows.withColumn("first", ~F.lag(own).over(order).eqNullSafe(own)).where("first").drop("first")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, ann_id, line, category, box corners, area, iscrowd, and what predictions derive from."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    x, y = F.pmod("l_partkey", F.lit(150)), F.pmod(F.col("l_suppkey") * 7, F.lit(150))
    w, h = F.col("l_quantity"), 1 + F.pmod("l_partkey", F.lit(50))
    return lines(spark, sf_dir).join(part, "l_partkey").select(
        F.col("l_orderkey").alias("image_id"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ann_id"),
        F.col("l_linenumber").alias("line"),
        "category",
        x.cast("double").alias("x0"),
        y.cast("double").alias("y0"),
        (x + w).cast("double").alias("x1"),
        (y + h).cast("double").alias("y1"),
        (w * h).cast("double").alias("area"),
        (F.col("l_returnflag") == "R").alias("iscrowd"),
        (1 - F.col("l_discount") * 5).alias("score"),
        F.col("l_linestatus").alias("status"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted, scored copies of the annotations with status 'O'."""
    shifted = [(F.col(c) + (F.col("line") if c[0] == "x" else -F.col("line"))).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return annotations(spark, sf_dir).where("status = 'O'").select("image_id", F.col("ann_id").alias("pred_id"), "category", F.round("score", 4).alias("score"), *shifted)


#: The same views for DuckDB.
SQL = """
v_lines AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn FROM lineitem) WHERE rn = 1),
v_ann AS (SELECT l_orderkey AS image_id, l_orderkey * 100 + l_linenumber AS ann_id, l_linenumber AS line, p_type AS category,
    (l_partkey % 150)::DOUBLE AS x0, ((l_suppkey * 7) % 150)::DOUBLE AS y0, (l_partkey % 150) + l_quantity AS x1,
    ((l_suppkey * 7) % 150 + 1 + l_partkey % 50)::DOUBLE AS y1, l_quantity * (1 + l_partkey % 50) AS area,
    l_returnflag = 'R' AS iscrowd, 1 - l_discount * 5 AS score, l_linestatus AS status FROM v_lines JOIN part ON l_partkey = p_partkey),
v_pred AS (SELECT image_id, ann_id AS pred_id, category, round(score, 4) AS score, x0 + line AS x0, y0 - line AS y0, x1 + line AS x1, y1 - line AS y1
    FROM v_ann WHERE status = 'O')
"""
