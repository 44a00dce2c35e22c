"""Crops around the peaks of score maps, and fusion of the maps of crops."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import box

BOX = ("x0", "y0", "x1", "y1")


def peak_candidates(cells: DataFrame, grid: tuple[int, int], size: int, fraction: float) -> DataFrame:
    """Cells (key, y, x, score, width, height of the image) of letterboxed score grids with their centre in the image and the crop around it; padding cells go."""
    high, wide = grid
    rows = cells.withColumn("g", box.letterbox(F.col("width"), F.col("height"), size))
    on = lambda c, n, pad: (F.col(c) + 0.5) * size / n - F.col(f"g.{pad}")
    rows = rows.withColumn("px", on("x", wide, "pad_x")).withColumn("py", on("y", high, "pad_y")).where("px >= 0 and px < g.width and py >= 0 and py < g.height")
    rows = rows.withColumn("cx", F.col("px") * F.col("width") / F.col("g.width")).withColumn("cy", F.col("py") * F.col("height") / F.col("g.height"))
    side = F.greatest(F.lit(1), F.bround(F.greatest("width", "height") * fraction).cast("int"))
    for c, low, high_, most in (("cx", "x0", "x1", "width"), ("cy", "y0", "y1", "height")):
        own = F.least(side, F.col(most))
        rows = rows.withColumn(low, F.least(F.col(most) - own, F.greatest(F.lit(0), F.bround(F.col(c) - own / 2).cast("int")))).withColumn(high_, F.col(low) + own)
    return rows.drop("g", "px", "py")


def peak_crops(cells: DataFrame, key: str, grid: tuple[int, int], size: int, fraction: float, most: int) -> DataFrame:
    """(key, rank, x0, y0, x1, y1): crops around the best cells of each map whose centre no earlier crop holds, at most ``most``.

    Maps are dealt by key and sorted by score; one pass carries the crops of the current map only.
    """
    rows = peak_candidates(cells, grid, size, fraction).select(key, "score", "y", "x", "cx", "cy", *BOX)
    order = rows.repartition(key).sortWithinPartitions(key, F.desc("score"), "y", "x")

    def cover(batches):
        last, held = None, []
        for batch in batches:
            out = []
            for name, cx, cy, *crop in zip(*(batch.column(c).to_pylist() for c in (key, "cx", "cy", *BOX))):
                if name != last:
                    last, held = name, []
                if len(held) < most and not any(a <= cx < c and b <= cy < d for a, b, c, d in held):
                    held.append(crop)
                    out.append((name, len(held), *crop))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(key).type), *(pa.array(c, pa.int32()) for c in columns[1:])], [key, "rank", *BOX])

    return order.mapInArrow(cover, f"{key} {dict(cells.dtypes)[key]}, rank int, x0 int, y0 int, x1 int, y1 int")


def fused(maps: DataFrame, key: str) -> DataFrame:
    """(key, y, x, score): crop maps (key, crop_x, crop_y, y, x, score) put in their places of the full map, the largest score where they overlap. Places without a crop are 0 and have no row."""
    placed = maps.select(key, (F.col("crop_y") + F.col("y")).alias("y"), (F.col("crop_x") + F.col("x")).alias("x"), "score")
    sound = F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(0, 1)
    checked = placed.withColumn("score", F.when(sound, F.col("score")).otherwise(F.raise_error(F.lit("scores of maps lie between 0 and 1")).cast("double")))
    return checked.groupBy(key, "y", "x").agg(F.max("score").alias("score"))
