"""Region masks as flat arrays in row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_box(mask: Column, width: int) -> Column:
    """struct(x, y, w, h) of the cells over 0, extents without the last cell; null for an empty mask."""
    on = F.filter(F.transform(mask, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    x, y = F.transform(on, lambda i: i % width), F.transform(on, lambda i: F.floor(i / width).cast("int"))
    low, high = F.array_min, F.array_max
    box = F.struct(low(x).alias("x"), low(y).alias("y"), (high(x) - low(x)).alias("w"), (high(y) - low(y)).alias("h"))
    return F.when(F.size(on) > 0, box)


def region_point(mask: Column, width: int, frame_height: int, frame_width: int) -> Column:
    """struct(y, x): the mask's first largest cell, moved to the frame's size, rounded half to even and clamped."""
    at = (F.array_position(mask, F.array_max(mask)) - 1).cast("int")
    height = F.size(mask) / F.lit(width)

    def move(place: Column, cells: Column, size: int) -> Column:
        return F.when(cells > 1, F.greatest(F.lit(0), F.least(F.lit(size - 1), F.bround(place * F.lit(float(size - 1)) / (cells - 1)).cast("int")))).otherwise(0)

    return F.struct(move(F.floor(at / width), height, frame_height).alias("y"), move(at % width, F.lit(float(width)), frame_width).alias("x"))


def kept_groups(regions: DataFrame, drop_single: bool = True) -> DataFrame:
    """Rows of groups of two regions or more; a frame without any keeps its region of the largest mask.

    ``regions``: video_id, frame_idx, region_idx, group, mask.
    """
    from pyspark.sql import Window

    frame = ["video_id", "frame_idx"]
    area = F.aggregate("mask", F.lit(0.0), lambda s, v: s + v)
    rows = regions.withColumn("n", F.count("*").over(Window.partitionBy(*frame, "group"))).withColumn("area", area)
    w = Window.partitionBy(*frame)
    rows = rows.withColumn("most", F.max("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.col("area").desc(), "region_idx")))
    keep = (F.col("n") > 1) | ((F.col("most") == 1) & (F.col("place") == 1)) if drop_single else F.lit(True)
    return rows.where(keep).drop("n", "area", "most", "place")
