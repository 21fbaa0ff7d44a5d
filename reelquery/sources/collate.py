"""Ragged batches: samples in batches of fixed size, their boxes end to end with offsets, and records nested from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import numbered


def batches(samples: DataFrame, size: int, order: str = "ordinal") -> DataFrame:
    """Samples with ``batch`` and ``place``: the order cut into batches of ``size``, the last one as long as it is."""
    rows = numbered(samples, [order], "__n")
    return rows.withColumns({"batch": F.floor(F.col("__n") / size).cast("long"), "place": (F.col("__n") % size).cast("int")}).drop("__n")


def collate(samples: DataFrame, boxes: DataFrame, size: int, key: str = "image_id", order: str = "ordinal", box_order: str = "box_id") -> tuple[DataFrame, DataFrame]:
    """(batches: batch, keys, offsets, more columns as lists; boxes: batch, at, place and the columns of ``boxes``).

    ``at`` is a box's place in its batch, where the boxes of its samples lie end to end; ``offsets`` has one entry more
    than the batch has samples, so sample i has the boxes from offsets[i] up to offsets[i + 1], none if these are equal.
    """
    placed = batches(samples, size, order)
    more = [c for c in samples.columns if c not in (key, order)]
    each = boxes.join(placed.select(key, "batch", "place"), key)
    flat = each.withColumn("at", (F.row_number().over(Window.partitionBy("batch").orderBy("place", box_order)) - 1).cast("int"))
    count = boxes.groupBy(key).agg(F.count("*").cast("int").alias("__k"))
    rows = placed.join(count, key, "left").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", F.col(key).alias("key"), F.coalesce("__k", F.lit(0)).alias("k"), *more))).alias("s"))
    ends = F.transform(F.sequence(F.lit(0), F.size("s")), lambda i: F.aggregate(F.slice("s", F.lit(1), i), F.lit(0), lambda n, x: n + x["k"]))
    listed = lambda c: F.transform("s", lambda x: x[c])
    out = rows.select("batch", listed("key").alias("keys"), ends.alias("offsets"), *(listed(c).alias(c) for c in more))
    return out, flat.select("batch", "at", "place", *boxes.columns)


def nested_records(files: DataFrame, keys: list[str], frame: str = "frame_idx") -> DataFrame:
    """keys, n_frames, frames: a record for each folder with its files in order of frame number, then name.

    ``files``: keys, path, a frame number or null; files without a number come last.
    """
    one = F.struct(F.col(frame).isNull().alias("late"), F.col(frame).alias("frame"), "path")
    listed = files.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("__f"))
    return listed.select(*keys, F.size("__f").alias("n_frames"), F.transform("__f", lambda f: F.struct(f["frame"].alias("frame_idx"), f["path"].alias("path"))).alias("frames"))


def attach(records: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Records with ``items``: what is asked of each folder, as one list by uid; a folder of which nothing is asked has an empty list."""
    fields = [c for c in items.columns if c not in keys]
    asked = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    return records.join(asked, keys, "left").withColumn("items", F.coalesce("items", F.array().cast(asked.schema["items"].dataType)))
