"""Ranks: percentiles with distinct ranks for ties, top-k, and carry-over of earlier picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch


def percentile(scores: DataFrame, keys: list[str], score: str = "score", frame: str = "frame_idx") -> DataFrame:
    """Adds ``pct``: rank over n-1, ascending by score; among equal scores the lower frame ranks lower; 1 if alone."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(F.col(score).asc(), F.col(frame).asc()))
    return scores.withColumn("pct", F.when(n == 1, 1.0).otherwise((rank - 1) / (n - 1)))


def top_k(scores: DataFrame, keys: list[str], k: int, score: str = "score", frame: str = "frame_idx") -> DataFrame:
    """The k best rows of each group; equal scores by lower frame."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(frame).asc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_frame(scores: DataFrame, keys: list[str], score: str = "score", frame: str = "frame_idx") -> DataFrame:
    """The single best frame of each group, without a sort."""
    best = F.max(F.struct(F.col(score), -F.col(frame))).alias("b")
    return scores.groupBy(*keys).agg(best).select(*keys, (-F.col("b.col2")).alias(frame), F.col(f"b.{score}").alias(score))


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; rows without a key are dropped."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def head_of_source(pool: Column, used: Column, k: int) -> Column:
    """The first k frames of an earlier run's pool, else of its used frames, else null."""
    return F.coalesce(F.slice(pool, 1, k), F.slice(used, 1, k))


def running_best(rows: DataFrame, keys: list[str], step: str, value: str, least_gain: float = 0.0) -> DataFrame:
    """Adds ``best`` so far and ``patience``: steps since the last strict improvement by more than ``least_gain``."""
    w = Window.partitionBy(*keys).orderBy(step)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("best", F.max(value).over(w)).withColumn("gain", (before.isNull() | (F.col(value) > before + least_gain)).cast("int"))
    out = out.withColumn("era", F.sum("gain").over(w))
    return out.withColumn("patience", F.row_number().over(Window.partitionBy(*keys, "era").orderBy(step)) - 1).drop("gain", "era")


def neighbour_boost(scores: Column, picked: Column, reach: int = 5) -> Column:
    """Scores raised around picked frames: max(s[n], s[f] / (|n-f|+1)), picked frames in order, in place."""
    def raise_(acc: Column, f: Column) -> Column:
        own = F.get(acc, f)
        return F.transform(acc, lambda s, n: F.when((F.abs(n - f) <= reach) & (n != f), F.greatest(s, own / (F.abs(n - f) + 1))).otherwise(s))

    return F.aggregate(picked, scores, raise_)


def top_quarter(frames: Column, confidences: Column) -> Column:
    """Frames whose confidence reaches the linear 75th percentile of all, in order."""
    ordered = F.array_sort(confidences)
    at = (F.size(confidences) - 1) * F.lit(0.75)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
    cut = a + (b - a) * (at - low)
    return F.transform(F.filter(F.arrays_zip(frames.alias("f"), confidences.alias("c")), lambda z: z["c"] >= cut), lambda z: z["f"])


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in the order of ``by``, without one task that holds them all.

    Rows are dealt by ranges of ``by`` and sorted where they are; only the ranges' counts, as many as there are shuffle
    partitions, are laid end to end.  The ranges are written once, since a second run could draw other borders.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc() for c in by]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    dealt = scratch.written(dealt, "numbered").withColumns({"__part": F.shiftright("__id", 33), "__place": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__place") + F.col("__before")).drop("__id", "__part", "__place", "__before")
