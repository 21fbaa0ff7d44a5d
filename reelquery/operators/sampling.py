"""Frame samplers without a curve (grids), with a curve (inverse CDF), and shared index arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(start: Column, end: Column, k: int, mode: str = "trunc", endpoint: bool = True) -> Column:
    """k indices evenly from start to end: truncated, floored or rounded half to even; one index sits at the start."""
    if k <= 0:
        return F.lit([]).cast("array<int>")
    if k == 1:
        return F.array(start.cast("int"))
    step = (end - start).cast("double") / (k - 1 if endpoint else k)
    value = lambda i: F.when((i == k - 1) & F.lit(endpoint), end.cast("double")).otherwise(start + i * step)
    whole = {"trunc": lambda x: x.cast("int"), "floor": lambda x: F.floor(x).cast("int"), "round": lambda x: F.bround(x).cast("int")}[mode]
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: whole(value(i)))


def uniform(n: Column, k: int) -> Column:
    """All frames if at most k, else an even grid over the video."""
    return F.when(n <= 0, F.lit([]).cast("array<int>")).when(n <= k, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(grid(F.lit(0), n - 1, k))


def inside(start: Column, end: Column, n: Column, fps: Column, k: int) -> Column:
    """A grid inside an interval in seconds, in native frames clamped to the video; a span of one frame gives its start."""
    a = F.greatest(F.lit(0), F.bround(start * fps).cast("int"))
    b = F.least(n.cast("int") - 1, F.bround(end * fps).cast("int"))
    few = F.sequence(a, F.greatest(a, b))
    return F.when(b - a < 1, F.array(a)).when(b - a + 1 <= k, few).otherwise(grid(a, b, k))


def fill_up(picks: Column, n: Column, k: int) -> Column:
    """Distinct picks in time order; if fewer than k, with an even grid, of which the k smallest stay."""
    own = F.array_sort(F.array_distinct(picks))
    return F.when((F.size(own) < k) & (n > 0), F.slice(F.array_sort(F.array_union(own, grid(F.lit(0), n - 1, k))), 1, k)).otherwise(F.slice(own, 1, k))


def inverse_cdf(scores: DataFrame, keys: list[str], k: int, power: float | None = None, score: str = "score", frame: str = "frame_idx") -> DataFrame:
    """keys, picks: frames where the curve's cumulated weight passes k even quantiles; frames are 0..n-1 per group.

    At most k frames: all.  A constant curve: an even grid.  Weights are the scores over their range, to a power.
    """
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    weight = (F.col(score) - low) / F.nullif(high - low, F.lit(0.0))
    rows = scores.select(*keys, F.col(frame).cast("int").alias("f"), (F.pow(weight, F.lit(power)) if power is not None else weight).alias("w"))
    share = rows.withColumn("p", F.col("w") / F.sum("w").over(w))
    cdf = share.withColumn("cdf", F.sum("p").over(w.orderBy("f").rowsBetween(Window.unboundedPreceding, 0)))
    points = [1 / k + i * ((1 - 2 / k) / (k - 1)) for i in range(k)] if k > 1 else [1.0]
    if k > 1:
        points[-1] = 1 - 1 / k
    hits = [F.min(F.when(F.col("cdf") >= u, F.col("f"))).alias(f"q{i}") for i, u in enumerate(points)]
    out = cdf.groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.count("w").alias("varied"), *hits)
    picks = F.array(*(F.coalesce(f"q{i}", F.col("n") - 1) for i in range(k)))
    n = F.col("n")
    return out.select(*keys, F.when(n <= k, F.sequence(F.lit(0), n - 1)).when(F.col("varied") == 0, grid(F.lit(0), n - 1, k, "floor")).otherwise(fill_up(picks, n, k)).alias("picks"))


def adaptive_split(scores: DataFrame, keys: list[str], k: int, t1: float = 0.8, t2: float = -100.0, depth: int | None = None, score: str = "score", frame: str = "frame_idx") -> DataFrame:
    """keys, picks: recursive halving of the min-max normalised curve until a segment's top-k mean stands out.

    A segment stays whole if mean(top k) - mean > t1 and std > t2, or at the last depth; one of depth d gives its
    int(k / 2**d) best frames.  Halves don't depend on the data, so every depth is one pair of windows.
    """
    depth = min(5, max(1, int(math.log2(k)))) if depth is None else depth
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    norm = F.when(high > low, (F.col(score) - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.0)
    rows = scores.select(*keys, F.col(frame).cast("int").alias("f"), norm.alias("s"), F.count("*").over(w).cast("int").alias("n"))
    rows = rows.withColumns({"a": F.lit(0), "len": F.col("n"), "at": F.lit(None).cast("int")})
    for d in range(depth + 1):
        part = Window.partitionBy(*keys, "a", "len")
        rows = rows.withColumn("rn", F.row_number().over(part.orderBy(F.col("s").desc(), F.col("f"))))
        top = F.avg(F.when(F.col("rn") <= k, F.col("s"))).over(part)
        whole = (top - F.avg("s").over(part) > t1) & (F.stddev_pop("s").over(part) > t2) if d < depth else F.lit(True)
        rows = rows.withColumn("whole", whole & F.col("at").isNull())
        rows = rows.withColumn("take", F.when(F.col("whole"), F.col("rn") <= int(k / 2**d)).otherwise(F.col("take") if d else F.lit(False)))
        rows = rows.withColumn("at", F.when(F.col("whole"), d).otherwise(F.col("at")))
        half = F.floor(F.col("len") / 2).cast("int")
        first = F.col("f") - F.col("a") < half
        split = F.col("at").isNull()
        rows = rows.withColumns({"a": F.when(split & ~first, F.col("a") + half).otherwise(F.col("a")), "len": F.when(split, F.when(first, half).otherwise(F.col("len") - half)).otherwise(F.col("len"))})
    out = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("take"), F.col("f")))).alias("p"))
    return out.select(*keys, F.when(F.col("n") < k, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.col("p")).alias("p"), "n").select(*keys, fill_up(F.col("p"), F.col("n"), k).alias("picks"))


def softmax(x: Column, keys: list[str], temperature: float = 1.0) -> Column:
    w = Window.partitionBy(*keys)
    e = F.exp((x - F.max(x).over(w)) / max(temperature, 1e-8))
    return e / F.sum(e).over(w)


def gaussian(x: Column, mean: Column, std: Column) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / std, 2)) / (std * math.sqrt(2 * math.pi))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def segment_stats(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean, population deviation, maximum and variance of each segment."""
    return scores.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.max(score).alias("max"), F.var_pop(score).alias("var"))


def stride_sample(n: Column, k: int) -> Column:
    """range(0, n, n // k), the baseline of the benchmark's table."""
    return F.sequence(F.lit(0), n.cast("int") - 1, F.greatest(F.lit(1), F.floor(n / k).cast("int")))


def batch_of_grid(n: Column, k: int, batch: Column, batches: int) -> Column:
    """The k frames of one of ``batches`` batches (from 1) of an even grid of k * batches frames; frames may repeat in short videos."""
    total = k * batches
    step = (n - 1) / F.lit(float(total - 1)) if total > 1 else F.lit(0.0)
    at = lambda i: F.when(i == total - 1, n - 1).otherwise(F.floor(i * step)).cast("int") if total > 1 else F.lit(0)
    return F.when(n > 0, F.transform(F.sequence((batch - 1) * k, batch * k - 1), at)).otherwise(F.lit([]).cast("array<int>"))
