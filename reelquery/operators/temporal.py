"""Joins in time: the nearest row of another side, and points or intervals that meet, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_gaps(rows: DataFrame, keys: list[str], side: str = "side", at: str = "t") -> DataFrame:
    """Adds ``gap``: how far the nearest row of the other side (``side`` is true or false) of the same keys is; null if there is none.

    A row's neighbour is the last of the other side at or before it, or the first at or after it.  Both come from one
    partitioning by the keys, sorted forwards and backwards, so an item's rows are read in order and never paired.
    """
    def reach(w) -> Column:
        last = lambda s: F.last(F.when(F.col(side) == s, F.col(at)), ignorenulls=True).over(w)
        return F.abs(F.col(at) - F.when(F.col(side), last(False)).otherwise(last(True)))

    # Equal times are in each other's frame, as it goes by value.
    w = Window.partitionBy(*keys)
    return rows.withColumns({"__before": reach(w.orderBy(F.col(at).asc())), "__after": reach(w.orderBy(F.col(at).desc()))}).withColumn("gap", F.least("__before", "__after")).drop("__before", "__after")


def _sides(truth: DataFrame, pred: DataFrame, key: str, at: str, *more: str) -> DataFrame:
    """key, side (true: a truth), t, gap; rows without a key or a time are no rows."""
    one = truth.select(key, F.lit(True).alias("side"), F.col(at).cast("double").alias("t"), *more)
    two = pred.select(key, F.lit(False).alias("side"), F.col(at).cast("double").alias("t"), *(F.lit(None).cast(truth.schema[c].dataType).alias(c) for c in more))
    return nearest_gaps(one.union(two).where(F.col(key).isNotNull() & F.col("t").isNotNull()), [key])


def _per_item(truth: DataFrame, pred: DataFrame, key: str, at: str, within: float) -> DataFrame:
    """key, n_truth, n_pred, truth_near, pred_near, truth_gap, pred_gap (sums) of the items that have both sides."""
    mine = lambda s, c: F.sum(F.when(F.col("side") == s, c))
    near = (F.col("gap") <= within).cast("int")
    out = _sides(truth, pred, key, at).groupBy(key).agg(
        F.count_if("side").alias("n_truth"), F.count_if(~F.col("side")).alias("n_pred"),
        mine(True, near).alias("truth_near"), mine(False, near).alias("pred_near"), mine(True, F.col("gap")).alias("truth_gap"), mine(False, F.col("gap")).alias("pred_gap"),
    )
    return out.where("n_truth > 0 and n_pred > 0")


def prf(truth: DataFrame, pred: DataFrame, within: float, key: str = "uid", at: str = "t") -> DataFrame:
    """key, precision (predictions near a truth), recall (truths near a prediction), f1; items without a side are left out."""
    p, r = F.col("pred_near") / F.col("n_pred"), F.col("truth_near") / F.col("n_truth")
    return _per_item(truth, pred, key, at, within).select(key, p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def prf_covered(truth: DataFrame, pred: DataFrame, within: float, key: str = "uid", at: str = "t") -> DataFrame:
    """key, covered, precision, recall: covered truths, over predictions (it may pass 1) and over truths."""
    hit = F.col("truth_near")
    return _per_item(truth, pred, key, at, within).select(key, hit.cast("int").alias("covered"), (hit / F.col("n_pred")).alias("precision"), (hit / F.col("n_truth")).alias("recall"))


def prf_over_all(truth: DataFrame, pred: DataFrame, items: DataFrame, seconds: float, group: str | None = None, key: str = "uid", at: str = "frame") -> DataFrame:
    """One row of precision, recall and f1: sums over the items of a group with a known rate, divided by all items.

    ``items``: key, fps (null: unknown), grp, one row each; times are frame numbers, and a truth is covered within
    ``seconds`` of a prediction at the item's rate.  Items of other groups, without a rate or without a side add nothing,
    but count.
    """
    limits = items.where("fps is not null").where(F.lit(True) if group is None else F.col("grp") == group).select(key, (F.col("fps") * seconds).alias("__limit"))
    rows = _sides(truth.join(limits, key), pred.join(limits.select(key), key, "left_semi"), key, at, "__limit")
    per = rows.groupBy(key).agg(F.count_if("side").alias("n"), F.count_if(~F.col("side")).alias("m"), F.count_if(F.col("side") & (F.col("gap") <= F.col("__limit"))).alias("hit")).where("n > 0 and m > 0")
    p, r = F.col("hit") / F.col("m"), F.col("hit") / F.col("n")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = per.agg(total(p).alias("p"), total(r).alias("r"), total(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))).alias("f"))
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    return sums.crossJoin(items.agg(F.count("*").alias("n"))).select(share("p").alias("precision"), share("r").alias("recall"), share("f").alias("f1"))


def annd(truth: DataFrame, pred: DataFrame, key: str = "uid", at: str = "t") -> DataFrame:
    """key, to_pred, to_truth, annd: mean nearest distances of truths and of predictions, and their mean."""
    one, two = F.col("truth_gap") / F.col("n_truth"), F.col("pred_gap") / F.col("n_pred")
    return _per_item(truth, pred, key, at, 0.0).select(key, one.alias("to_pred"), two.alias("to_truth"), ((one + two) / 2).alias("annd"))


def relative_errors(truth: DataFrame, pred: DataFrame, length: float | Column, key: str = "uid", at: str = "t", correct: str = "correct") -> DataFrame:
    """correct, error: mean distance of truths to their nearest prediction over ``length``, by the truths' column ``correct``."""
    rows = _sides(truth, pred, key, at, correct).where(F.col("side") & F.col("gap").isNotNull())
    return rows.groupBy(correct).agg(F.avg(F.col("gap") / length).alias("error"))


# ---------------------------------------------------------------- intervals

def _bin(t: Column, width: float) -> Column:
    return F.floor(t / width)


def cut(intervals: DataFrame, width: float, start: str = "start", end: str = "end", bin_: str = "bin") -> DataFrame:
    """Intervals once for each bin of ``width`` seconds that they touch; empty ones (end before start) and nulls go.

    Pick a width near the usual length: a longer interval takes as many rows as it touches bins, a shorter width
    spreads an item that holds most of the rows over more keys.
    """
    good = intervals.where(F.col(start) <= F.col(end))
    return good.withColumn(bin_, F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(end), width))))


def holding(points: DataFrame, intervals: DataFrame, keys: list[str], width: float, strict: bool = False, t: str = "t", start: str = "start", end: str = "end") -> DataFrame:
    """Every point with every interval of its keys that holds it; both ends count unless ``strict``.

    An equi-join on keys and bin: a point is in one bin, so no pair comes twice.
    """
    met = points.withColumn("__bin", _bin(F.col(t), width)).join(cut(intervals, width, start, end, "__bin"), [*keys, "__bin"])
    inside = (F.col(t) > F.col(start)) & (F.col(t) < F.col(end)) if strict else F.col(t).between(F.col(start), F.col(end))
    return met.where(inside).drop("__bin")


def overlapping(one: DataFrame, two: DataFrame, keys: list[str], width: float, touching: bool = False, ends: tuple[str, str] = ("start", "end"), other_ends: tuple[str, str] = ("other_start", "other_end")) -> DataFrame:
    """Every two intervals of the same keys that share time (with ``touching``, a single instant is enough).

    A pair that shares several bins is kept in the one where the later of both begins.
    """
    (a, b), (c, d) = ends, other_ends
    met = cut(one, width, a, b, "__bin").join(cut(two, width, c, d, "__bin"), [*keys, "__bin"])
    owner = F.col("__bin") == _bin(F.greatest(a, c), width)
    apart = (F.col(a) > F.col(d)) | (F.col(c) > F.col(b)) if touching else (F.col(a) >= F.col(d)) | (F.col(c) >= F.col(b))
    return met.where(owner & ~apart).drop("__bin")


def interval_hits(picks: DataFrame, truth: DataFrame, key: str = "uid", width: float = 60.0, margin: float = 0.0) -> DataFrame:
    """The rows of ``truth`` (key, start_s, end_s) with ``n_inside``: how many picked times (key, t) lie in them, ends included.

    Counted before anything else is joined, so an item may have any number of picks and of intervals.
    """
    wide = truth.withColumns({"__a": F.col("start_s") - margin, "__b": F.col("end_s") + margin})
    spans = wide.select(key, "__a", "__b").distinct()
    inside = holding(picks.select(key, F.col("t")), spans, [key], width, start="__a", end="__b").groupBy(key, "__a", "__b").agg(F.count("*").alias("n_inside"))
    same = [wide[key] == inside[key], wide["__a"] == inside["__a"], wide["__b"] == inside["__b"]]
    return wide.join(inside, same, "left").select(*(wide[c] for c in truth.columns), F.coalesce("n_inside", F.lit(0).cast("long")).alias("n_inside"))


def interleave(frames: DataFrame, subtitles: DataFrame, key: str = "video_id", width: float = 30.0, least: float = 1.0) -> DataFrame:
    """key, place, kind, value: frames (0) and the subtitles (1) that hold a frame time strictly inside, as one list.

    ``frames``: key, frame_idx, t; ``subtitles``: key, ordinal, start, end, text.  A subtitle shorter than ``least``
    seconds is widened to that around its middle.  It comes after the frames up to its middle, and never before a
    subtitle that was given earlier.
    """
    middle = (F.col("start") + F.col("end")) / 2
    short = F.col("end") - F.col("start") < least
    so_far = Window.partitionBy(key).orderBy("ordinal")
    given = subtitles.withColumns({"__m": middle, "__s": F.when(short, middle - least / 2).otherwise(F.col("start")), "__e": F.when(short, middle + least / 2).otherwise(F.col("end"))})
    given = given.withColumn("at", F.max("__m").over(so_far))
    shown = holding(frames.select(key, "t"), given, [key], width, strict=True, start="__s", end="__e").select(key, "ordinal", "at", "text").distinct()
    both = frames.select(key, F.col("t").cast("double").alias("at"), F.lit(0).alias("kind"), F.col("frame_idx").cast("long").alias("ordinal"), F.col("frame_idx").cast("string").alias("value"))
    both = both.union(shown.select(key, F.col("at").cast("double"), F.lit(1), F.col("ordinal").cast("long"), "text"))
    order = Window.partitionBy(key).orderBy("at", "kind", "ordinal")
    return both.select(key, (F.row_number().over(order) - 1).alias("place"), "kind", "value")
