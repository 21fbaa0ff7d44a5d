"""Evaluation: hits, accuracies, precision and recall in time, image similarity, rewards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_at_k(picks: DataFrame, truth: DataFrame, key: str = "uid", margin: float = 0.0) -> DataFrame:
    """key, hit for every record of picks with a truth: whether a picked time lies in the interval, both ends included.

    ``picks``: key, times (an array; an empty one misses); ``truth``: key, start_s, end_s.  Items without a record, and
    records without an item, don't count.
    """
    inside = F.exists(F.coalesce("times", F.lit([]).cast("array<double>")), lambda t: t.between(F.col("start_s") - margin, F.col("end_s") + margin))
    return picks.join(truth, key).select(key, F.coalesce(inside, F.lit(False)).alias("hit"))


def hit_summary(hits: DataFrame, digits: int = 4) -> DataFrame:
    """n_items, n_hits, hit_rate (0 without items), n_misses of the rows of ``hit_at_k``; misses are the rows that aren't hits."""
    n = F.coalesce(F.sum(F.col("hit").cast("int")), F.lit(0))
    return hits.agg(F.count("*").alias("n_items"), n.alias("n_hits")).select("n_items", "n_hits", F.coalesce(F.round(F.try_divide("n_hits", "n_items"), digits), F.lit(0.0)).alias("hit_rate"), (F.col("n_items") - F.col("n_hits")).alias("n_misses"))


def detection_counts(rows: DataFrame, by: list[str], lists: str) -> DataFrame:
    """Rows and list elements of each group (null lists hold none)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(F.coalesce(F.size(lists), F.lit(0))).alias("n_elements"))


def smooth_weights(window: int, order: int) -> list[list[float]]:
    """Least-squares polynomial smoothing: row i gives the fitted value at place i of a window from its values."""
    x = np.vander(np.arange(window) - window // 2, order + 1, increasing=True)
    return (x @ np.linalg.pinv(x)).tolist()


def smooth_curve(values: Column, window: int = 5, order: int = 2) -> Column:
    """A curve smoothed by local polynomials of an odd window; the ends take the fit of the first and last whole window.

    Curves shorter than the window come back unchanged.
    """
    if window % 2 == 0 or order >= window:
        raise ValueError("an odd window, longer than the order")
    fit = F.lit(smooth_weights(window, order))
    n, half = F.size(values), window // 2

    def at(v: Column, i: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(i - half, n - window))
        part = F.slice(values, start + 1, F.lit(window))
        return F.aggregate(F.zip_with(part, F.get(fit, i - start), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    return F.when(n >= window, F.transform(values, at)).otherwise(values.cast("array<double>"))


def hit_grid(picks: DataFrame, truth: DataFrame, key: str = "uid", margin: float = 0.0) -> DataFrame:
    """method, k, hits, items, rate; an item counts where the method reports it (``picks``: key, method, k, times)."""
    flat = picks.join(truth, key).withColumn("hit", F.exists("times", lambda t: t.between(F.col("start_s") - margin, F.col("end_s") + margin)).cast("int"))
    return flat.groupBy("method", "k").agg(F.sum("hit").alias("hits"), F.count("*").alias("items"), F.round(F.avg("hit"), 4).alias("rate"))


def accuracy(rows: DataFrame, digits: int = 4) -> DataFrame:
    """total, correct, accuracy of (answer, gold); equal nulls count as correct, an empty table is 0."""
    good = F.sum(F.col("answer").eqNullSafe(F.col("gold")).cast("int"))
    return rows.agg(F.count("*").alias("total"), F.coalesce(good, F.lit(0)).alias("correct")).withColumn("accuracy", F.coalesce(F.round(F.try_divide("correct", "total"), digits), F.lit(0.0)))


def accuracy_resumed(rows: DataFrame, earlier: DataFrame, key: str = "uid", digits: int = 4) -> DataFrame:
    """The accuracy of a run that goes on after ``earlier`` (both: key, answer, gold): an item that has a result keeps it."""
    cols = [key, "answer", "gold"]
    return accuracy(earlier.select(*cols).dropDuplicates([key]).union(rows.select(*cols).join(earlier.select(key), key, "left_anti")), digits)


def accuracy_by_group(rows: DataFrame, group: str = "grp") -> DataFrame:
    """Per group and in all (group ``total``): answered, correct, errors, accuracy; errors and empty answers don't count."""
    bad = F.col("error").isNotNull() | F.coalesce(F.trim("answer") == "", F.lit(True))
    good = ~bad & (F.lower(F.trim("answer")) == F.lower(F.trim("gold")))
    return rows.groupingSets([[F.col(group)], []], F.col(group)).agg(
        F.when(F.grouping(group) == 1, "total").otherwise(F.first(group)).alias("g"),
        F.sum((~bad).cast("int")).alias("answered"),
        F.sum(good.cast("int")).alias("correct"),
        F.sum(bad.cast("int")).alias("errors"),
    ).select("g", "answered", "correct", "errors", F.round(F.coalesce(F.try_divide("correct", "answered"), F.lit(0.0)), 6).alias("accuracy"))


def nearest(of: Column, to: Column) -> Column:
    """The distance of every value of one list to the nearest of another."""
    return F.transform(of, lambda x: F.array_min(F.transform(to, lambda y: F.abs(x - y))))


def _share(distances: Column, within: float) -> Column:
    return F.size(F.filter(distances, lambda d: d <= within)) / F.size(distances).cast("double")


def prf(rows: DataFrame, within: float, truth: str = "gt", pred: str = "pred") -> DataFrame:
    """Adds precision (predictions near a truth), recall (truths near a prediction) and f1; empty sides are dropped."""
    rows = rows.where((F.size(truth) > 0) & (F.size(pred) > 0))
    p, r = _share(nearest(F.col(pred), F.col(truth)), within), _share(nearest(F.col(truth), F.col(pred)), within)
    return rows.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def prf_covered(rows: DataFrame, within: Column | float, truth: str = "gt", pred: str = "pred") -> DataFrame:
    """The variant whose precision is covered truths over predictions (it may pass 1)."""
    within = F.lit(within) if not isinstance(within, Column) else within
    hit = F.size(F.filter(nearest(F.col(truth), F.col(pred)), lambda d: d <= within))
    return rows.withColumn("covered", F.when(F.size(pred) > 0, hit).otherwise(0)).withColumns({"precision": F.coalesce(F.try_divide(F.col("covered").cast("double"), F.size(pred)), F.lit(0.0)), "recall": F.coalesce(F.try_divide(F.col("covered").cast("double"), F.size(truth)), F.lit(0.0))})


def macro(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Means of precision, recall and f1, and the F1 of the means."""
    p, r = F.avg("precision"), F.avg("recall")
    return rows.agg(F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(F.avg("f1"), digits).alias("f1"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), digits).alias("f1_of_means"), F.count("*").alias("n"))


def annd(rows: DataFrame, truth: str = "gt", pred: str = "pred") -> DataFrame:
    """Adds ``to_pred`` and ``to_truth``, mean nearest distances either way, and ``annd``, their mean."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    rows = rows.where((F.size(truth) > 0) & (F.size(pred) > 0))
    return rows.withColumns({"to_pred": mean(nearest(F.col(truth), F.col(pred))), "to_truth": mean(nearest(F.col(pred), F.col(truth)))}).withColumn("annd", (F.col("to_pred") + F.col("to_truth")) / 2)


def relative_errors(rows: DataFrame, truth: str = "gt", pred: str = "pred", length: str = "duration") -> DataFrame:
    """correct, error: mean distance of truths to their nearest prediction, over the duration, by correctness."""
    flat = rows.where((F.size(truth) > 0) & (F.size(pred) > 0)).select("correct", F.explode(nearest(F.col(truth), F.col(pred))).alias("d"), F.col(length).alias("len"))
    return flat.groupBy("correct").agg(F.avg(F.col("d") / F.col("len")).alias("error"))


def shift_filter(weights: Column) -> Column:
    """The smallest weight is at least half the largest."""
    return F.array_min(weights) >= 0.5 * F.array_max(weights)


def _gauss(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    g = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return g / g.sum()


def ssim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Structural similarity of grey images in [0, 1], two stacks (..., height, width): 11 x 11 Gaussian window, zero padding."""
    g = _gauss()
    half = len(g) // 2

    def blur(x: np.ndarray) -> np.ndarray:
        for axis in (-2, -1):
            wide = np.pad(x, [(0, 0)] * (x.ndim + axis) + [(half, half)] + [(0, 0)] * (-1 - axis))
            x = sum(w * np.take(wide, range(k, k + x.shape[axis]), axis) for k, w in enumerate(g))
        return x

    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    c1, c2 = 0.01**2, 0.03**2
    return (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean((-2, -1))


def image_ssim(a: Column, b: Column, width: Column) -> Column:
    """Similarity of two images given as flat arrays and their width, in Arrow batches; images of one size go together."""

    @F.pandas_udf("double")
    def run(one: pd.Series, two: pd.Series, wide: pd.Series) -> pd.Series:
        size = pd.Series(list(zip(one.map(len), wide, strict=True)))
        out = np.zeros(len(one))
        for (_, w), at in size.groupby(size).indices.items():
            x, y = (np.stack([np.asarray(s.iloc[i], float) for i in at]).reshape(len(at), -1, int(w)) for s in (one, two))
            out[at] = ssim(x, y)
        return pd.Series(out)

    return run(a, b, width)


def image_scores(pairs: DataFrame) -> DataFrame:
    """uid, precision, recall: means of the best similarity of each prediction and each truth (``pairs``: uid, i, j, sim)."""
    rows = pairs.groupBy("uid", "i").agg(F.max("sim").alias("m")).groupBy("uid").agg(F.avg("m").alias("recall"))
    cols = pairs.groupBy("uid", "j").agg(F.max("sim").alias("m")).groupBy("uid").agg(F.avg("m").alias("precision"))
    return rows.join(cols, "uid")


def correlation_score(pairs: DataFrame) -> DataFrame:
    """uid, scc: the n_truth largest correlations of each item, summed, over its number of truths (``pairs``: uid, i, n_truth, corr)."""
    from pyspark.sql import Window

    w = Window.partitionBy("uid").orderBy(F.col("corr").desc())
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.col("n_truth")).groupBy("uid").agg((F.sum("corr") / F.first("n_truth")).alias("scc"))


def weighted(rewards: dict[str, float]) -> Column:
    """The weighted sum of reward columns."""
    total = F.lit(0.0)
    for name, weight in rewards.items():
        total = total + F.col(name) * weight
    return total
