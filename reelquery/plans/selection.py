"""Selectors by K over one scoring pass: every selector picks from the same table of scores, and hits are counted once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions.times import CACHE_FPS
from ..operators import nms, sampling

#: (scores: keys, frame_idx, score; keys; k) to keys, picks.
Selector = Callable[[DataFrame, list[str], int], DataFrame]


def uniform(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count("*").cast("int").alias("n")).select(*keys, sampling.uniform(F.col("n"), k).alias("picks"))


def per_item(select: Callable[[np.ndarray, int], list[int]], score: str = "score", frame: str = "frame_idx") -> Selector:
    """A selector from a function of one item's scores, in frame order, and k; an item on which it fails gets null picks."""

    def run(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
        def one(group: pa.Table) -> pa.Table:
            curve = group.sort_by(frame).column(score).to_numpy()
            try:
                picks = [int(x) for x in select(curve, k)]
            except Exception:
                picks = None
            return pa.table({**{c: group.column(c).slice(0, 1) for c in keys}, "picks": pa.array([picks], pa.list_(pa.int32()))})

        kinds = ", ".join(f"`{c}` {scores.schema[c].dataType.simpleString()}" for c in keys)
        return scores.select(*keys, frame, score).groupBy(*keys).applyInArrow(one, f"{kinds}, picks array<int>")

    return run


#: Selectors without options of their own.
SELECTORS: dict[str, Selector] = {"uniform": uniform, "cosine": nms.gap_select, "split": sampling.adaptive_split, "cdf": sampling.inverse_cdf}


def pick_grid(scores: DataFrame, keys: list[str], selectors: dict[str, Selector], ks: list[int]) -> tuple[DataFrame, DataFrame]:
    """(the scores, written once; keys, method, k, picks of every selector and K)."""
    shared = scratch.written(scores, "scores")
    parts = [select(shared, keys, k).select(*keys, F.lit(method).alias("method"), F.lit(k).alias("k"), F.col("picks").cast("array<int>").alias("picks")) for method, select in selectors.items() for k in ks]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return shared, out


def selector_records(scores: DataFrame, items: DataFrame, selectors: dict[str, Selector], ks: list[int], keys: list[str], fps: float = CACHE_FPS, margin: float = 0.0) -> DataFrame:
    """The columns of ``items`` (keys, start_s, end_s) with method, k, picks, hit, for every selector and K.

    An item without scores (its cache is missing) has no record and leaves the denominator.  A selector that has no picks
    for an item, or failed on it, has an empty pick there, which misses.  Intervals include their ends, widened by ``margin``.
    """
    shared, picks = pick_grid(scores, keys, selectors, ks)
    grid = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(k).alias("k")) for m in selectors for k in ks))
    calls = items.join(shared.select(*keys).distinct(), keys, "left_semi").select("*", F.inline(grid))
    found = calls.join(picks, [*keys, "method", "k"], "left").withColumn("picks", F.coalesce("picks", F.lit([]).cast("array<int>")))
    inside = lambda f: (f / F.lit(float(fps))).between(F.col("start_s") - margin, F.col("end_s") + margin)
    return found.select(*items.columns, "method", "k", "picks", F.exists("picks", inside).alias("hit"))


def hit_table(records: DataFrame) -> DataFrame:
    """method, k, hits, items, rate of the rows of ``selector_records``."""
    hit = F.col("hit").cast("int")
    return records.groupBy("method", "k").agg(F.sum(hit).alias("hits"), F.count("*").alias("items"), F.round(F.avg(hit), 4).alias("rate"))
