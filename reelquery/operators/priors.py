"""Prior grids of a detection head as a table, and decoders from predictions to boxes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def prior_grid(spark: SparkSession, levels: list[tuple[int, int, int]], offset: float = 0.5, bases: list[list[tuple[float, float]]] | None = None) -> DataFrame:
    """prior, level, row, column, base, stride, px, py, and base_w, base_h: every prior point of (height, width, stride) levels.

    Priors are numbered level after level, row by row; with ``bases`` (widths and heights for each level) every cell has one
    for each.  Points are (column + offset, row + offset) strides from the corner.
    """
    parts, before = [], 0
    for k, (height, width, stride) in enumerate(levels):
        sizes = bases[k] if bases else [(float(stride), float(stride))]
        n = height * width * len(sizes)
        cell = F.floor(F.col("id") / len(sizes))
        size = lambda j: F.get(F.array(*(F.lit(float(s[j])) for s in sizes)), F.col("base"))  # noqa: B023, E731
        one = spark.range(n).select((F.col("id") + before).alias("prior"), F.lit(k).alias("level"), F.floor(cell / width).cast("int").alias("row"), (cell % width).cast("int").alias("column"), (F.col("id") % len(sizes)).cast("int").alias("base"), F.lit(stride).alias("stride"))
        parts.append(one.select("*", ((F.col("column") + offset) * stride).alias("px"), ((F.col("row") + offset) * stride).alias("py"), size(0).alias("base_w"), size(1).alias("base_h")))
        before += n
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def decode_anchor(p: list[Column], stride: Column | str = "stride") -> dict[str, Column]:
    """Centre boxes from an anchor's squashed offsets and scales: two strides of play, up to four times the base's size."""
    s = F.col(stride) if isinstance(stride, str) else stride
    x, y, w, h = (_sigmoid(c) for c in p)
    return {"cx": (x - 0.5) * 2 * s + F.col("px"), "cy": (y - 0.5) * 2 * s + F.col("py"), "w": F.pow(w * 2, F.lit(2.0)) * F.col("base_w"), "h": F.pow(h * 2, F.lit(2.0)) * F.col("base_h")}


def decode_distances(p: list[Column], stride: Column | str = "stride") -> dict[str, Column]:
    """Corner boxes from distances to a point, in strides."""
    s = F.col(stride) if isinstance(stride, str) else stride
    return {"x1": F.col("px") - p[0] * s, "y1": F.col("py") - p[1] * s, "x2": F.col("px") + p[2] * s, "y2": F.col("py") + p[3] * s}


def decode_offsets(p: list[Column], stride: Column | str = "stride") -> dict[str, Column]:
    """Centre boxes from offsets in strides and logarithms of sizes in strides."""
    s = F.col(stride) if isinstance(stride, str) else stride
    return {"cx": p[0] * s + F.col("px"), "cy": p[1] * s + F.col("py"), "w": F.exp(p[2]) * s, "h": F.exp(p[3]) * s}


DECODERS = {"anchor": decode_anchor, "distances": decode_distances, "offsets": decode_offsets}


def corners(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    """Corner boxes of centre boxes."""
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def decoded(predictions: DataFrame, grid: DataFrame, decoder: str, columns: list[str]) -> DataFrame:
    """Predictions (prior, four ``columns``) with x1, y1, x2, y2; a grid is as small as a head's output for one image."""
    found = DECODERS[decoder]([F.col(c) for c in columns])
    box = found if "x1" in found else corners(*(found[c] for c in ("cx", "cy", "w", "h")))
    return predictions.join(grid, "prior").select(*predictions.columns, *(v.alias(k) for k, v in box.items()))
