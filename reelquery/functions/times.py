"""Seconds, frames and clock strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CACHE_FPS = 2.0


def parse_clock(value: Column, parts: tuple[int, ...] = (3,)) -> Column:
    """Seconds from a number or ``HH:MM:SS.mmm`` (with 2 in ``parts`` also ``MM:SS``); null for anything else."""
    fields = F.split(value, ":")
    n = F.size(fields)
    number = lambda i: F.get(fields, F.lit(i)).try_cast("double")
    out = F.when(n == 1, value.try_cast("double"))
    if 3 in parts:
        out = out.when(n == 3, number(0) * 3600 + number(1) * 60 + number(2))
    if 2 in parts:
        out = out.when(n == 2, number(0) * 60 + number(1))
    return out


def frame_seconds(frame: Column, fps: float = CACHE_FPS) -> Column:
    return frame / F.lit(fps)


def cached_frames(total: Column, video_fps: Column, target_fps: float = CACHE_FPS, most: int | None = None) -> Column:
    """How many frames a video's cache holds: even, at least 2."""
    n = F.least(total / video_fps * target_fps, total.cast("double"))
    n = F.least(n, F.lit(float(most))) if most else n
    return F.greatest(F.lit(2), (F.floor(n / 2) * 2).cast("int"))


def native_frame(k: Column, total: Column, video_fps: Column, target_fps: float = CACHE_FPS) -> Column:
    """The native frame behind a cache index, truncated and clamped."""
    return F.least((k / F.lit(target_fps) * video_fps).cast("int"), total.cast("int") - 1)


def native_frame_rounded(k: Column, total: Column, video_fps: Column, target_fps: float = CACHE_FPS) -> Column:
    """The same, rounded half to even."""
    return F.least(F.bround(k * video_fps / F.lit(target_fps)).cast("int"), total.cast("int") - 1)


def frame_plan(total: Column, video_fps: Column, target_fps: float = CACHE_FPS, most: int | None = None) -> Column:
    """All native frames of a cache."""
    n = cached_frames(total, video_fps, target_fps, most)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: native_frame(k, total, video_fps, target_fps))


def rescale_frames(frames: Column, cached_fps: Column, current_fps: Column) -> Column:
    """Cached frame indices at another rate: truncated, distinct, sorted; unchanged at the same rate; null stays null."""
    cached = F.coalesce(cached_fps, F.lit(CACHE_FPS))
    moved = F.array_sort(F.array_distinct(F.transform(frames, lambda i: (i * (current_fps / cached)).cast("int"))))
    return F.when(F.abs(current_fps - cached) > 1e-6, moved).otherwise(frames)


def subsample_step(source_fps: Column, target_fps: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(source_fps / target_fps).cast("int"))


def subsampled(n: Column, step: Column) -> Column:
    """Frames left after taking every ``step``-th."""
    return F.floor((n + step - 1) / step).cast("int")


def fraction(rate: Column) -> Column:
    """A rate such as ``30000/1001`` or ``25`` as a number."""
    parts = F.split(rate, "/")
    return F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))).otherwise(rate.try_cast("double"))


def relative_position(position: Column, length: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), position / length))


def hms(seconds: Column) -> Column:
    """struct(h, m, s) of a number of seconds."""
    return F.struct(F.floor(seconds / 3600).alias("h"), F.floor(seconds % 3600 / 60).alias("m"), (seconds % 60).alias("s"))
