"""Gaps and islands over frames: text-confirmed clusters, on-screen text segments, and their expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clusters(frames: DataFrame, keys: list[str], gap: int | Column) -> DataFrame:
    """keys, frame_idx: one frame (upper median) of each run whose steps are at most ``gap`` (a number or a column)."""
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    fresh = F.coalesce((F.col("frame_idx") - F.lag("frame_idx").over(w) > gap).cast("int"), F.lit(1))
    marked = frames.withColumn("fresh", fresh).select(*keys, "frame_idx", "fresh").withColumn("island", F.sum("fresh").over(w))
    lists = marked.groupBy(*keys, "island").agg(F.array_sort(F.collect_list("frame_idx")).alias("f"))
    return lists.select(*keys, F.element_at("f", (F.size("f") / 2).cast("int") + 1).alias("frame_idx"))


def pool_gap(num_frames: int, fps: float, most_k: int, seconds: float = -1.0, cap: float = 10.0) -> int:
    """The cluster gap in frames; negative seconds mean min(duration / 2k, cap)."""
    if seconds < 0:
        seconds = min((num_frames / fps if fps > 0 else 0) / max(1, 2 * most_k), cap)
    return int(seconds * fps)


def inject(scores: DataFrame, confirmed: DataFrame, keys: list[str]) -> DataFrame:
    """Scores with confirmed frames at 1; ``is_new`` marks frames that had no score (they lose ties)."""
    both = scores.select(*keys, "frame_idx", "score").join(confirmed.select(*keys, "frame_idx", F.lit(1.0).alias("up")).distinct(), [*keys, "frame_idx"], "full")
    return both.select(*keys, "frame_idx", F.coalesce("up", "score").alias("score"), F.col("score").isNull().alias("is_new"))


def normal_text(detections: Column) -> Column:
    """Trimmed non-empty detections joined by `` | ``."""
    return F.array_join(F.filter(F.transform(detections, lambda t: F.trim(t)), lambda t: t != ""), " | ")


def text_segments(rows: DataFrame, fps: float, seconds: float = 5.0) -> DataFrame:
    """Runs of the same text (case folded) whose steps are at most int(seconds * fps); frames without text are skipped.

    ``rows``: video_id, frame_idx, txt.  Result: video_id, seg_id (from 0 in time), text (as first seen), start_frame,
    end_frame, start_time, end_time.
    """
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    shown = rows.where(F.trim("txt") != "").withColumn("norm", F.lower("txt"))
    fresh = F.coalesce(((F.col("norm") != F.lag("norm").over(w)) | (F.col("frame_idx") - F.lag("frame_idx").over(w) > int(seconds * fps))).cast("int"), F.lit(1))
    island = shown.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    out = island.groupBy("video_id", (F.col("island") - 1).alias("seg_id")).agg(F.min_by("txt", "frame_idx").alias("text"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"))
    return out.withColumn("start_time", F.col("start_frame") / fps).withColumn("end_time", F.col("end_frame") / fps)


def unique_texts(segments: DataFrame) -> DataFrame:
    """video_id, norm, text (first seen), seg_ids: what a judge has to read once."""
    return segments.groupBy("video_id", F.lower("text").alias("norm")).agg(F.min_by("text", "seg_id").alias("text"), F.array_sort(F.collect_list("seg_id")).alias("seg_ids"))


def judge_batches(texts: DataFrame, size: int = 20) -> DataFrame:
    """Adds ``batch`` and ``place`` (from 1): texts of a video in order of first appearance, ``size`` to a call."""
    w = Window.partitionBy("video_id").orderBy(F.element_at("seg_ids", 1))
    rn = F.row_number().over(w)
    return texts.withColumn("batch", F.floor((rn - 1) / size)).withColumn("place", (rn - 1) % size + 1)


def segment_frames(segments: DataFrame) -> DataFrame:
    """Distinct frames of the segments, both ends included."""
    return segments.select("video_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame_idx")).distinct()


def judge(segments: DataFrame, question: DataFrame, model, size: int = 20) -> DataFrame:
    """uid, video_id, seg_id, keep: a model's verdict on every segment, each distinct text of a video asked once.

    ``segments``: of ``text_segments``; ``question``: uid, video_id, question.  A call holds ``size`` texts as a numbered
    list; a text without a verdict in the reply stays, and a call that fails (no reply) rejects all its texts.
    """
    from ..functions.text import judge_votes, numbered
    from ..models import ask_or_none

    texts = judge_batches(unique_texts(segments), size)
    calls = texts.groupBy("video_id", "batch").agg(F.array_sort(F.collect_list(F.struct("place", "text", "seg_ids"))).alias("texts"))
    listed = numbered(F.transform("texts", lambda t: t["text"]))
    prompt = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nWhich of these texts on screen help to answer it? Reply with lines such as ``1. YES`` or ``1. NO``.\n"), listed)
    asked = calls.join(question, "video_id").withColumn("reply", ask_or_none(prompt, model))
    votes = F.when(F.col("reply").isNull(), F.transform("texts", lambda t: F.lit(False))).otherwise(judge_votes(F.col("reply"), F.size("texts")))
    each = asked.select("uid", "video_id", F.inline(F.arrays_zip(F.col("texts").alias("t"), votes.alias("keep"))))
    return each.select("uid", "video_id", F.explode("t.seg_ids").alias("seg_id"), "keep")
