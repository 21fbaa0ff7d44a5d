"""Vector scoring in the JVM: dot products, cosine, and scores from regions and tracks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACK_THRESHOLD = 0.18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with each norm at least 1e-12, in double precision."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def score_frames(frames: DataFrame, queries: DataFrame, on: list[str], digits: int = 6, start: int | None = None, end: int | None = None) -> DataFrame:
    """Cosine of every query with every frame that shares ``on`` (the video, at least); frames in [start, end)."""
    if not on:
        raise ValueError("queries meet the frames of their own videos: name the columns they share")
    if start is not None:
        frames = frames.where(F.col("frame_idx") >= start)
    if end is not None:
        frames = frames.where(F.col("frame_idx") < end)
    joined = frames.join(queries, on)
    keep = [c for c in dict.fromkeys([*on, *queries.columns, "video_id"]) if c != "q"]
    return joined.select(*keep, "frame_idx", F.round(cosine(F.col("emb"), F.col("q")), digits).alias("score"))


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of rows over their length, each length at least 1e-12."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    if not len(lists):
        return flat.reshape(0, 0)
    size = np.diff(lists.offsets.to_numpy())
    if (size != size[0]).any():
        raise ValueError("vectors of one cache have one width")
    rows = flat.reshape(len(lists), -1)
    return rows / np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-12)[:, None]


def score_blocks(frames: DataFrame, queries: DataFrame, rows: int = 4096, digits: int = 6) -> DataFrame:
    """video_id, qid, frame_idx, score: what ``score_frames`` gives per video, as one matrix product for each block of frames.

    Blocks are ranges of ``rows`` frame numbers, so a long video is many tasks; each meets all queries of its video in a
    cogrouped Arrow task.  Only the queries are repeated, once for each block of their video.  Rows without a vector or a
    number give no score; a video without queries, or a query of no cached video, gives no rows.
    """
    kind = frames.schema["video_id"].dataType.simpleString()
    cut = frames.where("emb is not null and frame_idx is not null").select("video_id", F.col("frame_idx").cast("int").alias("frame_idx"), "emb", F.floor(F.col("frame_idx") / rows).alias("block"))
    # names of their own, as the queries may come from the frames
    asked = queries.where("q is not null").select(F.col("video_id").alias("v"), F.col("qid").cast("string").alias("qid"), F.col("q").alias("q"))
    asked = asked.join(cut.select(F.col("video_id").alias("v"), F.col("block").alias("part")).distinct(), "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, k = left.num_rows, right.num_rows
        score = np.round(_unit_rows(left.column("emb")) @ _unit_rows(right.column("q")).T, digits) if n and k else np.zeros((0, 0))
        video = left.column("video_id").slice(0, 1).take(pa.array(np.zeros(score.size, np.int64)))
        query = right.column("qid").take(pa.array(np.tile(np.arange(k), n if score.size else 0)))
        frame = left.column("frame_idx").take(pa.array(np.repeat(np.arange(n), k) if score.size else np.zeros(0, np.int64)))
        return pa.table({"video_id": video, "qid": query, "frame_idx": frame, "score": pa.array(score.ravel() + 0.0)})

    return cut.groupBy("video_id", "block").cogroup(asked.groupBy("v", "part")).applyInArrow(run, f"video_id {kind}, qid string, frame_idx int, score double")


def score_regions(frames: DataFrame, regions: DataFrame, query: Column, digits: int = 6) -> DataFrame:
    """The best cosine of each frame's regions; frames without regions score 0.  ``frames``: the spine."""
    best = regions.groupBy("video_id", "frame_idx").agg(F.max(cosine(F.col("tok"), query)).alias("best"))
    return frames.join(best, ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", F.round(F.coalesce("best", F.lit(0.0)), digits).alias("score"))


def active_tracks(tracks: DataFrame, query: Column, threshold: float = TRACK_THRESHOLD) -> DataFrame:
    """(video_id, track_id, sim) of the tracks at or above the threshold, else of the video's single best one."""
    scored = tracks.select("video_id", "track_id", cosine(F.col("tok"), query).alias("sim"))
    top = scored.groupBy("video_id").agg(F.max(F.struct("sim", -F.col("track_id"))).alias("top"))
    return scored.join(top, "video_id").where((F.col("sim") >= threshold) | ((F.col("top.sim") < threshold) & (-F.col("top.col2") == F.col("track_id")))).select("video_id", "track_id", "sim")


def score_tracks(frames: DataFrame, tracks: DataFrame, members: DataFrame, query: Column, threshold: float = TRACK_THRESHOLD, digits: int = 6) -> DataFrame:
    """The best active track of each frame, at least 0; members beyond the spine are ignored."""
    best = members.join(active_tracks(tracks, query, threshold), ["video_id", "track_id"]).groupBy("video_id", "frame_idx").agg(F.max("sim").alias("best"))
    return frames.join(best, ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", F.round(F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)), digits).alias("score"))


def track_frames(tracks: DataFrame, members: DataFrame, query: Column, threshold: float = TRACK_THRESHOLD) -> DataFrame:
    """Distinct frames of the active tracks."""
    return members.join(active_tracks(tracks, query, threshold), ["video_id", "track_id"]).select("video_id", "frame_idx").distinct()


def patch_match(patches: DataFrame, text: Column, image: Column, threshold: float) -> DataFrame:
    """Frames whose best text similarity times best image similarity over patches reaches the threshold."""
    both = patches.groupBy("video_id", "frame_idx").agg((F.max(cosine(F.col("tok"), text)) * F.max(cosine(F.col("tok"), image))).alias("score"))
    return both.where(F.col("score") >= threshold)


def group_means(tokens: DataFrame, keys: list[str], token: str = "tok") -> DataFrame:
    """Element-wise mean vector of each group."""
    flat = tokens.select(*keys, F.posexplode(token).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def pool_masked(cells: DataFrame, masks: DataFrame) -> DataFrame:
    """Mask-weighted average of cell features per region; ``cells``: image, cell, feat; ``masks``: image, region, cell, weight."""
    flat = masks.join(cells, ["image", "cell"]).select("image", "region", "weight", F.posexplode("feat").alias("pos", "x"))
    mean = flat.groupBy("image", "region", "pos").agg((F.sum(F.col("weight") * F.col("x")) / F.greatest(F.sum("weight"), F.lit(1.0))).alias("x"))
    return mean.groupBy("image", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("feat"))
