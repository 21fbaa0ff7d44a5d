"""Feature files and videos as tables: bytes are read by Spark and decoded by a given function, in Arrow batches."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Decoder = Callable[[bytes], list[list[float]]]


def files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """video_id (the file's name), path, content; of several extensions of one video the first listed counts."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.regexp_extract(name, r"\.([^.]*)$", 1)
    place = F.array_position(F.array(*(F.lit(e) for e in extensions)), kind)
    rows = raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("video_id"), "path", "content", place.alias("place")).where("place > 0")
    first = rows.groupBy("video_id").agg(F.min("place").alias("place"))
    return rows.join(first, ["video_id", "place"]).drop("place")


def import_frames(cached: DataFrame, decode: Decoder) -> DataFrame:
    """video_id, frame_idx, emb from feature files; a file that can't be decoded gives no rows (see ``failed``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = decode(content)
                except Exception:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([video] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float32()))], names=["video_id", "frame_idx", "emb"])

    return cached.select("video_id", "content").mapInArrow(run, "video_id string, frame_idx int, emb array<float>")


def failed(cached: DataFrame, imported: DataFrame) -> DataFrame:
    """Files of which nothing was imported."""
    return cached.select("video_id", "path").join(imported.select("video_id").distinct(), "video_id", "left_anti")


def decode_frames(videos: DataFrame, plan: DataFrame, decode: Callable[[bytes, list[int]], list[bytes]], chunk: int = 256) -> DataFrame:
    """video_id, frame_idx, image for the native frames of ``plan`` (video_id, frames), ``chunk`` frames at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, content, frames in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for at in range(0, len(frames), chunk):
                    part = frames[at : at + chunk]
                    yield pa.RecordBatch.from_arrays([pa.array([video] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int32()), pa.array(decode(content, part), pa.binary())], names=["video_id", "frame_idx", "image"])

    return videos.select("video_id", "content").join(plan, "video_id").select("video_id", "content", "frames").mapInArrow(run, "video_id string, frame_idx int, image binary")


def input_modes(items: DataFrame, frames: int, subtitles: DataFrame) -> DataFrame:
    """Questions with no frames (0), subtitles alone (-1) or a number of frames and the subtitles (``subtitles``: video_id, text)."""
    joined = subtitles.groupBy("video_id").agg(F.array_join(F.collect_list("text"), "\n").alias("subtitles"))
    out = items.join(joined, "video_id", "left")
    return out.withColumn("n_frames", F.lit(max(frames, 0))).withColumn("subtitles", F.when(F.lit(frames != 0), F.coalesce("subtitles", F.lit(""))))


def regroup(rows: DataFrame, longest_short: float = 600.0) -> tuple[DataFrame, DataFrame]:
    """Questions as one list per video, short and long videos apart."""
    lists = rows.groupBy("video_id", "duration").agg(F.array_sort(F.collect_list(F.struct("uid", "question", "answer"))).alias("items"))
    return lists.where(F.col("duration") <= longest_short), lists.where(F.col("duration") > longest_short)


def common_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the keys they share."""
    return a.join(b.select(*keys), keys, "left_semi"), b.join(a.select(*keys), keys, "left_semi")


#: Names under which feature files keep their matrix, in the order in which they are looked for.
FEATURE_NAMES = ("features", "embeddings", "image_features", "emb")


def decode_features(content: bytes) -> list[list[float]]:
    """The matrix of an .npy file, or of an .npz file: under one of ``FEATURE_NAMES``, else its only matrix; others are errors."""
    found = np.load(io.BytesIO(content), allow_pickle=False)
    if not isinstance(found, np.ndarray):
        names = [n for n in FEATURE_NAMES if n in found.files] or ([found.files[0]] if len(found.files) == 1 else [])
        if not names:
            raise ValueError(f"no features among {found.files}")
        found = found[names[0]]
    if found.ndim != 2:
        raise ValueError(f"a matrix is asked for, not {found.ndim} dimensions")
    return found.astype(np.float32).tolist()


_PROBED = "frame_count bigint, frame_rate double, duration double, width int, height int, codec string, bitrate bigint"


def probe_videos(videos: DataFrame, read: Callable[[bytes], dict]) -> DataFrame:
    """file_name, what ``read`` tells of each video (path, content), resolution, and an error where it fails; duration is frames
    over rate, 0 without a rate; a missing codec is ``N/A``, a missing bitrate 0."""
    from .attempts import attempt

    tried = attempt(videos, lambda row: {"frame_count": 0, "frame_rate": 0.0, "codec": "N/A", "bitrate": 0, **read(row["content"])}, f"struct<{_PROBED.replace(' ', ':').replace(',:', ',')}>", key="path")
    v = lambda c: F.col(f"value.{c}")
    length = F.when(v("frame_rate") > 0, v("frame_count") / v("frame_rate")).otherwise(F.when(F.col("error").isNull(), 0.0))
    return tried.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), v("frame_count").alias("frame_count"), v("frame_rate").alias("frame_rate"), length.alias("duration"), F.concat(v("width"), F.lit("x"), v("height")).alias("resolution"), v("codec").alias("codec"), v("bitrate").alias("bitrate"), "error")
