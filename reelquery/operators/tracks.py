"""Region tracks over frames, and connected groups of regions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Linker:
    """The open tracks of one video, frame after frame; what a later frame needs is all that is kept."""

    def __init__(self, least: float = 0.65):
        self.least, self.last, self.made = least, None, 0
        self.ids: list[int] = []
        self.count: list[int] = []
        self.mean = np.zeros((0, 0))

    def step(self, frame: int, tokens: np.ndarray) -> tuple[list[int], list[tuple[int, int, np.ndarray]]]:
        """(track of each token, tracks closed before this frame as id, members, token).

        Only tracks that end at the frame before are open; pairs are taken one to one from the most similar down, at or
        above ``least``; a track's token is the running mean of its members.
        """
        closed = []
        if self.ids and self.last != frame - 1:
            closed = self.close()
        given: list[int | None] = [None] * len(tokens)
        used: set[int] = set()
        if self.ids and len(tokens):
            mean = self.mean
            sim = (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)) @ (tokens / np.maximum(np.linalg.norm(tokens, axis=1, keepdims=True), 1e-12)).T
            for flat in np.argsort(-sim, axis=None, kind="stable"):
                i, j = divmod(int(flat), sim.shape[1])
                if sim[i, j] < self.least:
                    break
                if i not in used and given[j] is None:
                    used.add(i)
                    given[j] = i
        closed += [(self.ids[i], self.count[i], self.mean[i]) for i in range(len(self.ids)) if i not in used]
        # A frame's tracks: those that went on, in the order in which they began, then the new ones.
        on = sorted((i, j) for j, i in enumerate(given) if i is not None)
        ids, count, mean = [], [], []
        for i, j in on:
            n = self.count[i] + 1
            ids.append(self.ids[i])
            count.append(n)
            mean.append(self.mean[i] + (tokens[j] - self.mean[i]) / n)
        out = [self.ids[i] if i is not None else -1 for i in given]
        for j in range(len(tokens)):
            if out[j] < 0:
                out[j] = self.made
                ids.append(self.made)
                count.append(1)
                mean.append(tokens[j].astype(float))
                self.made += 1
        self.ids, self.count, self.mean, self.last = ids, count, np.array(mean), frame
        return out, closed

    def close(self) -> list[tuple[int, int, np.ndarray]]:
        """The open tracks, which end here."""
        out = list(zip(self.ids, self.count, self.mean, strict=True))
        self.ids, self.count, self.mean = [], [], np.zeros((0, 0))
        return out


def link_tracks(frames: list[tuple[int, np.ndarray]], least: float = 0.65) -> list[dict]:
    """Tracks of one video from (frame, unit tokens) in frame order: token, members, last frame."""
    linker, tracks = Linker(least), {}
    for frame, tokens in frames:
        ids, closed = linker.step(frame, tokens)
        for t, _, token in closed:
            tracks[t]["token"] = token
        for j, t in enumerate(ids):
            one = tracks.setdefault(t, {"token": None, "members": []})
            one["members"].append((frame, j))
            one["last"] = frame
    for t, _, token in linker.close():
        tracks[t]["token"] = token
    return [tracks[t] for t in sorted(tracks)]


def track_rows(regions: DataFrame, least: float = 0.65) -> DataFrame:
    """video_id, track_id, frame_idx, place, n_members, tok: a row for each member, and one without a frame for each track.

    ``regions`` (video_id, frame_idx, region_idx, tok) of a video go to one task, sorted by frame, and are read chunk by
    chunk; between chunks only the open tracks and the frame that a chunk may have cut are kept, and a track is sent as
    soon as it ends.  So memory depends on the regions of a frame, not on the length of a video.  ``place`` is the
    region's place among those of its frame.
    """
    kind = regions.schema["video_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, video, frame, held, rows = None, None, None, [], []

        def member(t: int, at: int, j: int) -> None:
            rows.append((video, t, at, j, None, None))

        def end(found: list[tuple[int, int, np.ndarray]]) -> None:
            rows.extend((video, t, None, None, n, token.tolist()) for t, n, token in found)

        def frame_done() -> None:
            if frame is not None:
                ids, closed = linker.step(frame, np.concatenate(held))
                end(closed)
                for j, t in enumerate(ids):
                    member(t, frame, j)

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["video_id", "track_id", "frame_idx", "place", "n_members", "tok"])
            rows.clear()
            return out

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
            if not batch.num_rows:
                continue
            videos, frames, lists = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
            tokens = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            edge = [k for k in range(batch.num_rows) if k == 0 or frames[k] != frames[k - 1] or videos[k] != videos[k - 1]]
            for a, b in zip(edge, [*edge[1:], batch.num_rows], strict=True):
                if linker is None or videos[a] != video or frames[a] != frame:
                    frame_done()
                    if linker is None or videos[a] != video:
                        if linker is not None:
                            end(linker.close())
                        linker, video = Linker(least), videos[a]
                    frame, held = int(frames[a]), []
                held.append(tokens[a:b])
            if rows:
                yield sent()
        if linker is not None:
            frame_done()
            end(linker.close())
            yield sent()

    ordered = regions.select("video_id", "frame_idx", "tok", "region_idx").repartition("video_id").sortWithinPartitions("video_id", "frame_idx", "region_idx").drop("region_idx")
    return ordered.mapInArrow(run, f"video_id {kind}, track_id int, frame_idx int, place int, n_members int, tok array<double>")


def track(regions: DataFrame, least: float = 0.65) -> DataFrame:
    """video_id, track_id, tok, members of every track; ``regions``: video_id, frame_idx, region_idx, tok."""
    members = F.array_sort(F.collect_list(F.when(F.col("frame_idx").isNotNull(), F.struct("frame_idx", F.col("place").alias("region_idx")))))
    return track_rows(regions, least).groupBy("video_id", "track_id").agg(F.max("tok").alias("tok"), members.alias("members"))


def compression(tracks: DataFrame) -> DataFrame:
    """Members per track of each video."""
    return tracks.groupBy("video_id").agg(F.count("*").alias("n_tracks"), F.sum(F.size("members")).alias("n_members")).withColumn("ratio", F.col("n_members") / F.col("n_tracks"))


def adjacency(regions: DataFrame, box_above: float, cosine_above: float) -> DataFrame:
    """Pairs of regions of one frame that overlap or look alike (video_id, frame_idx, a, b with a < b)."""
    from .nms import iou
    from .vectors import cosine

    cols = ["region_idx", "tok", "x1", "y1", "x2", "y2"]
    left, right = (regions.select("video_id", "frame_idx", *(F.col(c).alias(p + c) for c in cols)) for p in "lr")
    corner = lambda p: [F.col(p + c) for c in cols[2:]]
    near = (iou(corner("l"), corner("r")) > box_above) | (cosine(F.col("ltok"), F.col("rtok")) > cosine_above)
    return left.join(right, ["video_id", "frame_idx"]).where(F.col("lregion_idx") < F.col("rregion_idx")).where(near).select("video_id", "frame_idx", F.col("lregion_idx").alias("a"), F.col("rregion_idx").alias("b"))


def labels_of(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """Smallest-label propagation over a small graph, ceil(log2(n+1))+1 rounds at most."""
    label = np.arange(n)
    a = np.array([x for e in edges for x in e], dtype=int)
    b = np.array([x for e in edges for x in e[::-1]], dtype=int)
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        new = label.copy()
        if len(a):
            np.minimum.at(new, a, label[b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label.tolist()


def region_groups(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """video_id, frame_idx, region_idx, group: connected groups of each frame's regions (0..n-1 per frame)."""
    spine = regions.groupBy("video_id", "frame_idx").agg((F.max("region_idx") + 1).cast("int").alias("n"))
    graph = spine.join(pairs.groupBy("video_id", "frame_idx").agg(F.collect_list(F.struct("a", "b")).alias("e")), ["video_id", "frame_idx"], "left")

    @F.pandas_udf("array<int>")
    def label(n, e):
        import pandas as pd

        return pd.Series([labels_of(int(k), [(int(x["a"]), int(x["b"])) for x in (g if g is not None else [])]) for k, g in zip(n, e, strict=True)])

    return graph.select("video_id", "frame_idx", F.posexplode(label("n", "e")).alias("region_idx", "group"))
