"""Relation-guided search: sample frames on a grid image, detect, score, reshape the sampling distribution, repeat.

The search of one video is a small sequential process over its own frames, so each video is one group of
``applyInArrow``; the detector is a function of (video, frames) to detections and is given by the caller.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch

Detector = Callable[[str, list[int], list[str]], list[list[tuple[str, float, tuple[float, float, float, float]]]]]
#: Weights of cues and of relations, the time window, the overlap that counts as attribute.
TARGET_WEIGHT, CUE_WEIGHT, RELATION_WEIGHT, NEAR_FRAMES, OVERLAP = 1.0, 0.5, 0.25, 5, 0.5


def budget(n: int, ratio: float, most: int = 1000) -> float:
    return min(most, n * ratio)


def cell_scores(detections: DataFrame, width: float, height: float, rows: int, cols: int) -> DataFrame:
    """image_id, cell, score: the best weighted confidence in each cell of a grid image, by box centre."""
    x = F.least(F.lit(cols - 1), F.floor((F.col("x1") + F.col("x2")) / 2 / (width / cols)))
    y = F.least(F.lit(rows - 1), F.floor((F.col("y1") + F.col("y2")) / 2 / (height / rows)))
    weight = F.when(F.col("kind") == "target", TARGET_WEIGHT).otherwise(CUE_WEIGHT)
    return detections.groupBy("image_id", (y * cols + x).cast("int").alias("cell")).agg(F.max(F.col("score") * weight).alias("score"))


def timed_pairs(seen: DataFrame, relations: DataFrame) -> DataFrame:
    """uid, a, b, type, first, second: frames that satisfy a time (fewer than 5 apart) or causal (earlier) relation."""
    one, two = (seen.select("uid", F.col("place").alias(f"p{p}"), F.col("frame_idx").alias(f"f{p}"), F.col("name").alias(p)) for p in "ab")
    rows = relations.join(one, ["uid", "a"]).join(two, ["uid", "b"]).where("pa <= pb")
    good = ((F.col("type") == "time") & (F.abs(F.col("fa") - F.col("fb")) < NEAR_FRAMES)) | ((F.col("type") == "causal") & (F.col("fa") < F.col("fb")))
    return rows.where(good).select("uid", "a", "b", "type", F.col("fa").alias("first"), F.col("fb").alias("second"))


def raise_neighbours(score: np.ndarray, frames: list[int], confidence: np.ndarray, reach: int = 5) -> None:
    """In place: around the sampled frames of the top quarter, in order, a frame at distance d gets at least score / (d + 1)."""
    for f in (f for f, c in zip(frames, confidence, strict=True) if c >= np.percentile(confidence, 75)):
        low, high = max(0, f - reach), min(len(score), f + reach + 1)
        near = score[f] / (np.abs(np.arange(low, high) - f) + 1)
        score[low:high] = np.maximum(score[low:high], near)


def bell_curve(score: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The distribution of Gaussian bells around visited frames, as wide as 0.1 of their scores' deviation.

    Where all bells vanish (equal or zero scores) it is even.
    """
    n, width = len(score), 0.1 * float(score[at].std()) if len(at) else 0.0
    if width == 0:
        return np.full(n, 1.0 / max(1, n))
    p = np.exp(-0.5 * ((np.arange(n)[:, None] - at) / width) ** 2) @ score[at]
    return p / p.sum() if p.sum() > 0 else np.full(n, 1.0 / n)


def smoothing_spline(x: np.ndarray, y: np.ndarray, s: float, where: np.ndarray) -> np.ndarray:
    """The natural cubic spline of least curvature whose squared residuals sum to at most ``s``, at ``where``; straight beyond
    the ends.

    Second derivatives g at the inner knots solve (R + a QtQ) g = Qt y, and the smallest curvature is the largest a that
    keeps the residuals a Q g within ``s``.
    """
    x, y = x.astype(float), y.astype(float)
    if len(x) < 3:
        return np.interp(where, x, y)
    h = np.diff(x)
    m = len(x) - 2
    q, r = np.zeros((len(x), m)), np.zeros((m, m))
    k = np.arange(m)
    q[k, k], q[k + 1, k], q[k + 2, k] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    r[k, k] = (h[:-1] + h[1:]) / 3
    r[k[:-1], k[1:]] = r[k[1:], k[:-1]] = h[1:-1] / 6
    values, vectors = np.linalg.eigh(np.linalg.solve(c := np.linalg.cholesky(r), np.linalg.solve(c, q.T @ q).T))  # R^-1/2 QtQ R^-1/2
    load = vectors.T @ np.linalg.solve(c, q.T @ y)
    bend = lambda a: np.linalg.solve(c.T, vectors @ (load / (1 + a * values)))
    off = lambda a: float(((a * q @ bend(a)) ** 2).sum())
    low, high = 0.0, 1.0
    while off(high) < s and high < 1e12:
        low, high = high, 10 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if off(mid) < s else (low, mid)
    g = np.concatenate(([0.0], bend(low), [0.0]))
    fit = y - low * q @ g[1:-1]
    i = np.clip(np.searchsorted(x, where, "right") - 1, 0, len(h) - 1)
    inside = np.clip(where, x[0], x[-1])
    u, v = inside - x[i], x[i + 1] - inside
    out = (u * fit[i + 1] + v * fit[i]) / h[i] - u * v * ((1 + u / h[i]) * g[i + 1] + (1 + v / h[i]) * g[i]) / 6
    first = (fit[1] - fit[0]) / h[0] - h[0] * g[1] / 6
    last = (fit[-1] - fit[-2]) / h[-1] + h[-1] * g[-2] / 6
    return out + np.where(where < x[0], (where - x[0]) * first, 0) + np.where(where > x[-1], (where - x[-1]) * last, 0)


def spline_curve(score: np.ndarray, at: np.ndarray, s: float = 0.5) -> np.ndarray:
    """The distribution of a smoothed curve through visited frames, floored at 1/n, through a sigmoid."""
    n = len(score)
    if not len(at):
        return np.full(n, 1.0 / max(1, n))
    p = 1 / (1 + np.exp(-np.maximum(1.0 / n, smoothing_spline(at, score[at], s, np.arange(n)))))
    return p / p.sum()


#: How the distribution follows the scores.
UPDATES = {"spline": spline_curve, "gaussian": bell_curve}


@dataclass(frozen=True)
class Grounding:
    targets: list[str]
    cues: list[str]
    relations: list[tuple[str, str, str]]


def _overlap(a, b) -> float:
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]) + 1)
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
    area = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
    return w * h / min(area(a), area(b))


def relation_bonus(frames: list[int], seen: list[dict], relations: list[tuple[str, str, str]], met: set[int]) -> np.ndarray:
    """Additions to frame scores from relations not met before; newly met ones join ``met``."""
    bonus = np.zeros(len(frames))
    for r, (a, b, kind) in enumerate(relations):
        if r in met:
            continue
        pairs = []
        for i in range(len(frames)):
            if kind in ("spatial", "attribute"):
                if a in seen[i] and b in seen[i] and (kind == "spatial" or _overlap(seen[i][a], seen[i][b]) > OVERLAP):
                    pairs.append((i,))
            elif a in seen[i]:
                near = (lambda d: abs(d) < NEAR_FRAMES) if kind == "time" else (lambda d: d > 0)
                pairs += [(i, j) for j in range(i, len(frames)) if b in seen[j] and near(frames[j] - frames[i])]
        for pair in pairs:
            for i in pair:
                bonus[i] += RELATION_WEIGHT
            met.add(r)
    return bonus


class Search:
    """The state of one video's search between rounds."""

    def __init__(self, video: str, n: int, g: Grounding, k: int, ratio: float = 0.5, side: int = 4, threshold: float = 0.5, seed: int = 2025, update: str = "spline"):
        self.video, self.n, self.g, self.k = video, n, g, k
        self.side, self.threshold, self.update = side, threshold, update
        self.rng = np.random.RandomState((seed ^ zlib.crc32(video.encode())) & 0x7FFFFFFF)
        self.score, self.visited, self.p = np.zeros(n), np.zeros(n, bool), np.full(n, 1.0 / max(1, n))
        self.left, self.missing, self.met, self.first = budget(n, ratio), list(g.targets), set(), True

    @property
    def names(self) -> list[str]:
        return [*self.g.targets, *self.g.cues]

    def open(self) -> bool:
        """Whether targets or relations are missing, and budget and unseen frames are left."""
        return bool(self.left > 0 and self.n and (self.missing or len(self.met) < len(self.g.relations)) and not self.visited.all())

    def sample(self) -> list[int]:
        """The frames of the next grid image."""
        size = min(self.side**2, self.n)
        if self.first:
            frames = sorted({int(i) for i in np.linspace(0, self.n - 1, size)})
        else:
            q = (self.p + self.k / self.n) * ~self.visited
            q = np.where(q >= np.quantile(q, 0.75), q, 0.0)
            frames = sorted(self.rng.choice(self.n, min(size, int((q > 0).sum())), replace=False, p=q / q.sum()).tolist())
        self.first = False
        self.left -= self.side**2
        self.visited[frames] = True
        return frames

    def confidence(self, found: list) -> float:
        """The best weighted confidence of a frame's detections, 0 without any."""
        return max([0.0, *(c * (TARGET_WEIGHT if name in self.g.targets else CUE_WEIGHT) for name, c, _ in found)])

    def absorb(self, frames: list[int], found: list[list]) -> list[int]:
        """Take a grid image's detections: scores, neighbours, distribution.  Returns the frames to be looked at alone."""
        seen = [{name: box for name, _, box in one} for one in found]
        confidence = np.array([self.confidence(one) for one in found]) + relation_bonus(frames, seen, self.g.relations, self.met)
        self.score[frames] = confidence
        raise_neighbours(self.score, frames, confidence)
        self.p = UPDATES[self.update](self.score, np.flatnonzero(self.visited))
        self.shown = dict(zip(frames, seen, strict=True))
        return [f for f, one in zip(frames, seen, strict=True) if any(t in one for t in self.missing)]

    def confirm(self, frames: list[int], alone: list[list]) -> None:
        """Take the detections of single frames, in order: each replaces its frame's score, and may confirm one target.

        A frame whose targets have all been confirmed on frames before it isn't looked at any more.
        """
        for f, one in zip(frames, alone, strict=True):
            sought = [t for t in self.missing if t in self.shown[f]]
            if sought:
                self.score[f] = self.confidence(one)
                sure = self.score[f] > self.threshold
                names = {name for name, _, _ in one}
                hit = next((t for t in sought if t in names and sure), None)
                if hit is not None:
                    self.missing.remove(hit)

    def result(self) -> tuple[list[int], list[float]]:
        """The k best frames in time order, and all scores."""
        picks = np.lexsort((np.arange(self.n), -self.score))[: self.k]
        return sorted(map(int, picks)), self.score.tolist()


def search_video(video: str, n: int, g: Grounding, detect: Detector, k: int, ratio: float = 0.5, side: int = 4, threshold: float = 0.5, seed: int = 2025, update: str = "spline", alone: Detector | None = None) -> tuple[list[int], list[float]]:
    """(picks, final scores) of one video: until targets and relations are found or the budget is spent.

    A sampled frame's score is replaced by what was seen now, relations included; then the neighbours of the best quarter
    rise, and ``update`` (spline or gaussian) turns the scores of visited frames into the next distribution.  Frames that
    show a missing target are detected again, each alone (by ``alone``, else by ``detect``): that confidence replaces the
    frame's score, and over ``threshold`` it takes the target off the list.
    """
    s = Search(video, n, g, k, ratio, side, threshold, seed, update)
    while s.open():
        frames = s.sample()
        again = s.absorb(frames, detect(video, frames, s.names))
        s.confirm(again, [(alone or detect)(video, [f], s.names)[0] for f in again])
    return s.result()


def _grounding(row: dict) -> Grounding:
    return Grounding(row["targets"] or [], row["cues"] or [], [(r["a"], r["b"], r["type"]) for r in row["relations"] or []])


def relation_search(videos: DataFrame, detect: Detector, k: int, ratio: float = 0.5, update: str = "spline", alone: Detector | None = None) -> DataFrame:
    """uid, picks, scores; ``videos``: uid, video_id, n, targets, cues, relations (array of struct a, b, type).

    Each video searches on its own, with calls of its own; ``search_rounds`` does the same for all videos together.
    """
    def run(group: pa.Table) -> pa.Table:
        row = group.slice(0, 1).to_pylist()[0]
        picks, scores = search_video(str(row["video_id"]), int(row["n"]), _grounding(row), detect, k, ratio, update=update, alone=alone)
        return pa.table({"uid": pa.array([str(row["uid"])]), "picks": pa.array([picks], pa.list_(pa.int32())), "scores": pa.array([scores], pa.list_(pa.float64()))})

    return videos.groupBy("uid").applyInArrow(run, "uid string, picks array<int>, scores array<double>")


#: One call for many videos: (video, frames, names) each, answered like a ``Detector``'s call for each.
ManyDetector = Callable[[list[tuple[str, list[int], list[str]]]], list[list[list[tuple[str, float, tuple[float, float, float, float]]]]]]
_STATE = "uid string, open boolean, state binary"


def search_rounds(videos: DataFrame, detect: ManyDetector, alone: ManyDetector, k: int, ratio: float = 0.5, update: str = "spline", at_once: int = 64, **options) -> DataFrame:
    """uid, picks, scores like ``relation_search``, in rounds over all videos that are still open.

    The searches are rows of a table that every round writes anew.  In a round a task makes one call of ``detect`` for the
    next grid images of up to ``at_once`` videos, one of ``alone`` for all frames of theirs that show a missing target,
    and draws each video's next frames.  A video that is done stays in the table of its last round.  The budget bounds
    the number of rounds, and the driver sees only whether any video is open.
    """
    spark = videos.sparkSession

    def rows(states: list[tuple[str, Search]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in states], pa.string()), pa.array([s.open() for _, s in states], pa.bool_()), pa.array([pickle.dumps(s) for _, s in states], pa.binary())], ["uid", "open", "state"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows([(str(r["uid"]), Search(str(r["video_id"]), int(r["n"]), _grounding(r), k, ratio, update=update, **options)) for r in batch.to_pylist()])

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                states = list(zip(part.column(0).to_pylist(), map(pickle.loads, part.column(2).to_pylist()), strict=True))
                asked = [(s.video, s.sample(), s.names) for _, s in states]
                again = [s.absorb(frames, found) for (_, s), (_, frames, _), found in zip(states, asked, detect(asked), strict=True)]
                single = [(s.video, [f], s.names) for (_, s), frames in zip(states, again, strict=True) for f in frames]
                seen = iter(alone(single) if single else [])
                for (_, s), frames in zip(states, again, strict=True):
                    s.confirm(frames, [next(seen)[0] for _ in frames])
                yield rows(states)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.loads(s).result() for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float64()))], ["uid", "picks", "scores"])

    given = videos.select(F.col("uid").cast("string").alias("uid"), F.col("video_id").cast("string").alias("video_id"), "n", "targets", "cues", "relations")
    now = scratch.written(given.repartition("uid").mapInArrow(begin, _STATE), "search")
    done = now.where("not open")
    while not now.where("open").isEmpty():
        now = scratch.written(now.where("open").mapInArrow(go_on, _STATE), "search")
        done = done.union(now.where("not open"))
    return done.mapInArrow(finish, "uid string, picks array<int>, scores array<double>")
