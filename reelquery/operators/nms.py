"""Greedy suppression: frames under a temporal gap as JVM folds, boxes under an overlap in Arrow groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auto_tau(n: Column, fps: Column, k: Column | int, cap: float = 10.0) -> Column:
    """min(duration / 2k, cap) seconds; 0 without frames per second or k."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when((fps <= 0) | (k <= 0), 0.0).otherwise(F.least(n / F.nullif(fps, F.lit(0)) / F.nullif(2 * k, F.lit(0)), F.lit(cap)))


def gap_fold(ordered: Column, k: Column, gap: Column) -> Column:
    """Frames of a best-first array, greedily, at most k, each at least ``gap`` from all kept."""
    none = F.lit([]).cast("array<int>")
    return F.aggregate(ordered, none, lambda kept, x: F.when((F.size(kept) < k) & ~F.exists(kept, lambda y: F.abs(y - x) < gap), F.concat(kept, F.array(x))).otherwise(kept))


def _ordered(scores: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Best-first frames of each group; ties by ``tie`` columns."""
    row = F.struct((-F.col("score")).alias("s"), *(F.col(t) for t in tie), F.col("frame_idx").cast("int").alias("f"))
    return scores.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["f"]).alias("ordered"), F.count("*").alias("n"))


def greedy_gap(scores: DataFrame, keys: list[str], k: int, gap: int, tie: list[str] | None = None) -> DataFrame:
    """keys, picks: the greedy selection of each group in order of choice."""
    return _ordered(scores, keys, tie or []).select(*keys, gap_fold(F.col("ordered"), F.lit(k), F.lit(gap)).alias("picks"))


def pools(scores: DataFrame, keys: list[str], ks: list[int], meta: DataFrame | None = None, fps: float = 2.0, tau: float = -1.0, cap: float = 10.0, tie: list[str] | None = None) -> DataFrame:
    """keys, k, gap, picks for every pool size.

    The gap comes from each k (or a fixed ``tau``); a group of at most k frames is returned whole, best first.
    ``meta`` (keys, num_frames, fps) gives durations; otherwise the group's own number of frames counts.
    """
    rows = _ordered(scores, keys, tie or [])
    rows = rows.join(meta, keys) if meta is not None else rows.withColumn("num_frames", F.col("n")).withColumn("fps", F.lit(fps))
    rows = rows.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    seconds = F.lit(tau) if tau >= 0 else auto_tau(F.col("num_frames"), F.col("fps"), F.col("k"), cap)
    rows = rows.withColumn("gap", (seconds * F.col("fps")).cast("int"))
    return rows.select(*keys, "k", "gap", F.when(F.col("n") <= F.col("k"), F.col("ordered")).otherwise(gap_fold(F.col("ordered"), F.col("k"), F.col("gap"))).alias("picks"))


def final_frames(pooled: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The picks of one pool size in time order with their timestamps at 2 frames per second."""
    return pooled.where(F.col("k") == k).select(*keys, F.array_sort("picks").alias("frames_used")).withColumn("timestamps_used", F.transform("frames_used", lambda i: i / F.lit(2.0)))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two (x1, y1, x2, y2) boxes; 0 where the union is empty."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - width * height
    return F.when(union > 0, width * height / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def _values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``iou`` of corners (4, ...) in numpy."""
    both = np.minimum(a[2], b[2])
    both -= np.maximum(a[0], b[0])
    np.maximum(both, 0.0, out=both)
    high = np.minimum(a[3], b[3])
    high -= np.maximum(a[1], b[1])
    both *= np.maximum(high, 0.0, out=high)
    union = np.subtract((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]), both, out=high)
    some = union > 0
    return np.divide(both, union, out=both) if some.all() else np.divide(both, union, out=np.zeros_like(both), where=some)


def _tiles(corners: np.ndarray, most: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): shapes (n, 4) split at medians into tiles of at most ``most`` that are alike in all corners."""
    todo, out = [np.arange(len(corners))], []
    while todo:
        part = todo.pop()
        if len(part) <= most:
            out.append(part)
            continue
        p, mid = corners[part], len(part) // 2
        order = part[np.argpartition(p[:, np.argmax(np.ptp(p, axis=0))], mid)]
        todo += [order[mid:], order[:mid]]
    return np.concatenate(out), np.cumsum([0, *map(len, out)])


class _Shapes:
    """Distinct shapes of some boxes, in tiles: how many boxes have each, whose it is (``own``: a number for an id, or one of its own if several ids have it), bounds of the tiles."""

    def __init__(self, ids: np.ndarray, corners: np.ndarray):
        by = np.lexsort((ids, *corners.T))
        ids, corners = ids[by], corners[by]
        fresh = np.concatenate([[True], (corners[1:] != corners[:-1]).any(1)])
        at, of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        order, self.starts = _tiles(corners[at])
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        self.of = np.empty(len(ids), np.int64)  # the shape of each box
        self.of[by] = place[of]
        last = np.append(at[1:], len(ids)) - 1
        self.corners = np.ascontiguousarray(corners[at][order].T)
        self.count, self.shared = np.diff(np.append(at, len(ids)))[order].astype(float), (ids[at] != ids[last])[order]
        self.own = np.where(self.shared, -1 - np.arange(len(at)), np.unique(ids[at][order], return_inverse=True)[1]).astype(np.int32)
        self.area = np.prod(np.maximum(self.corners[2:] - self.corners[:2], 0.0), axis=0)
        self.points = np.vstack([self.corners, self.area])
        self.low, self.high = (f.reduceat(self.points, self.starts[:-1], axis=1) for f in (np.minimum, np.maximum))

    def bound(self, t: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """At least the overlap of any shape of tile ``t`` with shapes between ``lo`` and ``hi`` (corners and area)."""
        a, b = self.low[:, t], self.high[:, t]
        both = np.maximum(0.0, np.minimum(b[2], hi[2]) - np.maximum(a[0], lo[0])) * np.maximum(0.0, np.minimum(b[3], hi[3]) - np.maximum(a[1], lo[1]))
        both = np.minimum(both, np.minimum(b[4], hi[4]))
        union = np.maximum(a[4] + lo[4] - both, np.maximum(a[4], lo[4]))
        return np.divide(both, union, out=np.where(both > 0, np.inf, 0.0), where=union > 0) * (1 + 1e-9)


def _best(q: _Shapes, c: _Shapes, over: float) -> tuple[np.ndarray, np.ndarray]:
    """For each shape of ``q``: the best overlap with a shape of ``c`` that isn't its own box's alone (-1: none met), and how many boxes overlap by more than ``over``.

    ``q`` and ``c`` are the same shapes, or have no id in common.
    """
    top, n = np.full(len(q.count), -1.0), np.zeros(len(q.count))
    sizes = np.diff(c.starts)
    for t, (i, j) in enumerate(zip(q.starts[:-1], q.starts[1:], strict=True)):
        bound, mine = q.bound(t, c.low, c.high), np.arange(i, j)
        for least in (over, 0.0):  # lower overlaps only matter to shapes without a high one
            mine = mine[top[mine] <= over]
            if not len(mine):
                break
            near = np.flatnonzero(np.repeat(bound > least, sizes))
            points = c.points[:, near]
            near = near[q.bound(t, points, points) > least]
            for k in range(0, len(near), 1 << 16):
                part = near[k : k + (1 << 16)]
                v = _values(q.corners[:, mine, None], c.corners[:, None, part])
                if least == over:
                    n[mine] += (v > over) @ c.count[part]
                if q is c:
                    v[q.own[mine, None] == c.own[part]] = -1.0
                top[mine] = np.maximum(top[mine], v.max(axis=1))
    if q is c:  # a shape of several boxes is met by itself
        top = np.where(q.shared, np.maximum(top, q.area > 0), top)
    return top, n


def best_overlaps(boxes: DataFrame, over: float = 0.5, most: int = 400_000) -> DataFrame:
    """image_id, box_id, best, n_over: each box against all others (by box_id) of its image and label.

    A box without others drops out; several boxes of one id in an image are one row, their best and the sum of their counts.
    Equal shapes are compared once, and only tiles of shapes whose bounds allow an overlap that counts.  A group of more
    than ``most`` boxes is dealt into blocks by box_id, and each pair of blocks is a group of its own.  A box with a null
    corner has no overlap (null) and is none.
    """
    corners = ["x1", "y1", "x2", "y2"]
    given = boxes.select("image_id", "label", "box_id", *(F.col(c).cast("double").alias(c) for c in corners)).dropna(subset=["image_id", "label", "box_id"])
    large = given.groupBy("image_id", "label").count().where(F.col("count") > most).select("image_id", "label", F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    dealt = given.join(F.broadcast(large), ["image_id", "label"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("box_id"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    own = F.col("own")
    pairs = dealt.select("image_id", "label", "box_id", *corners, "own", F.explode(F.concat(F.array(pair(own, own)), F.transform(others, lambda k: pair(own, k)), F.transform(others, lambda k: pair(k, own)))).alias("p")).select("image_id", "label", "box_id", *corners, "own", "p.i", "p.j")

    def run(group: pa.Table) -> pa.Table:
        ids, own = (group.column(c).to_numpy() for c in ("box_id", "own"))
        at = np.stack([group.column(c).to_numpy() for c in corners], 1)
        i, j, whole = group.column("i")[0].as_py(), group.column("j")[0].as_py(), ~np.isnan(at).any(1)
        asked, met = own == i, own == j
        some = lambda values: (values.min() != ids) | (values.max() != ids) if len(values) else np.zeros(len(ids), bool)
        best, n, known = np.zeros(len(ids)), np.zeros(len(ids), np.int64), some(ids[met & whole]) & whole
        q, c = np.flatnonzero(asked & whole), np.flatnonzero(met & whole)
        if len(q) and len(c):
            seen = _Shapes(ids[c], at[c])
            shapes = seen if i == j else _Shapes(ids[q], at[q])
            top, count = _best(shapes, seen, over)
            best[q], n[q] = np.maximum(top, 0.0)[shapes.of], count[shapes.of]
            if i == j:  # boxes of the same id, itself included, don't count
                order = c[np.argsort(ids[c], kind="stable")]
                at_id, end = (np.searchsorted(ids[order], ids[q], side) for side in ("left", "right"))
                while len(q):
                    n[q] -= _values(at[q].T, at[order[at_id]].T) > over
                    at_id = at_id + 1
                    q, at_id, end = q[at_id < end], at_id[at_id < end], end[at_id < end]
        out = np.flatnonzero(asked & some(ids[met]))
        table = group.select(["image_id", "box_id"]).take(pa.array(out))
        return table.append_column("best", pa.array(best[out], mask=~known[out])).append_column("n_over", pa.array(n[out]))

    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    met = pairs.groupBy("image_id", "label", "i", "j").applyInArrow(run, f"image_id {kinds['image_id']}, box_id {kinds['box_id']}, best double, n_over long")
    return met.groupBy("image_id", "box_id").agg(F.max("best").alias("best"), F.sum("n_over").alias("n_over"))


def overlap_of_smaller(a: list[Column], b: list[Column]) -> Column:
    """Intersection over the smaller area, pixel-inclusive (+1)."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1)
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1)
    area = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
    return width * height / F.least(area(a), area(b))


def _kept(corners: np.ndarray, above: float, most: int) -> list[int]:
    """Places of the boxes that stay, best first in and out: each goes if it overlaps one that stays."""
    x1, y1, x2, y2 = corners.T
    area = (x2 - x1) * (y2 - y1)
    left, out = np.arange(len(corners)), []
    while len(left) and len(out) < most:
        i, left = left[0], left[1:]
        out.append(int(i))
        both = np.maximum(0.0, np.minimum(x2[i], x2[left]) - np.maximum(x1[i], x1[left])) * np.maximum(0.0, np.minimum(y2[i], y2[left]) - np.maximum(y1[i], y1[left]))
        union = area[i] + area[left] - both
        left = left[~((union > 0) & (both > above * union))]
    return out


def box_nms(boxes: DataFrame, iou_above: float = 0.7, score_above: float = 0.001, per_class: int = 300, keep: int = 300) -> DataFrame:
    """Class-aware suppression per image: score gate, greedy by score within a class, then the best ``keep`` per image.

    An image and class is one group; a step compares one kept box with all that are left, in numpy.
    """
    given = boxes.where(F.col("score") > score_above).select("image_id", "label", "box_id", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "score")))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("score", "descending"), ("box_id", "ascending")])
        corners = np.stack([group.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], 1)
        return group.take(pa.array(_kept(corners, iou_above, per_class), pa.int64()))

    flat = given.groupBy("image_id", "label").applyInArrow(run, given.schema)
    w = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "box_id")
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def head_boxes(scores: DataFrame, score_above: float = 0.001, pre: int = 30000, multi_label: bool = True) -> DataFrame:
    """Candidates of a detection head: (image_id, prior, label, score, ...) from class scores times objectness.

    ``scores``: image_id, prior, classes (array), objectness (null: 1), anything else.  With ``multi_label`` a prior gives
    a box for every class over the threshold, else for its best class alone; the best ``pre`` of each image go on.
    """
    rest = [c for c in scores.columns if c not in ("classes", "objectness")]
    each = scores.select(*rest, F.posexplode("classes").alias("label", "s"), F.coalesce("objectness", F.lit(1.0)).alias("o")).withColumn("score", F.col("s") * F.col("o")).drop("s", "o")
    if not multi_label:
        best = Window.partitionBy("image_id", "prior").orderBy(F.col("score").desc(), "label")
        each = each.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
    w = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "prior", "label")
    return each.where(F.col("score") > score_above).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= pre).drop("rn")


def gap_select(scores: DataFrame, keys: list[str], k: int, fps: float = 2.0, cap: float = 10.0) -> DataFrame:
    """keys, picks: the greedy selection by score alone, with the gap of ``auto_tau``, whatever the number of frames."""
    rows = _ordered(scores, keys, [])
    gap = (auto_tau(F.col("n"), F.lit(fps), k, cap) * fps).cast("int")
    return rows.select(*keys, gap_fold(F.col("ordered"), F.lit(k), gap).alias("picks"))


def top_detections(boxes: DataFrame, score_above: float, most: int) -> DataFrame:
    """Boxes over a score, the best ``most`` of each image."""
    w = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "box_id")
    return boxes.where(F.col("score") > score_above).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def finish_boxes(boxes: DataFrame, width: Column, height: Column, pad_x: float = 0.0, pad_y: float = 0.0, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """Boxes back in the original image: padding off, scale off, clamped to the image."""
    fit = lambda c, pad, scale, most: F.greatest(F.lit(0.0), F.least((F.col(c) - pad) / scale, most.cast("double")))
    return boxes.withColumns({"x1": fit("x1", pad_x, scale_x, width), "y1": fit("y1", pad_y, scale_y, height), "x2": fit("x2", pad_x, scale_x, width), "y2": fit("y2", pad_y, scale_y, height)})


def left_top(boxes: DataFrame, score_at_least: float, width: float, height: float) -> DataFrame:
    """Boxes of class 0 at or over a score as left, top, width, height within the image."""
    fit = lambda c, most: F.greatest(F.lit(0.0), F.least(F.col(c), F.lit(most)))
    out = boxes.where((F.col("label") == 0) & (F.col("score") >= score_at_least))
    return out.select("image_id", "box_id", fit("x1", width).alias("left"), fit("y1", height).alias("top"), (fit("x2", width) - fit("x1", width)).alias("width"), (fit("y2", height) - fit("y1", height)).alias("height"), "score")


def decode_centre(boxes: DataFrame, stride: Column) -> DataFrame:
    """Distances to a prior point (left, top, right, bottom, in strides) as corner boxes."""
    return boxes.withColumns({"x1": F.col("px") - F.col("dl") * stride, "y1": F.col("py") - F.col("dt") * stride, "x2": F.col("px") + F.col("dr") * stride, "y2": F.col("py") + F.col("db") * stride})


def one_box_per_class(boxes: DataFrame, least_area: float = 4096.0, seed: int = 0) -> DataFrame:
    """One box per image and class among those of some area, chosen by a seeded hash; classes without one drop out."""
    big = boxes.where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= least_area)
    chance = F.md5(F.concat_ws(":", "image_id", "label", "box_id", F.lit(seed)).cast("binary"))
    w = Window.partitionBy("image_id", "label").orderBy(chance, "box_id")
    return big.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
