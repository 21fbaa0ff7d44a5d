"""Ranks, suppression, islands and samplers against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.operators import islands, nms, rank, sampling, wavelet


def curves(seed=0, videos=12):
    rnd = random.Random(seed)
    out = {}
    for v in range(videos):
        n = [0, 1, 2, 5, 8, 9, 64, 65, 120, 200][v % 10]
        out[v] = [round(rnd.random(), 1 + v % 2 * 3) for _ in range(n)]
    out[100] = [0.5] * 40
    return out


def table(spark, given):
    return spark.createDataFrame([(v, f, s) for v, c in given.items() for f, s in enumerate(c)], "video_id int, frame_idx int, score double")


def greedy(scores, k, gap):
    kept = []
    for f in sorted(range(len(scores)), key=lambda f: (-scores[f], f)):
        if len(kept) < k and all(abs(f - y) >= gap for y in kept):
            kept.append(f)
    return kept


def test_percentiles(spark):
    given = curves()
    got = defaultdict(dict)
    for r in rank.percentile(table(spark, given), ["video_id"]).collect():
        got[r.video_id][r.frame_idx] = r.pct
    for v, c in given.items():
        order = sorted(range(len(c)), key=lambda f: (c[f], f))
        assert got.get(v, {}) == {f: 1.0 if len(c) == 1 else i / (len(c) - 1) for i, f in enumerate(order)}


@pytest.mark.parametrize("k, gap", [(3, 2), (8, 0), (8, 5), (1, 100)])
def test_greedy_gap(spark, k, gap):
    given = curves(1)
    got = {r.video_id: r.picks for r in nms.greedy_gap(table(spark, given), ["video_id"], k, gap).collect()}
    assert got == {v: greedy(c, k, gap) for v, c in given.items() if c}


def test_pools_skip_suppression_for_small_groups(spark):
    given = curves(2)
    for r in nms.pools(table(spark, given), ["video_id"], [4, 8, 64]).collect():
        c = given[r.video_id]
        gap = int(min(len(c) / 2 / (2 * r.k), 10) * 2)
        assert r.gap == gap and r.picks == (greedy(c, len(c), 0) if len(c) <= r.k else greedy(c, r.k, gap))


def test_tau(spark):
    rows = spark.createDataFrame([(7200, 2.0, 8), (60, 2.0, 8), (10, 0.0, 8), (10, 2.0, 0)], "n int, fps double, k int")
    assert [r.t for r in rows.select(nms.auto_tau(F.col("n"), F.col("fps"), F.col("k")).alias("t")).collect()] == [10.0, 1.875, 0.0, 0.0]


def test_clusters_and_injection(spark):
    given = [(0, f) for f in (50, 51, 52, 100, 120, 141, 300)] + [(1, 7)]
    df = spark.createDataFrame(given, "video_id int, frame_idx int")
    got = sorted((r.video_id, r.frame_idx) for r in islands.clusters(df, ["video_id"], 20).collect())
    assert got == [(0, 51), (0, 120), (0, 141), (0, 300), (1, 7)]
    assert islands.pool_gap(200, 2.0, 8) == 12 and islands.pool_gap(200, 2.0, 8, 10.0) == 20
    scored = spark.createDataFrame([(0, 51, 0.2), (0, 9, 0.5)], "video_id int, frame_idx int, score double")
    out = {(r.frame_idx): (r.score, r.is_new) for r in islands.inject(scored, df.where("frame_idx in (51, 300)"), ["video_id"]).collect()}
    assert out == {51: (1.0, False), 9: (0.5, False), 300: (1.0, True)}


def test_text_segments(spark):
    rows = [(0, "Exit"), (1, "EXIT"), (2, " "), (3, "exit"), (20, "exit"), (21, "Go"), (22, "exit")]
    df = spark.createDataFrame([(1, f, t) for f, t in rows], "video_id int, frame_idx int, txt string")
    got = [(r.seg_id, r.text, r.start_frame, r.end_frame) for r in islands.text_segments(df, 2.0).orderBy("seg_id").collect()]
    assert got == [(0, "Exit", 0, 3), (1, "exit", 20, 20), (2, "Go", 21, 21), (3, "exit", 22, 22)]


def inverse(scores, k):
    n = len(scores)
    if n <= k:
        return list(range(n))
    s = np.array(scores)
    even = [int(x) for x in np.linspace(0, n - 1, k, dtype=int)]
    if s.max() == s.min():
        return even
    w = (s - s.min()) / (s.max() - s.min())
    at = np.clip(np.searchsorted(np.cumsum(w / w.sum()), np.linspace(1 / k, 1 - 1 / k, k)), 0, n - 1)
    own = sorted(set(map(int, at)))
    return own if len(own) == k else sorted({*own, *even})[:k]


@pytest.mark.parametrize("k", [1, 2, 8])
def test_inverse_cdf(spark, k):
    given = {v: c for v, c in curves(3).items() if c}
    got = {r.video_id: r.picks for r in sampling.inverse_cdf(table(spark, given), ["video_id"], k).collect()}
    assert got == {v: inverse(c, k) for v, c in given.items()}


def split(scores, k, t1, depth):
    n = len(scores)
    if n < k:
        return list(range(n))
    s = np.array(scores)
    s = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else s * 0
    picks, todo = [], [(0, n, 0)]
    while todo:
        a, b, d = todo.pop()
        if a == b:
            continue
        seg = s[a:b]
        best = sorted(range(b - a), key=lambda i: (-seg[i], i))
        if d == depth or np.mean(seg[best[:k]]) - seg.mean() > t1:
            picks += [a + i for i in best[: k // 2**d]]
        else:
            todo += [(a, a + (b - a) // 2, d + 1), (a + (b - a) // 2, b, d + 1)]
    even = [int(x) for x in np.linspace(0, n - 1, k, dtype=int)]
    own = sorted(set(picks))
    return own[:k] if len(own) >= k else sorted({*own, *even})[:k]


@pytest.mark.parametrize("k, t1", [(8, 0.8), (8, 0.3), (4, 0.5)])
def test_adaptive_split(spark, k, t1):
    given = {v: c for v, c in curves(4).items() if c}
    got = {r.video_id: r.picks for r in sampling.adaptive_split(table(spark, given), ["video_id"], k, t1=t1).collect()}
    depth = {8: 3, 4: 2}[k]
    assert got == {v: split(c, k, t1, depth) for v, c in given.items()}


def test_wavelet_inverts_and_selects():
    rng = np.random.default_rng(0)
    for n in (16, 33, 100, 257):
        x = rng.random(n)
        a, d = wavelet._down(x)
        assert np.allclose(wavelet._up(a, d)[:n], x)
        picks = wavelet.select(x, 8, rng.random((n, 4)))
        assert len(picks) == len(set(picks)) == 8 and picks == sorted(picks) and 0 <= picks[0] and picks[-1] < n
    assert wavelet.select(np.zeros(0), 8) == [] and wavelet.select(np.ones(5), 8) == list(range(5)) and len(wavelet.select(np.ones(50), 8)) <= 8


def test_peaks_against_definition():
    x = np.array([0, 3, 1, 2, 2, 1, 5, 0, 4, 3, 4, 0], float)
    assert wavelet.peaks(x, 0, 1, 0).tolist() == [1, 3, 6, 8, 10]
    assert wavelet.peaks(x, 0, 3, 0).tolist() == [1, 6, 10]
    assert wavelet.peaks(x, 2.5, 1, 3).tolist() == [1, 6, 8, 10] or wavelet.peaks(x, 2.5, 1, 3).tolist() == [6, 8, 10]


def test_box_suppression(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 0, 2, 1.0, 1.0, 11.0, 11.0, 0.8), (1, 1, 3, 0.0, 0.0, 10.0, 10.0, 0.7), (1, 0, 4, 10.0, 0.0, 20.0, 10.0, 0.6), (2, 0, 5, 3.0, 3.0, 3.0, 3.0, 0.5)]
    df = spark.createDataFrame(rows, "image_id int, label int, box_id int, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r.box_id for r in nms.box_nms(df, 0.5).collect()) == [1, 3, 4, 5]
