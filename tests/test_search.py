"""The relation-guided search in rounds against a plain loop over each video."""

import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle

from reelquery import catalog
from reelquery.operators import search

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SF = "/root/testdata/sf0.001"
BOX = (0.0, 0.0, 4.0, 4.0)


def grid(video, frames, names):
    salt = zlib.crc32(video.encode()) % 7
    return [[(name, 0.3 + 0.05 * ((f * 3 + i + salt) % 13), BOX) for i, name in enumerate(names) if (f + salt) % (2 + i) == 0] for f in frames]


def single(video, frames, names):
    return [[(name, 0.2 + 0.08 * ((f + i) % 11), BOX) for i, name in enumerate(names) if f % (3 + i) != 1] for f in frames]


def plain_search(video, n, targets, cues, relations, k, ratio, update, detect, alone, threshold=0.5, side=4):
    """One video, round by round, as written down: sample, score, spread, look again at each frame that shows a target."""
    rng = np.random.RandomState((2025 ^ zlib.crc32(video.encode())) & 0x7FFFFFFF)
    score, visited, p = np.zeros(n), np.zeros(n, bool), np.full(n, 1 / max(n, 1))
    left, missing, met, names, begun = min(1000, n * ratio), list(targets), set(), [*targets, *cues], False
    best = lambda one: max([0.0, *(c * (1.0 if name in targets else 0.5) for name, c, _ in one)])
    while left > 0 and n and (missing or len(met) < len(relations)) and not visited.all():
        if not begun:
            frames = sorted({int(i) for i in np.linspace(0, n - 1, min(side * side, n))})
        else:
            q = (p + k / n) * ~visited
            q = np.where(q >= np.quantile(q, 0.75), q, 0)
            frames = sorted(rng.choice(n, min(side * side, n, int((q > 0).sum())), replace=False, p=q / q.sum()).tolist())
        begun, left = True, left - side * side
        visited[frames] = True
        found = [detect(video, [f], names)[0] for f in frames]
        bonus = search.relation_bonus(frames, [{x: b for x, _, b in one} for one in found], relations, met)
        now = np.array([best(one) for one in found]) + bonus
        score[frames] = now
        for f in [f for f, c in zip(frames, now) if c >= np.percentile(now, 75)]:
            for g in range(max(0, f - 5), min(n, f + 6)):
                score[g] = max(score[g], score[f] / (abs(g - f) + 1))
        p = search.UPDATES[update](score, np.flatnonzero(visited))
        for f, one in zip(frames, found):
            for t in list(missing):
                if t in [x for x, _, _ in one]:
                    close = alone(video, [f], names)[0]
                    score[f] = best(close)
                    if t in [x for x, _, _ in close] and score[f] > threshold:
                        missing.remove(t)
                        break
    return sorted(np.lexsort((np.arange(n), -score))[:k].tolist()), score.tolist()


VIDEOS = [("u1", "v1", 100, ["cup", "lamp"], ["hand"], [("cup", "hand", "time")]), ("u2", "v2", 7, ["cup"], [], []), ("u3", "v3", 0, ["cup"], ["hand"], []), ("u4", "v4", 333, ["cup", "lamp", "dog"], ["hand", "sky"], [("cup", "sky", "spatial"), ("dog", "hand", "causal")]), ("u5", "v5", 60, [], ["hand"], [("hand", "hand", "attribute")]), ("u6", "v6", 50, ["never"], [], [])]
SCHEMA = "uid string, video_id string, n int, targets array<string>, cues array<string>, relations array<struct<a:string,b:string,type:string>>"


@pytest.mark.parametrize("update", ["spline", "gaussian"])
@pytest.mark.parametrize("at_once", [1, 64])
def test_rounds_give_what_a_plain_loop_gives(spark, update, at_once):
    many = lambda f: lambda requests: [f(*r) for r in requests]
    videos = spark.createDataFrame(VIDEOS, SCHEMA)
    got = {r.uid: (r.picks, r.scores) for r in search.search_rounds(videos, many(grid), many(single), 6, 1.0, update, at_once).collect()}
    own = {r.uid: (r.picks, r.scores) for r in search.relation_search(videos, grid, 6, 1.0, update, single).collect()}
    assert got.keys() == own.keys() == {v[0] for v in VIDEOS}
    for uid, video, n, targets, cues, relations in VIDEOS:
        picks, scores = plain_search(video, n, targets, cues, relations, 6, 1.0, update, grid, single)
        assert got[uid][0] == own[uid][0] == picks
        assert np.allclose(got[uid][1], scores, atol=1e-12) and np.allclose(own[uid][1], scores, atol=1e-12)


def test_a_round_makes_one_call_for_all_open_videos():
    """Second looks of a round come in one call, and only for frames that show a target which is still missing."""
    s = search.Search("v", 40, search.Grounding(["cup", "lamp"], [], []), 4)
    frames = s.sample()
    again = s.absorb(frames, [[("cup", 0.6, BOX)] if k < 3 else [] for k in range(len(frames))])
    assert again == frames[:3]
    s.confirm(again, [[("cup", 0.4, BOX)], [("cup", 0.7, BOX)], [("cup", 0.9, BOX)]])
    assert s.missing == ["lamp"] and s.score[frames[0]] == 0.4 and s.score[frames[1]] == 0.7
    assert s.score[frames[2]] != 0.9  # the target was confirmed before


def test_registered_searches_match_plain_loops(spark):
    n = {r.video_id: r["count"] for r in catalog.P.frames(spark, SF).groupBy("video_id").count().collect()}
    relation = [("cup", "hand", "time")]
    close = lambda *r: catalog._stand_in_close_look([r])[0]
    found = {}
    for r in catalog.queries()["search_in_rounds"](spark, SF).collect():
        found.setdefault(r.uid, {})[r.frame_idx] = r.score
    picks = {}
    for r in catalog.queries()["relation_search"](spark, SF).collect():
        picks.setdefault(r.uid, []).append(r.frame_idx)
    for v, size in n.items():
        _, scores = plain_search(str(v), size, ["cup"], ["hand"], relation, 8, 0.5, "spline", catalog._stand_in_detector, close)
        assert np.allclose([found[str(v)][k] for k in range(size)], scores, atol=2e-6)
        own, _ = plain_search(str(v), size, ["cup"], ["hand"], relation, 8, 0.5, "spline", catalog._stand_in_detector, catalog._stand_in_detector)
        assert sorted(picks[str(v)]) == own
