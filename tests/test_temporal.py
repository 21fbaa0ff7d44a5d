"""Joins in time against plain loops, and the plans they run as."""

import random

import pytest
from pyspark.sql import functions as F

from reelquery.operators import temporal


def plan(df):
    df.collect()  # adaptive execution shows its last plan
    return df._jdf.queryExecution().executedPlan().toString()


def pairs(spark, seed, n, items=5, span=40):
    rng = random.Random(seed)
    return [(f"u{rng.randrange(items)}", float(rng.randrange(span)) / 2) for _ in range(n)]


def by_key(rows):
    out = {}
    for k, t in rows:
        out.setdefault(k, []).append(t)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_against_all_pairs(spark, seed):
    one, two = pairs(spark, seed, 60), pairs(spark, seed + 50, 40)
    a, b = by_key(one), by_key(two)
    df = lambda rows: spark.createDataFrame([*rows, (None, 1.0), ("u0", None), ("lonely", 3.0)] if rows is one else rows, "uid string, t double")
    truth, pred = df(one), df(two)
    both = sorted(a.keys() & b.keys())
    gap = lambda x, ys: min(abs(x - y) for y in ys)
    got = {r.uid: r for r in temporal.annd(truth, pred).collect()}
    assert sorted(got) == both
    for k in both:
        to_pred, to_truth = sum(gap(x, b[k]) for x in a[k]) / len(a[k]), sum(gap(y, a[k]) for y in b[k]) / len(b[k])
        assert got[k].to_pred == pytest.approx(to_pred) and got[k].to_truth == pytest.approx(to_truth)
    got = {r.uid: r for r in temporal.prf(truth, pred, 0.5).collect()}
    covered = {r.uid: r for r in temporal.prf_covered(truth, pred, 0.5).collect()}
    for k in both:
        r, p = sum(gap(x, b[k]) <= 0.5 for x in a[k]), sum(gap(y, a[k]) <= 0.5 for y in b[k])
        assert (got[k].recall, got[k].precision) == (pytest.approx(r / len(a[k])), pytest.approx(p / len(b[k])))
        assert covered[k].covered == r and covered[k].precision == pytest.approx(r / len(b[k]))


def test_nearest_has_one_exchange(spark):
    rows = spark.createDataFrame(pairs(spark, 4, 30), "uid string, t double")
    text = plan(temporal.prf(rows, rows, 1.0))
    final = text.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in final and "NestedLoop" not in final


def test_equal_times_and_sides_that_are_missing(spark):
    rows = spark.createDataFrame([("a", True, 1.0), ("a", False, 1.0), ("a", False, 9.0), ("b", True, 2.0)], "k string, side boolean, t double")
    got = sorted((r.k, r.side, r.t, r.gap) for r in temporal.nearest_gaps(rows, ["k"]).collect())
    assert got == [("a", False, 1.0, 0.0), ("a", False, 9.0, 8.0), ("a", True, 1.0, 0.0), ("b", True, 2.0, None)]


SPANS = [(0.0, 10.0), (10.0, 10.0), (9.99, 10.01), (3.0, 95.0), (20.0, 19.0), (-7.5, -2.5), (29.0, 30.0), (30.0, 31.0), (30.0, 60.0), (30.0, 60.0)]


@pytest.mark.parametrize("width", [0.7, 10.0, 1000.0])
@pytest.mark.parametrize("strict", [True, False])
def test_points_in_intervals(spark, width, strict):
    points = [(k, i, t) for i, t in enumerate([-7.5, -3.0, 0.0, 9.995, 10.0, 30.0, 59.0, 60.0, 95.0, 200.0]) for k in "ab"]
    spans = [("a", i, s, e) for i, (s, e) in enumerate(SPANS)] + [("b", 0, 0.0, 60.0), ("b", 1, None, 5.0)]
    got = temporal.holding(spark.createDataFrame(points, "k string, p int, t double"), spark.createDataFrame(spans, "k string, i int, start double, end double"), ["k"], width, strict)
    want = sorted((k, p, i) for k, p, t in points for j, i, s, e in spans if k == j and s is not None and s <= e and (s < t < e if strict else s <= t <= e))
    assert sorted((r.k, r.p, r.i) for r in got.collect()) == want


@pytest.mark.parametrize("width", [0.7, 10.0, 1000.0])
@pytest.mark.parametrize("touching", [True, False])
def test_overlapping_intervals_come_once(spark, width, touching):
    one = [("a", i, s, e) for i, (s, e) in enumerate(SPANS)]
    a = spark.createDataFrame(one, "k string, i int, start double, end double")
    b = a.select("k", F.col("i").alias("j"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    got = sorted((r.i, r.j) for r in temporal.overlapping(a, b, ["k"], width, touching).collect())
    meet = lambda s, e, u, v: s <= v and u <= e if touching else s < v and u < e
    assert got == sorted((i, j) for _, i, s, e in one for _, j, u, v in one if s <= e and u <= v and meet(s, e, u, v))


def test_interval_join_goes_by_key_and_bin(spark):
    p = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("t"))
    i = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 5.0).alias("start"), (F.col("id") * 5.0 + 3).alias("end"))
    text = temporal.holding(p, i.hint("merge"), ["k"], 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in text and "__bin#" in text.split("hashpartitioning(")[1].split(")")[0]


def test_interleave_follows_the_given_order(spark):
    frames = spark.createDataFrame([("v", k, k * 1.0) for k in range(6)] + [("w", 0, 0.0)], "video_id string, frame_idx int, t double")
    said = [("v", 0, 0.2, 2.4, "first"), ("v", 1, 3.0, 3.2, "short"), ("v", 2, 1.1, 1.9, "between frames"), ("v", 3, 0.5, 1.5, "late"), ("v", 4, 5.0, 5.0, "at a frame"), ("w", 0, 0.0, 2.0, "not strictly inside"), ("x", 0, 0.0, 1.0, "no frames")]
    subs = spark.createDataFrame(said, "video_id string, ordinal int, start double, end double, text string")
    got = [(r.video_id, r.value) for r in temporal.interleave(frames, subs, width=0.5).orderBy("video_id", "place").collect()]
    assert got == [("v", x) for x in ("0", "1", "first", "2", "3", "short", "late", "4", "5", "at a frame")] + [("w", "0")]


def test_hits_of_many_intervals(spark):
    picks = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 7.0), ("b", 2.0)], "uid string, t double")
    truth = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 6.0, 6.5), ("a", 2, 0.0, 1.0), ("c", 3, 0.0, 9.0)], "uid string, n int, start_s double, end_s double")
    got = {r.n: r.n_inside for r in temporal.interval_hits(picks, truth, margin=0.5).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 0}
