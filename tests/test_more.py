"""Importers, grids, relations, masks of questions, distributions, evidence, blind answers and arriving files."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from reelquery import models
from reelquery.functions import text as X
from reelquery.functions import times as T
from reelquery.operators import islands, metrics, nms, rank, sampling, search, vectors
from reelquery.plans import planner, retrieval
from reelquery.sources import importers, sinks, tables
from reelquery.streaming.arrivals import evaluate_arrivals


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_grids(spark):
    n = F.lit(9)
    got = one(spark, a=sampling.grid(F.lit(0), n, 4), b=sampling.grid(F.lit(0), n, 4, "round", False), c=sampling.grid(F.lit(2), n, 1), d=sampling.grid(F.lit(0), n, 0), e=sampling.grid(F.lit(0), F.lit(10), 5, "round"), f=sampling.grid(F.lit(0), n, 2))
    assert (got.a, got.b, got.c, got.d, got.e, got.f) == ([0, 3, 6, 9], [0, 2, 4, 7], [2], [], [0, 2, 5, 8, 10], [0, 9])
    g = one(spark, g=sampling.gaussian(F.lit(1.0), F.lit(0.0), F.lit(2.0)), s=sampling.sigmoid(F.lit(0.0)))
    assert abs(g.g - math.exp(-0.125) / (2 * math.sqrt(2 * math.pi))) < 1e-12 and g.s == 0.5


def test_times_and_texts(spark):
    got = one(spark, s=T.subsample_step(F.lit(30.0), F.lit(4.0)), n=T.subsampled(F.lit(10), F.lit(4)), p=T.relative_position(F.lit(5.0), F.lit(4.0)), h=T.hms(F.lit(3723.5)), k=X.letter_index(F.lit("C")), m=X.numbered(F.array(F.lit("a"), F.lit("b"))), t=X.seconds_label(F.lit(3)), j=islands.normal_text(F.array(F.lit(" a "), F.lit(" "), F.lit("b"))))
    assert (got.s, got.n, got.p, tuple(got.h), got.k, got.m, got.t, got.j) == (8, 3, 1.0, (1, 2, 3.5), 2, "1. a\n2. b", "3.0s", "a | b")
    assert islands.pool_gap(400, 2.0, 8) == 20 and islands.pool_gap(400, 2.0, 8, 1.5) == 3 and islands.pool_gap(40, 0, 8) == 0


def test_plan_replies_one_by_one(spark):
    good = '{"tool": "image", "query": "a", "id": "Q1"}'
    cases = [
        (f'{{"queries": [{good}, "x", 3, null, []], "combine": "Q1"}}', 1, 5, "Q1"),
        (f'{{"queries": [{good}]}} trailing {{}}', 0, 0, ""),
        (f'```json\n{{"queries": [{good}], "combine": "Q1"}}\n``` and {{broken', 1, 1, "Q1"),
        (f'```{{"queries": [{good}], "combine": "Q1"}}, {{}}```', 0, 0, ""),
        ('{"queries": {"tool": 1}, "combine": "Q1"}', 0, 0, "Q1"),
        ('{"queries": [{"tool": null, "query": 5, "id": "Q1"}], "combine": "Q1"}', 1, 1, "Q1"),
        ("[1, 2]", 0, 0, ""),
        (None, 0, 0, ""),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, reply string")
    r = F.col("reply")
    got = df.select("k", F.size(planner.parse_plan(r)["queries"]).alias("n"), planner.raw_query_count(r).alias("raw"), planner.parse_plan(r)["combine"].alias("c")).orderBy("k").collect()
    assert [(g.n, g.raw, g.c) for g in got] == [c[1:] for c in cases]
    asked = planner.plan(df.where("k = 0").withColumn("uid", F.lit("u")).withColumnRenamed("reply", "prompt"), "prompt", lambda ps: list(ps), ["region"]).first()
    assert asked.queries == [] and asked.combine == "Q1"
    p = one(spark, p=planner.planner_prompt(F.lit("why {tools}?"), F.create_map(*map(F.lit, "BxAy")), F.array(F.lit("image"), F.lit("region")), F.lit(12)), m=planner.message_text(F.array(F.struct(F.lit("text").alias("type"), F.lit("a").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("b").alias("text")))))
    assert "why {tools}?" in p.p and "12.0s" in p.p and "image, region" in p.p and p.p.index("B: x") < p.p.index("A: y") and p.m == "a"


def test_importers(spark, tmp_path):
    for name, content in (("a.npz", b"[[1, 2]]"), ("a.json", b"[[9, 9]]"), ("b.json", b"broken"), ("c.txt", b"[]")):
        (tmp_path / name).write_bytes(content)
    found = importers.files(spark, str(tmp_path), ("npz", "json"))
    frames = importers.import_frames(found, json.loads)
    assert [(r.video_id, r.frame_idx, r.emb) for r in frames.collect()] == [("a", 0, [1.0, 2.0])]
    assert [r.video_id for r in importers.failed(found, frames).collect()] == ["b"]
    plan = spark.createDataFrame([("a", [3, 4, 5])], "video_id string, frames array<int>")
    images = importers.decode_frames(found, plan, lambda raw, at: [str(i).encode() for i in at], chunk=2).collect()
    assert sorted((r.frame_idx, bytes(r.image)) for r in images) == [(0, b"3"), (1, b"4"), (2, b"5")]
    (tmp_path / "s" / "t").mkdir(parents=True)
    (tmp_path / "s" / "t" / "frame_12.jpg").write_bytes(b"x")
    keyed = tables.files_by_key(spark, str(tmp_path / "s")).first()
    assert (keyed.k1, keyed.k2, keyed.frame_idx) == ("s", "t", 12)
    items = spark.createDataFrame([("u", "a", "q", "A", 100.0), ("v", "b", "q", "B", 900.0)], "uid string, video_id string, question string, answer string, duration double")
    subs = spark.createDataFrame([("a", "hello")], "video_id string, text string")
    assert {r.uid: (r.n_frames, r.subtitles) for r in importers.input_modes(items, -1, subs).collect()} == {"u": (0, "hello"), "v": (0, "")}
    assert {r.subtitles for r in importers.input_modes(items, 0, subs).collect()} == {None}
    short, long = importers.regroup(items)
    assert ([r.video_id for r in short.collect()], [r.video_id for r in long.collect()]) == (["a"], ["b"])
    a, b = importers.common_keys(items, subs.withColumn("x", F.lit(1)), ["video_id"])
    assert [r.uid for r in a.collect()] == ["u"] and b.count() == 1
    letters = spark.createDataFrame([("a", "q", 2, "x"), ("a", "q", 1, "L-cat"), ("a", None, 0, "x")], "video_id string, question string, answer int, category string")
    assert [r.answer for r in tables.letters_for_answers(letters, "L").collect()] == ["C"]
    assert tables.zip_columns(spark.createDataFrame([([1, 2], ["x", "y"])], "a array<int>, b array<string>"), ["a", "b"]).count() == 2
    clips = spark.createDataFrame([("a", "c1", 0.12345, 2.0), ("a", "c1", 0.12345, 2.0), ("a", "c2", 1.0, 2.0)], "video_id string, clip_uid string, start double, end double")
    assert [(r.clip_uid, r.start) for r in tables.clips_to_cut(clips, clips.where("clip_uid = 'c2'").select("clip_uid")).collect()] == [("c1", 0.123)]
    texts = spark.createDataFrame([(i, t) for i in (1, 2) for t in "abcd"], "image_id int, text string")
    assert tables.sample_texts(texts, 3).groupBy("image_id").count().where("count = 3").count() == 2
    path = str(tmp_path / "out")
    sinks.write_results(items, path)
    assert spark.read.parquet(path).count() == 2
    kept = sinks.keyframes(items.withColumn("options", F.lit(None).cast("map<string,string>")), spark.createDataFrame([("u", [4, 2])], "uid string, picks array<int>")).first()
    assert kept.frames_used == [2, 4] and kept.timestamps_used == [1.0, 2.0]


def test_relations_and_scores(spark):
    seen = spark.createDataFrame([("u", 0, 10, "cup"), ("u", 1, 12, "hand"), ("u", 2, 30, "hand")], "uid string, place int, frame_idx int, name string")
    rel = spark.createDataFrame([("u", "cup", "hand", "time"), ("u", "cup", "hand", "causal"), ("u", "hand", "cup", "causal")], "uid string, a string, b string, type string")
    got = {(r["type"], r["first"], r["second"]) for r in search.timed_pairs(seen, rel).collect()}
    assert got == {("time", 10, 12), ("causal", 10, 12), ("causal", 10, 30)}
    pairs = spark.createDataFrame([("u", 0, 0, 0.9), ("u", 0, 1, 0.1), ("u", 1, 0, 0.3), ("u", 1, 1, 0.2)], "uid string, i int, j int, sim double")
    r = metrics.image_scores(pairs).first()
    assert abs(r.recall - 0.6) < 1e-9 and abs(r.precision - 0.55) < 1e-9
    corr = spark.createDataFrame([("u", 0, 2, 0.5), ("u", 1, 2, 0.9), ("u", 2, 2, 0.1)], "uid string, i int, n_truth int, corr double")
    assert abs(metrics.correlation_score(corr).first().scc - 0.7) < 1e-9
    w = one(spark, a=metrics.shift_filter(F.array(F.lit(0.5), F.lit(1.0))), b=metrics.shift_filter(F.array(F.lit(0.4), F.lit(1.0))))
    assert w.a and not w.b
    assert spark.createDataFrame([(1.0, 2.0)], "x double, y double").select(metrics.weighted({"x": 0.5, "y": 2.0}).alias("r")).first().r == 4.5
    cells = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "image int, cell int, feat array<double>")
    masks = spark.createDataFrame([(1, 7, 0, 3.0), (1, 7, 1, 1.0)], "image int, region int, cell int, weight double")
    assert vectors.pool_masked(cells, masks).first().feat == [0.75, 0.25]
    box = lambda *v: [F.lit(float(x)) for x in v]
    o = one(spark, o=nms.overlap_of_smaller(box(0, 0, 9, 9), box(5, 0, 9, 9)), i=nms.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)))
    assert (o.o, o.i) == (1.0, 0.0)
    boxes = spark.createDataFrame([(10.0, 20.0, 1.0, 2.0, 3.0, 4.0)], "px double, py double, dl double, dt double, dr double, db double")
    assert tuple(nms.decode_centre(boxes, F.lit(8.0)).select("x1", "y1", "x2", "y2").first()) == (2.0, 4.0, 34.0, 52.0)
    up = one(spark, u=rank.neighbour_boost(F.array(*(F.lit(float(x)) for x in (0, 0, 9, 0, 4))), F.array(F.lit(2)), 1), q=rank.top_quarter(F.array(*map(F.lit, [3, 5, 7, 9])), F.array(*map(F.lit, [0.1, 0.9, 0.2, 0.3]))))
    assert up.u == [0.0, 4.5, 9.0, 4.5, 4.0] and up.q == [5]


def test_box_suppression_matches_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), int(i % 2), i, float(x), float(y), float(x + 5 + w), float(y + 5 + h), round(float(s), 1)) for i, (x, y, w, h, s) in enumerate(rng.random((200, 5)) * [20, 20, 5, 5, 1])]
    want = set()
    for image in range(3):
        for label in range(2):
            kept = []
            for r in sorted((r for r in rows if r[:2] == (image, label) and r[7] > 0.2), key=lambda r: (-r[7], r[2])):
                def iou(a, b):
                    both = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
                    return both / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - both)
                if len(kept) < 9 and all(iou(r, k) <= 0.3 for k in kept):
                    kept.append(r)
            want |= {r[2] for r in kept}
    df = spark.createDataFrame(rows, "image_id int, label int, box_id int, x1 double, y1 double, x2 double, y2 double, score double")
    assert {r.box_id for r in nms.box_nms(df, 0.3, 0.2, per_class=9).collect()} == want
    assert nms.box_nms(df.limit(0)).count() == 0


def test_evidence_and_blind_answers(spark):
    encoder = models.hashed_encoder(8)
    rng = np.random.default_rng(0)
    frames = spark.createDataFrame([("v", i, rng.standard_normal(8).tolist()) for i in range(60)] + [("w", i, rng.standard_normal(8).tolist()) for i in range(10)], "video_id string, frame_idx int, emb array<double>")
    items = spark.createDataFrame([("a", "v", "what?"), ("b", "w", "who?"), ("c", "v", "why?")], "uid string, video_id string, question string").withColumn("options", F.create_map(*map(F.lit, "BxAy")))
    plans = spark.createDataFrame([("a", [("image", "cup", "Q1")], "Q1"), ("b", [("none", "x", "Q1")], "Q1"), ("c", [], "")], "uid string, queries array<struct<tool:string,query:string,id:string>>, combine string")
    got = {r.uid: r for r in retrieval.evidence(items, plans, frames, encoder, k=5).collect()}
    assert got["a"].found and len(got["a"].frames_used) == 5 and got["b"].frames_used == got["c"].frames_used == [] and not got["b"].found
    got = {r.uid: r for r in retrieval.evidence(items, plans, frames, encoder, k=5, fallback=3).collect()}
    assert got["b"].frames_used == [0, 4, 9] and got["c"].timestamps_used == [0.0, 14.5, 29.5]
    # a size that isn't a pool's gets a gap of its own: 60 frames at 2 a second, K = 5 -> 3 s -> 6 frames
    out = {r.uid: r for r in retrieval.retrieve(items, plans, frames, encoder, k=5).collect()}
    f = out["a"].frames_used
    assert set(out["a"].pools) == {8, 16, 32, 64} and min(y - x for x, y in zip(f, f[1:], strict=False)) >= 6
    replies = retrieval.blind(items, lambda ps: ["A" if "who" in p else "zzz" for p in ps]).collect()
    assert {r.uid: r.answer for r in replies} == {"a": None, "b": "A", "c": None}
    regions = spark.createDataFrame([(b"ab",), (b"",)], "image binary").select(models.encode_regions(F.col("image"), lambda images: [np.ones((len(i), 3)) for i in images]).alias("r")).collect()
    assert [len(r.r) for r in regions] == [2, 0]
    plans = plans.withColumn("uid", F.lit("a"))
    calls = retrieval.evaluate_once(plans.union(plans), lambda p: p.select("uid", "key", F.size("queries").alias("n")))
    assert sorted(r.n for r in calls.collect()) == [0, 0, 1, 1, 1, 1]


def test_arriving_files_are_evaluated_once(spark, tmp_path):
    source, results, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def evaluate(batch):
        return batch.select("uid", (F.col("n") * 2).alias("twice"))

    def add(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
        evaluate_arrivals(spark, source, "uid string, n int", evaluate, results, checkpoint).awaitTermination(120)
        return sorted((r.uid, r.twice) for r in spark.read.parquet(results).collect())

    assert add("1.json", [{"uid": "a", "n": 1}, {"uid": "a", "n": 1}]) == [("a", 2)]
    assert add("2.json", [{"uid": "a", "n": 9}, {"uid": "b", "n": 2}]) == [("a", 2), ("b", 4)]
