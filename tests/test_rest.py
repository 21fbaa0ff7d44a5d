"""Tracks, metrics, texts, times, sources, sinks, models and configuration."""

import json

import numpy as np
from pyspark.sql import functions as F

from reelquery import config, models
from reelquery.functions import text as X
from reelquery.functions import times as T
from reelquery.operators import metrics, search, tracks
from reelquery.sources import sinks, tables


def test_tracks():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    got = tracks.link_tracks([(0, np.array([a, b])), (1, np.array([b, a])), (3, np.array([a]))])
    assert [t["members"] for t in got] == [[(0, 0), (1, 1)], [(0, 1), (1, 0)], [(3, 0)]]
    assert tracks.labels_of(6, [(0, 1), (1, 2), (4, 5)]) == [0, 0, 0, 3, 4, 4] and tracks.labels_of(0, []) == []


def test_metrics(spark):
    rows = spark.createDataFrame([("a", [0.0, 10.0], [1.0, 30.0]), ("b", [5.0], []), ("c", [5.0], [5.0])], "uid string, gt array<double>, pred array<double>")
    got = {r.uid: (r.precision, r.recall, r.f1) for r in metrics.prf(rows, 2.0).collect()}
    assert got == {"a": (0.5, 0.5, 0.5), "c": (1.0, 1.0, 1.0)}
    assert {r.uid: r.annd for r in metrics.annd(rows).collect()} == {"a": (5.0 + 10.5) / 2, "c": 0.0}
    assert metrics.accuracy(spark.createDataFrame([], "answer string, gold string")).first().accuracy == 0
    assert metrics.accuracy(spark.createDataFrame([(None, None), ("A", "B")], "answer string, gold string")).first().accuracy == 0.5
    img = np.random.default_rng(0).random((16, 16))
    assert abs(metrics.ssim(img, img) - 1) < 1e-9 and metrics.ssim(img, 1 - img) < 0.5
    truth = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("c", 0.0, 0.0)], "uid string, start_s double, end_s double")
    # a record without frames misses, an item without a record doesn't count, a record without an item neither
    picks = spark.createDataFrame([("a", [0.0, 2.0]), ("b", [2.5]), ("z", [1.0]), ("d", [])], "uid string, times array<double>")
    more = truth.union(spark.createDataFrame([("d", 0.0, 9.0)], truth.schema))
    hits = metrics.hit_at_k(picks, more)
    assert {r.uid: r.hit for r in hits.collect()} == {"a": True, "b": False, "d": False}
    assert {r.uid: r.hit for r in metrics.hit_at_k(picks, more, margin=0.5).collect()}["b"]
    assert tuple(metrics.hit_summary(hits).first()) == (3, 1, 0.3333, 2)
    assert tuple(metrics.hit_summary(hits.limit(0)).first()) == (0, 0, 0.0, 0)
    counts = metrics.detection_counts(spark.createDataFrame([("a", [1, 2]), ("a", None), ("b", [])], "g string, x array<int>"), ["g"], "x")
    assert {r.g: (r.n_rows, r.n_elements) for r in counts.collect()} == {"a": (2, 2), "b": (1, 0)}


def test_texts(spark):
    row = spark.createDataFrame([("A cat (C)", {"B": "y", "A": "x"}, "1. NO\n2: yes\n2) NO\nfoo", "A) one\nB. two")], "reply string, options map<string,string>, judge string, opts string")
    got = row.select(X.parse_answer(F.col("reply"), F.col("options")).alias("a"), X.judge_votes(F.col("judge"), F.lit(3)).alias("v"), X.options_of_text(F.col("opts")).alias("o"), X.format_options(F.col("options"), "bracket").alias("f"), X.retrieval_query(F.lit("q"), F.col("options")).alias("q")).first()
    assert (got.a, got.v, got.o, got.f, got.q) == ("A", [False, False, True], {"A": "one", "B": "two"}, "A) x\nB) y", "q x y")
    size = spark.range(1).select(X.resize(F.lit(1000), F.lit(700)).alias("s"), X.item_uid(F.lit(""), F.lit("7")).alias("u")).first()
    assert (size.s.h, size.s.w, size.u) == (1008, 700, "7")


def test_times(spark):
    rows = spark.createDataFrame([("01:02:03.5",), ("02:03",), ("12.5",), ("soon",), (None,), ("1:x:3",)], "t string")
    assert [r[0] for r in rows.select(T.parse_clock(F.col("t"), (2, 3))).collect()] == [3723.5, 123.0, 12.5, None, None, None]
    assert [r[0] for r in rows.select(T.parse_clock(F.col("t"))).collect()][1] is None
    one = spark.range(1).select(T.cached_frames(F.lit(100), F.lit(30.0)).alias("n"), T.native_frame(F.lit(3), F.lit(100), F.lit(29.97)).alias("f"), T.fraction(F.lit("30000/1001")).alias("r"), T.rescale_frames(F.array(F.lit(5), F.lit(4), F.lit(4)), F.lit(None).cast("double"), F.lit(1.0)).alias("z")).first()
    assert (one.n, one.f, round(one.r, 3), one.z) == (6, 44, 29.97, [2])


def test_sources_and_sinks(spark, tmp_path):
    items = [{"question_id": "q1", "video_id": "v", "question": "?", "options": {"A": "x"}, "answer": "A"}, {"uid": "u2", "video_id": "w"}, {"uid": "u3", "video_id": "v"}]
    (tmp_path / "a.json").write_text(json.dumps(items))
    got = tables.read_items(spark, str(tmp_path / "a.json"), 0, 2).orderBy("ordinal").collect()
    assert [r.uid for r in got] == ["q1", "u2"] and got[0].options == {"A": "x"}
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"uid": "t", "video_id": "v", "choices": ["x", "y"], "clip_start": 1.0}]}))
    got = tables.read_training_items(spark, str(tmp_path / "b.json")).collect()
    assert got[0].options == {"A": "x", "B": "y"} and got[0].clip_start == 1.0
    df = spark.createDataFrame([("v", 1), ("w", 2)], "video_id string, n int")
    path = str(tmp_path / "cache")
    assert sinks.write_cache(df, path).count() == 2
    assert sinks.write_cache(df.union(spark.createDataFrame([("x", 3)], df.schema)), path).count() == 3
    assert tables.prior_results(spark, str(tmp_path / "none"), "uid string").count() == 0
    assert len(sinks.manifest(spark, {"b": 1, "a": 2}).first().config_sha256) == 64
    log = sinks.completion_log(spark.createDataFrame([(1, ["a", "b"], [0.5], [1.0, 2.0])], "step int, completions array<string>, rewards array<double>, advantages array<double>"))
    assert [(r.place, r.rewards) for r in log.orderBy("place").collect()] == [(0, 0.5), (1, None)]
    frames = spark.createDataFrame([("v", 0, 0.0), ("v", 1, 1.0), ("v", 2, 2.0)], "video_id string, frame_idx int, t double")
    subs = spark.createDataFrame([("v", 0.5, 1.6, "hi"), ("v", 1.0, 1.0, "no")], "video_id string, start double, end double, text string")
    assert [(r.at, r.value) for r in tables.interleave(frames, subs).orderBy("at", "kind").collect()] == [(0.0, "0"), (1.0, "1"), (1.05, "hi"), (2.0, "2")]


def test_models(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "p string")
    calls = []
    assert [r.r for r in models.ask_once(df, "p", "r", lambda ps: [p.upper() for p in ps]).orderBy("p").collect()] == ["A", "A", "B"]
    v = [r.v for r in df.select(models.encode(F.col("p"), models.hashed_encoder(8)).alias("v")).collect()]
    assert v[0] == v[2] != v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-5

    def flaky(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return prompts

    assert models.with_retries(flaky, base=0.0)(["x"]) == ["x"] and len(calls) == 3
    st = spark.createDataFrame([(0, 0, 0, {"A": "x"}), (1, 0, 0, {"A": "x"}), (1, 1, 0, {"A": "x"}), (1, 1, 1, {}), (1, 1, 1, {"A": "x"})], "q int, s int, f int, o map<string,string>")
    assert [r[0] for r in st.select(models.status(F.col("q"), F.col("s"), F.col("f"), F.col("o"))).collect()] == ["no_queries", "no_scores", "no_frames", "retrieval_only", "answered"]


def test_answers_follow_the_options(spark):
    options = F.create_map(*map(F.lit, "BxAy"))
    cases = {"B or A": "B", "A or B": "B", "Zebra": None, "  a cat": "A", "nothing": None, "": None, "(A)": "A", "ABBA": "A", "\n\tbig": "B"}
    df = spark.createDataFrame([(k,) for k in cases], "reply string").withColumn("options", options)
    assert {r.reply: r.a for r in df.select("reply", X.parse_answer(F.col("reply"), F.col("options")).alias("a")).collect()} == cases
    one = df.limit(1).select(X.format_options(F.col("options")).alias("c"), X.format_options(F.col("options"), "bracket").alias("b"), X.answer_prompt(F.lit("Q {options}?"), F.col("options"), "letters").alias("p")).first()
    assert (one.c, one.b) == ("  B: x\n  A: y", "A) y\nB) x")
    assert "Question: Q {options}?\n" in one.p and "A) y\nB) x" in one.p and "out of B, A " in one.p
    kept = spark.createDataFrame([("a subtitle", "t"), ("plain", "t"), ("plain", "skip"), (None, "t"), ("plain", None)], "q string, task string")
    assert [r.k for r in kept.select(X.keep_question(F.col("q"), F.col("task"), skip_tasks=("skip",)).alias("k")).collect()] == [False, True, False, False, True]


def test_curves_and_similarity(spark):
    from reelquery.operators import metrics as M

    v = [0.0, 1.0, 4.0, 9.0, 16.0, 25.0, 36.0]
    df = spark.createDataFrame([(v,), ([1.0, 2.0],), ([0.0, 0.0, 35.0, 0.0, 0.0],)], "v array<double>")
    got = [r.s for r in df.select(M.smooth_curve(F.col("v")).alias("s")).collect()]
    assert np.allclose(got[0], v) and got[1] == [1.0, 2.0] and abs(got[2][2] - 17) < 1e-9
    rng = np.random.default_rng(1)
    a, b = rng.random((5, 8, 6)), rng.random((5, 8, 6))
    assert np.allclose(M.ssim(a, b), [M.ssim(x, y) for x, y in zip(a, b, strict=True)])
    rows = spark.createDataFrame([(a[0].ravel().tolist(), b[0].ravel().tolist(), 6), (a[1].ravel().tolist(), a[1].ravel().tolist(), 6), ([0.5] * 16, [0.5] * 16, 4)], "a array<double>, b array<double>, w int")
    out = [r.s for r in rows.select(M.image_ssim(F.col("a"), F.col("b"), F.col("w")).alias("s")).collect()]
    assert np.allclose(out, [M.ssim(a[0], b[0]), 1.0, 1.0])


def test_numbers_follow_the_order(spark):
    from reelquery.operators.rank import numbered

    rng = np.random.default_rng(2)
    values = sorted({int(x) for x in rng.integers(-200000, 200000, 500)})
    got = {r.k: r.n for r in numbered(spark.createDataFrame([(v,) for v in values], "k long"), ["k"], "n").collect()}
    assert [got[v] for v in values] == list(range(len(values)))
    texts = sorted({"".join(rng.choice(list("ab"), rng.integers(0, 6))) for _ in range(40)})
    got = {r.k: r.n for r in numbered(spark.createDataFrame([(t,) for t in texts], "k string"), ["k"], "n").collect()}
    assert [got[t] for t in texts] == list(range(len(texts)))


def test_joins_of_runs_and_questions(spark):
    items = spark.createDataFrame([("q", 1, "old"), ("q", 2, "new"), (None, 3, "x")], "question string, ordinal int, task string")
    asked = spark.createDataFrame([("q", 7), ("r", 8), (None, 9)], "question string, pred int")
    assert [(r.pred, r.task) for r in tables.join_by_question(asked, items).collect()] == [(7, "new")]
    runs = [spark.createDataFrame([("a", 0, 1), ("a", 1, 2)], "uid string, ordinal int, x int"), spark.createDataFrame([("a", 0, 3), ("b", 0, 4)], "uid string, ordinal int, x int")]
    assert sorted((r.uid, r.x) for r in tables.union_runs(runs).collect()) == [("a", 1), ("b", 4)]


def test_grid_of_records_goes_on(spark, tmp_path):
    truth = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 1.0)], "uid string, start_s double, end_s double")
    records = lambda rows: spark.createDataFrame(rows, "uid string, method string, k int, times array<double>")
    path = str(tmp_path / "grid")
    assert [tuple(r) for r in sinks.write_grid(records([("a", "m", 8, [0.5])]), truth, path).collect()] == [("m", 8, 1, 1, 1.0)]
    again = records([("a", "m", 8, [9.0]), ("b", "m", 8, [9.0])])
    assert [tuple(r) for r in sinks.write_grid(again, truth, path).collect()] == [("m", 8, 1, 2, 0.5)]
    assert spark.read.parquet(path).count() == 2


def test_head_boxes(spark):
    from reelquery.operators import nms

    rows = spark.createDataFrame([(1, 0, [0.9, 0.8], 0.5), (1, 1, [0.2, 0.6], None), (1, 2, [0.0, 0.0], 1.0)], "image_id int, prior int, classes array<double>, objectness double")
    out = sorted((r.prior, r.label, r.score) for r in nms.head_boxes(rows).collect())
    assert out == [(0, 0, 0.45), (0, 1, 0.4), (1, 0, 0.2), (1, 1, 0.6)]
    assert sorted((r.prior, r.label) for r in nms.head_boxes(rows, multi_label=False).collect()) == [(0, 0), (1, 1)]
    assert sorted((r.prior, r.label) for r in nms.head_boxes(rows, pre=1).collect()) == [(1, 1)]


def test_models_get_batches_of_bounded_size(spark):
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for key in keys:
            spark.conf.unset(key)
        rows = spark.range(0, 3000, 1, 1).select(F.when(F.col("id") < 100, F.repeat(F.lit("x"), 1 << 18)).otherwise("y").alias("p"))

        def model(prompts):
            return [f"{len(prompts)} {sum(map(len, prompts))}"] * len(prompts)

        def encoder(values):
            return np.array([[len(values), sum(map(len, values))]] * len(values), float)

        got = [tuple(map(int, r.r.split())) for r in rows.select(models.ask(F.col("p"), model).alias("r")).collect()] + [tuple(r.v) for r in rows.select(models.encode(F.col("p"), encoder).alias("v")).collect()]
        assert len(got) == 6000 and all(n <= models.BATCH_ROWS and size <= models.BATCH_BYTES + (1 << 18) for n, size in got)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_judge_takes_each_text_once(spark):
    from reelquery.operators import islands

    segs = spark.createDataFrame([("v", 0, "Exit"), ("v", 1, "stop"), ("v", 2, "EXIT"), ("w", 0, "fail")], "video_id string, seg_id long, text string")
    questions = spark.createDataFrame([("u", "v", "?"), ("t", "w", "?")], "uid string, video_id string, question string")

    def model(prompts):
        if "fail" in prompts[0]:
            raise RuntimeError
        return ["2. NO" for _ in prompts]

    assert sorted((r.uid, r.seg_id, r.keep) for r in islands.judge(segs, questions, model).collect()) == [("t", 0, False), ("u", 0, True), ("u", 1, False), ("u", 2, True)]
    scores = spark.createDataFrame([("v", 0, 0.5)], "video_id string, frame_idx int, score double")
    shown = spark.createDataFrame([("v", 0), ("v", 4)], "video_id string, frame_idx int")
    assert sorted((r.frame_idx, r.score, r.is_new) for r in islands.inject(scores, shown, ["video_id"]).collect()) == [(0, 1.0, False), (4, 1.0, True)]


def test_uneven_regions(spark):
    from reelquery.operators import vectors

    frames = spark.createDataFrame([("v", 0), ("v", 1), ("w", 0)], "video_id string, frame_idx int")
    regions = spark.createDataFrame([("v", 0, 0, [1.0, 0.0]), ("v", 0, 2, [0.0, 1.0]), ("w", 0, 1, [-1.0, 0.0])], "video_id string, frame_idx int, region_idx int, tok array<double>")
    got = {(r.video_id, r.frame_idx): r.score for r in vectors.score_regions(frames, regions, F.array(F.lit(1.0), F.lit(0.0))).collect()}
    assert got == {("v", 0): 1.0, ("v", 1): 0.0, ("w", 0): -1.0}
    try:
        vectors.score_frames(frames, frames, [])
        raise AssertionError
    except ValueError:
        pass


def test_distributions_of_the_search():
    score = np.zeros(40)
    score[[5, 20]] = 0.8, 0.4
    search.raise_neighbours(score, [5, 20], np.array([0.8, 0.4]), reach=2)
    assert np.allclose(score[3:8], [0.8 / 3, 0.4, 0.8, 0.4, 0.8 / 3]) and score[19] == 0 and score[20] == 0.4
    x = np.array([0, 3, 7, 12, 20, 30])
    line = search.smoothing_spline(x, 2.0 * x + 1, 0.5, np.arange(40))
    assert np.allclose(line, 2.0 * np.arange(40) + 1, atol=1e-6)
    y = np.array([0.0, 5.0, -3.0, 8.0, 1.0, 4.0])
    assert np.allclose(search.smoothing_spline(x, y, 1e-12, x), y, atol=1e-4)
    fit = search.smoothing_spline(x, y, 0.5, x)
    assert abs(((fit - y) ** 2).sum() - 0.5) < 1e-3
    for curve in search.UPDATES.values():
        p = curve(score, np.flatnonzero(score))
        assert abs(p.sum() - 1) < 1e-9 and (p >= 0).all() and len(p) == 40
        assert np.allclose(curve(np.zeros(10), np.array([], int)), 0.1)


def test_search_stops_when_found():
    g = search.Grounding(["cup"], ["hand"], [("cup", "hand", "time")])
    seen = []

    def detect(video, frames, names):
        seen.append(frames)
        return [[("cup", 0.9, (0, 0, 1, 1)), ("hand", 0.8, (0, 0, 1, 1))] if f == 40 else [] for f in frames]

    picks, scores = search.search_video("v", 200, g, detect, 4, ratio=5.0)
    assert 40 in picks and scores[40] == 0.9 and len(picks) == 4  # the second look at frame 40 replaces its score, bonus included
    assert search.search_video("v", 200, g, detect, 4, ratio=5.0) == (picks, scores)
    assert search.search_video("v", 0, g, detect, 4) == ([], []) and search.budget(10, 0.5) == 5


def test_config():
    files = {"base": {"a": {"x": 1, "y": 2}, "b": 3}, "top": {"defaults": ["base"], "a": {"y": 5}}}
    got = config.override(config.resolve("top", files.get), ["a.x=7", "c.d=text"])
    assert got == {"a": {"x": 7, "y": 5}, "b": 3, "c": {"d": "text"}} and config.resolve("none", files.get, False) == {}
