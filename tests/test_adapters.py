"""Question layouts, model inputs, results in parts, probes, keyed streams."""

import io
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reelquery.operators import metrics, sampling, temporal
from reelquery.plans import planner
from reelquery.sources import adapters, importers, sinks
from reelquery.streaming.arrivals import evaluate_arrivals

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_columns_as_rows(spark):
    table = spark.createDataFrame([(["a", "b", None, "d", ""], ["q1", "", "q3", "q4", "q5"], ["A", "B", "C", None, "E"], [{"B": "two", "A": "one"}, {"A": "x"}, {"A": "x"}, {"A": "x"}, {"A": "x"}], [[1, 2], [], None, [3], []])], "video_id array<string>, question array<string>, answer array<string>, options array<map<string,string>>, frame_indexes array<array<int>>")
    got = [(r.video_id, r.video_path, r.question, r.options, r.answer, r.gt_frame_index, r.position) for r in adapters.from_columns(table, "/v/").collect()]
    assert got == [("a", "/v/a.mp4", "q1", "A) one\nB) two", "A", [1, 2], []), ("d", "/v/d.mp4", "q4", "A) x", None, [3], [])]


def test_lettered_options(spark):
    rows = spark.createDataFrame([("a", "q", None, ["A. red", "B. dark blue"], None, "short", [5]), ("b", "q", "B", None, [1], "long", None), ("c", "q", "B", [], [1], "long", None)], "video_id string, question string, answer string, options array<string>, frame_indexes array<int>, duration string, position array<int>")
    got = [(r.video_id, r.options, r.answer, r.gt_frame_index, r.duration_group, r.position) for r in adapters.from_lettered(rows, "/v").collect()]
    assert got == [("a", "A) red\nB) dark blue", "", [], "short", [5])]


def test_choices_with_and_without_the_category_filter(spark):
    rows = [("a", "x/a.mp4", "q", ["r", "g"], 1, "S2E", 15, [3]), ("b", "b.mp4", "q", ["r"], 0, "T3O", 60, None), ("c", "c.mp4", "q", ["r"], 7, "S2E", 60, None), ("d", "d.mp4", None, ["r"], 0, "S2E", 60, None)]
    df = spark.createDataFrame(rows, "video_id string, video_path string, question string, candidates array<string>, correct_choice int, question_category string, duration_group int, position array<int>")
    got = [(r.video_id, r.video_path, r.options, r.answer, r.position) for r in adapters.from_choices(df, "/r").collect()]
    assert got == [("a", "/r/x/a.mp4", "A) r\nB) g", "B", [3])]
    assert [r.video_id for r in adapters.from_choices(df, "/r", without=None).orderBy("video_id").collect()] == ["a", "b"]


def test_three_input_modes(spark):
    questions = spark.createDataFrame([("q1", "v"), ("q2", "none")], "uid string, video_id string")
    frames = spark.createDataFrame([("v", k, k * 1.0) for k in range(9)], "video_id string, frame_idx int, t double")
    said = spark.createDataFrame([("v", 1, 3.5, 4.5, "mid"), ("v", 0, 0.2, 0.8, "early"), ("w", 0, 0.0, 1.0, "other")], "video_id string, ordinal int, start double, end double, text string")
    of = lambda most: {r.uid: r.inputs for r in adapters.model_inputs(questions, frames, said, most).collect()}
    assert of(0) == {"q1": [], "q2": []}
    assert of(-1) == {"q1": ["early", "mid"], "q2": []}
    assert of(3) == {"q1": ["frame 0", "frame 4", "mid", "frame 8"], "q2": []}  # a frame at the start of a widened subtitle isn't inside


def test_lists_by_video(spark):
    rows = spark.createDataFrame([(2, "b.mp4", "q3", ["x"], [1], 0, 700.0), (1, "a.mp4", "q2", ["x", "y"], [2], 1, 5.0), (0, "a.mp4", "q1", ["z"], [], 0, 600.0)], "ordinal int, video_path string, question string, candidates array<string>, position array<int>, correct_choice int, duration double")
    short, long_ = (df.collect() for df in adapters.questions_by_video(rows))
    assert [(r.video_name, r.questions, r.candidatess, r.correct_choices, r.durations) for r in short] == [("a.mp4", ["q1", "q2"], [["z"], ["x", "y"]], [0, 1], [600.0, 5.0])]
    assert [r.video_name for r in long_] == ["b.mp4"]
    clips = spark.createDataFrame([(0, "c", "where", [[0.0, 9.0], [12.0, 15.0]], 10.0), (1, "c", None, [[1.0, 2.0]], 0.0), (2, "c", "when", [], 0.0)], "ordinal int, clip_uid string, query string, trajectory array<array<double>>, clip_start double")
    assert [(r.video_name, r.questions, r.clips) for r in adapters.clips_by_video(clips).collect()] == [("c.mp4", ["where"], [[2.0, 5.0]])]
    files = spark.createDataFrame([("v", 0, "frame_3882.jpg", ""), ("v", 0, "frame_129.jpg", ""), ("v", 0, "answer.txt", " yes \n"), ("v", 1, "answer.txt", "no")], "video string, question int, name string, text string")
    got = adapters.snapshots_by_video(spark.createDataFrame([("v",), ("w",)], "video string"), files).orderBy("video").collect()
    assert (got[0].frames, got[0].answers, got[1].frames) == ([[], [129, 3882]], ["yes", "no"], None)


def test_results_in_parts_go_on_where_they_stopped(spark, tmp_path):
    path, done = str(tmp_path / "r"), []
    items = spark.createDataFrame([(f"u{k}", k) for k in range(50)], "uid string, n int")

    def work(part):
        done.append(sorted(r.uid for r in part.collect()))
        if len(done) == 3:
            raise RuntimeError("cut off")
        return part.select("uid", (F.col("n") * 2).alias("twice"))

    with pytest.raises(RuntimeError):
        sinks.write_in_parts(items, work, path, 10)
    out = sinks.write_in_parts(items, work, path, 10)
    assert len(done) == 6 and done[2] == done[3]
    assert sorted((r.uid, r.twice) for r in out.collect()) == sorted((f"u{k}", 2 * k) for k in range(50))
    assert sinks.write_in_parts(items, work, path, 10).count() == 50 and len(done) == 6


def test_resumed_accuracy(spark):
    new = spark.createDataFrame([("a", "A", "A"), ("b", "A", "B"), ("c", None, None)], "uid string, answer string, gold string")
    old = spark.createDataFrame([("b", "B", "B"), ("z", "A", "B"), ("z", "A", "B")], "uid string, answer string, gold string")
    assert tuple(metrics.accuracy_resumed(new, old).first()) == (4, 3, 0.75)
    assert tuple(metrics.accuracy_resumed(new.where("false"), old.where("false")).first()) == (0, 0, 0.0)


def test_group_over_all_items(spark):
    truth = spark.createDataFrame([("a", 10.0), ("a", 90.0), ("b", 5.0), ("c", 5.0)], "uid string, frame double")
    pred = spark.createDataFrame([("a", 20.0), ("a", 21.0), ("a", 99.0), ("b", 5.0)], "uid string, frame double")
    items = spark.createDataFrame([("a", 2.0, "x"), ("b", None, "x"), ("c", 2.0, "x"), ("d", 2.0, "y")], "uid string, fps double, grp string")
    p, r, f = temporal.prf_over_all(truth, pred, items, 5.0, "x").first()
    assert (p, r) == (pytest.approx(2 / 3 / 4), pytest.approx(1 / 4)) and f == pytest.approx(2 * (2 / 3) / (5 / 3) / 4)
    assert tuple(temporal.prf_over_all(truth, pred, items, 5.0, "none").first()) == (0.0, 0.0, 0.0)
    assert tuple(temporal.prf_over_all(truth, pred, items.where("false"), 5.0).first()) == (None, None, None)


def test_completions_of_any_layout(spark):
    parts = spark.createDataFrame([([("text", "a"), ("image", "b"), ("text", "c")],), ([],)], "m array<struct<type:string,text:string>>")
    assert [r.text for r in planner.completion_text(parts, "m").collect()] == ["a\nc", ""]
    plain = spark.createDataFrame([("say [x]",), ('[{"type": "text", "text": "y"}]',), ("[1, 2]",), ("[",), (None,)], "m string")
    assert [r.text for r in planner.completion_text(plain, "m").collect()] == ["say [x]", "y", "[1, 2]", "[", None]


def test_batches_of_one_grid_cover_it(spark):
    for n, k, batches in ((100, 4, 3), (5, 4, 2), (1, 2, 2), (30, 1, 1)):
        got = [spark.range(1).select(sampling.batch_of_grid(F.lit(n), k, F.lit(b), batches).alias("f")).first().f for b in range(1, batches + 1)]
        assert sum(got, []) == np.linspace(0, n - 1, k * batches, dtype=int).tolist()


def packed(value, **named):
    out = io.BytesIO()
    np.savez(out, **named) if named else np.save(out, value)
    return out.getvalue()


def test_class_prompts(spark):
    from reelquery import models

    classes = spark.createDataFrame([(0, ["a cup", "mug"]), (1, []), (2, ["a cup"])], "class_id int, captions array<string>")
    got = {r.class_id: r.emb for r in models.class_prompts(classes, models.hashed_encoder(8)).collect()}
    assert got.keys() == {0, 2} and got[0] == got[2] and np.linalg.norm(got[0]) == pytest.approx(1)
    images = spark.createDataFrame([(4, b"x")], "class_id int, image binary")
    rows = models.image_prompts(images, models.hashed_encoder(8), models.hashed_encoder(8)).orderBy("place").collect()
    assert [(r.place, r.class_id) for r in rows] == [(0, 4), (1, None)] and rows[1].emb == pytest.approx(models.hashed_encoder(8)([" "])[0].tolist(), abs=1e-6)


def test_feature_files_of_either_layout():
    m = np.arange(6.0).reshape(2, 3)
    assert importers.decode_features(packed(m)) == m.tolist() == importers.decode_features(packed(None, other=np.zeros(2), embeddings=m)) == importers.decode_features(packed(None, only=m))
    for bad in (packed(np.zeros(3)), packed(None, a=m, b=m)):
        with pytest.raises(ValueError):
            importers.decode_features(bad)


def test_probes_keep_errors(spark):
    def read(content):
        if not content:
            raise OSError("empty file")
        return json.loads(content)

    rows = spark.createDataFrame([("/x/a.mp4", b'{"frame_count": 50, "frame_rate": 25.0, "width": 4, "height": 3, "codec": "h264", "bitrate": 9}'), ("/x/b.mp4", b""), ("/x/c.mp4", b'{"width": 1, "height": 2}')], "path string, content binary")
    got = {r.file_name: (r.duration, r.resolution, r.codec, r.bitrate, r.error) for r in importers.probe_videos(rows, read).collect()}
    assert got == {"a.mp4": (2.0, "4x3", "h264", 9, None), "b.mp4": (None, None, None, None, "OSError: empty file"), "c.mp4": (0.0, "1x2", "N/A", 0, None)}


def test_a_retried_micro_batch_replaces_itself_and_keys_are_state(spark, tmp_path):
    source, results, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    fail = {"left": 1}

    def evaluate(batch):
        out = batch.select("uid", (F.col("n") + 1).alias("m"))
        if fail["left"] and out.where("uid = 'c'").count():
            fail["left"] -= 1
            out.write.mode("overwrite").parquet(f"{results}/batch=1")  # as if the batch died after it wrote
            raise RuntimeError("lost")
        return out

    def run(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
        evaluate_arrivals(spark, source, "uid string, n int", evaluate, results, checkpoint).awaitTermination(120)

    run("1.json", [{"uid": "a", "n": 1}, {"uid": "b", "n": 1}])
    with pytest.raises(Exception):
        run("2.json", [{"uid": "b", "n": 5}, {"uid": "c", "n": 7}])
    evaluate_arrivals(spark, source, "uid string, n int", evaluate, results, checkpoint).awaitTermination(120)
    assert sorted((r.uid, r.m) for r in spark.read.parquet(results).collect()) == [("a", 2), ("b", 2), ("c", 8)]


def test_image_similarity_matches_plain_loops(spark):
    from reelquery import catalog

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", "vec_id", "embedding").orderBy("vec_id").collect()
    first = {}
    for r in rows:
        first.setdefault(r.label, np.array(r.embedding, float).reshape(8, 8))
    g = np.exp(-((np.arange(11) - 5) ** 2) / 4.5)
    g /= g.sum()

    def blur(x):
        out = np.zeros((8, 8))
        for i in range(8):
            for j in range(8):
                out[i, j] = sum(g[a + 5] * g[b + 5] * x[i + a, j + b] for a in range(-5, 6) for b in range(-5, 6) if 0 <= i + a < 8 and 0 <= j + b < 8)
        return out

    def plain(a, b):
        ma, mb = blur(a), blur(b)
        va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
        return float((((2 * ma * mb + 1e-4) * (2 * cov + 9e-4)) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4))).mean())

    got = {r.vec_id: r.ssim for r in catalog.queries()["image_similarity"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows[::25]:
        assert got[r.vec_id] == pytest.approx(plain(np.array(r.embedding, float).reshape(8, 8), first[r.label]), abs=2e-6)
