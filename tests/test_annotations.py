"""Annotation files, prior grids and ragged batches."""

import json
import math

import pytest
from pyspark.sql import functions as F

from reelquery.operators import priors
from reelquery.sources import collate, phrases

CAPTION = "A größer Hund sits, two Hund"
FILE = {
    "images": [{"id": 1, "file_name": "a.jpg", "caption": CAPTION, "height": 50, "width": 40}, {"id": 2, "file_name": "b.jpg", "caption": "x", "height": 50, "width": 40}],
    "annotations": [
        {"id": 9, "image_id": 1, "bbox": [1, 2, 10, 10], "area": 5, "tokens_positive": [[9, 13]], "ignore": True},
        {"id": 8, "image_id": 1, "bbox": [1, 2, 10, 10], "area": 5, "iscrowd": 1, "tokens_positive": [[2, 8], [9, 13]]},
        {"id": 7, "image_id": 1, "bbox": [-5, 2, 10, 10], "area": 5, "tokens_positive": [[24, 99]]},
        {"id": 6, "image_id": 1, "bbox": [40, 2, 10, 10], "area": 5, "tokens_positive": [[20, 23]]},
        {"id": 5, "image_id": 1, "bbox": [1, 2, 0.5, 10], "area": 5, "tokens_positive": [[20, 23]]},
        {"id": 4, "image_id": 1, "bbox": [1, 2, 3, 4], "area": 0, "tokens_positive": []},
        {"id": 3, "image_id": 1, "bbox": [1, 2, 3, 4], "area": 1, "tokens_positive": None},
        {"id": 2, "image_id": 99, "bbox": [1, 2, 3, 4], "area": 1, "tokens_positive": [[0, 1]]},
    ],
}


def test_phrases_and_labels(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(FILE))
    (tmp_path / "none.json").write_text("{}")
    images, marks = phrases.read_annotations(spark, str(tmp_path))
    boxes, texts = phrases.phrase_boxes(images, marks)
    got = sorted((r.image_id, r.phrase, r.label, r.x1, r.y1, r.x2, r.y2, r.iscrowd) for r in boxes.collect())
    assert got == [(1, "", 3, 1.0, 2.0, 4.0, 6.0, False), (1, "Hund", 0, -5.0, 2.0, 5.0, 12.0, False), (1, "größer Hund", 1, 1.0, 2.0, 11.0, 12.0, True)]
    assert {r.image_id: r.phrases for r in texts.collect()} == {1: ["Hund", "größer Hund", "two", ""]}
    classes = spark.createDataFrame([("Hund", 17)], "phrase string, class_id int")
    assert [(r.phrase, r.label) for r in phrases.remap(boxes, classes).collect()] == [("Hund", 17)]
    assert sorted((r.phrase, r.label) for r in phrases.remap(boxes, classes, unknown=-1).collect()) == [("", -1), ("Hund", 17), ("größer Hund", -1)]


def test_an_image_in_many_files_is_labelled_as_in_one(spark, tmp_path):
    images = spark.createDataFrame([(1, "a.jpg", CAPTION, 50.0, 40.0), (2, "b.jpg", "xyz", 50.0, 40.0), (3, "c.jpg", "x" * 300, 50.0, 40.0)], "id long, file_name string, caption string, height double, width double")
    spans = [[[9, 13]], [[2, 8]], [[24, 28]], [[9, 13], [20, 23]]]
    rows = [(1 + (i % 7 == 0), (i * 37) % 200, [float(i % 9), 2.0, 3.0, 4.0], 5.0, 0, False, spans[-(-((i * 37) % 200) // 60) % 4]) for i in range(200)]
    marks = spark.createDataFrame(rows, "image_id long, id long, bbox array<double>, area double, iscrowd int, ignore boolean, tokens_positive array<array<int>>")
    phrases.write_annotations(images, marks, str(tmp_path / "many"), ["image_id", "id"], most=7, size=4000)
    files = [json.loads(p.read_text()) for p in (tmp_path / "many").glob("*.txt") if p.stat().st_size]
    assert sorted(len(f["annotations"]) for f in files if "annotations" in f)[-1] == 7 and sum(len(f.get("annotations", [])) for f in files) == 200
    boxes, texts = phrases.phrase_boxes(*phrases.read_annotations(spark, str(tmp_path / "many")))
    want = {}
    for image, _, _, _, _, _, (first, *rest) in sorted(rows, key=lambda r: r[:2]):
        text = " ".join((CAPTION if image == 1 else "xyz")[a:b] for a, b in [first, *rest])
        want.setdefault(image, {}).setdefault(text, len(want[image]) if image in want else 0)
    assert {r.image_id: r.phrases for r in texts.collect()} == {i: list(w) for i, w in want.items()}
    got = boxes.collect()
    assert len(got) == 200 and len({r.ordinal for r in got}) == 200 and all(r.label == want[r.image_id][r.phrase] for r in got)


def test_prior_grid(spark):
    got = [tuple(r)[:8] for r in priors.prior_grid(spark, [(2, 3, 8), (1, 1, 16)], bases=[[(1, 2), (3, 4)], [(5, 6), (7, 8)]]).orderBy("prior").collect()]
    want = [(lv, r, c, b, s, (c + 0.5) * s, (r + 0.5) * s) for lv, (h, w, s) in enumerate([(2, 3, 8), (1, 1, 16)]) for r in range(h) for c in range(w) for b in range(2)]
    assert got == [(k, *x) for k, x in enumerate(want)]
    sizes = [(r.base_w, r.base_h) for r in priors.prior_grid(spark, [(1, 2, 8)], bases=[[(1, 2), (3, 4)]]).orderBy("prior").collect()]
    assert sizes == [(1.0, 2.0), (3.0, 4.0)] * 2


@pytest.mark.parametrize("name", sorted(priors.DECODERS))
def test_decoders_against_plain_arithmetic(spark, name):
    grid = priors.prior_grid(spark, [(2, 2, 8)], bases=[[(10.0, 13.0)]])
    rows = [(k, 0.3 * k - 0.4, -0.2 * k, 0.1 * k, 0.5 - 0.3 * k) for k in range(4)]
    got = {r.prior: (r.x1, r.y1, r.x2, r.y2) for r in priors.decoded(spark.createDataFrame(rows, "prior long, a double, b double, c double, d double"), grid, name, ["a", "b", "c", "d"]).collect()}
    for k, a, b, c, d in rows:
        px, py, sig = (k % 2 + 0.5) * 8, (k // 2 + 0.5) * 8, lambda x: 1 / (1 + math.exp(-x))
        if name == "distances":
            want = (px - 8 * a, py - 8 * b, px + 8 * c, py + 8 * d)
        else:
            cx, cy, w, h = (px + 16 * (sig(a) - 0.5), py + 16 * (sig(b) - 0.5), 4 * sig(c) ** 2 * 10, 4 * sig(d) ** 2 * 13) if name == "anchor" else (px + 8 * a, py + 8 * b, 8 * math.exp(c), 8 * math.exp(d))
            want = (cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)
        assert got[k] == pytest.approx(want)


def test_ragged_batches(spark):
    samples = spark.createDataFrame([(f"i{k}", k * 3, f"t{k}") for k in range(7)], "image_id string, ordinal int, caption string")
    boxes = spark.createDataFrame([(f"i{k}", b, float(k)) for k in (0, 2, 2, 6, 6, 6) for b in [k]] + [("gone", 0, 0.0)], "image_id string, box_id int, x double")
    whole, flat = collate.collate(samples.repartition(3), boxes, 3)
    got = {r.batch: (r["keys"], r.offsets, r.caption) for r in whole.collect()}
    assert got == {0: (["i0", "i1", "i2"], [0, 1, 1, 3], ["t0", "t1", "t2"]), 1: (["i3", "i4", "i5"], [0, 0, 0, 0], ["t3", "t4", "t5"]), 2: (["i6"], [0, 3], ["t6"])}
    assert sorted((r.batch, r["at"], r.place, r.image_id) for r in flat.collect()) == [(0, 0, 0, "i0"), (0, 1, 2, "i2"), (0, 2, 2, "i2"), (2, 0, 0, "i6"), (2, 1, 0, "i6"), (2, 2, 0, "i6")]


def test_records_from_a_file_listing(spark, tmp_path):
    from reelquery.sources import tables

    for v, names in (("v1", ["frame_10.jpg", "frame_9.jpg", "cover.jpg"]), ("v2", ["frame_1.jpg"])):
        (tmp_path / "set" / v).mkdir(parents=True)
        for n in names:
            (tmp_path / "set" / v / n).write_bytes(b"x")
    records = collate.nested_records(tables.files_by_key(spark, str(tmp_path)), ["k1", "k2"])
    got = {(r.k1, r.k2): [(f.frame_idx, f.path.rsplit("/", 1)[1]) for f in r.frames] for r in records.collect()}
    assert got == {("set", "v1"): [(9, "frame_9.jpg"), (10, "frame_10.jpg"), (None, "cover.jpg")], ("set", "v2"): [(1, "frame_1.jpg")]}
    asked = spark.createDataFrame([("set", "v1", "u2", "why"), ("set", "v1", "u1", "what")], "k1 string, k2 string, uid string, question string")
    full = {r.k2: ([i.uid for i in r["items"]], r.n_frames) for r in collate.attach(records, asked, ["k1", "k2"]).collect()}
    assert full == {"v1": (["u1", "u2"], 3), "v2": ([], 1)}


def test_numbered_spreads_alike_prefixes_and_wide_numbers(spark):
    from reelquery.operators.rank import numbered

    ids = spark.range(5000).select(F.format_string("video_%012d", F.col("id") * 7).alias("k"))
    out = numbered(ids.repartition(5), ["k"], "n")
    assert [r.n for r in out.orderBy("k").collect()] == list(range(5000))
    wide = spark.range(3000).select((F.col("id") * 10**12).alias("k"))
    assert [r.n for r in numbered(wide.repartition(3), ["k"], "n").orderBy("k").collect()] == list(range(3000))
    assert numbered(wide.where("k < 0"), ["k"], "n").collect() == []


def test_numbered_leaves_no_partition_with_most_rows(spark):
    """What is written by ranges is even, whatever the texts begin with."""
    from reelquery import scratch
    from reelquery.operators import rank

    seen = []
    real = scratch.written
    try:
        scratch.written = lambda df, tag: (seen.append(real(df, tag)), seen[-1])[1]
        rank.numbered(spark.range(20000).select(F.format_string("video_%06d", "id").alias("k")), ["k"], "n").count()
    finally:
        scratch.written = real
    counts = [r["count"] for r in seen[0].groupBy(F.shiftright("__id", 33)).count().collect()]
    assert len(counts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(counts) < 2 * 20000 / len(counts)
