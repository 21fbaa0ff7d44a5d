"""Text extraction in two ragged stages against one frame at a time."""

import sys

import pytest
from pyspark import cloudpickle

from reelquery.operators import extraction

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test module

FRAMES = [("v", k, bytes([97 + k % 26]) * (k * 7 % 5)) for k in range(40)] + [("w", 0, None), ("w", 1, b""), ("w", 2, b"z" * 30)]


def detect(images):
    return [[(a, a + 1) for a in range(len(image))] for image in images]


def read(pairs):
    return [None if b % 5 == 0 else " " if b % 3 == 0 else f" {image[a:b].decode()}{a} " for image, (a, b) in pairs]


def plain():
    out = {}
    for video, frame, image in FRAMES:
        texts = [] if image is None else read([(image, box) for box in detect([image])[0]])
        out[video, frame] = [t.strip() for t in texts if t and t.strip()]
    return out


@pytest.mark.parametrize("n_frames,n_boxes", [(1, 1), (3, 4), (64, 512), (5, 1000)])
@pytest.mark.parametrize("batch", [1, 4, 1000])
def test_any_batch_gives_the_same_texts(spark, n_frames, n_boxes, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(FRAMES, "video_id string, frame_idx int, image binary").coalesce(2)
        got = {(r.video_id, r.frame_idx): r.texts for r in extraction.extract_texts(df, detect, read, n_frames, n_boxes).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain()


def test_calls_are_full_and_ragged():
    looks, reads = [], []

    def look(images):
        looks.append(len(images))
        return detect(images)

    def say(pairs):
        reads.append(len(pairs))
        return read(pairs)

    given = [((v, f), image) for v, f, image in FRAMES if image is not None]
    got = list(extraction._calls(iter(given), look, say, 8, 10))
    assert [k for k, _ in got] == [k for k, _ in given] and dict(got) == {k: t for k, t in plain().items() if k != ("w", 0)}
    assert looks == [8] * (len(given) // 8) + [len(given) % 8] * bool(len(given) % 8)
    boxes = sum(len(image) for _, image in given)
    assert reads == [10] * (boxes // 10) + [boxes % 10] * bool(boxes % 10)


def test_answers_must_fit():
    with pytest.raises(ValueError, match="once for each frame"):
        list(extraction._calls(iter([(("v", 0), b"a")]), lambda x: [], read, 8, 8))
    with pytest.raises(ValueError, match="once for each box"):
        list(extraction._calls(iter([(("v", 0), b"a")]), detect, lambda x: [], 8, 8))
