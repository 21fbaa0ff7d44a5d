"""Reading text off frames in two ragged stages: frames are detected in batches, boxes of many frames recognised in others."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Box = tuple[int, ...]
Detect = Callable[[list[bytes]], list[list[Box]]]
Recognise = Callable[[list[tuple[bytes, Box]]], list[str | None]]
#: Frames of a detector's call, boxes of a recogniser's.
FRAMES, BOXES = 64, 512


def _calls(frames: Iterator[tuple[tuple, bytes]], detect: Detect, recognise: Recognise, n_frames: int, n_boxes: int) -> Iterator[tuple[tuple, list[str]]]:
    """(key, texts) of every frame, in order.  Boxes wait until a call is full; a frame is sent when its last box is read."""
    waiting: deque = deque()  # [key, boxes left, texts] of frames that aren't complete
    boxes: deque = deque()  # (waiting frame, image, box) that aren't recognised
    taken: list[tuple[tuple, bytes]] = []

    def look() -> None:
        found = detect([image for _, image in taken])
        if len(found) != len(taken):
            raise ValueError("a detector answers once for each frame")
        for (key, image), own in zip(taken, found, strict=True):
            one = [key, len(own), []]
            waiting.append(one)
            boxes.extend((one, image, box) for box in own)
        taken.clear()

    def read(n: int) -> None:
        part = [boxes.popleft() for _ in range(n)]
        texts = recognise([(image, box) for _, image, box in part])
        if len(texts) != len(part):
            raise ValueError("a recogniser answers once for each box")
        for (one, _, _), text in zip(part, texts, strict=True):
            one[1] -= 1
            if text is not None and text.strip():
                one[2].append(text.strip())

    def complete() -> Iterator[tuple[tuple, list[str]]]:
        while waiting and not waiting[0][1]:
            key, _, texts = waiting.popleft()
            yield key, texts

    for item in frames:
        taken.append(item)
        if len(taken) == n_frames:
            look()
            while len(boxes) >= n_boxes:
                read(n_boxes)
            yield from complete()
    if taken:
        look()
    while boxes:
        read(min(n_boxes, len(boxes)))
    yield from complete()


def extract_texts(frames: DataFrame, detect: Detect, recognise: Recognise, n_frames: int = FRAMES, n_boxes: int = BOXES) -> DataFrame:
    """video_id, frame_idx, texts of every frame (video_id, frame_idx, image); blank texts are dropped.

    ``detect`` gets up to ``n_frames`` images and answers with the boxes of each; ``recognise`` gets up to ``n_boxes``
    pairs of image and box, of as many frames as it takes, and answers in order.  Calls go on over the edges of Arrow
    batches, so only a task's last calls aren't full.  A null image has no boxes and is in no call.
    """
    schema = frames.select("video_id", "frame_idx").schema
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, rows = None, []

        def given() -> Iterator[tuple[tuple, bytes]]:
            nonlocal types
            for b in batches:
                types = [b.schema.field(0).type, b.schema.field(1).type, pa.list_(pa.string())]
                for video, frame, image in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    if image is None:
                        rows.append((video, frame, []))
                    else:
                        yield (video, frame), image

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["video_id", "frame_idx", "texts"])
            rows.clear()
            return out

        for key, texts in _calls(given(), detect, recognise, n_frames, n_boxes):
            rows.append((*key, texts))
            if len(rows) >= 1000:
                yield sent()
        if rows:
            yield sent()

    return frames.select("video_id", "frame_idx", "image").mapInArrow(run, f"{kind}, texts array<string>")
