"""Substring de-duplication by difference-cover anchors (operator 7).

A window is ``window`` consecutive words of one document; a word goes when a window that covers it also starts in a
document with a smaller doc_id.  Positions whose index modulo 31 lies in a perfect difference set are anchors: for any
two positions i and j some shift below 31 puts both on anchors, so any shared window of 50 words shares an anchored
20-word window at the same place inside it.  Thus only 6 of 31 positions are hashed and shuffled at first:

1. anchor hashes that occur in two documents or more mark where documents may share text;
2. around those alone, full windows are hashed; the smallest doc_id of every window comes from a partial aggregation;
3. windows held by a smaller doc_id come back as lists per document, and the text is cut.

Exact copies are recognised by their whole word sequence and skip steps 2 and 3.  Skewed hashes meet only partial
aggregations and inner equi-joins that adaptive execution splits.

Edge cases: null and empty texts and texts below one window lose nothing; rows that repeat a doc_id are judged one by
one and a document never removes its own text; a row with null doc_id neither loses words nor costs others theirs;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The perfect difference set modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _bytes(part: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return part.column(part.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _ in C.groups(batches):
        words = [t.split() for t in _bytes(part)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([_sha(w) for w in words], pa.string())], names=["doc_id", "n_words", "sha"])


def _anchors_of(words: C.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, text) of all anchors of texts that hold a full window."""
    length = window - PERIOD + 1
    at, text = C.window_starts(words, length)
    enough = np.diff(words.first) >= window
    on = np.isin(np.arange(PERIOD), COVER)[(at - words.first[:-1][text]) % PERIOD] & enough[text]
    return at[on], text[on]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in C.groups(batches):
            words = C.word_table(texts)
            at, text = _anchors_of(words, window)
            hashed, text = C.distinct(C.windows(words.hash, window - PERIOD + 1)[at], text)
            yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), part.column(0).take(pa.array(text))], names=["h", "doc_id"])

    return run


def _member(hashed: np.ndarray, text: np.ndarray, part: pa.RecordBatch, name: str) -> np.ndarray:
    """Which (hash, text) are in the text's list."""
    column = part.column(part.schema.get_field_index(name))
    flat, sizes = column.flatten().to_numpy().view(np.uint64), column.value_lengths().to_numpy()
    edge = np.concatenate(([0], np.cumsum(sizes)))
    first = np.searchsorted(text, np.arange(part.num_rows + 1))
    out = np.zeros(len(hashed), bool)
    for i in range(part.num_rows):
        known, mine = np.sort(flat[edge[i] : edge[i + 1]]), hashed[first[i] : first[i + 1]]
        if len(known):
            out[first[i] : first[i + 1]] = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
    return out


def _windows(window: int):
    """Full windows around the shared anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in C.groups(batches):
            words = C.word_table(texts)
            at, text = _anchors_of(words, window)
            at = at[_member(C.windows(words.hash, window - PERIOD + 1)[at], text, part, "shared")]
            near = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(near, np.maximum(at - PERIOD + 1, 0), 1)
            np.add.at(near, at + 1, -1)
            starts, text = C.window_starts(words, window)
            on = np.cumsum(near)[starts] > 0
            hashed, text = C.distinct(C.windows(words.hash, window)[starts[on]], text[on])
            yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), part.column(0).take(pa.array(text))], names=["h", "doc_id"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in C.groups(batches):
            words = C.word_table(texts)
            starts, text = C.window_starts(words, window)
            gone = starts[_member(C.windows(words.hash, window)[starts], text, part, "gone")]
            over = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(over, gone, 1)
            np.add.at(over, gone + window, -1)
            keep = np.cumsum(over)[:-1] == 0
            whole, sha, removed, kept = [], [], [], []
            for i, t in enumerate(_bytes(part)):
                mask, all_words = keep[words.first[i] : words.first[i + 1]], t.split()
                left = list(compress(all_words, mask))
                whole.append(_sha(all_words))
                removed.append(len(mask) - len(left))
                sha.append(_sha(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole, pa.string()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "sha", "removed", "sha_cut", "kept_text"])

    return run


def _held(pairs: DataFrame, all_but_first: bool) -> DataFrame:
    """Pairs (h, doc_id) whose h is in two documents or more; with ``all_but_first`` only those not of the smallest doc_id.

    The hashes' documents are a table of their own, so that adaptive execution can split a hash that holds much of the rows.
    """
    least = C.materialize(pairs.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "low"), "shared")
    out = pairs.join(least, "h")
    return (out.where("doc_id > low") if all_but_first else out).select("doc_id", "h")


def repeated_windows(docs: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row (and kept_text, null where nothing goes, if asked for)."""
    if window < PERIOD + 4:
        raise ValueError(f"a window needs {PERIOD + 4} words at least")
    mark = C.made()
    C.small_batches(docs.sparkSession)
    docs = C.id_text(docs)
    known = docs.where("doc_id is not null")
    whole = C.materialize(docs.mapInArrow(_whole, "doc_id long, n_words long, sha string"), "whole")
    # a table of its own, so that adaptive execution can split a group of copies that holds much of the rows
    copies = C.materialize(whole.where(f"n_words >= {window} and doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("sha", "low"), "copies")
    whole = C.materialize(whole.join(copies, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))).drop("low"), "whole")

    anchors = known.mapInArrow(_anchors(window), "h long, doc_id long")
    marked = _held(anchors, False).groupBy("doc_id").agg(F.collect_set("h").alias("shared"))
    # an id all of whose rows are copies needs no windows of its own: its smallest twin has them all
    marked = marked.join(whole.groupBy("doc_id").agg(F.bool_and("copy").alias("copy")).where("copy").select("doc_id"), "doc_id", "left_anti")
    texts = C.materialize(known.join(marked, "doc_id"), "marked")
    gone = _held(texts.mapInArrow(_windows(window), "h long, doc_id long"), True).groupBy("doc_id").agg(F.collect_set("h").alias("gone"))
    cut = texts.select("doc_id", "text").join(gone, "doc_id").mapInArrow(_cut(window), "doc_id long, sha string, removed long, sha_cut string, kept_text string")
    cut = cut.select("doc_id", "sha", "removed", "sha_cut", *["kept_text"] * with_text).dropDuplicates(["doc_id", "sha"])

    out = whole.join(cut, ["doc_id", "sha"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    columns = [
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("sha_cut", "sha")).alias("kept_sha256"),
    ]
    result = out.select(*columns, *([F.when(F.col("copy"), "").otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))
    C.release(mark, [result])
    return result
