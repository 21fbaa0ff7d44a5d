"""Language identification with hyperdimensional profiles (operator 8).

Letters have fixed random vectors of +1 and -1.  A trigram's vector binds them: the product of the first letter's
vector permuted twice, the second's permuted once and the third's.  A document bundles (adds) its trigram vectors, a
language those of its training documents, and a document gets the language whose prototype has the largest cosine;
document and prototypes are taken relative to the mean prototype, which all languages share.

Bundling is linear, so training counts trigrams by language over all training rows in tasks, adds the counts with a
partial aggregation, multiplies once, and adds the vectors by language.  At most ``LANGUAGES`` vectors reach the driver
at a time: where there are more, they stay a table, and texts are compared with one part of them after the other.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; without training rows every document is
``und`` with score 0; rows that repeat a doc_id are judged one by one; ties go to the language first in order; doc_id
may be null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DIMENSIONS = 1024
LETTERS = 64
#: Most prototypes (8 KB each) that are collected and sent to tasks at a time.
LANGUAGES = 4096
_table: list[np.ndarray] = []


def _letter_codes() -> np.ndarray:
    """Code of every code point: 0 no letter, 1-26 a-z in either case, 27-63 other letters."""
    if not _table:
        out = np.zeros(0x32400, np.uint8)
        for i in [*range(0x30000), *range(0x30000, 0x32400)]:
            c = chr(i)
            if c.isalpha():
                low = ord(c.lower()[0])
                out[i] = low - 96 if 97 <= low <= 122 else 27 + (low * 40503 >> 4) % (LETTERS - 27)
        _table.append(out)
    return _table[0]


def _vectors() -> np.ndarray:
    bits = C.splitmix(801, LETTERS * DIMENSIONS).reshape(LETTERS, DIMENSIONS)
    return (1 - 2 * (bits >> np.uint64(63)).astype(np.int8)).astype(np.int8)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes."""
    v = _vectors()
    twice, once = np.roll(v, 2, 1), np.roll(v, 1, 1)
    return twice[codes // LETTERS**2] * once[codes // LETTERS % LETTERS] * v[codes % LETTERS]


def trigrams(texts: C.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count) of the distinct trigrams of every text, and whether each text has a letter.

    Runs of non-letters count as one gap, and a gap is put around every text.
    """
    data, off = texts
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != int(((data & 0xC0) != 0x80).sum()):  # broken utf-8: take bytes
        points, begin = data.astype(np.uint32), off
    else:
        begin = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
    table = _letter_codes()
    code = table[np.minimum(points, len(table) - 1)]
    rows = len(off) - 1
    text = np.repeat(np.arange(rows), np.diff(begin))
    letters = np.bincount(text, code > 0, rows) > 0
    # a gap before each text and one after
    spread = np.arange(len(code)) + 1 + 2 * text
    flat = np.zeros(len(code) + 2 * rows, np.int64)
    owner = np.repeat(np.arange(rows), np.diff(begin) + 2)
    flat[spread] = code
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] > 0) | (flat[:-1] > 0) | (owner[1:] != owner[:-1])
    flat, owner = flat[keep], owner[keep]
    if len(flat) < 3:
        z = np.zeros(0, np.int64)
        return z, z, z, letters
    tri = (flat[:-2] * LETTERS + flat[1:-1]) * LETTERS + flat[2:]
    same = (owner[:-2] == owner[2:]) & (flat[1:-1] > 0)
    key, count = np.unique(owner[:-2][same] << 18 | tri[same], return_counts=True)
    return key >> 18, key & (1 << 18) - 1, count, letters


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, total in held.items():
            code = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(total[code])], names=["lang", "code", "n"])
        held.clear()

    for part, texts in C.groups(batches):
        text, code, count, _ = trigrams(texts)
        lang = np.array(part.column(0).to_pylist(), object)
        for name in sorted(set(lang)):
            mine = (lang == name)[text]
            total = held.setdefault(name, np.zeros(LETTERS**3, np.int64))
            np.add.at(total, code[mine], count[mine])
        if len(held) > 32:  # languages are few; where they aren't, memory stays bounded
            yield from out()
    yield from out()


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, np.ndarray] = {}
    for batch in batches:
        lang, code, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for name in sorted(set(lang)):
            mine = np.flatnonzero(lang == name)
            total = held.setdefault(name, np.zeros(DIMENSIONS))
            for at in range(0, len(mine), 4096):
                k = mine[at : at + 4096]
                total += n[k].astype(np.float64) @ trigram_vectors(code[k]).astype(np.float64)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["lang", "vector"])


class Table(NamedTuple):
    """Prototypes of more languages than go to the driver at once: (lang, vector) of unit length, their mean, their number."""

    vectors: DataFrame
    mean: np.ndarray
    n: int


def _collected(vectors: DataFrame) -> dict[str, np.ndarray]:
    found = vectors.toPandas()
    return dict(sorted(zip(found["lang"], map(np.asarray, found["vector"]), strict=True)))


def fit(docs: DataFrame) -> dict[str | None, np.ndarray] | Table:
    """The prototype of each language of ``docs`` (text, lang), relative to the mean prototype, and that mean under None.

    Up to ``LANGUAGES`` prototypes come as a dictionary; more stay a table.
    """
    mark = C.made()
    C.small_batches(docs.sparkSession)
    given = docs.where("lang is not null and text is not null").select("lang", "text")
    counted = given.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    parts = counted.mapInArrow(_bundle, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("place", "value"))
    added = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector"))
    added = C.materialize(added, "prototypes")
    if (n := added.count()) > LANGUAGES:
        size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        unit = C.materialize(added.withColumn("size", size).where("size > 0").select("lang", F.transform("vector", lambda x: x / F.col("size")).alias("vector")), "prototypes")
        mean = unit.select(F.posexplode("vector").alias("place", "value")).groupBy("place").agg(F.avg("value").alias("value")).orderBy("place").toPandas()["value"].to_numpy()
        C.release(mark, [unit])
        return Table(unit, mean, n)
    unit = {k: v / size for k, v in _collected(added).items() if (size := np.linalg.norm(v)) > 0}
    C.release(mark, [])
    if not unit:
        return {}
    mean = np.mean(list(unit.values()), 0) if len(unit) > 1 else np.zeros(DIMENSIONS)
    return {None: mean} | {k: v - mean for k, v in unit.items()}


def _predict(prototypes: dict[str | None, np.ndarray]):
    names = [k for k in prototypes if k is not None]
    known = np.array([prototypes[k] for k in names]).reshape(-1, DIMENSIONS)
    known = (known / np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-12)).T.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in C.groups(batches):
            rows = part.num_rows
            text, code, count, letters = trigrams(texts)
            vector = np.zeros((rows, DIMENSIONS), np.float32)
            seen, place = np.unique(code, return_inverse=True)
            for at in range(0, len(seen), 4096):
                mine = (place >= at) & (place < at + 4096)
                dense = np.zeros((rows, len(seen[at : at + 4096])), np.float32)
                dense[text[mine], place[mine] - at] = count[mine]
                vector += dense @ trigram_vectors(seen[at : at + 4096]).astype(np.float32)
            guess, score = np.full(rows, "und", object), np.zeros(rows)
            if names:
                vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
                vector -= prototypes[None].astype(np.float32)
                cosine = (vector @ known) / np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
                best = cosine.argmax(1)
                guess[letters] = np.array(names, object)[best][letters]
                score[letters] = np.clip((1 + cosine.max(1)) / 2, 0, 1)[letters]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(guess, pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, prototypes: dict[str | None, np.ndarray] | Table) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``.

    With a table of prototypes each scan compares the texts with a part of them, and a text's best guesses meet by its
    digest; of equal cosines the first language counts.
    """
    C.small_batches(docs.sparkSession)
    given, schema = C.id_text(docs), "doc_id long, lang_pred string, score double"
    if isinstance(prototypes, dict):
        return given.mapInArrow(_predict(prototypes), schema)
    parts = -(-2 * prototypes.n // LANGUAGES)  # by hash, so about half full
    digest = F.sha2("text", 256)
    mark, found = C.made(), []
    for k in range(parts):
        some = {None: prototypes.mean} | {lang: v - prototypes.mean for lang, v in _collected(prototypes.vectors.where(F.pmod(F.xxhash64("lang"), F.lit(parts)) == k)).items()}
        found.append(C.materialize(given.select(digest.alias("doc_id"), "text").mapInArrow(_predict(some), "doc_id string, lang_pred string, score double").distinct(), "guesses"))
    best = reduce(DataFrame.union, found).groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("rank"), "lang_pred", "score")).alias("best")).withColumnRenamed("doc_id", "digest")
    out = given.join(C.materialize(best, "guesses"), digest == F.col("digest")).select("doc_id", "best.lang_pred", "best.score")
    C.release(mark, [out])
    return out
