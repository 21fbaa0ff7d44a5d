"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3).

A short test item hides in a long document: their similarity is tiny, so documents are cut into overlapping windows of
the item's size class.  Class k holds items of 2**k to 2**(k+1)-1 shingles; its windows are three blocks of 2**k
document shingles, one block apart.  A contained item has similarity 0.25 or more with some window, so one of 48
one-row bands matches with a miss probability below 1e-6; and an item whose shingles are scattered over the document
meets the same expected number of matches over all windows.  Every candidate is verified exactly: the share of the
item's distinct five-word shingles (A-Z folded) that the whole document holds.

The items are the stated query set: tasks turn them into sets, equal sets become one, and they go to all document rows
in blocks of at most ``BLOCK`` shingles.  At most ``AT_ONCE`` blocks are broadcast at a time; further ones follow when
the results of these are written and their broadcasts freed, so memory is bounded whatever the benchmark's size.
Documents are never shuffled.

Edge cases: a null or empty text matches nothing; an item or document of fewer than five words is one shingle; rows
that repeat a doc_id or item_id are reported once for each distinct pair and count; ids may be null; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HASHES = 48
#: Most shingles of one broadcast block of items (8 bytes each).
BLOCK = 500_000
#: Most blocks that are broadcast at a time.
AT_ONCE = 4


def _permute(x: np.ndarray, j: int, flip: np.ndarray, times: np.ndarray) -> np.ndarray:
    y = (x ^ flip[j]) * times[j]
    return y ^ (y >> np.uint32(15))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    return (C.splitmix(401, HASHES) >> np.uint64(32)).astype(np.uint32), (C.splitmix(402, HASHES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class _Index:
    """Minima of one block's items by size class and hash."""

    def __init__(self, sets: list[np.ndarray]):
        flip, times = _constants()
        self.sets = sets
        self.classes: dict[int, list] = {}
        for i, s in enumerate(sets):
            self.classes.setdefault(int(len(s)).bit_length() - 1, []).append(i)
        self.minima = {}
        for k, items in self.classes.items():
            each = np.concatenate([(sets[i] >> np.uint64(32)).astype(np.uint32) for i in items])
            first = np.cumsum([0, *(len(sets[i]) for i in items[:-1])])
            for j in range(HASHES):
                low = np.minimum.reduceat(_permute(each, j, flip, times), first)
                order = np.argsort(low, kind="stable")
                near = np.zeros(1 << 16, bool)
                near[low & 0xFFFF] = True
                self.minima[k, j] = low[order], np.array(items)[order], near


#: The indexes of the blocks that a worker met last, by the block's key.
_indexes: dict[str, _Index] = {}


def _index(held) -> tuple[list[list], _Index]:
    key, ids, sets = held.value
    if key not in _indexes:
        while len(_indexes) >= AT_ONCE:
            del _indexes[next(iter(_indexes))]
        _indexes[key] = _Index(sets)
    return ids, _indexes[key]


def _search(held: list, percent: int, size: int, form: str):
    """A scan over the blocks ``held`` (broadcasts): ``pairs`` reports, ``clean`` keeps the rows without a match, ``bad`` gives
    the digests (of a column after the text) of the others."""
    def candidates(index: _Index, x: np.ndarray, first: np.ndarray, rows: int) -> np.ndarray:
        """Distinct (text * items + item) with an equal minimum; ``first``: where each text's shingles begin."""
        flip, times = _constants()
        found = [np.zeros(0, np.int64)]
        shape = {}
        for k in index.classes:
            n = -(-np.diff(first) // (1 << k))  # blocks of each text
            text = np.repeat(np.arange(rows), n)
            rank = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            shape[k] = first[:-1][text] + (rank << k), text
        for j in range(HASHES):
            y = _permute(x, j, flip, times)
            for k in index.classes:
                starts, text = shape[k]
                low = np.minimum.reduceat(y, starts)
                for ahead in (1, 2):  # a window is this block and the next two of the same text
                    same = text[ahead:] == text[:-ahead]
                    if ahead == 1:
                        window = low.copy()
                    window[:-ahead] = np.where(same, np.minimum(window[:-ahead], low[ahead:]), window[:-ahead])
                values, items, near = index.minima[k, j]
                hit = np.flatnonzero(near[window & np.uint32(0xFFFF)])
                if len(hit):
                    at, to = np.searchsorted(values, window[hit], "left"), np.searchsorted(values, window[hit], "right")
                    n = to - at
                    which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - at, n)
                    found.append(C.unique(np.repeat(text[hit], n) * len(index.sets) + items[which]))
        return C.unique(np.concatenate(found))

    def matches(index: _Index, ids: list[list], rows: int, texts: C.Texts) -> list[tuple]:
        """(text, item id, item size, found) of the verified pairs."""
        hashed, text = C.shingles(C.word_table(texts, lower=True), size)
        if not len(hashed):
            return []
        first = np.searchsorted(text, np.arange(rows + 1))
        out = []
        doc, own = None, None
        for pair in candidates(index, (hashed >> np.uint64(32)).astype(np.uint32), first, rows).tolist():
            t, i = divmod(pair, len(index.sets))
            if t != doc:
                doc, own = t, C.unique(hashed[first[t] : first[t + 1]])
            mine = index.sets[i]
            n = int((own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine).sum())
            if 100 * n >= percent * len(mine):
                out += [(t, item, len(mine), n) for item in ids[i]]
        return out

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_index(h) for h in held]
        for part, texts in C.groups(batches):
            rows = [m for ids, index in blocks for m in matches(index, ids, part.num_rows, texts)]
            if rows:
                t, item, total, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t)), pa.array(item, pa.int64()), pa.array(total, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "n_item", "n_found"])

    def keeps(part: pa.RecordBatch, texts: C.Texts, blocks: list) -> np.ndarray:
        keep = np.ones(part.num_rows, bool)
        for ids, index in blocks:
            keep[[m[0] for m in matches(index, ids, part.num_rows, texts)]] = False
        return keep

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_index(h) for h in held]
        for part, texts in C.groups(batches):
            yield part.filter(pa.array(keeps(part, texts, blocks)))

    def bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_index(h) for h in held]
        for part, texts in C.groups(batches):
            yield part.select(["digest"]).filter(pa.array(~keeps(part, texts, blocks)))

    return {"pairs": report, "clean": clean, "bad": bad}[form]


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in C.groups(batches):
            hashed, text = C.distinct(*C.shingles(C.word_table(texts, lower=True), size))
            first = np.searchsorted(text, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hashed[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["item_id", "shingles"])

    return run


def _blocks(benchmark: DataFrame, size: int) -> Iterator[tuple[str, list[list], list[np.ndarray]]]:
    """(key, ids, sets) of the distinct items, a partition at a time, as blocks of at most ``BLOCK`` shingles."""
    items = C.id_text(benchmark.withColumn("doc_id", F.col("item_id"))).mapInArrow(_sets(size), "item_id long, shingles binary").where("length(shingles) > 0")
    ids: list[list] = []
    sets: list[np.ndarray] = []
    held = 0
    for row in items.groupBy("shingles").agg(F.collect_list("item_id").alias("ids"), F.count("*").alias("n")).toLocalIterator():
        s = np.frombuffer(row["shingles"], np.uint64)
        if sets and held + len(s) > BLOCK:
            yield uuid.uuid4().hex, ids, sets
            ids, sets, held = [], [], 0
        ids.append(row["ids"] + [None] * (row["n"] - len(row["ids"])))
        sets.append(s)
        held += len(s)
    if sets:
        yield uuid.uuid4().hex, ids, sets


def _by_few(blocks: Iterator[tuple]) -> Iterator[tuple[list[tuple], bool]]:
    """(at most ``AT_ONCE`` blocks, whether these are the last)."""
    few = list(islice(blocks, AT_ONCE))
    while few:
        more = list(islice(blocks, AT_ONCE))
        yield few, not more
        few = more


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """doc_id, item_id, n_item, n_found: every pair in which the document holds ``percent`` of the item's shingles."""
    spark = docs.sparkSession
    C.small_batches(spark)
    schema = "doc_id long, item_id long, n_item long, n_found long"
    found = []
    for few, last in _by_few(_blocks(benchmark, size)):
        held = [spark.sparkContext.broadcast(block) for block in few]
        some = C.id_text(docs).mapInArrow(_search(held, percent, size, "pairs"), schema)
        found.append(some if last else C.materialize(some, "contaminated"))
        for h in held if not last else ():
            h.unpersist()
    return reduce(DataFrame.union, found).distinct() if found else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that match no item; one scan for ``AT_ONCE`` blocks of items.

    The scans but the last give the digests of the texts that match, which the rows of the last scan then must not have;
    so the corpus is never written, and not shuffled either where one scan is enough.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    found: list[DataFrame] = []
    out = docs
    for few, last in _by_few(_blocks(benchmark, size)):
        held = [spark.sparkContext.broadcast(block) for block in few]
        if last:
            out = docs.mapInArrow(_search(held, percent, size, "clean"), docs.schema)
            break
        text = F.coalesce(F.col("text"), F.lit(""))
        given = docs.select(text.alias("text"), F.sha2(text, 256).alias("digest"))
        found.append(C.materialize(given.mapInArrow(_search(held, percent, size, "bad"), "digest string").distinct(), "decontaminated"))
        for h in held:
            h.unpersist()
    for digests in found:
        name = "_".join(["digest", *docs.columns])  # unlike any column
        out = out.join(digests.withColumnRenamed("digest", name), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256) == F.col(name), "left_anti")
    return out
