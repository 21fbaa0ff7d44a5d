"""Stupid-backoff language-model scores (operator 6), relationally.

The n-gram count table is partitioned by hash and joined to the n-grams exploded from the documents; both are packed:

1. documents become blocks of about ``BLOCK_BYTES`` of text, one row each: the words' hashes and the text as numbers
   into them;
2. each block sends its distinct n-grams of all orders, sorted by hash and cut into ranges of hashes (buckets), with the
   block's own counts; a bucket is one partition of the count table;
3. in each bucket the counts of equal n-grams are added up and joined back to the blocks' n-grams, of which only the
   counts return, in the order sent;
4. blocks meet their counts again, score every word and sum by document.

A common n-gram is one entry per block, so no key is hot: buckets are even and blocks bounded.  Traffic is about six
bytes for each distinct n-gram of a block.  A bucket holds about ``BUCKET_TOKENS`` entries at any size of the corpus.

The more buckets, the fewer n-grams of a block are in each.  Where a row of a block would hold less than ``ROW_GRAMS``,
blocks send to fewer, wider ranges instead, and step 3 gets a level between: the runs of a few blocks in a range meet in
a cell, which sends their distinct n-grams on to the buckets as one block would, and answers its blocks from the counts
that come back.  So rows stay long: a block's hold ``ROW_GRAMS``, a cell's its ``CELL_TOKENS`` over the buckets of a range.

Counts leave one out: a document is scored by what the other rows hold, numerator and denominator alike.  A word after
m known context words (at most ``order`` - 1) takes the longest n-gram found elsewhere:
backoff**(m + 1 - k) * count(n-gram of k words) / count(its first k - 1 words), where no words stand for all words.  A
word that occurs nowhere else takes backoff**(m + 1) / (all other rows' words, at least 1).

Edge cases: null and empty texts, and texts without words, have no words and score 0; rows that repeat a doc_id are
scored one by one, as are rows with null doc_id; exact copies see each other; a single document scores by the last
rule alone; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BACKOFF = 0.4
ORDER = 3
#: Text of one block, and n-grams of one bucket, both bounds of a task's memory.
BLOCK_BYTES, BUCKET_TOKENS = 16 << 20, 4_000_000
#: N-grams that a block sends in one row at least, on average, and of one cell.
ROW_GRAMS, CELL_TOKENS = 256, 1_000_000
#: Ranges of hashes that a block's n-grams are sorted in, one after the other (a power of two).
PARTS = 4
#: Words that are scored at once.
SLICE_WORDS = 1 << 18
#: The hash of the n-gram without words, whose count is that of all words.
NOTHING = 0x5851F42D4C957F2D

_BLOCK = "block long not null, digest binary, doc_id array<long>, size array<long>, vocabulary binary, ids binary"


# ---------------------------------------------------------------- packed numbers

def _planes(values: np.ndarray) -> tuple[int, np.ndarray]:
    """The fewest bytes that hold every value, and the values byte by byte: all lowest bytes first."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return width, np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _unplanes(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((raw.size // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.view("<u8").ravel()


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    width, planes = _planes(values)
    return bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpack_numbers(raw: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.uint64)
    return _unplanes(np.frombuffer(pa.decompress(raw[1:], count * raw[0], "zstd", asbytes=True), np.uint8), raw[0])


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending hashes as the first and the differences; only the highest byte plane of these has a pattern to compress."""
    width, planes = _planes(np.diff(values, prepend=values[:1]))
    return bytes([width]) + values[:1].tobytes() + planes[:-1].tobytes() + pa.compress(planes[-1].tobytes(), "zstd", asbytes=True)


def unpack_sorted(raw: bytes, count: int) -> np.ndarray:
    width, low = raw[0], 9 + (raw[0] - 1) * count
    both = raw[9:low] + pa.decompress(raw[low:], count, "zstd", asbytes=True)
    return np.cumsum(_unplanes(np.frombuffer(both, np.uint8), width), dtype=np.uint64) + np.frombuffer(raw[1:9], np.uint64)


def ordered(hashes: np.ndarray) -> np.ndarray:
    """The stable order of hashes: one sort of (leading bits, place), then the few places where these don't decide."""
    bits = max(1, len(hashes).bit_length())
    place = np.uint64((1 << bits) - 1)
    packed = hashes & ~place
    packed |= np.arange(len(hashes), dtype=np.uint64)
    packed.sort()
    order = (packed & place).astype(np.int64)
    lead = packed >> np.uint64(bits)
    found = hashes[order]
    wrong = np.flatnonzero((lead[1:] == lead[:-1]) & (found[1:] != found[:-1]))
    if len(wrong):
        runs = np.flatnonzero(np.isin(lead, lead[wrong]))
        order[runs] = order[runs][np.argsort(found[runs], kind="stable")]
    return order


# ---------------------------------------------------------------- steps

def _pooled(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches laid together until their texts hold ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        for part, texts in C.groups(iter([batch]), most=most):
            if held and size + len(texts.data) > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += len(texts.data)
    if held:
        yield pa.Table.from_batches(held)


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, table in enumerate(_pooled(batches, most)):
            hashes, sizes = [], []
            for _, texts in C.groups(iter(table.to_batches())):
                words = C.word_table(texts, lower=True)
                hashes.append(words.hash)
                sizes.append(np.diff(words.first))
            hashed, size = np.concatenate(hashes), np.concatenate(sizes)
            order = ordered(hashed)
            new = np.ones(len(hashed), bool)
            new[1:] = hashed[order][1:] != hashed[order][:-1]
            group = np.cumsum(new) - 1
            rank = np.argsort(-np.bincount(group)) if len(group) else group  # common words get small numbers, which compress
            number = np.empty(len(rank), np.int64)
            number[rank] = np.arange(len(rank))
            ids = np.empty(len(hashed), np.uint64)
            ids[order] = number[group]
            vocabulary, packed = hashed[order][new][rank].tobytes(), pack_numbers(ids)
            digest = hashlib.blake2b(vocabulary + packed + size.tobytes(), digest_size=8).digest()
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + k]), pa.array([digest]), pa.array([table.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([size.tolist()], pa.list_(pa.int64())), pa.array([vocabulary]), pa.array([packed])],
                names=["block", "digest", "doc_id", "size", "vocabulary", "ids"],
            )

    return run


def _words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words of each row) of a block."""
    size = np.array(row["size"], np.int64)
    return np.frombuffer(row["vocabulary"], np.uint64)[unpack_numbers(row["ids"], int(size.sum())).astype(np.int64)], size


def _starts(size: np.ndarray, k: int) -> np.ndarray:
    """Where the n-grams of k words start that lie within one row."""
    n = np.maximum(size - k + 1, 0)
    begin = np.cumsum(size) - size
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begin, n)


def _grams(hashed: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every n-gram of k words."""
    at = _starts(size, k)
    return at, C.mix(C.windows(hashed, k)[at] + np.uint64(k))


def _slices(size: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first word, end word) of runs of rows with about ``SLICE_WORDS`` words, a longer row alone."""
    edge = np.concatenate(([0], np.cumsum(size)))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + SLICE_WORDS, "right")) - 1)
        yield at, to, int(edge[at]), int(edge[to])
        at = to


def _sorted_grams(hashed: np.ndarray, size: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """All n-grams of a block in order of their hashes, and the one without words once, in ``PARTS`` equal ranges of hashes:
    hashing again is cheaper than holding them all."""
    for part in range(PARTS):
        mine = [np.full(1, NOTHING, np.uint64)[: NOTHING * PARTS >> 64 == part]]
        for at, to, a, z in _slices(size):
            for k in range(1, order + 1):
                grams = _grams(hashed[a:z], size[at:to], k)[1]
                mine.append(grams[(grams >> np.uint64(64 - PARTS.bit_length() + 1)) == part])
        each = np.concatenate(mine)
        del mine
        each.sort()
        yield each


def _starts_new(each: np.ndarray) -> np.ndarray:
    new = np.ones(len(each), bool)
    np.not_equal(each[1:], each[:-1], out=new[1:])
    return new


def _distinct(hashed: np.ndarray, size: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct n-grams of a block in order of their hashes, with their counts, by ranges; one is that of all words."""
    for each in _sorted_grams(hashed, size, order):
        at = np.flatnonzero(_starts_new(each))
        found, count = each[at], np.diff(at, append=len(each))
        all_words = int(np.searchsorted(found, np.uint64(NOTHING)))
        if all_words < len(found) and found[all_words] == NOTHING:
            count[all_words] += len(hashed) - 1
        yield found, count


def _edges(buckets: int) -> np.ndarray:
    """The first hash of each bucket but the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def _send(order: int, buckets: int):
    def packed(row: dict, some: list[tuple[int, int, int]], found: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(some), 16):
            part = some[k : k + 16]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _, _ in part], pa.int32()),
                    pa.array([row["block"]] * len(part)),
                    pa.array([row["digest"]] * len(part)),
                    pa.array([z - a for _, a, z in part]),
                    pa.array([pack_sorted(found[a:z]) for _, a, z in part]),
                    pa.array([pack_numbers(count[a:z]) for _, a, z in part]),
                ],
                names=["bucket", "block", "digest", "n", "grams", "counts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(buckets)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                for part, (found, count) in enumerate(_distinct(*_words(row), order)):
                    first = part * buckets // PARTS
                    own = range(first, first + buckets // PARTS)
                    cut = [0, *np.searchsorted(found, edges[own[0] : own[-1]]).tolist(), len(found)]
                    yield from packed(row, [(b, x, z) for b, x, z in zip(own, cut[:-1], cut[1:], strict=True) if x < z], found, count)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each bucket, next to each other, to the same n-grams' counts over all blocks."""
    held: list[dict] = []

    def totals() -> Iterator[pa.RecordBatch]:
        grams = np.concatenate([unpack_sorted(r["grams"], r["n"]) for r in held])
        own = np.concatenate([unpack_numbers(r["counts"], r["n"]) for r in held])
        order = ordered(grams)
        grams = grams[order]
        at = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        all_ = np.empty(len(grams), np.uint64)
        all_[order] = np.repeat(np.add.reduceat(own[order], at), np.diff(at, append=len(grams)))
        end = np.cumsum([r["n"] for r in held])
        packed = [pack_numbers(all_[z - r["n"] : z]) for r, z in zip(held, end.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r["block"] for r in held]), pa.array([r["digest"] for r in held]), pa.array([r["bucket"] for r in held], pa.int32()), pa.array([r["n"] for r in held]), pa.array(packed)], names=["block", "digest", "bucket", "n", "counts"])

    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield from totals()
                held = []
            held.append(row)
    if held:
        yield from totals()


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each cell, which come next to each other."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["cell"] != row["cell"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _cell(runs: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, bytes]:
    """(the n-grams of each run, the distinct ones of all in order, their counts over the runs, a digest of both)."""
    each = [unpack_sorted(r["grams"], r["n"]) for r in runs]
    grams, own = np.concatenate(each), np.concatenate([unpack_numbers(r["counts"], r["n"]) for r in runs])
    order = ordered(grams)
    grams = grams[order]
    at = np.flatnonzero(_starts_new(grams))
    found, count = grams[at], np.add.reduceat(own[order], at)
    return each, found, count, hashlib.blake2b(found.tobytes() + count.tobytes(), digest_size=8).digest()


def _merge(ranges: int, fine: int):
    """The runs of each cell as one: its distinct n-grams with their counts, cut into the ``fine`` buckets of its range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _by_cell(batches):
            _, found, count, digest = _cell(runs)
            first = runs[0]["bucket"] * fine
            edges = np.array([((first + k) << 64) // (ranges * fine) for k in range(1, fine)], np.uint64)
            cut = [0, *np.searchsorted(found, edges).tolist(), len(found)]
            some = [(first + k, a, z) for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < z]
            for k in range(0, len(some), 16):
                part = some[k : k + 16]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in part], pa.int32()), pa.array([runs[0]["cell"]] * len(part)), pa.array([digest] * len(part)), pa.array([z - a for _, a, z in part]), pa.array([pack_sorted(found[a:z]) for _, a, z in part]), pa.array([pack_numbers(count[a:z]) for _, a, z in part])],
                    names=["bucket", "block", "digest", "n", "grams", "counts"],
                )

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of a cell, the counts of its n-grams over all blocks; a cell's runs come first, then its buckets in order."""
    for rows in _by_cell(batches):
        runs, back = [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1]
        each, found, _, digest = _cell(runs)
        total = np.concatenate([unpack_numbers(r["counts"], r["n"]) for r in back])
        if len(total) != len(found) or any(r["digest"] != digest for r in back):
            raise RuntimeError("the documents changed between two reads; write them to a table first")
        for r, grams in zip(runs, each, strict=True):
            counts = pack_numbers(total[np.searchsorted(found, grams)])
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([r["digest"]]), pa.array([r["bucket"]], pa.int32()), pa.array([r["n"]]), pa.array([counts])], names=["block", "digest", "bucket", "n", "counts"])


def _elsewhere(hashed: np.ndarray, row_of: np.ndarray, found: np.ndarray, total: np.ndarray) -> np.ndarray:
    """For each n-gram (by row, then place), how often it occurs outside its own row."""
    order = ordered(hashed)
    sorted_, row = hashed[order], row_of[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    run = new | np.concatenate(([True], row[1:] != row[:-1]))  # places ascend within a group, so rows do too
    at = np.flatnonzero(run)
    own = np.diff(at, append=len(row))
    group = np.flatnonzero(new)
    everywhere = np.repeat(total[np.searchsorted(found, sorted_[group])].astype(np.int64), np.diff(group, append=len(row)))
    out = np.empty(len(row), np.int64)
    out[order] = everywhere - np.repeat(own, own)
    return out


def _scored(hashed: np.ndarray, size: np.ndarray, found: np.ndarray, total: np.ndarray, order: int, backoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n_known, n_full, log_score) of some rows, by the block's n-grams and their counts everywhere."""
    rows, n = len(size), len(hashed)
    others = np.maximum(int(total[np.searchsorted(found, np.uint64(NOTHING))]) - size, 0)
    row_of = np.repeat(np.arange(rows), size)
    context = np.minimum(np.arange(n) - np.repeat(np.cumsum(size) - size, size), order - 1)
    levels = np.zeros(n, np.int64)  # words of the n-gram found
    score = -np.log(np.maximum(others, 1).astype(float))[row_of]
    before = others[row_of]  # of the n-gram without its last word, by the last word's place
    for k in range(1, order + 1):
        at, grams = _grams(hashed, size, k)
        here = np.zeros(n, np.int64)
        if len(at):
            here[at + k - 1] = _elsewhere(grams, row_of[at], found, total)
        known = np.flatnonzero(here > 0)
        score[known] = np.log(here[known]) - np.log(before[known])
        levels[known] = k
        before = np.zeros(n, np.int64)
        before[1:] = here[:-1]
    score += (context + 1 - levels) * np.log(backoff)
    by_row = lambda x: np.bincount(row_of, x, rows)
    return by_row(levels > 1).astype(np.int64), by_row(levels == order).astype(np.int64), by_row(score)


def _finish(order: int, backoff: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                back = sorted(row["back"], key=lambda x: x["bucket"])
                hashed, size = _words(row)
                length = sum(x["n"] for x in back)
                found, total, n = np.empty(length, np.uint64), np.empty(length, np.uint64), 0
                for each in _sorted_grams(hashed, size, order):
                    mine = each[_starts_new(each)]
                    found[n : n + len(mine)] = mine[: max(0, length - n)]
                    n += len(mine)
                if n != length or any(x["digest"] != row["digest"] for x in back):
                    raise RuntimeError("the documents changed between two reads; write them to a table first")
                n = 0
                for x in back:
                    total[n : n + x["n"]] = unpack_numbers(x["counts"], x["n"])
                    n += x["n"]
                for at, to, a, z in _slices(size):  # counts are by row, so a block's rows can be scored in slices
                    known, full, score = _scored(hashed[a:z], size[at:to], found, total, order, backoff)
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"][at:to], pa.int64()), pa.array(size[at:to]), pa.array(known), pa.array(full), pa.array(score)], names=["doc_id", "n_words", "n_known", "n_full", "log_score"])

    return run


def _layout(size: int, order: int, block_bytes: int, bucket_tokens: int, row_grams: int, cell_tokens: int, least: int) -> tuple[int, int, int]:
    """(ranges that a block sends to, buckets of each range, groups of blocks that share cells) for ``size`` bytes of text."""
    # about six bytes a word, and each order adds a number of n-grams below that of the words
    buckets = -(-max(least, size * order // (6 * bucket_tokens) + 1) // PARTS) * PARTS
    ranges = min(buckets, max(PARTS, block_bytes * order // (6 * row_grams) // PARTS * PARTS))
    return ranges, -(-buckets // ranges), max(1, size // block_bytes * row_grams // cell_tokens)


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS, row_grams: int = ROW_GRAMS, cell_tokens: int = CELL_TOKENS) -> DataFrame:
    """doc_id, n_words, n_known (found with a word of context or more), n_full (found with all ``order`` words), log_score
    and mean_log (per word; 0 without words) for every row."""
    if order < 1 or not 0 < backoff <= 1:
        raise ValueError("an order of 1 or more and a backoff above 0, at most 1")
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = C.id_text(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, fine, groups = _layout(size, order, block_bytes, bucket_tokens, row_grams, cell_tokens, spark.sparkContext.defaultParallelism)
    blocks = docs.mapInArrow(_blocks(block_bytes), _BLOCK).repartition("block")
    run, answer = "bucket int, block long, digest binary, n long, grams binary, counts binary", "block long not null, digest binary, bucket int, n long, counts binary"
    sent = blocks.mapInArrow(_send(order, ranges), run)
    if fine == 1:
        counted = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, answer)
    else:
        cells = sent.withColumn("cell", F.col("bucket") * F.lit(groups).cast("long") + F.pmod(F.xxhash64("block"), F.lit(groups)))
        merged = cells.repartition("cell").sortWithinPartitions("cell", "block").mapInArrow(_merge(ranges, fine), run)
        totals = merged.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, answer)
        runs = cells.select("cell", F.lit(0).alias("kind"), "bucket", "block", "digest", "n", "grams", "counts")
        back = totals.select(F.col("block").alias("cell"), F.lit(1), "bucket", F.lit(None).cast("long"), "digest", "n", F.lit(None).cast("binary"), "counts")
        counted = runs.union(back).repartition("cell").sortWithinPartitions("cell", "kind", "bucket", "block").mapInArrow(_answer, answer)
    back = counted.groupBy("block").agg(F.collect_list(F.struct("digest", "bucket", "n", "counts")).alias("back"))
    out = blocks.join(back.hint("merge"), "block").mapInArrow(_finish(order, backoff), "doc_id long, n_words long, n_known long, n_full long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    return out.select("doc_id", "n_words", "n_known", "n_full", F.round("log_score", 3).alias("log_score"), F.round(mean, 6).alias("mean_log"))
