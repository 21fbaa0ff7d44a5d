"""Shared machinery of the corpus operators: shared-folder tables, ragged text batches, vectorised word hashing.

Words are maximal runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return.  All
hashing is vectorised over Arrow buffers: a batch of texts becomes one byte array, words are hashed eight bytes at a
time, and a window of words from the hashes of its halves.  Every step goes through a mixing function that isn't
linear, so regular texts don't collide by construction; what is left is the chance of two equal 64-bit numbers.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Texts are handled in groups of about this many bytes, so that the scratch arrays stay in cache.
GROUP_BYTES = 1 << 20
#: A word or line longer than this is hashed by blake2b instead of eight bytes at a time.
LONG_SPAN = 256
#: Arrow batches end at about this many bytes.
BATCH_BYTES = 32 << 20
SPACES = (32, 9, 10, 11, 12, 13)


# ---------------------------------------------------------------- shared folder

#: Tables made so far: (session, path), in order.
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode only, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = spark.conf.get("spark.reelquery.scratch", None)
    if not made:
        made = "file://" + tempfile.mkdtemp(prefix="reelquery-")
        spark.conf.set("spark.reelquery.scratch", made)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone already
            return


class Scope:
    """The tables that one operator makes; scopes nest, and other threads have their own."""

    def __init__(self, parent: Scope | None):
        self.parent, self.tables = parent, []


_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


def made() -> Scope:
    """Open a scope for ``release``: it holds the tables made from now on."""
    scope = Scope(_scope.get())
    _scope.set(scope)
    return scope


def _read(df: DataFrame) -> str:
    """The folders that a result reads, from its plan's leaves; no file is listed."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = [leaves.apply(k) for k in range(leaves.size())]
    return " ".join(x.relation().location().rootPaths().mkString(" ") for x in found if x.getClass().getSimpleName() == "LogicalRelation")


def release(scope: Scope, still_read: list[DataFrame]) -> None:
    """Close a scope and delete its tables, except those that the given results still read; these go to the scope around."""
    _scope.set(scope.parent)
    plans = " ".join(map(_read, still_read))
    for table in scope.tables:
        if table[1].rpartition("/")[2] in plans:
            if scope.parent is not None:
                scope.parent.tables.append(table)
        else:
            _delete(*table)
            _made.remove(table)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    if not _made:
        atexit.register(_remove_all)
    path = f"{shared_dir(spark)}/reelquery/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    if (scope := _scope.get()) is not None:
        scope.tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df``, of about ``rows`` rows at most, in tasks of about ``each`` rows and at least one a core.

    So a small table isn't written by hundreds of tasks; a large one keeps the partitions that it has.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, because one row can hold a very long text; workers get this package's sources."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), so that no other column of ``docs`` can clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(column: str, folds: int) -> Column:
    """crc32 of an id as text, modulo ``folds`` (null id: the empty string's)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


# ---------------------------------------------------------------- ragged batches

class Texts(NamedTuple):
    data: np.ndarray  # uint8, all texts end to end
    offsets: np.ndarray  # int64, one more than there are texts


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return Texts(data, off - off[0])


def groups(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches whose texts hold about ``most`` bytes, a longer text alone."""
    for batch in batches:
        off = texts_of(batch.column(batch.schema.get_field_index(column))).offsets
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            part = batch.slice(at, to - at)
            yield part, texts_of(part.column(part.schema.get_field_index(column)))
            at = to


# ---------------------------------------------------------------- hashing

def splitmix(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.isin(np.arange(256), SPACES)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers that tell the two parts of a window apart.
_LEFT, _OVERLAP = np.uint64(0x9E3779B97F4A7C17), np.uint64(0xD6E8FEB86659FD93)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, exact bytes; spans of up to eight bytes never collide with others of their length."""
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    left = size.copy()
    at, place = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), start
    while len(at):
        chunk, n = eight[place[at]], left[at]
        part = np.flatnonzero(n < 8)
        chunk[part] &= (np.uint64(1) << (8 * n[part]).astype(np.uint64)) - np.uint64(1)
        out[at] = mix(out[at] ^ chunk)
        at = at[n > 8]
        if len(at):
            left, place = left - 8, place + 8
    long = np.flatnonzero(size > LONG_SPAN)
    if len(long):
        raw = data.tobytes()
        out[long] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


class Words(NamedTuple):
    hash: np.ndarray  # uint64
    start: np.ndarray  # byte offset in the group
    end: np.ndarray
    first: np.ndarray  # for each text, its first word; one more entry at the end


def word_table(texts: Texts, lower: bool = False) -> Words:
    """All words of a group of texts, with 64-bit hashes; ``lower`` folds A-Z only."""
    data, off = texts
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64))
    inside = ~_IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    start = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return Words(span_hash(_LOWER[data] if lower else data, start, end), start, end, np.searchsorted(start, off))


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` words that start at each word with as many words from it on."""
    if len(hashes) < length:
        return hashes[:0]
    out, n = hashes, 1
    while 2 * n <= length:
        out = mix(out[:-n] * _LEFT + out[n:])
        n *= 2
    rest = length - n
    return mix(out[:-rest] * _OVERLAP + out[rest:]) if rest else out


def window_starts(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``length`` words within one text, and the text of each."""
    count = np.diff(words.first)
    n = np.maximum(count - length + 1, 0)
    text = np.repeat(np.arange(len(count)), n)
    begin = np.concatenate(([0], np.cumsum(n)))[:-1]
    return np.arange(int(n.sum())) - begin[text] + words.first[:-1][text], text


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle, by text; a text of fewer words is one shingle, a text without words has none."""
    at, text = window_starts(words, size)
    hashed = windows(words.hash, size)[at]
    count = np.diff(words.first)
    if not ((count > 0) & (count < size)).any():
        return hashed, text
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        one = windows(words.hash, n)[words.first[:-1][short]]
        hashed = np.concatenate((hashed, mix(one + np.uint64(n))))
        text = np.concatenate((text, short))
    order = np.argsort(text, kind="stable")
    return hashed[order], text[order]


def distinct(hashed: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text) pairs, sorted by text, then hash; ``text`` ascends."""
    hashed = hashed.copy()
    edge = np.concatenate(([0], np.flatnonzero(text[1:] != text[:-1]) + 1, [len(text)])).tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        hashed[a:b].sort()
    keep = np.ones(len(hashed), bool)
    keep[1:] = (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])
    return hashed[keep], text[keep]


def unique(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting (numpy's own hash table is many times slower on large arrays)."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values).cast(kind) if values.dtype != np.uint64 else pa.array(values.view(np.int64)))
