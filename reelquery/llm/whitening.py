"""Embedding whitening: a tiled covariance over distinct rows, its leading eigenvectors, and every row projected on them.

Vectors become whole numbers (floor of 256 times each entry), so that equal rows are recognised exactly.  The distinct ones
are cut into blocks of rows and, across, into blocks of dimensions; each pair of dimension blocks is a tile.  Column blocks
are shuffled by tile and row block; a task multiplies the centred blocks that meet and keeps one sum per tile, and these
are added entry by entry.  Only the assembled matrix (the square of the vectors' width, whatever the number of rows)
reaches the driver, where it is decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Dimensions of a column block, rows of a row block.
TILE, ROWS = 32, 4096
#: An eigenvalue up to this share of the largest is no more than rounding, and its component isn't returned.
LEAST_SHARE = 1e-12
MOST_LONG = float(2**63)


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Without the rows whose vector is null or holds null or non-finite entries."""
    wrong = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return rows.where(F.col(column).isNotNull() & ~F.coalesce(F.exists(column, wrong), F.lit(True)))


def whole(column: str = "embedding"):
    """floor(256 c) of every entry, as long."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * 256).cast("long"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` whole numbers; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), flat.dtype)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Whitening(NamedTuple):
    n: int  # distinct rows
    sums: np.ndarray  # long, by dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    trace: float
    error: float  # largest absolute entry of the whitened rows' covariance minus the identity


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """The number of distinct rows and their sum by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, np.int64)
        for b in batches:
            column = b.column(0)
            width = max(int(np.diff(column.offsets.to_numpy()).max(initial=0)), len(total))
            total = np.concatenate((total, np.zeros(width - len(total), np.int64)))
            part = matrix(column, width)
            if (np.abs(total.astype(float)) + np.abs(part.astype(float)).sum(0)).max(initial=0) >= MOST_LONG:
                raise OverflowError("sums of a dimension don't fit into 64 bits")
            total += part.sum(0)
            n += b.num_rows
        # Dimension -1 carries the rows.
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array(np.concatenate(([n], total)), pa.int64())], ["pos", "s"])

    found = {r.pos: r.s for r in fit.mapInArrow(run, "pos int, s long").groupBy("pos").agg(F.sum("s").alias("s")).collect()}
    return found.get(-1, 0), np.array([found[k] for k in range(len(found) - 1)], np.int64)


def covariance(fit: DataFrame, n: int, sums: np.ndarray, tile: int = TILE, rows: int = ROWS) -> np.ndarray:
    """The covariance of the distinct rows ``fit`` (x), divisor n, through tiles of ``tile`` by ``tile`` dimensions."""
    width = len(sums)
    k = -(-width // tile)
    mean = sums / max(n, 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every column block of each row block, once for each tile that it takes part in."""
        for b in batches:
            for at in range(0, b.num_rows, rows):
                x = matrix(b.column(0).slice(at, rows), width)
                small = x.astype(np.int16) if len(x) and np.abs(x).max(initial=0) < 1 << 15 else x
                # The block's own bytes name it: a task that runs again names it alike.
                block = int.from_bytes(C.hashlib.blake2b(np.ascontiguousarray(small).tobytes(), digest_size=8).digest(), "little", signed=True)
                raw = [np.ascontiguousarray(small[:, c * tile : (c + 1) * tile]).tobytes() for c in range(k)]
                keys = [(a, c, side) for a in range(k) for c in range(a, k) for side in range(1 + (a < c))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in keys], pa.int32()), pa.array([x[1] for x in keys], pa.int32()), pa.array([block] * len(keys), pa.int64()), pa.array([x[2] for x in keys], pa.int32()), pa.array([small.dtype.itemsize] * len(keys), pa.int32()), pa.array([raw[x[x[2]]] for x in keys], pa.binary())],
                    ["a", "b", "block", "side", "bytes", "raw"],
                )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One sum of products for each tile of the task; rows come by tile, block and side."""
        now, total, left = None, None, None

        def told() -> pa.RecordBatch:
            flat = total.ravel()
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(flat), pa.int32()), pa.array([now[1]] * len(flat), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["a", "b", "pos", "v"])

        for batch in batches:
            for a, b, side, size, raw in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), batch.column(5), strict=True):
                if (a, b) != now:
                    if now is not None:
                        yield told()
                    now, total = (a, b), np.zeros((min(tile, width - a * tile), min(tile, width - b * tile)))
                own = (a, b)[side]
                wide = min(tile, width - own * tile)
                x = np.frombuffer(raw.as_buffer(), np.int16 if size == 2 else np.int64).reshape(-1, wide) - mean[own * tile : own * tile + wide]
                if a == b:
                    total += x.T @ x
                elif side == 0:
                    left = x
                else:
                    total += left.T @ x
        if now is not None:
            yield told()

    blocks = fit.mapInArrow(cut, "a int, b int, block long, side int, bytes int, raw binary")
    met = blocks.repartition("a", "b", "block").sortWithinPartitions("a", "b", "block", "side")
    tiles = met.mapInArrow(multiply, "a int, b int, pos int, v double").groupBy("a", "b", "pos").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in tiles.toPandas().itertuples():
        i, j = divmod(r.pos, min(tile, width - r.b * tile))
        out[r.a * tile + i, r.b * tile + j] = out[r.b * tile + j, r.a * tile + i] = r.v / n
    return out


def _identity_error(fit: DataFrame, w: Whitening) -> float:
    """How far the covariance of the whitened distinct rows is from the identity."""
    k, project = len(w.values), w.vectors / np.sqrt(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            y = (matrix(b.column(0), len(w.sums)) - w.sums / w.n) @ project
            y = np.column_stack((np.ones(len(y)), y))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["pos", "v"])

    found = dict(map(tuple, fit.mapInArrow(run, "pos int, v double").groupBy("pos").agg(F.sum("v")).collect()))
    total = np.array([found[p] for p in range((k + 1) ** 2)]).reshape(k + 1, k + 1) / w.n
    return float(np.abs(total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(k)).max())


def fit(rows: DataFrame, column: str = "embedding", most: int = 4, tile: int = TILE, block: int = ROWS) -> Whitening | None:
    """The ``most`` leading components of the distinct usable rows; None if these don't vary or there are none."""
    scope = C.made()
    C.small_batches(rows.sparkSession, block)
    distinct = C.materialize(usable(rows, column).select(whole(column).alias("x")).distinct(), "whole-vectors")
    n, sums = _sums(distinct)
    out = None
    if n and len(sums):
        cov = covariance(distinct, n, sums, tile, block)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[:most]
        order = order[values[order] > LEAST_SHARE * max(values.max(), 0.0)]
        if len(order):
            out = Whitening(n, sums, values[order], vectors[:, order], float(np.trace(cov)), 0.0)
            out = out._replace(error=_identity_error(distinct, out))
    C.release(scope, [])
    return out


def transform(rows: DataFrame, w: Whitening | None, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    C.small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, k = w.vectors / np.sqrt(w.values), len(w.values)
        for b in batches:
            x = matrix(b.column(1), len(w.sums))
            wide = np.abs(x.astype(float)) * w.n + np.abs(w.sums.astype(float))
            if wide.max(initial=0) >= MOST_LONG or (wide**2).sum(1).max(initial=0) >= 4 * MOST_LONG and ((x.astype(float) * w.n - w.sums) ** 2).sum(1).max() >= MOST_LONG:
                raise OverflowError("a deviation doesn't fit into 64 bits")
            off = x * w.n - w.sums
            times = np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1), b.num_rows), pa.int32()), pa.array(np.full(len(times), w.n)), pa.array((off * off).sum(1)[times]), pa.array(((x - w.sums / w.n) @ project).ravel()), pa.array(np.tile(w.values / w.trace, b.num_rows)), pa.array(np.full(len(times), w.error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    if w is None:
        return rows.sparkSession.createDataFrame([], schema)
    return usable(rows, column).select(key, whole(column).alias("x")).mapInArrow(run, schema)


def whiten(rows: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = 4) -> DataFrame:
    """Every usable row on the leading components of all distinct ones.

    Rows whose vector is null or holds null or non-finite entries are left out; a null or repeated id is kept, each row on
    its own.  Vectors shorter than the longest end in zeros.  Equal whole vectors count once in the fit.  Components
    without variance aren't returned: none for a table that is empty or holds one distinct vector only, fewer than ``most``
    where the rows span fewer dimensions.  Sums or deviations beyond 64 bits fail the job.  Other columns are ignored.
    """
    return transform(rows, fit(rows, column, most), column, key)
