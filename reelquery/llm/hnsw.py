"""Nearest neighbours by inner product through hierarchical navigable small-world graphs, one per shard.

Distinct vectors are dealt to shards by their hash.  A shard's graph is built by one task: nodes enter in batches, from the
highest level down, each searching the graph that is there already; a node keeps neighbours that no closer neighbour
hides, and links back.  The neighbours of a level are one flat array.  Graphs are written as a table, a row each; queries
are dealt to all shards in blocks, the nodes that a graph finds are scored in double precision, and the best of all shards
are merged.

Inner products become distances on a sphere: a vector is divided by the longest of its shard and gets one more entry that
makes its length 1, while a query gets a zero; so order by distance is order by inner product whatever the lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .whitening import matrix, usable

#: Links of a node (twice as many on the lowest level), width of the search that builds and of the search that answers.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 24, 96, 224
#: Vectors of a shard on average, queries of a block, nodes that enter at once, nodes that a step of a search expands.
SHARD_ROWS, BLOCK, BATCH, STEP = 8192, 512, 256, 4


class Graph(NamedTuple):
    points: np.ndarray  # float32, unit length
    sizes: list[int]  # nodes of each level, from the lowest; a level's nodes are the first ones
    links: list[np.ndarray]  # for each level, its nodes' neighbours side by side, -1 where there are none


def levels(n: int, links: int = LINKS) -> list[int]:
    """How many nodes each level has, from the lowest: a 1/links part of the level below."""
    out = [n]
    while out[-1] > links:
        out.append(max(1, out[-1] // links))
    return out


def _distance(points: np.ndarray, queries: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
    return 1 - np.einsum("ij,ij->i", points[node], queries[row])


def beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of the ``width`` nearest found on a level from the given entries, nearest first; -1 and inf fill up.

    All queries go on together; a step expands the nearest few nodes that are still unexpanded among each one's best.
    """
    many = len(queries)
    seen = np.zeros((many, n), bool)
    best = np.full((many, width), -1)
    far = np.full((many, width), np.inf, np.float32)
    open_ = np.zeros((many, width), bool)
    row, col = np.nonzero(entry >= 0)
    first = entry[row, col]
    seen[row, first] = True
    best[row, col], far[row, col], open_[row, col] = first, _distance(points, queries, row, first), True
    active = np.arange(many)
    while len(active):
        ready = np.where(open_[active], far[active], np.inf)
        step = min(STEP, width)
        at = np.argpartition(ready, step - 1, 1)[:, :step] if step < width else np.tile(np.arange(width), (len(active), 1))
        good = np.isfinite(np.take_along_axis(ready, at, 1))
        r, c = np.nonzero(good)
        row, col = active[r], at[r, c]
        open_[row, col] = False
        near = links[best[row, col]]
        flat_row, flat = np.repeat(row, near.shape[1]), near.ravel()
        ok = flat >= 0
        flat_row, flat = flat_row[ok], flat[ok]
        ok = ~seen[flat_row, flat]
        key = C.unique(flat_row[ok] * n + flat[ok])
        flat_row, flat = key // n, key % n
        seen[flat_row, flat] = True
        d = _distance(points, queries, flat_row, flat).astype(np.float32)
        # What can't enter the best is left out at once.
        ok = d < far[flat_row].max(1) if width < 8 else d < far.max(1)[flat_row]
        flat_row, flat, d = flat_row[ok], flat[ok], d[ok]
        if len(flat):
            touched, start, count = np.unique(flat_row, return_index=True, return_counts=True)
            place = np.arange(len(flat)) - np.repeat(start, count)
            local = np.repeat(np.arange(len(touched)), count)
            more = int(count.max())
            node = np.concatenate((best[touched], np.full((len(touched), more), -1)), 1)
            dist = np.concatenate((far[touched], np.full((len(touched), more), np.inf, np.float32)), 1)
            new = np.concatenate((open_[touched], np.zeros((len(touched), more), bool)), 1)
            node[local, width + place], dist[local, width + place], new[local, width + place] = flat, d, True
            top = np.argpartition(dist, width - 1, 1)[:, :width]
            best[touched], far[touched], open_[touched] = (np.take_along_axis(x, top, 1) for x in (node, dist, new))
        active = active[open_[active].any(1)]
    order = np.argsort(far, 1, kind="stable")
    return np.take_along_axis(best, order, 1), np.take_along_axis(far, order, 1)


def choose(points: np.ndarray, node: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the candidates (nearest first, -1 fills up) of each row: those nearer to the row's point than to any
    kept before, then the nearest of the others."""
    rows, width = node.shape
    there = node >= 0
    x = points[np.where(there, node, 0)]
    between = 1 - x @ x.transpose(0, 2, 1)
    keep, hidden, count = np.zeros((rows, width), bool), ~there, np.zeros(rows, int)
    for c in range(width):
        take = ~hidden[:, c] & (count < most)
        keep[:, c] = take
        count += take
        hidden |= take[:, None] & (between[:, c] < far)
    rank = np.where(keep, 0, np.where(there, 1, 2)) * width + np.arange(width)
    top = np.argsort(rank, 1, kind="stable")[:, :most]
    out = np.take_along_axis(node, top, 1)
    return out if out.shape[1] == most else np.concatenate((out, np.full((rows, most - out.shape[1]), -1)), 1)


def _link_back(points: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Add source to the neighbours of target for every pair; full lists are chosen anew, with a margin of candidates."""
    room = links.shape[1]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    node, start, count = np.unique(target, return_index=True, return_counts=True)
    local, place = np.repeat(np.arange(len(node)), count), np.arange(len(target)) - np.repeat(start, count)
    held = (links[node] >= 0).sum(1)
    fits = held + count <= room
    put = fits[local]
    links[target[put], (held[local] + place)[put]] = source[put]
    full = np.flatnonzero(~fits)
    if not len(full):
        return
    wide = np.full((len(full), room + int(count[full].max())), -1)
    wide[:, :room] = links[node[full]]
    where = np.full(len(node), -1)
    where[full] = np.arange(len(full))
    put = ~fits[local]
    wide[where[local[put]], room + place[put]] = source[put]
    far = np.full(wide.shape, np.inf, np.float32)
    r, c = np.nonzero(wide >= 0)
    far[r, c] = _distance(points, points, node[full][r], wide[r, c])
    order = np.argsort(far, 1, kind="stable")[:, : 2 * room]
    wide, far = np.take_along_axis(wide, order, 1), np.take_along_axis(far, order, 1)
    for a in range(0, len(full), BATCH):
        links[node[full[a : a + BATCH]]] = choose(points, wide[a : a + BATCH], far[a : a + BATCH], room)


def build(points: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> Graph:
    """The graph of unit vectors, in the order given."""
    n = len(points)
    sizes = levels(n, links)
    graph = Graph(points, sizes, [np.full((size, 2 * links if k == 0 else links), -1, np.int32) for k, size in enumerate(sizes)])
    at = 1
    while at < n:
        edge = next(size for size in sizes[::-1] if size > at)  # nodes of a batch have the same top level
        to = min(2 * at, at + BATCH, edge)
        own = np.arange(at, to)
        top = max(k for k, size in enumerate(sizes) if size >= to)
        entry = np.zeros((len(own), 1), int)
        each = points[own]
        among = 1 - each @ each.T
        np.fill_diagonal(among, np.inf)
        beside = np.argsort(among, 1, kind="stable")[:, : min(links, len(own) - 1)]
        for k in range(len(sizes) - 1, -1, -1):
            if sizes[k] == 1 and k > 0:
                continue
            if k > top:
                entry = beam(points, graph.links[k], each, entry, 1, min(at, sizes[k]))[0]
                continue
            found, far = beam(points, graph.links[k], each, entry, width, at)
            entry = found[:, :4]
            node = np.concatenate((found, own[beside]), 1)
            far = np.concatenate((far, np.take_along_axis(among, beside, 1).astype(np.float32)), 1)
            order = np.argsort(far, 1, kind="stable")
            mine = choose(points, np.take_along_axis(node, order, 1), np.take_along_axis(far, order, 1), links)
            graph.links[k][own, :links] = mine
            r, c = np.nonzero(mine >= 0)
            source, target = own[r], mine[r, c]
            twice = (target >= at) & (graph.links[k][target] == source[:, None]).any(1)  # two of a batch that chose each other
            _link_back(points, graph.links[k], source[~twice], target[~twice])
        at = to
    return graph


def search(graph: Graph, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
    """The nearest nodes found for each unit query, nearest first."""
    entry = np.zeros((len(queries), 1), int)
    for k in range(len(graph.sizes) - 1, 0, -1):
        entry = beam(graph.points, graph.links[k], queries, entry, 1, graph.sizes[k])[0]
    return beam(graph.points, graph.links[0], queries, entry, width, graph.sizes[0])[0]


def on_sphere(vectors: np.ndarray) -> np.ndarray:
    """Vectors over the longest of them, with one more entry that makes each length 1."""
    # Each by its largest entry first, so that squares of very large or small ones neither overflow nor vanish.
    top = np.abs(vectors).max(initial=0.0) or 1.0
    x = vectors / top
    size = np.sqrt((x * x).sum(1))
    x = x / max(size.max(initial=0.0), 1e-300)
    return np.column_stack((x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1))))).astype(np.float32)


def as_queries(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.maximum(np.abs(vectors).max(1, initial=0.0), 1e-300)[:, None]
    return np.column_stack((x / np.sqrt((x * x).sum(1))[:, None], np.zeros(len(x)))).astype(np.float32)


# ---------------------------------------------------------------- tables

def prepared(rows: DataFrame, column: str, key: str) -> DataFrame:
    """id, x of the rows that take part: with an id, without null or non-finite entries, not zero; x is double, without zeros at its end."""
    wide = usable(rows.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")).where("id is not null"), "x")
    # Vectors that differ by zeros at their ends, or by the sign of zeros, are the same vector.
    last = F.aggregate("x", F.struct(F.lit(0).alias("at"), F.lit(0).alias("last")), lambda s, c: F.struct((s["at"] + 1).alias("at"), F.when(c != 0, s["at"] + 1).otherwise(s["last"]).alias("last")), lambda s: s["last"])
    return wide.select("id", F.transform(F.slice("x", F.lit(1), last), lambda c: c + F.lit(0.0)).alias("x")).where(F.size("x") > 0)


def _shard(x: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(shards)).cast("int")


def index(vectors: DataFrame, width: int, shards: int, keep: int) -> DataFrame:
    """shard, n, vectors, ids, counts, sizes, links: a row for each shard's graph, written as a table.

    ``vectors`` (id, x): every row is in the index; equal vectors are one node with their ``keep`` smallest ids, which is
    all that an answer of ``keep`` - 1 can need of them.
    """
    first = Window.partitionBy("x").orderBy("id")
    nodes = vectors.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= keep).groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = matrix(group.column("x"), width)
        # The order in which nodes enter follows their bytes, so that a task that runs again builds the same graph.
        raw = np.ascontiguousarray(x)
        code = C.mix(np.bitwise_xor.reduce(C.mix(raw.view(np.uint64) + C.splitmix(7, width)), 1))
        order = np.lexsort((*raw.T[::-1], code))
        x = x[order]
        graph = build(on_sphere(x))
        ids = group.column("ids").combine_chunks().take(pa.array(order))
        return pa.table({
            "shard": group.column("shard").slice(0, 1), "n": pa.array([len(x)], pa.int32()), "vectors": pa.array([x.tobytes()], pa.binary()),
            "ids": pa.array([ids.flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary()), "counts": pa.array([np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes()], pa.binary()),
            "sizes": pa.array([graph.sizes], pa.list_(pa.int32())), "links": pa.array([[a.tobytes() for a in graph.links]], pa.list_(pa.binary())),
        })

    schema = "shard int, n int, vectors binary, ids binary, counts binary, sizes array<int>, links array<binary>"
    return C.materialize(nodes.withColumn("shard", _shard(F.col("x"), shards)).groupBy("shard").applyInArrow(run, schema), "graphs")


def search_shards(graphs: DataFrame, queries: DataFrame, width: int, shards: int, k: int) -> DataFrame:
    """query, query_id, vec_id, score: the k best rows that each shard finds for each query (query, id, x)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries in blocks, once for each shard."""
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                raw = [np.ascontiguousarray(part.column(0).to_numpy()).tobytes(), np.ascontiguousarray(part.column(1).to_numpy()).tobytes(), matrix(part.column(2), width).tobytes()]
                for s in range(shards):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([1], pa.int32()), *(pa.array([x], pa.binary()) for x in raw), pa.array([None], pa.binary()), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.binary()))], ["shard", "kind", "a", "b", "c", "d", "sizes", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's graph comes first, its blocks of queries after it; a shard that got no vectors has no graph."""
        graph = x = ids = offsets = held = None
        for b in batches:
            for shard, kind, *raw, sizes, links in zip(*(b.column(c).to_pylist() for c in range(8)), strict=True):
                if kind == 0:
                    held = shard
                    x = np.frombuffer(raw[0]).reshape(-1, width)
                    ids, counts = np.frombuffer(raw[1], np.int64), np.frombuffer(raw[2], np.int32)
                    offsets = np.concatenate(([0], np.cumsum(counts)))
                    graph = Graph(on_sphere(x), list(sizes), [np.frombuffer(a, np.int32).reshape(size, -1) for a, size in zip(links, sizes, strict=True)])
                    continue
                if shard != held:
                    continue
                query, own, asked = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.int64), np.frombuffer(raw[2]).reshape(-1, width)
                yield _answers(graph, x, ids, offsets, query, own, asked, k)

    graph_rows = graphs.select("shard", F.lit(0).alias("kind"), F.col("vectors").alias("a"), F.col("ids").alias("b"), F.col("counts").alias("c"), F.lit(None).cast("binary").alias("d"), "sizes", "links")
    block = "shard int, kind int, a binary, b binary, c binary, d binary, sizes array<int>, links array<binary>"
    met = graph_rows.union(queries.select("query", "id", "x").mapInArrow(pack, block)).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return met.mapInArrow(run, "query long, query_id long, vec_id long, score double")


def _answers(graph: Graph, x: np.ndarray, ids: np.ndarray, offsets: np.ndarray, query: np.ndarray, own: np.ndarray, asked: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of a shard for each query of a block; a query's own row is left out once."""
    found = search(graph, as_queries(asked), max(SEARCH_WIDTH, k + 1))
    out = []
    for q in range(len(query)):
        node = found[q][found[q] >= 0]
        score = np.einsum("ij,j->i", x[node], asked[q])
        count = np.diff(offsets)[node]
        row = np.repeat(np.arange(len(node)), count)
        member = ids[np.repeat(offsets[node] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(row))]
        keep = np.ones(len(row), bool)
        self_ = np.flatnonzero((member == own[q]) & (x[node[row]] == asked[q]).all(1))[:1] if len(row) else []
        keep[self_] = False
        row, member = row[keep], member[keep]
        top = np.lexsort((member, -score[row]))[:k]
        out.append((member[top], score[row[top]]))
    n = [len(m) for m, _ in out]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(query, n)), pa.array(np.repeat(own, n)), pa.array(np.concatenate([m for m, _ in out])), pa.array(np.concatenate([s for _, s in out]))], ["query", "query_id", "vec_id", "score"])


def nearest(rows: DataFrame, column: str = "embedding", key: str = "vec_id", every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found nearest by inner product to each row whose id ``every`` divides.

    Nearest first, equal scores by id.  A query's own row is no candidate; another row of its id is.  Rows without an id,
    and vectors that are null, zero, or hold null or non-finite entries, take no part; shorter vectors end in zeros.  A
    repeated row is another candidate, and another query with the same answers.  With at most k candidates all that are
    found are returned; an empty table gives no rows.  Other columns are ignored.
    """
    spark = rows.sparkSession
    C.small_batches(spark, 4096)
    schema = "query_id long, rank int, vec_id long, score double"
    scope = C.made()
    vectors = C.materialize(prepared(rows, column, key), "vectors")
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n:
        C.release(scope, [])
        return spark.createDataFrame([], schema)
    shards = -(-n // shard_rows)
    queries = C.materialize(vectors.where(F.pmod("id", F.lit(every)) == 0).withColumn("query", F.monotonically_increasing_id()), "queries")
    graphs = index(vectors, width, shards, k + 1)
    found = search_shards(graphs, queries, width, shards, k)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    C.release(scope, [out])
    return out
