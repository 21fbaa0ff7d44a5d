"""MinHash near-duplicate detection with sequential Bayesian verification (operator 10).

Documents are sets of five-word shingles (A-Z folded).  Rows with equal sets are one node, so exact copies never meet in
a bucket.  MinHash signatures are banded; the members of a bucket are compared in linear steps instead of in all pairs:

1. every member with the bucket's smallest node; accepted links give provisional components;
2. documents of buckets that still hold several components are dealt anew, by the shingles of their prefixes: with the
   shingles of all such documents in order from rare to common, two sets of similarity t share one among the first
   |x| - t |x| + 1 of the larger and the first |y| - 2t/(1+t) |y| + 1 of the smaller (the prefix filter of exact
   similarity joins).  Documents that are alike below the threshold differ in their rare shingles, so large loose buckets
   fall apart into small ones.  Each new bucket is compared with its smallest node first;
3. in new buckets that still hold several components, the members outside the bucket's largest component meet all
   members of other components, in blocks of bounded size that run as separate tasks, by intersections of whole sets;
   a block returns no more links than join its components.  Where that would be more than ``AT_ONCE`` comparisons for
   each member, rounds that take each member's likeliest pair only come first.

A pair that shares a band is thus either compared, already connected, or excluded by its prefixes, which is all that
components need.  Each comparison first goes through signature slices: with m of n minima equal, the pair is dropped
once the posterior probability (uniform prior) that its similarity reaches the threshold is below ``miss``.  Survivors
are verified on full shingle sets; shingles are 64-bit hashes, so a false link would take many accidental collisions.

Edge cases: a null or empty text, or one without words, has no shingles, is linked with nothing and forms its own
component; a text of fewer than five words is one shingle; rows are judged one by one, also where they repeat a doc_id
with another text, and a component is named by its smallest doc_id; a row with null doc_id is never linked, has a null
component and is kept; ties of similarity change nothing; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common as C

BANDS, ROWS, STEP = 30, 5, 30
#: Block sizes of the second comparison step: how many minority members and how many others meet in one task.
MINORITY_BLOCK, OTHERS_BLOCK = 512, 1024
#: Comparisons of whole sets for each member up to which these need no rounds of likeliest pairs before them.
AT_ONCE = 512
#: Edges that a task holds at once when it joins them to stars.
EDGES_AT_ONCE = 1 << 20


def _log_beta_tail(m: int, n: int, t: float) -> float:
    """P(similarity >= t) after m equal minima of n, under a uniform prior: P(Binomial(n+1, t) <= m)."""
    from math import exp, lgamma, log

    k = np.arange(0, m + 1)
    logs = [lgamma(n + 2) - lgamma(i + 1) - lgamma(n + 2 - i) + i * log(t) + (n + 1 - i) * log(1 - t) for i in k]
    top = max(logs)
    return exp(top) * sum(exp(x - top) for x in logs)


def least_matches(t: float, miss: float, steps: list[int]) -> list[int]:
    """For each number of compared minima, the fewest equal ones with which a pair stays in."""
    out = []
    for n in steps:
        m = 0
        while m < n and _log_beta_tail(m, n, t) < miss:
            m += 1
        out.append(m)
    return out


def _node_of(hashed: np.ndarray, text: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each text's set, the set's size) from its distinct shingles."""
    n = np.bincount(text, minlength=rows).astype(np.int64)
    full = np.flatnonzero(n)
    node = np.zeros(rows, np.uint64)
    if len(full):
        begin = np.concatenate(([0], np.cumsum(n[full])))[:-1]
        one, two = np.add.reduceat(C.mix(hashed), begin), np.add.reduceat(C.mix(hashed ^ np.uint64(0x5851F42D4C957F2D)), begin)
        node[full] = C.mix(one ^ C.mix(two + n[full].astype(np.uint64)))
    return node.view(np.int64), n


def _signer(bands: int, rows: int, size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_hash = bands * rows
        flip = (C.splitmix(101, n_hash) >> np.uint64(32)).astype(np.uint32)
        times = (C.splitmix(202, n_hash) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        salt = C.splitmix(303, bands)
        for part, texts in C.groups(batches):
            hashed, text = C.distinct(*C.shingles(C.word_table(texts, lower=True), size))
            node, n = _node_of(hashed, text, part.num_rows)
            full = np.flatnonzero(n)
            begin = np.concatenate(([0], np.cumsum(n[full])))[:-1]
            minima = np.zeros((len(full), n_hash), np.uint32)
            if len(full):
                x = (hashed >> np.uint64(32)).astype(np.uint32)
                for j in range(n_hash):
                    y = (x ^ flip[j]) * times[j]
                    minima[:, j] = np.minimum.reduceat(y ^ (y >> np.uint32(15)), begin)
            keys = np.zeros((len(full), bands), np.uint64)
            for r in range(rows):
                keys = C.mix(keys + minima[:, r::rows].astype(np.uint64) + salt)
            has = n > 0
            count = np.where(has, bands, 0)
            sig = np.full(part.num_rows, None, object)
            low = minima.astype(np.uint8)
            for i, k in enumerate(full):
                sig[k] = low[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(n), pa.array(node, mask=n == 0), C.lists(keys.ravel(), count, pa.int64()), pa.array(sig, pa.binary())],
                names=["doc_id", "print", "n_shingles", "node", "bands", "sig"],
            )

    return sign


_SIGNED = "doc_id long, print long, n_shingles long, node long, bands array<long>, sig binary"


def _alike(a: np.ndarray, b: np.ndarray, steps: list[int], least: list[int]) -> np.ndarray:
    """The number of equal minima of each pair of signature rows; 0 for pairs that a slice dropped.

    Signatures keep the low byte of each minimum; chance agreement only ever keeps a pair longer.
    """
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    last = 0
    for to, m in zip(steps, least, strict=True):
        equal[alive] += (a[alive, last:to] == b[alive, last:to]).sum(1, dtype=np.int32)
        alive = alive[equal[alive] >= m]
        last = to
    out = np.zeros(len(a), np.int32)
    out[alive] = equal[alive]
    return out


def _signatures(column: pa.Array) -> np.ndarray:
    t = C.texts_of(column)
    return t.data.reshape(len(t.offsets) - 1, -1) if len(t.data) else np.zeros((0, 1), np.uint8)


def _pruner(steps: list[int], least: list[int]):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keep = _alike(_signatures(b.column(2)), _signatures(b.column(3)), steps, least) > 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return prune


def _likeliest(steps: list[int], least: list[int]):
    """Of one block, each minority member's pair of most equal minima with a member of another component."""

    def pairs(minor: np.ndarray, doc: np.ndarray, comp: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sig = _signatures(column)
        a, b = np.flatnonzero(minor), np.flatnonzero(~minor)
        for at in range(0, len(a), 16):
            x, y = (z.ravel() for z in np.meshgrid(a[at : at + 16], b, indexing="ij"))
            other = comp[x] != comp[y]
            x, y = x[other], y[other]
            equal = _alike(sig[x], sig[y], steps, least)
            good = np.flatnonzero(equal)
            if len(good):
                good = good[np.lexsort((y[good], -equal[good], x[good]))]
                good = good[np.concatenate(([True], x[good][1:] != x[good][:-1]))]
                yield x[good], y[good]

    return pairs


def _overlapping(percent: int):
    """Of one block, pairs of a minority member and a member of another component that reach the threshold, as many as
    join the components that such pairs connect.

    Sets are arrays of shingle hashes; intersections of a few members with all others are one matrix product over the
    few members' shingles, and exact.
    """

    def pairs(minor: np.ndarray, doc: np.ndarray, comp: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        flat = C.texts_of(column)
        hashed, first = flat.data.view(np.uint64), flat.offsets // 8
        size = np.diff(first)
        group = np.searchsorted(C.unique(comp), comp)
        a, b = np.flatnonzero(minor), np.flatnonzero(~minor)
        owner = np.repeat(np.arange(len(b)), size[b])
        theirs = np.concatenate([hashed[first[i] : first[i + 1]] for i in b]) if len(b) else hashed[:0]
        for at in range(0, len(a), 32):
            mine = a[at : at + 32]
            own = np.concatenate([hashed[first[i] : first[i + 1]] for i in mine])
            row = np.repeat(np.arange(len(mine)), size[mine])
            known = C.unique(own)
            place = np.searchsorted(known, own)
            where = np.minimum(np.searchsorted(known, theirs), max(0, len(known) - 1))
            shared = np.flatnonzero(known[where] == theirs) if len(known) else where[:0]
            both = np.zeros((len(mine), len(b)), np.float32)
            for k in range(0, len(known), 4096):
                left = np.zeros((len(mine), min(4096, len(known) - k)), np.float32)
                inside = (place >= k) & (place < k + 4096)
                left[row[inside], place[inside] - k] = 1
                right = np.zeros((left.shape[1], len(b)), np.float32)
                w = shared[(where[shared] >= k) & (where[shared] < k + 4096)]
                right[where[w] - k, owner[w]] = 1
                both += left @ right
            union = size[mine][:, None] + size[b][None, :] - both
            good = (100 * both >= percent * union) & (both > 0)
            for i in range(len(mine)):
                y = b[good[i] & (group[b] != group[mine[i]])]
                if len(y):
                    near, one = np.unique(group[y], return_index=True)
                    group[np.isin(group, near)] = group[mine[i]]
                    yield np.full(len(one), mine[i]), y[one]

    return pairs


def _blocks(pairs):
    """Rows (block, minor, doc, comp, payload) sorted by block to the pairs that ``pairs`` finds in each block.

    A block has at most a few thousand rows by construction, so carrying one block over a batch edge is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            block, minor, doc, comp = (t.column(k).to_numpy() for k in range(4))
            payload = t.column(4).combine_chunks()
            edge = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
            out = []
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                for x, y in pairs(minor[i:j], doc[i:j], comp[i:j], payload.slice(i, j - i)):
                    x, y = doc[i:j][x], doc[i:j][y]
                    out.append((np.minimum(x, y), np.maximum(x, y)))
            if out:
                x, y = (np.concatenate(z) for z in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            if not t.num_rows:
                continue
            block = t.column(0).to_numpy()
            cut = int(np.searchsorted(block, block[-1]))
            rest = t.slice(cut).combine_chunks()
            if cut:
                yield from emit(t.slice(0, cut).combine_chunks())
        if rest is not None and rest.num_rows:
            yield from emit(rest)

    return run


def _set_bytes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in C.groups(batches):
            hashed, text = C.distinct(*C.shingles(C.word_table(texts, lower=True), size))
            first = np.searchsorted(text, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hashed[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc", "payload"])

    return run


def _verifier(percent: int, size: int):
    """Exact check of pairs (a, b, text_a, text_b): 100 * intersection >= percent * union."""

    def sets(column: pa.Array, last: dict) -> list[np.ndarray]:
        out = []
        for text in column.cast(pa.large_binary()).to_pylist():
            if text != last.get("text"):
                t = C.Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                last["text"], last["set"] = text, C.unique(C.shingles(C.word_table(t, lower=True), size)[0])
            out.append(last["set"])
        return out

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = {}, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                keep = []
                for x, y in zip(sets(b.column(2), one), sets(b.column(3), two), strict=True):
                    both = np.intersect1d(x, y, assume_unique=True).size
                    keep.append(100 * both >= percent * (x.size + y.size - both) and both > 0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (a, b) as edges from the smallest id of each piece that they connect to the piece's others."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
        ids = C.unique(np.concatenate((a, b)))
        x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
        root = np.arange(len(ids))
        while (apart := root[x] != root[y]).any():
            x, y = x[apart], y[apart]
            np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
        other = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[root[other]]), pa.array(ids[other])], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= EDGES_AT_ONCE:
            yield joined(held)
            held, n = [], 0
    if n:
        yield joined(held)


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp): the smallest id reachable over the undirected edges (a, b), for every id that has one.

    Each task first joins its own edges to stars.  Minimum labels then spread along edges, and each round also jumps to
    the label's own label, so the number of rounds is logarithmic in a component's diameter.  Every round is a table in
    the shared folder; only a count reaches the driver.
    """
    stars = C.materialize(edges.select("a", "b").mapInArrow(_stars, "a long, b long"), "edges")
    most = 2 * stars.count()
    both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = C.materialize(C.few(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.col("doc")).alias("comp")), most), "labels")
    while True:
        seen = both.join(label.select(F.col("doc").alias("b"), "comp"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("comp").alias("near"))
        step = label.join(seen, "doc").select("doc", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = label.select(F.col("doc").alias("comp"), F.col("comp").alias("up"))
        now = C.materialize(C.few(step.join(up, "comp").select("doc", "old", F.least("comp", "up").alias("comp")), most), "labels")
        label, changed = now.select("doc", "comp"), now.where("old != comp").limit(1).count()
        if not changed:
            return label


def _with_nodes(size: int):
    """Rows with their text's node (null without shingles) as the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in C.groups(batches):
            node, n = _node_of(*C.distinct(*C.shingles(C.word_table(texts, lower=True), size)), part.num_rows)
            yield part.append_column("node", pa.array(node, mask=n == 0))

    return run


def _shingle_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in C.groups(batches):
            hashed, text = C.distinct(*C.shingles(C.word_table(texts, lower=True), size))
            count = np.bincount(text, minlength=part.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(hashed.view(np.int64)), pa.array(count[text])], names=["doc", "h", "size"])

    return run


def _by_prefix(texts: DataFrame, percent: int, size: int) -> DataFrame:
    """(bucket, doc): documents (node, text) by the shingles of their prefixes; a bucket is a shingle that occurs in the
    shorter prefix of a document and the longer one of another."""
    rows = texts.select("node", "text").mapInArrow(_shingle_rows(size), "doc long, h long, size int")
    common = C.materialize(rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "common")  # of its own, so that hot shingles can be split
    shared = rows.join(common, "h").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("hs"), F.max("size").alias("size"))
    alone = F.col("size") - F.size("hs")  # shingles that no other has come first
    long = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - alone
    short = F.col("size") - F.ceil(F.col("size") * (2 * percent) / (100 + percent)) + 1 - alone
    first = F.slice("hs", 1, F.greatest(F.lit(0), long).cast("int"))
    sub = C.materialize(shared.select("doc", short.alias("short"), F.posexplode(first).alias("at", "s")).select(F.col("s.h").alias("bucket"), "doc", (F.col("at") < F.col("short")).alias("short")), "prefixes")
    real = C.materialize(sub.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last"), F.bool_or("short").alias("short")).where("short and pivot < last").select("bucket", "pivot"), "prefix-buckets")
    return sub.drop("short").join(real, "bucket")


def _once(members: DataFrame) -> DataFrame:
    """Members (bucket, doc, pivot) without buckets that have the same members as another, and without the pivots' own rows."""
    marks = [F.bit_xor(F.xxhash64("doc")).alias("m1"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("m2"), F.count("*").alias("n")]
    most = members.count()
    kept = C.materialize(C.few(members.groupBy("bucket").agg(*marks).groupBy("m1", "m2", "n").agg(F.min("bucket").alias("bucket")).select("bucket"), most), "buckets")
    return C.materialize(C.few(members.join(kept, "bucket", "left_semi").where("doc != pivot"), most), "members")


def _judged(docs: DataFrame, percent: int, miss: float, bands: int, rows: int, size: int) -> DataFrame:
    """doc_id, node and group (null without shingles), n_shingles, component_id of every row.  A group is a component, also
    where an id with several texts names two of them."""
    C.small_batches(docs.sparkSession)
    docs = C.id_text(docs).withColumn("print", F.xxhash64("text"))  # tells the texts of a repeated id apart
    steps = [*range(STEP, bands * rows, STEP), bands * rows]
    least = least_matches(percent / 100, miss, steps)

    signed = C.materialize(docs.mapInArrow(_signer(bands, rows, size), _SIGNED), "signed")
    most = signed.count()
    real = signed.where("node is not null and doc_id is not null")
    reps = real.groupBy("node").agg(F.min_by(F.struct("doc_id", "print", "bands", "sig"), "doc_id").alias("r")).select("node", F.col("r.doc_id").alias("rep"), "r.print", "r.bands", "r.sig")
    reps = C.materialize(C.few(reps, most, each=8000), "reps")
    banded = reps.select(F.explode("bands").alias("bucket"), F.col("node").alias("doc"))
    shared = C.materialize(C.few(banded.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last")).where("pivot < last").drop("last"), bands * most), "shared")
    members = _once(C.materialize(C.few(banded.join(shared, "bucket"), bands * most), "banded"))

    involved = members.select("doc").union(members.select("pivot")).distinct().withColumnRenamed("doc", "node").join(reps.select("node", F.col("rep").alias("doc_id"), "print"), "node")
    # the same join at every size: ids of involved documents grow with the corpus
    texts = docs.where("doc_id is not null").join(involved.hint("merge"), ["doc_id", "print"]).dropDuplicates(["doc_id", "print"]).select("node", "text")
    texts = C.materialize(C.few(texts, most, each=2000), "texts")
    sig = reps.select("node", "sig")

    def checked(pairs: DataFrame) -> DataFrame:
        one, two = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
        return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verifier(percent, size), "a long, b long")

    def star(members: DataFrame, label: DataFrame | None) -> DataFrame:
        """Verified links of members with their bucket's pivot, those that ``label`` connects already left out."""
        pairs = members.select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
        if label is not None:
            two, one = (label.select(F.col("doc").alias(k), F.col("comp").alias(f"comp_{k}")) for k in "ba")
            pairs = pairs.join(two, "b", "left").join(one, "a", "left").where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")
        one, two = (sig.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab")
        likely = pairs.join(two, "b").join(one, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(_pruner(steps, least), "a long, b long")
        return C.materialize(checked(likely), "links")

    def opened(members: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members with their components, buckets with more than one of these)."""
        named = C.materialize(members.join(label, "doc", "left").select("bucket", "doc", F.coalesce("comp", "doc").alias("comp")), "named")
        size_of = named.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        open_ = size_of.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("total"), F.count("*").alias("comps")).where("comps > 1")
        return named, C.materialize(C.few(open_, named.count()), "open")

    def across(named: DataFrame, open_: DataFrame, best: bool, likely: DataFrame | None = None) -> DataFrame:
        """Pairs between different components that share a bucket: likely ones (``best``), or links that join all
        components that pairs at the threshold connect.

        ``likely``: the likely pairs of the same components.  Only members that had one can have a pair that reaches the
        threshold, so whole sets are carried for these alone.
        """
        row = named.join(open_, "bucket").select("bucket", "doc", "comp", (F.col("comp") != F.col("top.comp")).alias("small"), F.ceil((F.col("total") - F.col("top.n")) / MINORITY_BLOCK).alias("parts"), F.ceil(F.col("total") / OTHERS_BLOCK).alias("others"))
        if likely is not None:
            found = likely.select(F.col("a").alias("doc")).union(likely.select("b")).distinct().withColumn("found", F.lit(True))
            row = row.join(found, "doc", "left").withColumn("small", F.col("small") & F.coalesce("found", F.lit(False))).drop("found")
            row = row.join(row.where("small").select("bucket").distinct(), "bucket", "left_semi")
        payload = sig.select(F.col("node").alias("doc"), F.col("sig").alias("payload")) if best else texts.mapInArrow(_set_bytes(size), "doc long, payload binary")
        row = row.join(payload, "doc")
        own = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = row.where("small").select("*", own("parts").alias("i"), every("others").alias("j"), F.lit(True).alias("minor"))
        right = row.select("*", every("parts").alias("i"), own("others").alias("j"), F.lit(False).alias("minor"))
        blocks = left.unionByName(right).select(F.xxhash64("bucket", "i", "j").alias("block"), "minor", "doc", "comp", "payload")
        blocks = blocks.repartition("block").sortWithinPartitions("block")
        if best:
            return C.materialize(blocks.mapInArrow(_blocks(_likeliest(steps, least)), "a long, b long").distinct(), "pairs")
        return C.materialize(blocks.mapInArrow(_blocks(_overlapping(percent)), "a long, b long"), "links")

    edges = star(members, None)
    label = components(edges)
    named, open_ = opened(members, label)
    if open_.limit(1).count():
        loose = named.join(open_.select("bucket"), "bucket", "left_semi").select(F.col("doc").alias("node")).distinct()
        members = _once(C.materialize(_by_prefix(texts.join(loose, "node"), percent, size), "dealt"))
        found = star(members, label)
        if found.limit(1).count():
            edges = edges.union(found)
            label = components(edges)
        # Members of one group that missed its pivot join it by their likeliest pairs first, as long as the full round has
        # many comparisons to do; what is still apart then, or when a round links nothing more, is compared in full, so no
        # pair is skipped.
        while True:
            named, open_ = opened(members, label)
            left = open_.agg(F.sum((F.col("total") - F.col("top.n")) * F.col("total")).alias("pairs"), F.sum("total").alias("members")).first()
            if left.members is None:
                break
            likely = None
            if left.pairs > AT_ONCE * left.members:
                likely = across(named, open_, best=True)
                if not likely.limit(1).count():
                    break
                found = C.materialize(checked(likely), "links")
                if found.limit(1).count():
                    edges = edges.union(found)
                    label = components(edges)
                    continue
            found = across(named, open_, best=False, likely=likely)
            if found.limit(1).count():
                label = components(edges.union(found))
            break

    by_node = reps.select("node", "rep").join(label.withColumnRenamed("doc", "node"), "node", "left")
    low = by_node.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("low"))
    names = C.materialize(C.few(by_node.join(low, "comp", "left").select("node", F.coalesce("comp", "node").alias("group"), F.coalesce("low", "rep").alias("low")), most), "names")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
    return signed.select("doc_id", "node", "n_shingles").join(names, "node", "left").select("doc_id", "node", "n_shingles", "group", comp.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-6, bands: int = BANDS, rows: int = ROWS, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, anything else)."""
    mark = C.made()
    out = _judged(docs, percent, miss, bands, rows, size)
    out = out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    C.release(mark, [out])
    return out


def deduplicate(docs: DataFrame, percent: int = 80, miss: float = 1e-6, bands: int = BANDS, rows: int = ROWS, size: int = 5) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate group: one with the smallest doc_id of the group.

    Of rows that repeat an id, those of the group's first node stay, and of equal texts one.  Rows without shingles and
    rows with null doc_id are in no group and stay.
    """
    mark = C.made()
    found = C.materialize(_judged(docs, percent, miss, bands, rows, size), "judged")
    ids = found.where("doc_id is not null")
    again = C.materialize(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    gone = ids.where("doc_id != component_id").select("doc_id").distinct()
    id_ = F.col("doc_id").cast("long")
    left = docs.join(gone.union(again).distinct().withColumnRenamed("doc_id", "__id"), id_ == F.col("__id"), "left_anti")
    if again.limit(1).count():  # only these rows need to be told apart by their texts
        own = docs.select("*", *([F.col("node").alias("__theirs")] if "node" in docs.columns else [])).drop("node")
        mine = own.join(again.withColumnRenamed("doc_id", "__id"), id_ == F.col("__id"), "left_semi")
        mine = mine.mapInArrow(_with_nodes(size), StructType([*own.schema.fields, StructField("node", LongType())]))
        columns = [F.col("__theirs").alias("node") if c == "node" else F.col(c) for c in docs.columns]
        stay = ids.where("doc_id = component_id and node is not null").groupBy("group").agg(F.min(F.struct("doc_id", "node")).alias("s")).select(F.col("s.doc_id").alias("__id"), F.col("s.node").alias("__node"))
        one = mine.join(stay, (id_ == F.col("__id")) & (F.col("node") == F.col("__node")), "left_semi").dropDuplicates(["doc_id", "node"])
        left = left.union(one.union(mine.where("node is null")).select(*columns))
    C.release(mark, [left])
    return left
