"""Near duplicates where buckets are loose, ids repeat, and columns clash."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import shingle_set

from reelquery.llm import common, neardup


def groups_of(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


def templated(seed, n, own):
    """Texts of one template with ``own`` words of their own, and a few that copy another's own words in part."""
    rnd = random.Random(seed)
    template = [f"t{i}" for i in range(200)]
    texts = []
    for i in range(n):
        extra = [f"x{i}_{k}" for k in range(own)]
        if i % 5 == 4:
            extra = texts[rnd.randrange(len(texts))][200:]
            extra = [*extra[: own - 3], *(f"y{i}_{k}" for k in range(3))]
        texts.append(template + extra)
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("own", "percent"), [(12, 85), (25, 85), (40, 85), (30, 80)])
def test_loose_groups_match_brute_force(spark, own, percent):
    texts = templated(own, 80, own)
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == groups_of({i: shingle_set(t) for i, t in texts.items()}, percent)


def test_prefix_buckets_hold_every_link_and_leave_loose_groups(spark):
    texts = templated(1, 60, 40)
    sets = {i: shingle_set(t) for i, t in texts.items()}
    rows = spark.createDataFrame(list(texts.items()), "node long, text string")
    dealt = neardup._by_prefix(rows, 85, 5).collect()
    by = {}
    for r in dealt:
        by.setdefault(r.bucket, set()).add(r.doc)
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    met = {(a, b) for m in by.values() for a in m for b in m if a < b}
    assert links and links <= met
    assert max(map(len, by.values())) < 20  # all 60 share the template


def test_repeated_ids_with_other_texts(spark):
    t = [f"w{i}" for i in range(60)]
    a, b = " ".join(t), " ".join(f"v{i}" for i in range(60))
    near_a, near_b = " ".join([*t[:-1], "z"]), b.replace("v59", "z")
    rows = [(1, a, "p"), (1, b, "q"), (1, a, "r"), (2, near_a, "s"), (3, near_b, "t"), (4, "", "u"), (4, "", "u"), (None, a, "v"), (5, None, "w"), (6, "other words that stand alone here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("h", F.lit(1))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (None, None, True), (5, 5, True), (6, 6, True)], key=str)
    left = neardup.deduplicate(df, percent=85)
    assert left.columns == df.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (4, ""), (4, ""), (None, a), (5, None), (6, rows[-1][1])], key=str)
    assert neardup.deduplicate(df.limit(0)).count() == 0


def tables_of(monkeypatch):
    """Tags of the tables that are made from now on, with the number of tasks that wrote each."""
    seen, write = [], common.materialize

    def materialize(df, tag):
        seen.append((tag, df.rdd.getNumPartitions() if tag == "labels" else 0))
        return write(df, tag)

    monkeypatch.setattr(common, "materialize", materialize)
    return seen


@pytest.mark.parametrize("at_once", [neardup.AT_ONCE, 0])
def test_loose_groups_need_few_rounds(spark, monkeypatch, at_once):
    # two families of one template (similarity 0.7), and a rare passage in some of both: its buckets stay loose
    words = [[f"t{k}" for k in range(200)] + [f"{f}{k}" for k in range(30)] + [f"own{f}{i}"] + [f"rare{k}" for k in range(12) if i < 3] for f in "ab" for i in range(6)]
    texts = {i: " ".join(w) for i, w in enumerate(words)}
    monkeypatch.setattr(neardup, "AT_ONCE", at_once)
    seen = tables_of(monkeypatch)
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=85)
    assert {r.doc_id: r.component_id for r in got.collect()} == groups_of({i: shingle_set(t) for i, t in texts.items()}, 85)
    tags = [tag for tag, _ in seen]
    if at_once:  # nothing but the full round, whose links need no further check
        assert "pairs" not in tags and tags.count("links") == 3 and tags.count("edges") <= 3
    else:
        assert "pairs" in tags


def test_components_of_few_edges_are_small_tables(spark, monkeypatch):
    seen = tables_of(monkeypatch)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 70), (80, 90)], "a long, b long")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(keep, ("64", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        got = {r.doc: r.comp for r in neardup.components(chain.coalesce(1)).collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(41)} | {i: 70 for i in (70, 80, 90)}
    rounds = [n for tag, n in seen if tag == "labels"]
    assert len(rounds) <= 3 and max(rounds) <= spark.sparkContext.defaultParallelism


def test_full_round_returns_links_that_join_components():
    base = np.arange(100, dtype=np.uint64)
    sets = [base, base, base[:90], base + np.uint64(500), base[:50]]
    rows = pa.array([x.tobytes() for x in [sets[k] for k in (1, 2, 3, 4, 0, 1, 2, 3, 4)]], pa.binary())
    doc = np.array([1, 2, 3, 4, 0, 1, 2, 3, 4])
    minor = np.array([True] * 4 + [False] * 5)
    found = [(int(doc[i]), int(doc[j])) for x, y in neardup._overlapping(85)(minor, doc, doc, rows) for i, j in zip(x, y, strict=True)]
    assert sorted({d for pair in found for d in pair}) == [0, 1, 2]
    assert len(found) == 2  # of three pairs that reach the threshold, a tree's two
