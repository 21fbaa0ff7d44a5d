"""Whitening and nearest neighbours against plain versions of themselves."""

import math

import numpy as np
import pytest

from reelquery.llm import hnsw, whitening

NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "z", 1.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, x string, score double")


def some(n, width, seed=3, scale=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, width)) * scale * np.linspace(0.5, 2, width)).astype(np.float32).tolist()


# ---------------------------------------------------------------- whitening

def plain_whitened(rows):
    """(rows, n, deviations, whitened, explained) by exact whole numbers and one dense matrix."""
    width = max(len(v) for _, v in rows)
    whole = [(i, [math.floor(256 * c) for c in v] + [0] * (width - len(v))) for i, v in rows]
    fit = sorted({tuple(x) for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    off = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(-values)[:4]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in whole]
    y = np.array([[a - s / n for a, s in zip(x, sums)] for _, x in whole]) @ vectors[:, order] / np.sqrt(values[order])
    return n, deviation, y, values[order] / values.sum()


def check_whitened(got, rows):
    n, deviation, y, explained = plain_whitened(rows)
    assert len(got) == 4 * len(rows)
    key = lambda r: (r[0] is None, r[0] or 0)
    per = {}
    for r in got:
        per.setdefault(r.component, []).append(r)
        assert r.n == n and abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    for c, found in per.items():
        want = sorted(((i, d, v) for (i, _), d, v in zip(rows, deviation, y[:, c - 1])), key=lambda r: (*key(r), r[1], abs(r[2])))
        found = sorted(((r.vec_id, r.deviation, r.whitened) for r in found), key=lambda r: (*key(r), r[1], abs(r[2])))
        assert [x[:2] for x in found] == [x[:2] for x in want]
        a, b = np.array([x[2] for x in found]), np.array([x[2] for x in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_leaves_out_bad_rows_and_counts_equal_ones_once(spark):
    good = list(enumerate(some(60, 7)))
    rows = good + [(100, good[3][1]), (100, good[3][1]), (3, good[4][1]), (None, good[5][1])]
    bad = [(200, None), (201, [NAN] * 7), (202, [0.0] * 6 + [INF]), (203, [None] + [0.0] * 6)]
    check_whitened(whitening.whiten(table(spark, rows + bad)).collect(), rows)


@pytest.mark.parametrize("tile,block", [(3, 16), (32, 4096), (1, 5)])
def test_tiles_and_row_blocks_change_nothing(spark, tile, block):
    rows = list(enumerate(some(80, 8, seed=5)))
    df = table(spark, rows).repartition(3)
    w = whitening.fit(df, tile=tile, block=block)
    check_whitened(whitening.transform(df, w).collect(), rows)


def test_short_vectors_end_in_zeros(spark):
    rows = [(i, v[: 3 + i % 4]) for i, v in enumerate(some(50, 6, seed=8))] + [(90, [])]
    check_whitened(whitening.whiten(table(spark, rows, "double")).collect(), rows)


def test_wide_values_are_exact(spark):
    rows = list(enumerate(some(40, 5, seed=2, scale=3000.0)))
    check_whitened(whitening.whiten(table(spark, rows)).collect(), rows)


def test_tables_without_variance(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        out = whitening.whiten(table(spark, rows))
        assert out.columns == columns and out.collect() == []
    line = [(k, [float(k), 2.0 * k, 0.0]) for k in range(5)]
    assert {r.component for r in whitening.whiten(table(spark, line)).collect()} == {1}


def test_deviation_beyond_64_bits_fails(spark):
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(table(spark, [(k, [1e13 * k, 1.0]) for k in range(9)], "double")).collect()


# ---------------------------------------------------------------- neighbours

def plain_nearest(rows, every=20, k=20):
    """Every row's scores with all other rows, in double precision."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.concatenate((v, np.zeros(width - len(v))))) for i, v in good]
    out = []
    for q, (i, v) in enumerate(good):
        if i % every == 0:
            near = sorted((-float(np.einsum("i,i->", w, v)), j) for p, (j, w) in enumerate(good) if p != q)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return out


def same(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for a, b in zip(got, want, strict=True):
        assert abs(a[3] - b[3]) < 1e-9
    assert sorted((x[0], x[2]) for x in got) == sorted((x[0], x[2]) for x in want)


def test_small_tables_are_exact(spark):
    rows = list(enumerate(some(150, 6, seed=1)))
    rows += [(300, None), (320, [0.0] * 6), (340, [NAN] + [0.0] * 5), (360, [INF] * 6), (380, [None] * 6), (None, rows[0][1]), (400, [])]
    same(hnsw.nearest(table(spark, rows)).collect(), plain_nearest(rows))
    same(hnsw.nearest(table(spark, rows), shard_rows=40).collect(), plain_nearest(rows))


def test_copies_repeats_ties_and_negative_ids(spark):
    base = some(30, 5, seed=4)
    rows = [(i, base[i % 30]) for i in range(-40, 200)] + [(40, base[3]), (40, base[10]), (60, base[0]), (60, base[0])]
    same(hnsw.nearest(table(spark, rows), shard_rows=10).collect(), plain_nearest(rows))
    one = [(k, [0.5, 0.5]) for k in range(100)]
    got = [tuple(r) for r in hnsw.nearest(table(spark, one)).collect()]
    assert sorted(got) == [(q, r + 1, ([j for j in range(100) if j != q])[r], 0.5) for q in range(0, 100, 20) for r in range(20)]


def test_few_candidates_short_vectors_and_empty_tables(spark):
    rows = [(0, [1.0]), (20, [0.5, -2.0]), (21, [3.0, 1.0, 1.0]), (22, [3.0, 1.0, 1.0, 0.0]), (23, [-0.0, 0.0])]
    same(hnsw.nearest(table(spark, rows, "double")).collect(), plain_nearest(rows))
    for none in ([], [(1, None)], [(20, [1.0])]):
        out = hnsw.nearest(table(spark, none))
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.collect() == []


def test_order_is_by_inner_product_whatever_the_lengths(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 8)) * rng.lognormal(0, 1.5, size=(400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = hnsw.nearest(table(spark, rows, "double")).collect(), plain_nearest(rows)
    assert len({(r.query_id, r.vec_id) for r in got} & {(a, c) for a, _, c, _ in want}) >= 0.95 * len(want)


def test_recall_of_one_graph():
    """Random directions and a large group of near copies, against all scores."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2500, 24))
    x[:600] = x[0] + 0.05 * x[:600]
    graph = hnsw.build(hnsw.on_sphere(x))
    q = np.arange(0, 2500, 20)
    score = x[q] @ x.T
    found = hnsw.search(graph, hnsw.as_queries(x[q]))
    want = np.argsort(-score, 1)[:, :20]
    got = [n[n >= 0][np.argsort(-s[n[n >= 0]])][:20] for n, s in zip(found, score, strict=True)]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got, want, strict=True)]) >= 0.95


def test_graph_has_levels_and_bounded_flat_neighbours():
    x = np.random.default_rng(2).normal(size=(1300, 6))
    graph = hnsw.build(hnsw.on_sphere(x), links=8, width=32)
    assert graph.sizes == [1300, 162, 20, 2] and [a.shape for a in graph.links] == [(1300, 16), (162, 8), (20, 8), (2, 8)]
    for size, a in zip(graph.sizes, graph.links, strict=True):
        assert a.max() < size and (a != np.arange(size)[:, None]).all()
        for row in a:
            own = row[row >= 0]
            assert len(set(own.tolist())) == len(own) and (own.size or size == 1)
