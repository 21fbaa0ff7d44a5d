"""Stupid backoff against brute force, in blocks and buckets of any size, and its edge cases."""

import math
from collections import Counter

import numpy as np
import pytest
from test_operators import corpus, frame, words

from reelquery.llm import lm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, order, backoff):
    count = lambda w: Counter(tuple(w[i : i + k]) for k in range(order + 1) for i in range(len(w) - k + 1) if k or i < len(w))
    whole = Counter()
    for _, w in texts:
        whole.update(count(w))
    out = []
    for doc, w in texts:
        own = count(w)
        rest = lambda g: whole[g] - own[g]  # noqa: B023, E731
        total, known, full = 0.0, 0, 0
        for i in range(len(w)):
            m = min(i, order - 1)
            for k in range(m + 1, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if rest(g) > 0:
                    total += (m + 1 - k) * math.log(backoff) + math.log(rest(g) / rest(g[:-1]))
                    known += k > 1
                    full += k == order
                    break
            else:
                total += (m + 1) * math.log(backoff) - math.log(max(1, rest(())))
        out.append((doc, len(w), known, full, total))
    return out


def plain(rows):
    return [(i, words((t or "").translate(LOW))) for i, t in rows]


def key(x):
    return x[0] is not None, x[0], x[1:]


@pytest.mark.parametrize(("order", "block", "bucket"), [(3, 16 << 20, 4_000_000), (3, 3000, 500), (1, 3000, 4_000_000), (2, 20000, 500), (5, 20000, 4_000_000)])
def test_scores_match_brute_force(spark, order, block, bucket):
    rows = [*corpus(), (0, "abc abc again"), (None, "abc ab"), (None, "abc ab"), (7, None)]
    expected = sorted(brute(plain(rows), order, 0.4), key=key)
    got = sorted(((r.doc_id, r.n_words, r.n_known, r.n_full, r.log_score, r.mean_log) for r in lm.score(frame(spark, rows), order=order, block_bytes=block, bucket_tokens=bucket).collect()), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-3
        assert abs(a[5] - (b[4] / b[1] if b[1] else 0)) < 1e-5


@pytest.mark.parametrize(("block", "bucket", "row", "cell"), [(3000, 300, 50, 400), (3000, 300, 300, 100_000), (900, 40, 20, 60), (50_000, 100, 1 << 30, 1000)])
def test_cells_between_blocks_and_buckets_change_nothing(spark, block, bucket, row, cell):
    rows = [*corpus(), (0, "abc abc again"), (None, "abc ab"), (None, "abc ab"), (7, None)]
    size = sum(len((t or "").encode()) for _, t in rows)
    ranges, fine, groups = lm._layout(size, 3, block, bucket, row, cell, 4)
    assert fine > 1 and (groups > 1 or cell > 500)
    of = lambda **k: sorted((tuple(r) for r in lm.score(frame(spark, rows), **k).collect()), key=str)
    assert of(block_bytes=block, bucket_tokens=bucket, row_grams=row, cell_tokens=cell) == of()


def test_rows_stay_long_at_any_size():
    """N-grams of a row, by the layout: from blocks to ranges, and from cells to buckets; and how many a cell holds."""
    for size in (10**9, 3 * 10**10, 10**12, 10**13, 10**14):
        ranges, fine, groups = lm._layout(size, 3, lm.BLOCK_BYTES, lm.BUCKET_TOKENS, lm.ROW_GRAMS, lm.CELL_TOKENS, 1000)
        grams = lm.BLOCK_BYTES * 3 // 6
        assert grams / ranges >= lm.ROW_GRAMS and ranges * fine * lm.BUCKET_TOKENS >= size * 3 // 6
        if fine > 1:
            held = size / lm.BLOCK_BYTES / groups * grams / ranges
            assert lm.CELL_TOKENS / 2 < held < 2 * lm.CELL_TOKENS and held / fine >= lm.ROW_GRAMS
    # a thousandth of everything: the same number of n-grams in a row
    small = lm._layout(10**11, 3, lm.BLOCK_BYTES // 1000, lm.BUCKET_TOKENS // 1000, lm.ROW_GRAMS, lm.CELL_TOKENS // 1000, 4)
    assert lm.BLOCK_BYTES // 1000 * 3 // 6 / small[0] >= lm.ROW_GRAMS


def test_small_tables(spark):
    assert lm.score(frame(spark, [])).count() == 0
    only = lm.score(frame(spark, [(1, "a b a")])).collect()
    assert [(r.n_words, r.n_known) for r in only] == [(3, 0)]
    assert abs(only[0].log_score - (1 + 2 + 3) * math.log(0.4)) < 1e-3
    with pytest.raises(ValueError):
        lm.score(frame(spark, []), order=0)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1000):
        for top in (1, 255, 256, 1 << 40, (1 << 64) - 1):
            x = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
            assert (lm.unpack_numbers(lm.pack_numbers(x), n) == x).all()
            s = np.sort(x)
            assert not n or (lm.unpack_sorted(lm.pack_sorted(s), n) == s).all()


def test_order_is_stable_where_leading_bits_are_equal():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, 5000, dtype=np.uint64) + (rng.integers(0, 2, 5000, dtype=np.uint64) << np.uint64(60))
    assert (lm.ordered(x) == np.argsort(x, kind="stable")).all()
