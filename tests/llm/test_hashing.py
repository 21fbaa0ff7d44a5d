"""Hashes tell apart texts on which polynomials modulo a power of two collide."""

import numpy as np
import pytest

from reelquery.llm import common, decontam, lm, neardup, rules, substring

SCHEMA = "doc_id long, text string, lang string"


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def pair(a, b, n):
    """A sequence by the Thue-Morse rule, and the one with a and b exchanged."""
    bits = thue_morse(n)
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


def table(text, lower=False):
    raw = text.encode()
    return common.word_table(common.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), lower)


@pytest.mark.parametrize("n", [4, 16, 64, 256, 1024, 4096])
def test_words_and_lines(n):
    one, two = ("".join(x) for x in pair("a", "b", n))
    h = table(f"{one} {two} {one} {one.upper()}", lower=True).hash
    assert h[0] == h[2] == h[3] and h[0] != h[1]


def test_spans_of_every_length():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 99, 5000).astype(np.uint8)
    spans = [(a, a + k) for k in [*range(0, 40), 255, 256, 257, 300] for a in range(0, 4000, 401)]
    start, end = (np.array(x) for x in zip(*sorted(spans), strict=True))
    h = common.span_hash(raw, start, end)
    seen = {}
    for a, b, x in zip(start, end, h.tolist(), strict=True):
        assert seen.setdefault(raw[a:b].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("length", [1, 2, 3, 5, 20, 50, 64])
def test_windows(length):
    words = np.array([f"w{i % 7}" for i in range(300)])
    h = common.windows(table(" ".join(words)).hash, length)
    assert len(h) == 301 - length
    plain = [tuple(words[i : i + length]) for i in range(301 - length)]
    assert len(set(h.tolist())) == len(set(plain)) and all((h[i] == h[0]) == (plain[i] == plain[0]) for i in range(len(h)))


def test_documents(spark):
    bits_a, bits_b = pair("x", "y", 2048)
    docs = [(1, " ".join(f"u{i} {w}" for i, w in enumerate(bits_a)), "en"), (2, " ".join(f"v{i} {w}" for i, w in enumerate(bits_b)), "en")]
    # the same words at the same places, but for the exchanged ones
    docs += [(3, " ".join(w for i, w in enumerate(bits_a)), "en"), (4, " ".join(w for i, w in enumerate(bits_b)), "en")]
    whole_a, whole_b = ("".join(x) for x in pair("a", "b", 1024))
    docs += [(5, f"{whole_a}\n{whole_b}\n{whole_a} {whole_b}", "en")]
    df = spark.createDataFrame(docs, SCHEMA)
    removed = {r.doc_id: r.n_removed for r in substring.repeated_windows(df).collect()}
    windows = lambda w: {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
    shared = windows(bits_a)
    over = set()
    for i in range(2048 - 49):
        if tuple(bits_b[i : i + 50]) in shared:
            over.update(range(i, i + 50))
    assert removed == {1: 0, 2: 0, 3: 0, 4: len(over), 5: 0}
    counts = {r.doc_id: r for r in rules.judge(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert counts[5].n_dup_lines == 0
    groups = {r.doc_id: r.component_id for r in neardup.near_duplicates(df.where("doc_id = 5").union(spark.createDataFrame([(6, f"{whole_b}\n{whole_a}\n{whole_b} {whole_a}", "en")], SCHEMA))).collect()}
    assert groups == {5: 5, 6: 6}
    items = spark.createDataFrame([(1, whole_a), (2, whole_b + " " + whole_b)], "item_id long, text string")
    assert decontam.contaminated(spark.createDataFrame([(7, whole_b, "en"), (8, whole_a, "en")], SCHEMA), items).collect() == [(8, 1, 1, 1)]
    known = {r.doc_id: r.n_known for r in lm.score(spark.createDataFrame([(9, f"q {whole_a}", "en"), (10, f"q {whole_b}", "en")], SCHEMA)).collect()}
    assert known == {9: 0, 10: 0}
