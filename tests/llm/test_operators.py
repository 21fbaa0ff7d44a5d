"""Each corpus operator against brute force on small tables, and its edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.llm import common, decontam, language, neardup, packing, pii, quality, rules, substring, urls
from reelquery.llm.queries import URL_RULES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, h string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=0, n=120):
    """Random texts with exact and near copies, shared passages, short, empty, null, long and odd texts."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghié") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    prose = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    passage = prose(70)
    texts = []
    for i in range(n):
        kind = i % 8
        if kind in (0, 1) or not texts:
            w = prose(rnd.randint(30, 160))
        elif kind == 2:
            w = list(rnd.choice(texts))
        elif kind in (3, 4):
            w = list(rnd.choice(texts))
            for _ in range(rnd.randint(1, 3)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        elif kind == 5:
            w = prose(rnd.randint(0, 40)) + passage[: rnd.randint(45, 70)] + prose(rnd.randint(0, 30))
        elif kind == 6:
            w = prose(rnd.randint(1, 6))
        else:
            w = prose(3) * rnd.randint(1, 60)
        texts.append(w)
    out = [(i, rnd.choice([" ", "\n", "\t ", " \u00a0"]).join(w)) for i, w in enumerate(texts)]
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "The one two"), (n + 4, "the ONE two"), (n + 5, "x" * 5000), (n + 6, "é\u00e8 \u4e2d\u6587 " * 400), (n + 7, " ".join(map(str, range(20000))))]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, True, "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus()


def words(t):
    return WORD.findall(t or "")


def shingle_set(t, size=5):
    w = words((t or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def test_near_duplicates_match_brute_force(spark, docs):
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, docs), percent=85).collect()}
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: r.component_id for i, r in got.items()} == {i: root(i) for i in sets}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_of_a_loose_group(spark):
    """Members that miss the smallest id still join: a chain of slow drift, which no star covers."""
    rnd = random.Random(3)
    w = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(w)))
        for k in range(3):
            w[(17 * i + k) % 300] = f"n{i}{k}{rnd.random()}"
    sets = {i: shingle_set(t) for i, t in rows}
    linked = [100 * len(sets[i] & sets[i + 1]) >= 85 * len(sets[i] | sets[i + 1]) for i in range(39)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert all(linked) and set(got.values()) == {0}


def test_near_duplicates_edge_rows(spark):
    t = "a b c d e f g h"
    rows = [(1, t), (1, t), (None, t), (2, t), (3, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 1, False), (3, 3, True)], key=str)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_posterior_thresholds_keep_similar_pairs():
    steps = [30, 60, 90, 120, 150]
    least = neardup.least_matches(0.85, 1e-6, steps)
    rng = np.random.default_rng(1)
    same = rng.random((20000, 150)) < 0.85
    for n, m in zip(steps, least, strict=True):
        assert (same[:, :n].sum(1) < m).mean() < 1e-3
    assert all(a < b for a, b in zip(least, least[1:], strict=False))


def removed_by_brute_force(rows, window=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [0, 5])
def test_repeated_windows_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = substring.repeated_windows(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == removed_by_brute_force(rows)


def test_repeated_windows_edge_rows(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(5, t), (5, t), (7, t + " tail"), (None, t), (9, None), (4, "short")]
    got = substring.repeated_windows(frame(spark, rows), with_text=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == removed_by_brute_force(rows)
    assert [r.kept_text for r in got if r.doc_id == 7] == ["tail"]
    assert substring.repeated_windows(frame(spark, [])).count() == 0


def test_cover_aligns_all_pairs():
    for i in range(31):
        for j in range(31):
            assert any((i + s) % 31 in substring.COVER and (j + s) % 31 in substring.COVER for s in range(31))


def test_contaminated_matches_brute_force(spark, docs):
    rnd = random.Random(2)
    texts = [t for _, t in docs if t]
    items = []
    for k in range(40):
        w = words(rnd.choice(texts))
        a = rnd.randrange(max(1, len(w) - 20))
        part = w[a : a + rnd.randint(3, 45)]
        if k % 3 == 0 and len(part) > 8:
            part[rnd.randrange(len(part))] = "changed"
        items.append((k, " ".join(part).upper() if k % 4 == 0 else " ".join(part)))
    items += [(100, None), (101, ""), (102, "the one TWO")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_found) for r in decontam.contaminated(frame(spark, docs), bench).collect()}
    expected = set()
    for i, t in docs:
        own = shingle_set(t)
        for j, b in items:
            s = shingle_set(b)
            if s and 100 * len(s & own) >= 80 * len(s):
                expected.add((i, j, len(s), len(s & own)))
    assert got == expected
    left = decontam.decontaminate(frame(spark, docs), bench)
    assert left.columns == frame(spark, docs).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({i for i, _ in docs} - {e[0] for e in expected})


def test_contaminated_in_blocks_and_empty(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, t) for k, t in docs[:12]], "item_id long, text string")
    whole = {tuple(r) for r in decontam.contaminated(frame(spark, docs), bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK", 150)
    assert {tuple(r) for r in decontam.contaminated(frame(spark, docs), bench).collect()} == whole
    # repeated rows, null ids and columns with the names that are used inside, over several groups of blocks
    monkeypatch.setattr(decontam, "AT_ONCE", 2)
    again = [(i, t, "x", 1) for i, t in docs + docs[:3]] + [(None, docs[0][1], "y", 2), (None, None, "y", 3), (77777, "", "y", 4)]
    wide = spark.createDataFrame(again, "doc_id long, text string, digest string, h int")
    twice = bench.union(bench.limit(2))
    found = {tuple(r) for r in decontam.contaminated(wide, twice).collect()}
    assert {f for f in found if f[0] is not None} == whole and {f[1:] for f in found if f[0] is None} == {f[1:] for f in whole if f[0] == docs[0][0]}
    bad = {t for i, t in docs if i in {f[0] for f in whole}}
    left = decontam.decontaminate(wide, twice)
    assert left.columns == wide.columns and sorted(map(str, left.collect())) == sorted(str(r) for r in wide.collect() if r.text not in bad)
    one_scan = decontam.contaminated(frame(spark, docs), bench.limit(4))._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in one_scan
    assert decontam.contaminated(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontam.contaminated(frame(spark, []), bench).count() == 0


PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits(s)))) % 10 == 0,
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return {k: [m.span() for m in p.finditer(t) if good[k](m.group())] for k, p in PLAIN.items()}


def test_base_spans_match_plain_patterns():
    rnd = random.Random(4)
    for _ in range(4000):
        t = "".join(rnd.choice("a1.@+-_() 2%5\n9é") for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("1234-5678 9012 3452", "9" * 6000 + ".1.1.1", "a" * 50000 + "@", "1" * 100000, "+1 (017) 555-7713 x@y.z_q@w.v 1.2.3.4.5.6.7.8"):
        assert pii.base_spans(t) == plain_spans(t) if len(t) < 4000 else pii.base_spans(t) is not None


def test_pii_query_and_redaction(spark):
    rows = [(1, 'mail 34@mail7.example.com, ip 10.0.0.255, card 4845168114407329 and +1 (017) 555-7713'), (2, None), (3, ""), (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok'), (None, "plain"), (4, "call (017) 555-7713 now")] + [(10 + i, f'key {i} user{i}@host.org secret = "{hashlib.sha1(str(i).encode()).hexdigest()}"') for i in range(40)]
    got = {(r.doc_id, r.spans): r for r in pii.find(frame(spark, rows)).collect()}
    for i, t in rows:
        base = plain_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k in base for a, b in base[k])
        mine = [r for (d, s), r in got.items() if d == i and s.startswith(joined)]
        assert any(r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() for r in mine)
        assert any([r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in base] for r in mine)
    assert any("secret:" in s for d, s in got if d == 4)
    out = {r.doc_id: r for r in pii.redact(frame(spark, rows[:4])).collect()}
    assert out[1].text == "mail <EMAIL>, ip <IP>, card <CARD> and <PHONE>" and out[2].text is None and out[3].text == "" and out[1].source == "s"
    assert pii.find(frame(spark, [])).count() == 0


def test_em_recovers_labeler_reliability():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.3
    votes = np.where(rng.random((20000, pii.LABELERS)) < 0.8, np.where(truth[:, None], 2, 0), np.where(truth[:, None], 0, 2))
    codes = (4 * 3**pii.LABELERS + sum(votes[:, j] * 3 ** (pii.LABELERS - 1 - j) for j in range(pii.LABELERS))) * pii.LENGTHS * pii.DIGITS
    seen, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
    post = pii.reliabilities(seen, counts.astype(float))[place]
    assert ((post > 0.5) == truth).mean() > 0.9


def test_urls(spark):
    given = [
        ("https://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/"),
        ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/"),
        ("https://x.org/en/5", "x.org", "/en/5", None),
        ("ftp://q.NET/es/é", "q.net", "/es/é", "net/es/"),
        ("https://com?x", "com", "", None),
        ("http://notcom/", "notcom", "/", None),
        ("http://a.com/", "a.com", "/", "com/"),
        ("no scheme", "", "", None),
        ("://É.COM/x://y", "É.com", "/x://y", "com/"),
        (None, "", "", None),
        ("", "", "", None),
    ]
    pages = spark.createDataFrame([(i, u[0], "h", "v") for i, u in enumerate(given)], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: r for r in urls.judge(pages, URL_RULES, labels).collect()}
    for i, (_, host, path, rule) in enumerate(given):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
    verdict = {None: "allow"} | {h + p: v for v, h, p in URL_RULES}
    assert all(got[i].verdict == verdict[g[3]] for i, g in enumerate(given))
    assert urls.judge(pages.limit(0), URL_RULES, labels).count() == 0


def test_url_templates_block_impure_branches(spark):
    rows = [(i, f"http://h.org/bad/item-{i}") for i in range(60)] + [(100 + i, f"http://h.org/good/{i}/page") for i in range(60)] + [(200 + i, f"http://h.org/tag/w{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60)] + [(100 + i, 0) for i in range(60)], "page_id long, bad int")
    got = {r.page_id: r for r in urls.judge(pages, [], labels).collect()}
    assert all(got[i].verdict == "block" for i in range(60))
    assert all(got[100 + i].verdict == "allow" and got[200 + i].verdict == "allow" for i in range(60))
    assert got[200].template == got[230].template and got[100].template != got[0].template


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    rows = [*docs, (None, "tie  two   spaces \n\n end <|endoftext|> "), (0, docs[0][1])]
    got = packing.pack(frame(spark, rows), tokenizer_path("byte_bpe_50k.json")).collect()
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append([*plain.encode(t or "", add_special_tokens=False).ids, 1])
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, all_ids in ids.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, all_ids))
        for r in pieces[i]:
            assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in all_ids)
    for i in set(ids) - {0}:
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    padding = 0
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.03 * sum(r.length for r in got)
    assert packing.pack(frame(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def lined(seed, n=400):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.6
        lines = [" ".join(word() for _ in range(rnd.randint(5, 20))) + "." for _ in range(rnd.randint(1, 6))]
        if not good:
            lines = [" | ".join(line.split()) if i % 2 else line.upper().replace(" ", "!! ") for line in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_classifier(spark):
    rows, labels = lined(1)
    rows += [(1000, None), (1001, ""), (None, "some words here"), (1002, "w " * 30000)]
    known = spark.createDataFrame([x for x in labels if x[0] % 3 != 1], "doc_id long, quality int")
    model = quality.fit(frame(spark, rows), known)
    got = {r.doc_id: r for r in quality.score(frame(spark, rows), model).collect()}
    held = [(got[i].predicted, y) for i, y in labels if i % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert got[1000].score == 0 and got[1001].score == 0 and 0 <= got[1002].score <= 1 and None in got
    one = quality.fit(frame(spark, rows), known.where("quality = 1"))
    assert one == 1.0 and quality.fit(frame(spark, []), known.limit(0)) == 0.5
    assert quality.score(frame(spark, []), model).count() == 0


def test_chain_marginals_match_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, s = rng.normal(size=7), rng.normal(size=(2, 2))
    text = np.array([0, 0, 0, 0, 1, 2, 2])
    got, _ = quality.marginals(e, s, text)
    for t in range(3):
        mine = np.flatnonzero(text == t)
        total, good = 0.0, np.zeros(len(mine))
        for y in itertools.product((0, 1), repeat=len(mine)):
            w = np.exp(sum(e[m] * v for m, v in zip(mine, y, strict=True)) + sum(s[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            good += w * np.array(y)
        assert np.allclose(got[mine], good / total)


def test_language_id(spark):
    rnd = random.Random(0)
    letters = {"xx": "abcdefgh", "yy": "efghijkl", "zz": "éèàçabno"}
    rows = [(i, " ".join("".join(rnd.choice(letters[k]) for _ in range(5)) for _ in range(30)), k) for i in range(300) for k in [rnd.choice(list(letters))]]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 !!", "xx"), (902, "", None), (None, "abc", None)], "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 4 != 2"))
    got = {r.doc_id: r for r in language.predict(docs.drop("lang"), model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows if i % 4 == 2]) > 0.98
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert language.fit(docs.limit(0)) == {} and {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}


def test_trigrams_match_plain_count():
    texts = ["Abc  d", "", "12", "é", "aa aa"]
    raw = [t.encode() for t in texts]
    t = common.Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    text, code, count, has = language.trigrams(t)
    table = language._letter_codes()
    for i, s in enumerate(texts):
        padded = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in s) + " ")
        expected = Counter()
        for k in range(len(padded) - 2):
            if padded[k + 1] != " ":
                a, b, c = (int(table[ord(x)]) for x in padded[k : k + 3])
                expected[(a * 64 + b) * 64 + c] += 1
        assert dict(zip(code[text == i].tolist(), count[text == i].tolist(), strict=True)) == dict(expected)
        assert has[i] == any(c.isalpha() for c in s)


def rule_counts(t):
    w = words(t)
    lines, seen, dup = (t or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    over = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] >= 2 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(over)


def test_rule_counts_match_brute_force(spark, docs):
    rows = [*docs, (500, "a\nb\na\n\n \na b\r\na"), (501, "\n\n"), (502, "x #*$%&|<>\nx #*$%&|<>")]
    got = rules.judge(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    for r in got:
        expected = rule_counts(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, r.doc_id
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert r.base_failed == failed and r.kept == (not failed)
    assert rules.judge(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_rules_reject_junk_and_bound_the_loss(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(6000):
        w = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
        bad = i % 4 == 0
        rows.append((i, " ".join(x + "&&&" for x in w) if bad else " ".join(w)))
        labels.append((i, int(not bad)))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in rules.judge(frame(spark, rows), known, risk=0.05).collect()}
    assert all(got[i] == bool(y) for i, y in labels)
    left = rules.filter_documents(frame(spark, rows), known, risk=0.05)
    assert left.columns == frame(spark, rows).columns and {r.doc_id for r in left.select("doc_id").collect()} == {i for i, y in labels if y}


def test_exact_binomial_bound():
    from math import comb

    for k, n, level in ((0, 50, 0.05), (3, 80, 0.01), (10, 10, 0.05)):
        p = rules.upper_bound(k, n, level)
        assert p == 1.0 or abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - level) < 1e-6


def test_intermediate_tables_go(spark):
    rows = frame(spark, [(i, f"a b c d e f {i // 2}") for i in range(20)])
    before = len(common._made)
    other = common.made()  # of someone else at the same time
    mine = common.materialize(rows, "other")
    got = neardup.near_duplicates(rows)
    assert len(common._made) - before == 3  # signatures, names and the other's
    common.release(other, [got])
    assert len(common._made) - before == 2
    with pytest.raises(Exception, match="(?i)exist|not find|not found"):
        mine.collect()
    assert got.count() == 20 and got.where("kept").count() == 10


def test_a_hot_window_is_split(spark):
    """Half of all rows under one hash: with low thresholds the join's plan shows that its partition is split."""
    from reelquery.llm import common, substring

    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in low}
    mark = common.made()
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        ids = spark.range(0, 120000, 1, 8)
        pairs = ids.select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.xxhash64("id")).alias("h"), F.col("id").alias("doc_id"))
        held = substring._held(pairs, True)
        assert held.count() == 59999
        counted = held.groupBy("doc_id").agg(F.count("*").alias("n"))
        counted.collect()
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        common.release(mark, [])
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
