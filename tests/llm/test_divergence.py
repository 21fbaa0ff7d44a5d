"""The divergence audit against plain loops over exact whole numbers."""

import re
from collections import Counter

from pyspark.sql import functions as F

from reelquery.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, least=3, most=200):
    """``rows``: (text, lang, source)."""
    docs = [(lang or "", source or "", Counter(re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in d[2])
        kept = [t for t, n in seen.items() if n >= least]
        sources = sorted({d[1] for d in own})
        count = {s: Counter() for s in sources}
        for _, s, c in own:
            count[s].update({t: c[t] for t in kept if t in c})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(count[s]) for s in sources}, share(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] > 0 and p[s][t] > q[t])[:most]
            out += [(lang, s, part, item.decode(), -v, r + 1) for part, found in (("pair", pair), ("term", term)) for r, (v, item) in enumerate(found)]
    return sorted(out)


def audited(spark, rows, parts=3, **options):
    docs = spark.createDataFrame([(k, *r, 0.5, "c") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n double, term string")
    df = divergence.audit(docs.repartition(parts), **options)
    assert df.columns == COLUMNS and dict(df.dtypes)["value"] == "bigint" and dict(df.dtypes)["rank"] == "int"
    return sorted(map(tuple, df.collect()))


ROWS = [
    ("Über das über-Maß hinaus, ÜBER alles: É é", "de", "a"), ("das Maß das Maß x1y x2y", "de", "b"), ("Das! maß? über", "de", "b"), ("nothing kept here", "de", "c"), (None, "de", "d"),
    ("one two two three", "en", "a"), ("one two three three", "en", "b"), ("one, two; THREE", "en", "c"), ("one two three", "en", "é"), ("one two three", "en", None), ("日本 one 日本", "en", "a"),
    ("a b c", None, "a"), ("a b c", "", "b"), ("a b", "", None), ("", "fr", "a"), (None, "fr", None), ("...", "xx", "alone"), ("a b c", "", "b"),
]


def test_against_plain_loops(spark):
    want = plain(ROWS)
    assert audited(spark, ROWS) == want
    assert {r[2] for r in want if r[0] == "fr"} == {"pair"} and not [r for r in want if r[0] == "xx"]
    assert audited(spark, ROWS, least=1, most=2) == plain(ROWS, 1, 2)


def test_hot_source_very_long_text_and_many_sources(spark):
    rows = [(" ".join(f"w{chr(97 + (i * k) % 23)}" for k in range(30)), "en", "hot" if i % 3 else f"s{i % 40}") for i in range(150)]
    rows += [("long " * 60000 + "wb wc", "en", "s1"), ("x" * 300000 + " wb", "en", "s2")]
    assert audited(spark, rows) == plain(rows)


def test_sending_early_changes_nothing(spark, monkeypatch):
    batch = spark.createDataFrame(ROWS, "text string, lang string, source string").select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text"))).toArrow().combine_chunks().to_batches()

    def sums():
        n, df = Counter(), Counter()
        for b in divergence.term_counts(iter(batch)):
            for r in b.to_pylist():
                n[r["lang"], r["source"], r["term"]] += r["n"]
                df[r["lang"], r["source"], r["term"]] += r["df"]
        return n, df

    whole = sums()
    monkeypatch.setattr(divergence, "HELD", 2)
    assert sums() == whole


def test_counts_of_any_size_are_exact(spark):
    big = 4 * 10**12
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(7 * 10**12 + 1)).alias("p"), divergence.share(F.lit(0), F.lit(0)).alias("none")).first()
    assert row.p == 1 + 10**9 * (big + 1) // (7 * 10**12 + 1) and row.none is None


def test_empty_table(spark):
    assert audited(spark, []) == []
