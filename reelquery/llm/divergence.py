"""Source divergence audit: how differently the sources of a language use its terms, in exact integers.

Each kept term of a language becomes one wide vector, an array of (source index, count) in the order of the sources;
sources without the term are left out of it.  Higher-order functions emit what each pair of sources in a vector adds to
their divergence, and map-side aggregation sums it.  Terms that one or both sources of a pair lack all share the value of
count 0, so they add in closed form: by the language's number of terms, and by how many terms have each count.

Texts are counted in Arrow batches, whatever follows is DataFrame functions.  With z a source's share of a count of 0 and f the contribution of two shares, the sum
over all terms is V f(z, z), plus f(p, z) - f(z, z) for every term of the one source, plus f(z, p) - f(z, z) for every term
of the other, plus f(p, p') - f(p, z) - f(z, p') + f(z, z) for every term of both.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are counted in this many parts.
PARTS = 1_000_000_000


#: A task sends what it has counted once it holds this many terms of groups.
HELD = 400_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, df: occurrences and rows of each term, counted over as many rows of a task as fit in memory.

    A term is a run of letters A-Z, lower-cased, and of anything beyond ASCII, unchanged; in UTF-8 that is a run of bytes.
    """
    find, counts, held = re.compile(TERM.encode()).findall, {}, 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in counts.items():
            found = [t.decode() for t in n]
            k = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(found, pa.string()), pa.array(n.values(), pa.int64()), pa.array((df[t] for t in n), pa.int64())], ["lang", "source", "term", "n", "df"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, df = counts.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            found = find(bytes(text.as_buffer()).translate(_LOWER))
            n.update(found)
            df.update(set(found))
            held += len(n) - before
            if held > HELD:
                yield from flush()
                counts, held = {}, 0
    yield from flush()


def share(count: Column, total: Column) -> Column:
    """1 + floor(PARTS (count + 1) / total), exact for any whole numbers (null where the total is 0)."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, F.nullif(total, F.lit(0)).cast("decimal(20,0)"))


def contribution(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _groups(docs: DataFrame) -> DataFrame:
    """lang, source, idx: every occurring group, numbered from 0 by source within its language."""
    return docs.select("lang", "source").distinct().withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def _vectors(docs: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """lang, term, total, counts (array of struct idx, n by idx) of the terms in at least ``least`` rows of the language."""
    C.small_batches(docs.sparkSession)
    counted = docs.mapInArrow(term_counts, "lang string, source string, term string, n long, df long")
    by_source = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    indexed = by_source.join(groups, ["lang", "source"]).select("lang", "term", "idx", "n", "df")
    wide = indexed.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("idx", "n"))).alias("counts"))
    return wide.where(F.col("df") >= least).drop("df")


def _languages(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """lang, v, n_lang, totals, zeros (by source index): kept terms, their occurrences, and each source's; zeros are the shares of count 0."""
    v = vectors.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    own = vectors.select("lang", F.inline("counts")).groupBy("lang", "idx").agg(F.sum("n").alias("n"))
    per = groups.join(own, ["lang", "idx"], "left").groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.coalesce("n", F.lit(0).cast("long")).alias("n")))), lambda x: x["n"]).alias("totals"))
    both = per.join(v, "lang", "left").select("lang", F.coalesce("v", F.lit(0).cast("long")).alias("v"), F.coalesce("n_lang", F.lit(0).cast("long")).alias("n_lang"), "totals")
    return both.withColumn("zeros", F.transform("totals", lambda n: share(F.lit(0).cast("long"), n + F.col("v"))))


def _pairs(vectors: DataFrame, languages: DataFrame) -> DataFrame:
    """lang, i, j, value for every two sources of a language: the divergence of i from j over all kept terms."""
    zero = lambda k: F.get(F.col("zeros"), k)
    add = lambda j, x: F.struct(j.alias("j"), x.alias("value"))
    # Both sources have the term.
    total = lambda idx: F.get(F.col("totals"), idx) + F.col("v")
    shares = F.transform("counts", lambda c: F.struct(c["idx"].alias("j"), share(c["n"], total(c["idx"])).alias("q"), zero(c["idx"]).alias("zj")))
    held = vectors.select("lang", "counts").join(languages, "lang").select("lang", shares.alias("shares"))
    one = held.select("lang", "shares", F.explode("shares").alias("one")).select("lang", "shares", F.col("one.j").alias("i"), F.col("one.q").alias("p"), F.col("one.zj").alias("zi"))
    two = one.select("lang", "i", "p", "zi", F.inline(F.filter("shares", lambda s: s["j"] != F.col("i"))))
    f = lambda a, b: contribution(F.col(a), F.col(b))
    both = two.select("lang", "i", "j", (f("p", "q") - f("p", "zj") - f("zi", "q") + f("zi", "zj")).alias("value"))
    # One source has it: as many terms as have that count there.
    counts = vectors.select("lang", F.inline("counts")).groupBy("lang", "idx", "n").agg(F.count("*").alias("m")).join(languages, "lang")
    counts = counts.withColumns({"p": share(F.col("n"), F.get("totals", F.col("idx")) + F.col("v")), "zi": zero(F.col("idx")), "other": F.explode(F.sequence(F.lit(0), F.size("totals") - 1))}).where("other <> idx")
    zj = zero(F.col("other"))
    ahead = counts.select("lang", F.col("idx").alias("i"), F.col("other").alias("j"), (F.col("m") * (contribution(F.col("p"), zj) - contribution(F.col("zi"), zj))).alias("value"))
    behind = counts.select("lang", F.col("other").alias("i"), F.col("idx").alias("j"), (F.col("m") * (contribution(zj, F.col("p")) - contribution(zj, F.col("zi")))).alias("value"))
    # No term at all: count 0 on both sides, for all kept terms.
    every = languages.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("totals") - 1)))
    js = F.filter(F.sequence(F.lit(0), F.size("totals") - 1), lambda j: j != F.col("i"))
    none = every.select("lang", "i", F.inline(F.transform(js, lambda j: add(j, F.coalesce(F.col("v") * contribution(zero(F.col("i")), zero(j)), F.lit(0).cast("long"))))))
    parts = [x.groupBy("lang", "i", "j").agg(F.sum("value").alias("value")) for x in (both, ahead, behind)]
    return none.union(parts[0]).union(parts[1]).union(parts[2]).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def _terms(vectors: DataFrame, groups: DataFrame, languages: DataFrame, most: int) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source has more of than its language, the ``most`` largest."""
    per = vectors.select("lang", "term", "total", F.inline("counts")).join(languages.drop("zeros"), "lang")
    p, q = share(F.col("n"), F.get("totals", F.col("idx")) + F.col("v")), share(F.col("total"), F.col("n_lang") + F.col("v"))
    over = per.select("lang", "idx", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "idx", "item", contribution(F.col("p"), F.col("q")).alias("value"))
    first = Window.partitionBy("lang", "idx").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = over.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    return ranked.join(groups, ["lang", "idx"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: divergences between the sources of each language, and each source's own terms.

    Null text, lang and source count as empty.  A repeated row counts as another document.  A language keeps the terms in
    at least ``least`` of its rows.  Part ``pair``: every other source of the language with the divergence over all kept
    terms (0 if there are none); part ``term``: the ``most`` terms that the source has more of than its language.  Ranks run
    from 1 in each group and part, by value downwards, then by the item's bytes.  A source that is alone in its language
    has no ``pair`` rows; an empty table gives none at all.  Texts of any length are read whole; further columns of
    ``docs`` are ignored.  Values beyond 64 bits fail the job instead of wrapping around.
    """
    scope = C.made()
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = C.materialize(_groups(given), "sources")
    vectors = C.materialize(_vectors(given, groups, least), "term-vectors")
    languages = C.materialize(_languages(groups, vectors), "languages")
    pairs = _pairs(vectors, languages)
    one, two = groups.select("lang", F.col("idx").alias("i"), "source"), groups.select("lang", F.col("idx").alias("j"), F.col("source").alias("item"))
    named = pairs.join(one, ["lang", "i"]).join(two, ["lang", "j"])
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    out = ranked.union(_terms(vectors, groups, languages, most))
    C.release(scope, [out])
    return out
