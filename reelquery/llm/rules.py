"""Quality rules with risk-controlled thresholds (operator 9).

Each document gets exact counts and a handful of ratios, every ratio cut into fixed bins.  Labelled documents are a
holdout, and the error allowed is spent on whole sets of cutoffs: a tenth of the good documents (by a hash of doc_id)
and the bad ones order the cutoffs of all rules into one chain, from the widest distance to any good document seen to
the narrowest; the other good documents test the sets along the chain one after the other until the first failure
(fixed-sequence testing, so each set is tested at the full level).  A set passes if the exact (Clopper-Pearson) upper
bound on its false-rejection rate is at most ``risk``; losses of several rules are added, which never understates them.
Strata (languages) with too few labels to pass even without a loss (at 4 groups, risk 0.01 and delta 0.05 that takes 436
good documents in the test, 299 for a single group) are tested together as one group, joined by the smallest others where
they are too few even so, and ``delta`` is split over the groups.  So in every group at most ``risk`` of the good documents are falsely rejected,
with probability ``1 - delta``; for strata tested together this holds for their documents taken together.  If all labels
together are too few, nothing is rejected.  Any number of strata is handled alike: counts and cutoffs are tables.

Edge cases: a null text is empty and fails the base rule; null languages form a stratum of their own; repeated doc_ids
are judged row by row, and a label that occurs several times counts each time; null labels are ignored; without labels
only the base rule acts; other columns are ignored (they pass through ``filter_documents``).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Ratios that rise with junk.
RULES = ("symbols_per_char", "upper_share", "pipes_per_word", "bang_per_word", "repeat_share", "dup_line_share", "digit_share", "short_words", "long_words")
BINS = 64
#: Kinds of labelled documents: bad, good ones of the test, good ones seen when the chain is ordered (one of PARTS).
BAD, GOOD, SEEN, PARTS = 0, 1, 2, 10
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flag)))[offsets])


def line_table(texts: C.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every line with a word; lines end at a newline or the text's end."""
    data, off = texts
    new = data == 10
    begin = C.unique(np.concatenate((off[:-1], np.flatnonzero(new) + 1)))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))[: len(begin)]
    stop = stop - new[stop - 1] if len(stop) else stop
    inside = np.concatenate(([0], np.cumsum(~C._IS_SPACE[data])))
    has = inside[stop] > inside[begin]
    begin, stop = begin[has], stop[has]
    return begin, stop, np.searchsorted(off, begin, "right") - 1


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in C.groups(batches):
        data, off = texts
        rows = part.num_rows
        words = C.word_table(texts)
        n_words = np.diff(words.first)
        inside = ~C._IS_SPACE[data]
        chars = _per_text(inside & ((data & 0xC0) != 0x80), off)
        symbols = _per_text(_SYMBOLS[data], off)
        begin, stop, line_text = line_table(texts)
        lines = np.bincount(line_text, minlength=rows)
        dup = lines - np.bincount(C.distinct(C.span_hash(data, begin, stop), line_text)[1], minlength=rows)

        at, text = C.window_starts(words, 3)
        h = C.windows(words.hash, 3)[at]
        order = np.lexsort((h, text))
        same = np.zeros(len(h), bool)
        equal = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
        same[order[1:][equal]] = True
        same[order[:-1][equal]] = True
        over = np.zeros(len(words.hash) + 3, bool)
        for k in range(3):
            over[at[same] + k] = True
        repeat = np.diff(np.concatenate(([0], np.cumsum(over)))[words.first])

        upper = _per_text((data >= 65) & (data <= 90), off)
        lower = _per_text((data >= 97) & (data <= 122), off)
        length = words.end - words.start
        by_word = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[words.first])
        over_one = lambda x: np.maximum(x, 1)
        ratios = np.stack(
            [
                symbols / over_one(chars),
                upper / over_one(upper + lower),
                _per_text(data == 124, off) / over_one(n_words),
                _per_text(data == 33, off) / over_one(n_words),
                repeat / over_one(n_words),
                dup / over_one(lines),
                _per_text((data >= 48) & (data <= 57), off) / over_one(chars),
                by_word(length == 1) / over_one(n_words),
                by_word(length > 24) / over_one(n_words),
            ],
            1,
        )
        bins = np.minimum(np.ceil(np.sqrt(np.minimum(ratios, 1.0)) * BINS), BINS).astype(np.int32)
        cols = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}
        yield pa.RecordBatch.from_arrays(
            [*(part.column(k) for k in range(part.num_columns - 1)), *(pa.array(v.astype(np.int64)) for v in cols.values()), C.lists(bins.ravel(), np.full(rows, len(RULES)), pa.int32())],
            names=[*part.schema.names[:-1], *cols, "bins"],
        )


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bins array<int>"
_BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate at which k or fewer of n still have probability ``level``."""
    if n == 0 or k >= n:
        return 1.0
    lead = math.lgamma(n + 1)

    def cdf(p: float) -> float:
        logs = [lead - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) > level else (low, mid)
    return high


def allowed_losses(n: int, level: float, risk: float) -> int:
    """The most losses among ``n`` whose upper bound at ``level`` is at most ``risk``; -1 if even none is too many."""
    if n == 0 or not 0 < risk < 1:
        return n if risk >= 1 else -1
    total, lead = 0.0, math.lgamma(n + 1)
    for k in range(n):
        total += math.exp(lead - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk))
        if total > level:
            return k - 1
    return n - 1


def least_good(parts: int, risk: float, delta: float) -> float:
    """The fewest good documents of a test that can certify anything where ``parts`` groups share ``delta``."""
    if risk >= 1:
        return 0
    return math.ceil(math.log(delta / parts) / math.log1p(-risk)) if 0 < risk else math.inf


def alone(sizes: list[tuple[int, int]], risk: float, delta: float) -> tuple[float, int]:
    """(least, groups): strata with ``least`` good documents or more are tested alone, all others together as one group.

    ``sizes``: (good documents, number of strata that have as many).  As many strata stand alone as can while each group,
    that of the others too, can still certify something; strata of equal size are treated alike.
    """
    total, many = sum(g * k for g, k in sizes), sum(k for _, k in sizes)
    out, j, used = (math.inf, 1), 0, 0
    for good, k in sorted(sizes, reverse=True):
        j, used = j + k, used + good * k
        parts = j + (j < many)
        need = least_good(parts, risk, delta)
        if good < need:
            break
        if j == many or total - used >= need:
            out = (good, parts)
    return out


def groups(good: dict[str, int], risk: float, delta: float) -> list[list[str]]:
    """Strata that are tested together, by their numbers of good documents in the test."""
    least, _ = alone(list(Counter(good.values()).items()), risk, delta)
    out = [[s] for s in good if good[s] >= least]
    rest = sorted(s for s in good if good[s] < least)
    return sorted(out + [rest] * bool(rest), key=lambda g: (sum(good[s] for s in g), g))


def chain(bad: np.ndarray, good: np.ndarray, seen: np.ndarray, level: float, risk: float) -> list[int]:
    """The cutoff bin of each rule of one group (BINS + 1: none); counts of each kind by rule and bin."""
    steps, lost = [], []
    for r in range(len(RULES)):
        lost.append(np.append(good[r][::-1].cumsum()[::-1], 0))
        caught, known = bad[r][::-1].cumsum()[::-1], seen[r][::-1].cumsum()[::-1]
        net = caught - 10 * PARTS * known
        best = BINS - int(net[:0:-1].argmax())
        if net[best] > 0:
            top = int(np.flatnonzero(seen[r]).max(initial=0))
            steps += [(int(known[b]), top - b, r, b) for b in range(best, BINS + 1) if bad[r][b]]
    left = allowed_losses(int(good[0].sum()), level, risk)
    cut = [BINS + 1] * len(RULES)
    for _, _, r, b in sorted(steps):
        left -= int(lost[r][b] - lost[r][cut[r]])
        if left < 0:
            break
        cut[r] = b
    return cut


def select_cutoffs(counts: dict[tuple[str, int, int, int], int], strata: list[str], risk: float, delta: float) -> dict[tuple[str, int], int]:
    """The cutoff bin of each (stratum, rule) that has one; ``counts`` by (stratum, rule, bin, kind: BAD, GOOD or SEEN)."""
    shared = groups({s: sum(counts.get((s, 0, b, GOOD), 0) for b in range(BINS + 1)) for s in strata}, risk, delta)
    out = {}
    for g in shared:
        at = lambda kind: np.array([[sum(counts.get((s, r, b, kind), 0) for s in g) for b in range(BINS + 1)] for r in range(len(RULES))])  # noqa: B023, E731
        cut = chain(at(BAD), at(GOOD), at(SEEN), delta / len(shared), risk)
        out |= {(s, r): b for s in g for r, b in enumerate(cut) if b <= BINS}
    return out


def _known(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")


def _measured(docs: DataFrame) -> DataFrame:
    C.small_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return given.mapInArrow(_measure, f"doc_id long, stratum string, {_COUNTS}")


def certify(measured: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """stratum, cutoffs (by rule) of every labelled stratum, a table.

    Counts by stratum, rule, bin and kind stay in tables and each group's chain runs in a task of its own; the driver sees
    only how many strata have how many good documents (at most the square root of twice the labels).
    """
    kind = F.when(F.col("quality") == 0, BAD).when(C.fold("doc_id", PARTS) == 0, SEEN).otherwise(GOOD)
    counted = measured.where(f"not ({_BASE})").join(_known(labels), "doc_id").select("stratum", kind.alias("kind"), F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin", "kind").count()
    counted = C.materialize(counted, "bins")
    tested = (F.col("rule") == 0) & (F.col("kind") == GOOD)
    strata = C.materialize(counted.groupBy("stratum").agg(F.sum(F.when(tested, F.col("count")).otherwise(0)).alias("good")), "strata")
    least, parts = alone([tuple(x) for x in strata.groupBy("good").count().collect()], risk, delta)
    own = strata.select("stratum", (F.when(F.col("good") >= least, F.col("stratum")) if least < math.inf else F.lit(None).cast("string")).alias("part"))
    shared = counted.join(own, "stratum").groupBy("part", "rule", "bin", "kind").agg(F.sum("count").alias("n"))

    def cut(group: pa.Table) -> pa.Table:
        at = np.zeros((3, len(RULES), BINS + 1), np.int64)
        at[tuple(group.column(c).to_numpy() for c in ("kind", "rule", "bin"))] = group.column("n").to_numpy()
        found = chain(at[BAD], at[GOOD], at[SEEN], delta / parts, risk)
        return pa.table({"part": group.column("part").slice(0, 1), "cutoffs": pa.array([found], pa.list_(pa.int32()))})

    found = shared.groupBy("part").applyInArrow(cut, "part string, cutoffs array<int>").withColumnRenamed("part", "__part")
    return C.materialize(own.join(found, F.col("part").eqNullSafe(F.col("__part"))).select("stratum", "cutoffs"), "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs`` (doc_id, text, lang, anything else)."""
    mark = C.made()
    measured = C.materialize(_measured(docs), "measured")
    hit = F.coalesce(F.exists(F.arrays_zip("bins", "cutoffs"), lambda x: x["bins"] >= x["cutoffs"]), F.lit(False))
    measured = measured.join(certify(measured, labels, risk, delta), "stratum", "left")
    out = measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(_BASE).alias("base_failed"), (~F.expr(_BASE) & ~hit).alias("kept"))
    C.release(mark, [out])
    return out


def _passing(text: int, lang: int):
    """The rows that pass the base rule, with their stratum and bins at the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in C.groups(iter([batch]), batch.schema.names[text]):
                strata = part.column(lang).fill_null("")
                given = pa.RecordBatch.from_arrays([strata, part.column(text).fill_null("")], names=["stratum", "text"])
                m = pa.Table.from_batches(list(_measure(iter([given]))))
                n, repeat = m.column("n_words").to_numpy(), m.column("n_repeat_words").to_numpy()
                names = [f"c{k}" for k in range(part.num_columns + 2)]
                yield pa.RecordBatch.from_arrays([*part.columns, strata, m.column("bins").combine_chunks()], names=names).filter(pa.array((n >= 50) & (100 * repeat <= 50 * n)))

    return run


def filter_documents(docs: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, judged row by row; rows are measured again and meet their stratum's cutoffs."""
    mark = C.made()
    cutoffs = certify(_measured(docs), labels, risk, delta).withColumnRenamed("stratum", "s")
    k = len(docs.columns)
    schema = ", ".join([*(f"c{j} {f.dataType.simpleString()}" for j, f in enumerate(docs.schema)), f"c{k} string", f"c{k + 1} array<int>"])
    passing = docs.mapInArrow(_passing(docs.columns.index("text"), docs.columns.index("lang")), schema)
    hit = F.exists(F.arrays_zip(F.col(f"c{k + 1}").alias("b"), F.col("cutoffs").alias("c")), lambda x: x["b"] >= x["c"])
    out = passing.join(cutoffs, F.col(f"c{k}") == F.col("s"), "left").where(~F.coalesce(hit, F.lit(False))).select(*(F.col(f"c{j}").alias(c) for j, c in enumerate(docs.columns)))
    C.release(mark, [out])
    return out
