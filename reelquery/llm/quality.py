"""Document quality by a linear-chain conditional random field over lines (operator 5).

Every line with a word gets ratios of its bytes and words, those of its neighbours, and its place among its document's
lines.  A two-state chain (bad, good) is trained on labelled documents whose lines inherit the document's label, by
gradient ascent on the conditional likelihood; forward-backward marginals of all lines then average, weighted by line
length, into the document's score.

Training uses at most ``sample`` labelled documents, those with the smallest hashes of their ids, and all of their lines
(the documented bound of the sample; a line takes about 0.6 KB of the driver's memory).  Scoring covers every line of
every text.

Edge cases: an empty or null text, or one without words, scores 0, which is fixed and not learned; without both labels in the sample every document
scores the share of good labels (0.5 without any); rows that repeat a doc_id are scored one by one; a doc_id labelled
twice counts as good if at least half its labels do; doc_id may be null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .rules import line_table

#: Most labelled rows to learn from; their texts are taken whole.
SAMPLE = 6000
OWN = 16


def line_features(texts: C.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, text) of every line with a word."""
    data, _ = texts
    begin, stop, text = line_table(texts)
    if not len(begin):
        return np.zeros((0, OWN), np.float32), np.zeros(0, np.int64), text
    words = C.word_table(texts)
    low, high = np.searchsorted(words.start, begin), np.searchsorted(words.start, stop)
    n = np.maximum(high - low, 1)
    length = stop - begin

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag)))
        return total[stop] - total[begin]

    def in_words(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag)))
        return total[high] - total[low]

    upper, lower = share((data >= 65) & (data <= 90)), share((data >= 97) & (data <= 122))
    letters = upper + lower + share(data >= 128)
    again = np.zeros(len(words.hash), bool)  # the word before in the text, or the one before that, is the same
    of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    again[1:] |= (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    again[2:] |= (words.hash[2:] == words.hash[:-2]) & (of[2:] == of[:-2])
    size = words.end - words.start
    hashed = C.span_hash(data, begin, stop)
    _, place, count = np.unique(hashed ^ C.mix(text.astype(np.uint64)), return_inverse=True, return_counts=True)
    key = words.hash ^ C.mix(np.repeat(np.arange(len(begin)), high - low).astype(np.uint64)) if (high - low).sum() == len(words.hash) else words.hash
    order = np.argsort(key, kind="stable")
    first = np.zeros(len(key), bool)
    first[order] = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else []
    out = np.stack(
        [
            np.ones(len(begin)),
            np.log1p(length) / 8,
            np.log1p(high - low) / 6,
            letters / length,
            upper / np.maximum(upper + lower, 1),
            share((data >= 48) & (data <= 57)) / length,
            share(np.isin(data, np.frombuffer(b"#*$%&<>", np.uint8))) / length,
            share(data == 124) / n,
            share(data == 33) / n,
            share(np.isin(data, np.frombuffer(b".,;:?", np.uint8))) / n,
            in_words(again) / n,
            in_words(first) / n,
            in_words(size) / n / 16,
            in_words(size == 1) / n,
            in_words(size > 20) / n,
            (count[place] > 1).astype(float),
        ],
        1,
    )
    return out.astype(np.float32), length, text


def with_neighbours(own: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Own features, then those of the lines before and after (zeros at a text's ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        same = (text[1:] == text[:-1])[:, None]
        before[1:] = own[:-1] * same
        after[:-1] = own[1:] * same
    return np.concatenate((own, before, after), 1)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # evidence for good against bad
    step: np.ndarray  # 2 x 2 transition scores


#: Chains are walked in pieces of this many lines.
PIECE = 256


def marginals(evidence: np.ndarray, step: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line good) for every line, and summed pair marginals (2 x 2); chains run over lines of one text.

    All chains advance together, the longest first, so a step costs one vector operation over the chains still running.
    A chain of more than ``PIECE`` lines is walked in pieces: the product of each piece's steps tells what enters the next
    one, then all pieces advance together; so a very long text takes few steps too.
    """
    n = len(evidence)
    pairs = np.zeros((2, 2))
    if not n:
        return np.zeros(0), pairs
    new = np.concatenate(([True], text[1:] != text[:-1]))
    chain = np.cumsum(new) - 1
    place = np.arange(n) - np.flatnonzero(new)[chain]
    head = np.flatnonzero(place % PIECE == 0)
    size = np.diff(np.append(head, n))
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    score = np.zeros((n, 2))
    score[:, 1] = np.clip(evidence, -40, 40)
    local = np.exp(score - score.max(1, keepdims=True))
    t = np.exp(step)
    running = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # pieces of more than k lines, by k
    a, b = np.zeros((n, 2)), np.ones((n, 2)) / 2
    inside = place[head] > 0  # pieces that go on from another
    enter, leave = _between(local, t, head, size, chain, place) if inside.any() else (np.zeros((0, 2)), np.zeros((0, 2)))
    a[head] = local[head]
    a[head[inside]] = (enter @ t) * local[head[inside]]
    a[head] /= a[head].sum(1, keepdims=True)
    for k in range(1, size[0]):
        at = head[: running[k]] + k
        x = (a[at - 1] @ t) * local[at]
        a[at] = x / x.sum(1, keepdims=True)
    last = head + size - 1
    goes_on = (last + 1 < n) & (chain[np.minimum(last + 1, n - 1)] == chain[last])
    b[last[goes_on]] = leave

    def back(at: np.ndarray) -> None:
        """What the lines ``at`` say about those before them."""
        ahead = local[at] * b[at]
        x = ahead @ t.T
        p = a[at - 1][:, :, None] * t * ahead[:, None, :]
        pairs[:] += (p / p.sum((1, 2), keepdims=True)).sum(0)
        b[at - 1] = x / x.sum(1, keepdims=True)

    for k in range(size[0] - 1, 0, -1):
        back(head[: running[k]] + k)
    back(head[inside])
    good = a * b
    return good[:, 1] / good.sum(1), pairs


def _between(local: np.ndarray, t: np.ndarray, head: np.ndarray, size: np.ndarray, chain: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces in the order of ``head``: what enters those that go on from another, and what comes back to those that go on."""
    long = np.isin(chain[head], chain[head[place[head] > 0]])
    piece = np.flatnonzero(long)
    first = place[head[piece]] == 0
    product = t * local[head[piece]][:, None, :]
    product[first] = local[head[piece][first]][:, None, :]  # a chain's first line has no step into it
    for k in range(1, int(size[piece].max())):
        go = np.flatnonzero(size[piece] > k)
        x = product[go] @ t * local[head[piece][go] + k][:, None, :]
        product[go] = x / x.sum((1, 2), keepdims=True)
    by_line = np.argsort(head[piece], kind="stable")
    number, own = place[head[piece]][by_line] // PIECE, chain[head[piece]][by_line]
    enter, leave = np.full((len(piece), 2), 0.5), np.full((len(piece), 2), 0.5)
    for k in range(1, int(number.max()) + 1):
        at = np.flatnonzero(number == k)
        x = np.einsum("ij,ijk->ik", enter[at - 1] if k > 1 else np.ones((len(at), 2)), product[by_line[at - 1]])
        enter[at] = x / x.sum(1, keepdims=True)
    last = np.flatnonzero(np.append(own[1:] != own[:-1], True))
    ends = number[last][np.searchsorted(own[last], own)]
    for k in range(int(number.max()) - 1, -1, -1):
        at = np.flatnonzero((number == k) & (ends > k))
        x = np.einsum("ijk,ik->ij", product[by_line[at + 1]], leave[at + 1])
        leave[at] = x / x.sum(1, keepdims=True)
    back = np.argsort(by_line)
    return enter[back][place[head[piece]] > 0], leave[back][(ends > number)[back]]


def train(own: np.ndarray, text: np.ndarray, label: np.ndarray, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Conditional likelihood by Adam; ``label``: 0 or 1 of every line.  Texts weigh alike, classes are balanced."""
    x = with_neighbours(own, text).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[0], scale[0] = 0, 1
    x = (x - mean) / scale
    head = np.concatenate(([True], text[1:] != text[:-1]))
    of = np.cumsum(head) - 1
    size = np.bincount(of)
    weight = 1 / np.sqrt(size)[of]
    inner = ~head
    w, s = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)
    total = max(1, inner.sum())
    for k in range(1, rounds + 1):
        p, pairs = marginals(x @ w, s, text)
        g = np.concatenate((x.T @ (weight * (label - p)) / weight.sum() - ridge * w, ((seen - pairs) / total - ridge * s).ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w += step[:-4]
        s += step[-4:].reshape(2, 2)
    return Model(mean, scale, w, s)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in C.groups(batches):
        own, _, text = line_features(texts)
        count = np.bincount(text, minlength=part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(part.column(1)), C.lists(own.ravel(), count * OWN, pa.float32())], names=["doc_id", "label", "own"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """The chain, or the share of good labels where one class is missing; ``labels``: (doc_id, quality) to learn from."""
    C.small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows of two numbers
    rows = C.id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(_describe, "doc_id long, label int, own array<float>").toArrow().sort_by("doc_id")
    label = rows.column("label").to_numpy()
    if not len(label) or label.min() == label.max():
        return float(label.mean()) if len(label) else 0.5
    column = rows.column("own").combine_chunks()
    own = np.asarray(column.flatten()).reshape(-1, OWN)
    count = column.value_lengths().to_numpy() // OWN
    text_of = np.repeat(np.arange(len(label)), count)
    return train(own, text_of, label[text_of])


def _score(model: Model | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in C.groups(batches):
            own, length, text = line_features(texts)
            if isinstance(model, float):
                p = np.full(len(length), model)
            else:
                p, _ = marginals(((with_neighbours(own, text) - model.mean) / model.scale) @ model.weight, model.step, text)
            total = np.bincount(text, length, part.num_rows)
            score = np.bincount(text, length * p, part.num_rows) / np.maximum(total, 1)
            score = np.clip(score, 0, 1) if not isinstance(model, float) else np.full(part.num_rows, model)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``."""
    C.small_batches(docs.sparkSession)
    return C.id_text(docs).mapInArrow(_score(model), "doc_id long, score double, predicted int")
