"""Secrets of any length are candidates and are redacted."""

import random
import string
import time

from reelquery.llm import pii


def test_long_secrets_are_found_and_redacted(spark):
    rnd = random.Random(3)
    token = lambda n: "a1" + "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(n - 2))
    long = {100 + n: token(n) for n in (128, 129, 342, 5000)}
    rows = [(i, f'key {i} user{i}@host.org secret = "{token(40)}"') for i in range(40)] + [(i, f'log in with token = "{t}" now') for i, t in long.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(t not in out[i] and t[-30:] not in out[i] for i, t in long.items())


def test_long_runs_take_linear_time():
    start = time.time()
    text = "ab1_" * 500_000
    assert pii.loose_spans(text, pii.base_spans(text))["secret"] == [(0, len(text))]
    assert time.time() - start < 20
