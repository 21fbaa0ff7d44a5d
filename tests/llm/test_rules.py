"""Cutoffs of the quality rules with production parameters."""

import os

import numpy as np
import pytest

from reelquery.llm import rules


def test_allowed_losses_agree_with_the_bound():
    for n, level, risk in ((298, 0.05, 0.01), (299, 0.05, 0.01), (436, 0.0125, 0.01), (1800, 0.0125, 0.01), (5, 0.5, 0.3)):
        k = rules.allowed_losses(n, level, risk)
        assert k == -1 or rules.upper_bound(k, n, level) <= risk
        assert rules.upper_bound(k + 1, n, level) > risk
    assert rules.allowed_losses(0, 0.05, 0.01) == -1


def test_small_strata_are_tested_together():
    assert rules.groups({"en": 1800, "de": 440, "fr": 430, "es": 280}, 0.01, 0.05) == [["de"], ["es", "fr"], ["en"]]
    assert rules.groups({"en": 200, "de": 90}, 0.01, 0.05) == [["de", "en"]]
    assert rules.groups({}, 0.01, 0.05) == []


def test_joint_losses_stay_below_the_risk():
    """Scores without any signal: a chain that loses 1.5% of the good documents must pass in at most delta of the draws."""
    rng = np.random.default_rng(0)
    passed = 0
    for _ in range(200):
        counts = {}
        for kind, n, rate in ((rules.BAD, 300, 1.0), (rules.GOOD, 800, 0.015), (rules.SEEN, 80, 0.0)):
            high = rng.binomial(n, rate)
            for r in range(len(rules.RULES)):
                counts["", r, 40, kind], counts["", r, 1, kind] = (int(high), int(n - high)) if r == 0 else (0, n)
        passed += bool({r for _, r in rules.select_cutoffs(counts, [""], 0.01, 0.05)} & {0})
    assert passed <= 20


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_tables_certify_the_symbol_rule_in_every_language(spark, name):
    d = f"/root/testdata/{name}"
    if not os.path.isdir(d):
        pytest.skip("test tables absent")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = rules.judge(docs, labels).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert not n.get((0, True)) and n[0, False] > 0
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
