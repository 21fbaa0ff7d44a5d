"""Selectors by K over one scoring pass."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reelquery.operators import nms, sampling
from reelquery.plans import selection

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def scores(spark, n=(40, 17, 3, 40)):
    rng = random.Random(2)
    return spark.createDataFrame([(f"u{v}", f, rng.random()) for v, m in enumerate(n) for f in range(m)], "uid string, frame_idx int, score double")


ITEMS = [("u0", 0.0, 3.0), ("u1", 50.0, 60.0), ("u2", 1.0, 1.0), ("u3", 5.0, 9.0), ("missing", 0.0, 99.0)]


def fails_on_short(curve, k):
    if len(curve) < 10:
        raise RuntimeError("too short")
    return [int(curve.argmax())][:k]


def test_grid_equals_each_selector_on_its_own(spark):
    table = scores(spark)
    items = spark.createDataFrame(ITEMS, "uid string, start_s double, end_s double")
    chosen = selection.SELECTORS | {"best": selection.per_item(fails_on_short)}
    ks = [1, 4, 8]
    got = {(r.uid, r.method, r.k): (r.picks, r.hit) for r in selection.selector_records(table, items, chosen, ks, ["uid"], margin=0.25).collect()}
    assert len(got) == 4 * 5 * 3 and not any(u == "missing" for u, _, _ in got)
    bounds = {u: (a - 0.25, b + 0.25) for u, a, b in ITEMS}
    for name, select in (("cosine", nms.gap_select), ("split", sampling.adaptive_split), ("cdf", sampling.inverse_cdf), ("uniform", selection.uniform)):
        for k in ks:
            for r in select(table, ["uid"], k).collect():
                picks, hit = got[r.uid, name, k]
                assert picks == r.picks and hit == any(bounds[r.uid][0] <= f / 2 <= bounds[r.uid][1] for f in picks)
    assert got["u2", "best", 4] == ([], False) and len(got["u0", "best", 4][0]) == 1


def test_table_counts_failures_as_misses_and_missing_caches_not_at_all(spark):
    items = spark.createDataFrame(ITEMS, "uid string, start_s double, end_s double")
    rows = selection.hit_table(selection.selector_records(scores(spark), items, {"all": lambda s, keys, k: s.groupBy(*keys).agg(F.sort_array(F.collect_list("frame_idx")).alias("picks")), "best": selection.per_item(fails_on_short)}, [2], ["uid"])).collect()
    found = {r.method: r for r in rows}
    assert (found["all"].hits, found["all"]["items"], found["all"].rate) == (3, 4, 0.75)
    assert found["best"]["items"] == 4 and found["best"].hits <= 2


def test_scores_are_computed_once(spark):
    """The plan of the grid reads the written scores alone, and what makes the scores runs once for each row."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    table = scores(spark)
    counted = table.mapInArrow(count, table.schema)
    items = spark.createDataFrame(ITEMS, "uid string, start_s double, end_s double")
    out = selection.hit_table(selection.selector_records(counted, items, selection.SELECTORS, [4, 8], ["uid"]))
    assert out.count() == 8 and seen.value == table.count()
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2])
def test_few_frames(spark, n):
    got = selection.pick_grid(scores(spark, (n,)), ["uid"], selection.SELECTORS, [4])[1].collect()
    assert sorted(r.method for r in got) == ["cdf", "cosine", "split", "uniform"] and all(set(r.picks) <= set(range(n)) and r.picks for r in got)
