"""Values or errors by row, time limits, and runs that go on after others."""

import os
import sys
import time

import pytest
from pyspark import cloudpickle

from reelquery.sources import attempts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test module


def table(spark, n=12):
    return spark.createDataFrame([(f"u{k}", k) for k in range(n)], "uid string, k int")


def work(row):
    k = row["k"]
    if k % 5 == 1:
        raise KeyError("x" * 600)
    if k % 5 == 2:
        return "not a number"
    return None if k % 5 == 3 else k * 10


def test_value_or_error(spark):
    got = {r.uid: (r.value, r.error) for r in attempts.attempt(table(spark), work, "bigint").collect()}
    assert len(got) == 12 and got["u0"] == (0, None) and got["u3"] == (None, None) and got["u5"] == (50, None)
    assert got["u1"][0] is None and len(got["u1"][1]) == attempts.ERROR_CHARS
    assert got["u2"][0] is None and "Arrow" in got["u2"][1]


def test_time_limit_ends_work_that_hangs_and_work_that_dies(spark):
    def slow(row):
        if row["k"] == 1:
            time.sleep(60)
        if row["k"] == 2:
            os._exit(3)
        return [str(row["k"])]

    began = time.time()
    got = {r.uid: (r.value, r.error) for r in attempts.attempt(table(spark, 4).coalesce(1), slow, "array<string>", seconds=1.0).collect()}
    assert time.time() - began < 40
    assert got == {"u0": (["0"], None), "u1": (None, "Timeout (>1s)"), "u2": (None, "the work's process ended without an answer"), "u3": (["3"], None)}


def test_resumed_runs_try_errors_again_and_values_never(spark, tmp_path):
    path, log = str(tmp_path / "a"), tmp_path / "log"
    log.mkdir()

    def logged(row):
        (log / f"{row['uid']}-{time.time_ns()}").touch()
        if row["k"] in (1, 2) and len([f for f in os.listdir(log) if f.startswith(row["uid"] + "-")]) < 1 + 2 * row["k"] - 1:
            raise ValueError("not yet")
        return row["k"]

    items = table(spark, 4)
    attempts.run_attempts(items, logged, "bigint", path, "r1")
    assert {r.uid: r.error for r in attempts.results(spark, path).collect()} == {"u0": None, "u1": "ValueError: not yet", "u2": "ValueError: not yet", "u3": None}
    assert sorted(r.uid for r in attempts.left_to_do(items, path).collect()) == ["u1", "u2"]
    assert attempts.left_to_do(items, path, most=1).count() == 0
    attempts.run_attempts(items, logged, "bigint", path, "r2")
    found = {r.uid: (r.value, r.error) for r in attempts.results(spark, path).collect()}
    assert found["u1"] == (1, None) and found["u2"] == (None, "ValueError: not yet")
    tries = lambda uid: len([f for f in os.listdir(log) if f.startswith(uid + "-")])
    assert [tries(f"u{k}") for k in range(4)] == [1, 2, 2, 1]


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "b")
    for _ in range(2):
        attempts.run_attempts(table(spark, 3), lambda row: row["k"], "int", path, "only")
    assert sorted((r.uid, r.value) for r in attempts.results(spark, path).collect()) == [("u0", 0), ("u1", 1), ("u2", 2)]
    attempts.run_attempts(table(spark, 5), lambda row: row["k"], "int", path, "next")
    assert sorted((r.uid, r.value) for r in attempts.results(spark, path).collect()) == [(f"u{k}", k) for k in range(5)]
    assert spark.read.parquet(f"{path}/values/run=next").count() == 2
    with pytest.raises(ValueError, match="no run"):
        attempts.results(spark, str(tmp_path / "none"))
