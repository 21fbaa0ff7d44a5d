"""Blocked scoring and bucketed caches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery import catalog
from reelquery.operators import rank, vectors
from reelquery.sources import sinks

SF = "/root/testdata/sf0.001"


def some(spark, videos=3, n=50, width=16):
    rng = np.random.default_rng(1)
    frames = [(v, f, rng.normal(size=width).tolist()) for v in range(videos) for f in range(n + v)]
    asked = [(v, f"Q{q}", rng.normal(size=width).tolist()) for v in range(videos) for q in range(3)]
    return spark.createDataFrame(frames + [(9, 0, [0.0] * width), (0, 999, None)], "video_id int, frame_idx int, emb array<float>"), spark.createDataFrame(asked + [(9, "Q0", [1.0] * width), (77, "Q0", [1.0] * width), (0, "none", None)], "video_id int, qid string, q array<double>")


@pytest.mark.parametrize("rows", [1, 7, 64, 10000])
def test_blocks_give_the_scores_of_pairs(spark, rows):
    frames, asked = some(spark)
    key = lambda r: (r.video_id, r.qid, r.frame_idx)
    want = {key(r): r.score for r in vectors.score_frames(frames.where("emb is not null"), asked.where("q is not null"), ["video_id"], digits=9).collect()}
    got = {key(r): r.score for r in vectors.score_blocks(frames, asked, rows, digits=9).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 2e-9


def test_queries_that_come_from_the_frames(spark):
    frames, _ = some(spark)
    own = frames.where("frame_idx < 2 and emb is not null")
    got = vectors.score_blocks(frames, own.select("video_id", F.concat(F.lit("Q"), F.col("frame_idx")).alias("qid"), F.col("emb").alias("q")), 20)
    assert all(abs(r.score - 1) < 1e-6 for r in got.collect() if r.qid == f"Q{r.frame_idx}" and r.video_id != 9)


def test_widths_that_differ_are_an_error(spark):
    frames = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [1.0, 2.0])], "video_id int, frame_idx int, emb array<double>")
    with pytest.raises(Exception, match="one width"):
        vectors.score_blocks(frames, spark.createDataFrame([(0, "Q", [1.0])], "video_id int, qid string, q array<double>")).collect()


def test_bucketed_cache_needs_no_exchange(spark, tmp_path):
    frames, asked = some(spark)
    cache = sinks.write_bucketed(frames, "cache_frames", str(tmp_path / "f"), buckets=4)
    with_queries = sinks.write_bucketed(asked, "cache_queries", str(tmp_path / "q"), order="qid", buckets=4)
    joined = cache.hint("merge").join(with_queries, "video_id")
    ranked = rank.percentile(joined.select("video_id", "qid", "frame_idx", vectors.cosine(joined.emb, joined.q).alias("score")).where("score is not null"), ["video_id", "qid"])
    ranked.collect()
    text = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Window" in text and "Exchange" not in text
    counted = cache.groupBy("video_id").count()
    counted.collect()
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_bucketed_cache_is_never_written_twice(spark, tmp_path):
    frames, _ = some(spark, videos=2)
    path = str(tmp_path / "c")
    n = sinks.write_bucketed(frames.where("video_id = 0"), "cache_again", path, buckets=2).count()
    both = sinks.write_bucketed(frames, "cache_again", path, buckets=2)
    assert both.count() == frames.count() and both.where("video_id = 0").count() == n
    assert sinks.write_bucketed(frames, "cache_again", path, buckets=2).count() == frames.count()


def test_registered_query_has_no_exchange_after_the_tables(spark):
    df = catalog.queries()["bucketed_ranks"](spark, SF)
    df.collect()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
