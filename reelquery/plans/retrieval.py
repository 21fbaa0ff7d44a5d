"""The whole retrieval: items and plans in, key frames, pools and a status out; and answering again from earlier frames.

Everything is one plan over all items: queries are exploded, encoded once per distinct text, joined to the frames of
their video, ranked, combined by each item's own expression, raised where text was confirmed, and suppressed per pool.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import models
from ..functions.text import answer_prompt, parse_answer
from ..functions.times import CACHE_FPS
from ..operators import islands, nms, rank, vectors
from ..operators.nms import auto_tau
from ..operators.sampling import uniform
from .combine import combine_plans
from .planner import available


def scored_queries(plans: DataFrame, items: DataFrame, frames: DataFrame, tracks: DataFrame | None, members: DataFrame | None, encoder: models.Encoder, image_tool: str = "image", region_tool: str = "region") -> DataFrame:
    """uid, video_id, qid, frame_idx, pct for every query whose tool has a cache; one encoding per distinct text."""
    calls = plans.join(items.select("uid", "video_id"), "uid").select("uid", "video_id", F.explode("queries").alias("c")).select("uid", "video_id", F.col("c.id").alias("qid"), F.col("c.tool").alias("tool"), F.col("c.query").alias("text"))
    texts = calls.select("tool", "text").distinct()
    plain = texts.where(F.col("tool") == image_tool).withColumn("q", models.encode(F.col("text"), encoder))
    seen = calls.join(plain, ["tool", "text"]).select("uid", "video_id", "qid", "q")
    scores = frames.join(seen, "video_id").select("uid", "video_id", "qid", "frame_idx", F.round(vectors.cosine(F.col("emb"), F.col("q")), 6).alias("score"))
    if tracks is not None and members is not None:
        vector = texts.where(F.col("tool") == region_tool).withColumn("q", models.region_text(F.col("text"), encoder))
        asked = calls.join(vector, ["tool", "text"]).withColumn("call", F.to_json(F.struct("uid", "qid"))).select("call", "uid", "qid", "video_id", "q")
        # a call on a video is a video of its own, so that each call picks its own active tracks
        own = lambda df: df.join(asked.select("video_id", "call"), "video_id").withColumn("video_id", F.col("call"))
        spine = own(frames.select("video_id", "frame_idx"))
        mine = tracks.join(asked.select("video_id", "call", "q"), "video_id").withColumn("video_id", F.col("call"))
        by_track = vectors.score_tracks(spine, mine, own(members), F.col("q"))
        names = asked.select(F.col("call"), "uid", F.col("video_id").alias("video"), "qid")
        scores = scores.unionByName(by_track.join(names, by_track["video_id"] == names["call"]).select("uid", F.col("video").alias("video_id"), "qid", "frame_idx", "score"))
    return rank.percentile(scores, ["uid", "video_id", "qid"]).select("uid", "video_id", "qid", "frame_idx", "pct")


def retrieve(
    items: DataFrame,
    plans: DataFrame,
    frames: DataFrame,
    encoder: models.Encoder,
    tracks: DataFrame | None = None,
    members: DataFrame | None = None,
    judged: DataFrame | None = None,
    tools: list[str] | None = None,
    ks: tuple[int, ...] = (8, 16, 32, 64),
    k: int = 8,
    fps: float = CACHE_FPS,
    cap: float = 10.0,
) -> DataFrame:
    """uid, video_id, options, pools (by size), frames_used, timestamps_used, status for every item.

    ``plans``: uid, queries, combine; ``frames``: video_id, frame_idx, emb; ``judged``: uid, frames.  Queries of tools
    outside ``tools`` are dropped, their ids stay in the expression and count 0.
    """
    tools = tools or ["image", *(["region"] if tracks is not None else [])]
    plans = plans.withColumn("queries", available(F.col("queries"), F.array(*(F.lit(t) for t in tools))))
    length = frames.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("num_frames"))
    scores = scored_queries(plans, items, frames, tracks, members, encoder)
    merged = combine_plans(scores, plans.select("uid", "combine"))
    if judged is not None:
        meta = items.select("uid", "video_id").join(length, "video_id").select("uid", (auto_tau(F.col("num_frames"), F.lit(fps), max(1, k), cap) * fps).cast("int").alias("gap"))
        shown = judged.select("uid", F.explode("frames").alias("frame_idx")).join(meta, "uid")
        confirmed = islands.clusters(shown, ["uid"], F.col("gap"))
        merged = islands.inject(merged, confirmed, ["uid"])
    else:
        merged = merged.withColumn("is_new", F.lit(False))
    meta = items.select("uid", "video_id").join(length, "video_id").select("uid", "num_frames", F.lit(fps).alias("fps"))
    # a final size that isn't a pool size gets a gap of its own, as if it were one
    pooled = nms.pools(merged, ["uid"], sorted({*ks, k}), meta, fps, cap=cap, tie=["is_new"])
    size = F.when(F.col("k").isin(*ks), F.struct("k", "picks"))
    by_size = pooled.groupBy("uid").agg(F.map_from_entries(F.collect_list(size)).alias("pools"), F.max(F.when(F.col("k") == k, F.col("picks"))).alias("final"))
    n_queries = plans.select("uid", F.greatest(F.size("queries"), F.lit(0)).alias("n_queries"))
    out = items.select("uid", "video_id", "options").join(n_queries, "uid", "left").join(by_size, "uid", "left")
    used = F.coalesce(F.array_sort("final"), F.lit([]).cast("array<int>"))
    status = models.status(F.coalesce("n_queries", F.lit(0)), F.when(F.col("pools").isNull(), 0).otherwise(1), F.size("frames_used"), F.col("options"))
    return out.withColumn("frames_used", used).withColumn("timestamps_used", F.transform("frames_used", lambda i: i / F.lit(fps))).withColumn("status", status).select("uid", "video_id", "options", "pools", "frames_used", "timestamps_used", "status")


def evidence(items: DataFrame, plans: DataFrame, frames: DataFrame, encoder: models.Encoder, k: int = 8, fallback: int = 0, **more) -> DataFrame:
    """uid, frames_used, timestamps_used, found: what a plan shows, without answering.

    An item whose plan scores nothing has no frames, or ``fallback`` frames at equal steps of its video if that is positive.
    """
    fps = more.get("fps", CACHE_FPS)
    found = retrieve(items, plans, frames, encoder, k=k, **more).select("uid", "video_id", "frames_used", F.size("frames_used").alias("n"))
    length = frames.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("num_frames"))
    rows = found.join(length, "video_id", "left")
    even = uniform(F.coalesce("num_frames", F.lit(0)), fallback) if fallback > 0 else F.lit([]).cast("array<int>")
    used = F.when(F.col("n") > 0, F.col("frames_used")).otherwise(F.coalesce(even.cast("array<int>"), F.lit([]).cast("array<int>")))
    return rows.select("uid", used.alias("frames_used"), (F.col("n") > 0).alias("found")).withColumn("timestamps_used", F.transform("frames_used", lambda i: i / F.lit(fps)))


def blind(items: DataFrame, model: models.Model, template: str = "short") -> DataFrame:
    """uid, reply, answer from the question and its options alone, no frame shown (``items``: uid, question, options)."""
    asked = models.ask_once(items.withColumn("prompt", answer_prompt(F.col("question"), F.col("options"), template)), "prompt", "reply", model)
    return asked.select("uid", "reply", parse_answer(F.col("reply"), F.col("options")).alias("answer"))


def answer(retrieved: DataFrame, prompts: DataFrame, model: models.Model) -> DataFrame:
    """Adds reply and answer to items that got frames and have options (``prompts``: uid, prompt); others have none."""
    asked = models.ask_once(prompts.join(retrieved.where("status = 'answered'").select("uid"), "uid", "left_semi"), "prompt", "reply", model)
    return retrieved.join(asked.select("uid", "reply"), "uid", "left").withColumn("answer", parse_answer(F.col("reply"), F.col("options")))


def answer_again(items: DataFrame, earlier: DataFrame, k: int, fps: float = CACHE_FPS) -> tuple[DataFrame, DataFrame]:
    """Frames of an earlier run for the same items, in time order, and the items it doesn't have.

    ``earlier``: uid, ordinal, pools (by size), frames_used; the last row of a uid counts.
    """
    last = rank.last_by(earlier, "uid", "ordinal")
    frames = F.array_sort(rank.head_of_source(F.try_element_at("pools", F.lit(k)), F.col("frames_used"), k))
    found = items.join(last.select("uid", frames.alias("frames_used")), "uid").where(F.col("frames_used").isNotNull())
    return found.withColumn("timestamps_used", F.transform("frames_used", lambda i: i / F.lit(fps))), items.join(found.select("uid"), "uid", "left_anti")


def evaluate_once(plans: DataFrame, evaluate) -> DataFrame:
    """Evaluates each distinct (uid, plan) once and joins the results back (``plans``: uid, queries, combine)."""
    from ..functions.text import content_key

    keyed = plans.withColumn("key", content_key(F.struct("queries", "combine")))
    return keyed.join(evaluate(keyed.dropDuplicates(["uid", "key"])), ["uid", "key"], "left")
