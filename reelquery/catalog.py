"""Every registered query of the retrieval operators, with its SQL oracle.

Each query applies one operator to a whole table (through the views of ``proxies``); scores are rounded to 6 digits
before they are ranked, so that both engines rank the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import proxies as P
from . import scratch
from .functions import text as X
from .functions import times as T
from .operators import extraction, islands, metrics, nms, priors, rank, sampling, search, temporal, tracks, vectors, wavelet
from .plans import combine as plan_combine
from .plans import planner, selection
from .proxies import with_views
from .session import ship
from .sources import adapters, attempts, collate, phrases, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _queries[f.__name__] = run
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


# ---------------------------------------------------------------- scoring and ranks

def _scores(spark: SparkSession, d: str) -> DataFrame:
    return vectors.score_frames(P.frames(spark, d), P.queries(spark, d), ["video_id"])


def _one(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("qid = 'Q1'").select("video_id", "frame_idx", "score")


def _pct(spark: SparkSession, d: str) -> DataFrame:
    return rank.percentile(_scores(spark, d), ["qid", "video_id"])


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return plan_combine.combine(_pct(spark, d), "Q1 AND (Q2 OR Q3)", ["video_id"])


_BASE = ("frames", "q", "scores")
_RANKED = (*_BASE, "pct", "ranks")


@query(with_views(*_BASE, body="SELECT qid, video_id, frame_idx, score FROM scores"))
def cosine_score(spark, d):
    return _scores(spark, d)


@query(with_views(*_BASE, body="SELECT qid, video_id, frame_idx, score FROM scores"))
def blocked_scores(spark, d):
    """The same scores as one matrix product for each block of a video's frames."""
    return vectors.score_blocks(P.frames(spark, d), P.queries(spark, d), rows=64).select("qid", "video_id", "frame_idx", "score")


@query(with_views(*_BASE, "pct", body="SELECT qid, video_id, frame_idx, score, pct FROM pct"))
def bucketed_ranks(spark, d):
    """Scores and ranks of one bucketed cache and one bucketed table of queries: a join and a window without an exchange."""
    frames, asked = bucketed(spark, P.frames(spark, d), "frames", "frame_idx"), bucketed(spark, P.queries(spark, d), "queries", "qid")
    scored = frames.hint("merge").join(asked, "video_id").select("qid", "video_id", "frame_idx", F.round(vectors.cosine(F.col("emb"), F.col("q")), 6).alias("score"))
    return rank.percentile(scored, ["video_id", "qid"])


def bucketed(spark: SparkSession, rows: DataFrame, tag: str, order: str) -> DataFrame:
    """A bucketed table in the shared folder, of its own for each call."""
    path = scratch.new_path(spark, tag)
    return sinks.write_bucketed(rows, path.rpartition("/")[2].replace("-", "_"), path, "video_id", order, buckets=8)


@query(with_views(*_BASE, "pct", body="SELECT qid, video_id, frame_idx, score, pct FROM pct"))
def percentile_rank(spark, d):
    return _pct(spark, d)


@query(with_views(*_RANKED, "merged", body="SELECT video_id, frame_idx, score FROM merged"))
def combine_and_or(spark, d):
    return _merged(spark, d)


@query(with_views(*_BASE, "pct", body="SELECT video_id, frame_idx, max(pct) AS score FROM pct GROUP BY ALL"))
def combine_or_all(spark, d):
    return plan_combine.combine(_pct(spark, d), "", ["video_id"])


@query(with_views(*_RANKED, body="SELECT video_id, frame_idx, 0.0::DOUBLE AS score FROM ranks"))
def combine_missing_leaf(spark, d):
    return plan_combine.combine(_pct(spark, d), "Q1 AND Q9", ["video_id"])


_PLANS = [(0, "Q1 AND Q2"), (1, "Q1 OR Q2 AND Q3"), (2, "(Q1 OR Q2) AND Q3"), (3, ""), (4, "Q1 AND"), (5, "q1 and Q2"), (6, "Q3"), (7, "Q7"), (8, "((Q1 or Q3"), (9, "Q2 Q1")]


@query(
    with_views(
        *_RANKED,
        body="""SELECT video_id, frame_idx, CASE video_id WHEN 0 THEN least(q1, q2) WHEN 1 THEN greatest(q1, least(q2, q3)) WHEN 2 THEN least(greatest(q1, q2), q3)
  WHEN 5 THEN 0.0 WHEN 6 THEN q3 WHEN 8 THEN greatest(q1, q3) WHEN 9 THEN q2 ELSE greatest(q1, q2, q3) END AS score FROM ranks WHERE video_id <> 7""",
    )
)
def combine_by_plan(spark, d):
    plans = spark.createDataFrame(_PLANS, "video_id int, combine string")
    return plan_combine.combine_plans(_pct(spark, d), plans, "video_id")


@query("SELECT k, n, round(CASE WHEN k <= 0 THEN 0 ELSE least(n / 2.0 / (2 * k), 10.0) END, 6) AS tau FROM (SELECT o_orderkey % 9 AS k, o_custkey AS n FROM orders)")
def auto_tau(spark, d):
    rows = P.table(spark, d, "orders").select((F.col("o_orderkey") % 9).alias("k"), F.col("o_custkey").alias("n"))
    return rows.select("k", "n", F.round(nms.auto_tau(F.col("n"), F.lit(2.0), F.col("k")), 6).alias("tau"))


_FOLD = """, ordered AS (SELECT video_id, frame_idx, score, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx) AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM {src}),
cfg AS (SELECT DISTINCT video_id, n, k, {gap} AS gap FROM ordered, (SELECT unnest([{ks}]) AS k)),
fold(video_id, k, rn, kept) AS (
  SELECT video_id, k, 0::BIGINT, []::INT[] FROM cfg
  UNION ALL
  SELECT f.video_id, f.k, f.rn + 1, CASE WHEN {whole} OR (len(f.kept) < f.k AND NOT list_bool_or([abs(y - o.frame_idx) < c.gap FOR y IN f.kept])) THEN list_append(f.kept, o.frame_idx) ELSE f.kept END
  FROM fold f JOIN cfg c ON c.video_id = f.video_id AND c.k = f.k JOIN ordered o ON o.video_id = f.video_id AND o.rn = f.rn + 1
), last AS (SELECT video_id, k, arg_max(kept, rn) AS kept FROM fold GROUP BY ALL)
"""
_NEVER = "FALSE"


def _fold_sql(src: str, views: tuple[str, ...], ks: str, gap: str, whole: str, body: str) -> str:
    text = _FOLD.format(src=src, ks=ks, gap=gap, whole=whole).replace("list_bool_or([", "coalesce(list_bool_or([").replace("FOR y IN f.kept])", "FOR y IN f.kept]), FALSE)")
    return with_views(*views, body=text.lstrip() + body, recursive=True)


@query(_fold_sql("one", (*_BASE, "one"), "8", "3", _NEVER, "SELECT video_id, unnest(generate_series(0, len(kept) - 1)) AS place, unnest(kept) AS frame_idx FROM last"))
def nms_topk(spark, d):
    picks = nms.greedy_gap(_one(spark, d), ["video_id"], 8, 3)
    return picks.select("video_id", F.posexplode("picks").alias("place", "frame_idx")).withColumn("place", F.col("place").cast("long"))


_POOL_GAP = "trunc(least(n / 2.0 / (2 * k), 10.0) * 2.0)::INT"


@query(_fold_sql("merged", (*_RANKED, "merged"), "4, 8, 16, 32, 64", _POOL_GAP, "c.n <= c.k", "SELECT video_id, k, unnest(generate_series(0, len(kept) - 1)) AS place, unnest(kept) AS frame_idx FROM last"))
def pool_multi_k(spark, d):
    pools = nms.pools(_merged(spark, d), ["video_id"], [4, 8, 16, 32, 64])
    return pools.select("video_id", "k", F.posexplode("picks").alias("place", "frame_idx")).withColumn("place", F.col("place").cast("long"))


@query(_fold_sql("merged", (*_RANKED, "merged"), "8", _POOL_GAP, "c.n <= c.k", "SELECT video_id, array_to_string(list_sort(kept), ',') AS frames_used, array_to_string([format('{:.1f}', x / 2.0) FOR x IN list_sort(kept)], ',') AS timestamps_used FROM last"))
def plan_merge(spark, d):
    """The flagship: score, rank, combine, suppress, and put eight frames of every video in time order."""
    final = nms.final_frames(nms.pools(_merged(spark, d), ["video_id"], [8]), ["video_id"], 8)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return final.select("video_id", text("frames_used").alias("frames_used"), text("timestamps_used").alias("timestamps_used"))


@query(with_views(*_BASE, "one", body="SELECT video_id, frame_idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx) AS rank FROM one) WHERE rank <= 5"))
def topk_head(spark, d):
    return rank.top_k(_one(spark, d), ["video_id"], 5).withColumn("rank", F.col("rank").cast("long"))


@query(with_views(*_BASE, "one", body="SELECT DISTINCT ON (video_id) video_id, frame_idx, score FROM one ORDER BY video_id, score DESC, frame_idx"))
def best_frame(spark, d):
    return rank.best_frame(_one(spark, d), ["video_id"])


# ---------------------------------------------------------------- regions and tracks

def _regions(spark, d):
    parts = P.frames(spark, d).select("video_id", "frame_idx", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("region_idx"), "emb")
    return parts.select("video_id", "frame_idx", "region_idx", F.slice("emb", F.col("region_idx") * 16 + 1, F.lit(16)).alias("tok"))


_REGIONS = "regions AS (SELECT video_id, frame_idx, r AS region_idx, emb[r * 16 + 1 : r * 16 + 16] AS tok FROM frames, (SELECT unnest([0, 1, 2, 3]) AS r)), qv AS (SELECT q[1:16] AS v FROM q WHERE qid = 'Q1')"


def _region_query(spark, d):
    return P.queries(spark, d).where("qid = 'Q1'").select("video_id", F.slice("q", 1, 16).alias("v"))


@query(with_views("frames", "q", body=f", {_REGIONS} SELECT f.video_id, f.frame_idx, round(coalesce(max(list_cosine_similarity(tok, v)), 0), 6) AS score FROM frames f LEFT JOIN regions USING (video_id, frame_idx) CROSS JOIN qv GROUP BY ALL".lstrip()))
def region_max(spark, d):
    regions = _regions(spark, d).join(_region_query(spark, d), "video_id")
    return vectors.score_regions(P.frames(spark, d), regions, F.col("v"))


_TRACKS = """, tracks AS (SELECT video_id, region_idx AS track_id, arg_min(tok, frame_idx) AS tok FROM regions GROUP BY ALL), sim AS (SELECT video_id, track_id, list_cosine_similarity(tok, v) AS sim FROM tracks CROSS JOIN qv),
active AS (SELECT * FROM sim WHERE sim >= 0.18 UNION ALL SELECT video_id, track_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sim DESC, track_id) AS rn, max(sim) OVER (PARTITION BY video_id) AS top FROM sim) WHERE top < 0.18 AND rn = 1)"""


def _tracks(spark, d):
    return _regions(spark, d).groupBy("video_id", F.col("region_idx").alias("track_id")).agg(F.min_by("tok", "frame_idx").alias("tok")).join(_region_query(spark, d), "video_id")


@query(with_views("frames", "q", body=f", {_REGIONS}{_TRACKS} SELECT f.video_id, f.frame_idx, round(greatest(coalesce(max(sim), 0), 0), 6) AS score FROM frames f LEFT JOIN (SELECT r.video_id, r.frame_idx, sim FROM regions r JOIN active a ON a.video_id = r.video_id AND a.track_id = r.region_idx) m USING (video_id, frame_idx) GROUP BY ALL".lstrip()))
def track_score(spark, d):
    members = _regions(spark, d).select("video_id", F.col("region_idx").alias("track_id"), "frame_idx")
    return vectors.score_tracks(P.frames(spark, d), _tracks(spark, d), members, F.col("v"))


@query(with_views("frames", "q", body=f", {_REGIONS}{_TRACKS} SELECT DISTINCT r.video_id, r.frame_idx FROM regions r JOIN active a ON a.video_id = r.video_id AND a.track_id = r.region_idx".lstrip()))
def track_frames(spark, d):
    members = _regions(spark, d).select("video_id", F.col("region_idx").alias("track_id"), "frame_idx")
    return vectors.track_frames(_tracks(spark, d), members, F.col("v"))


@query(with_views("frames", "q", body=f", {_REGIONS} SELECT video_id, frame_idx, round(a * b, 6) AS score FROM (SELECT video_id, frame_idx, max(list_cosine_similarity(tok, v)) AS a, max(list_cosine_similarity(tok, v[9:16] || v[1:8])) AS b FROM regions CROSS JOIN qv GROUP BY ALL) WHERE a * b >= 0.05".lstrip()))
def patch_match(spark, d):
    turned = F.concat(F.slice("v", 9, 8), F.slice("v", 1, 8))
    out = vectors.patch_match(_regions(spark, d).join(_region_query(spark, d), "video_id"), F.col("v"), turned, 0.05)
    return out.withColumn("score", F.round("score", 6))


@query(with_views("frames", "q", body=f", {_REGIONS} SELECT video_id, pos, round(avg(x), 6) AS x FROM (SELECT video_id, unnest(generate_series(0, 15)) AS pos, unnest(tok) AS x FROM regions) GROUP BY ALL".lstrip()))
def group_mean_vector(spark, d):
    return vectors.group_means(_regions(spark, d), ["video_id"]).select("video_id", F.posexplode("mean").alias("pos", "x")).select("video_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query()
def region_tracker(spark, d):
    out = tracks.track(_regions(spark, d))
    return out.select("video_id", "track_id", F.size("members").alias("n_members"), F.round(vectors.norm(F.col("tok")), 6).alias("norm"))


@query()
def track_compression(spark, d):
    return tracks.compression(tracks.track(_regions(spark, d)))


@query(with_views("frames", "q", recursive=True, body=f""", {_REGIONS}, e AS (SELECT a.video_id, a.frame_idx, a.region_idx AS a, b.region_idx AS b FROM regions a JOIN regions b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.region_idx <> b.region_idx
  WHERE list_cosine_similarity(a.tok, b.tok) > 0.2 OR greatest(0, least(a.region_idx, b.region_idx) * 4 + 5 - greatest(a.region_idx, b.region_idx) * 4) / (10.0 - greatest(0, least(a.region_idx, b.region_idx) * 4 + 5 - greatest(a.region_idx, b.region_idx) * 4)) > 0.3),
reach(video_id, frame_idx, a, b) AS (SELECT video_id, frame_idx, region_idx, region_idx FROM regions UNION SELECT r.video_id, r.frame_idx, r.a, e.b FROM reach r JOIN e ON e.video_id = r.video_id AND e.frame_idx = r.frame_idx AND e.a = r.b)
SELECT video_id, frame_idx, a::INT AS region_idx, min(b)::INT AS "group" FROM reach GROUP BY video_id, frame_idx, a""".lstrip()))
def region_components(spark, d):
    boxed = _regions(spark, d).withColumns({"x1": F.col("region_idx") * 4.0, "y1": F.lit(0.0), "x2": F.col("region_idx") * 4.0 + 5, "y2": F.lit(5.0)})
    return tracks.region_groups(boxed, tracks.adjacency(boxed, 0.3, 0.2))


# ---------------------------------------------------------------- on-screen text

_SEGMENTS = """, shown AS (SELECT *, lower(txt) AS norm FROM ocr WHERE trim(txt) <> ''), fresh AS (SELECT *, CASE WHEN norm = lag(norm) OVER w AND frame_idx - lag(frame_idx) OVER w <= 25 THEN 0 ELSE 1 END AS fresh FROM shown WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY frame_idx) AS island FROM fresh),
seg AS (SELECT video_id, (island - 1)::BIGINT AS seg_id, arg_min(txt, frame_idx) AS text, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame FROM island GROUP BY video_id, island)"""


def _segments(spark, d):
    return islands.text_segments(P.screen_text(spark, d), 5.0)


@query(with_views("ocr", body=f"{_SEGMENTS} SELECT *, start_frame / 5.0::DOUBLE AS start_time, end_frame / 5.0::DOUBLE AS end_time FROM seg"))
def ocr_segments(spark, d):
    return _segments(spark, d)


@query(with_views("ocr", body=f"{_SEGMENTS} SELECT DISTINCT video_id, unnest(generate_series(start_frame, end_frame))::INT AS frame_idx FROM seg"))
def segments_to_frames(spark, d):
    return islands.segment_frames(_segments(spark, d))


@query(with_views("ocr", body=f"{_SEGMENTS}, u AS (SELECT video_id, lower(text) AS norm, arg_min(text, seg_id) AS text, min(seg_id) AS first, count(*) AS n FROM seg GROUP BY ALL) SELECT video_id, norm, text, n, (rn - 1) // 20 AS batch, ((rn - 1) % 20 + 1)::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY first) AS rn FROM u)".replace("GROUP BY ALL)", "GROUP BY video_id, lower(text))")))
def judge_batches(spark, d):
    out = islands.judge_batches(islands.unique_texts(_segments(spark, d)))
    return out.select("video_id", "norm", "text", F.size("seg_ids").cast("long").alias("n"), "batch", "place")


def _stand_in_judge(prompts):
    """YES to texts of even length; a call whose first text's length divides by 7 fails.  For tests and the registered query."""
    out = []
    for p in prompts:
        texts = [line.split(". ", 1) for line in p.split("\n")[2:]]
        if len(texts[0][1]) % 7 == 0:
            raise RuntimeError("no reply")
        out.append("\n".join(f"{n}. {'YES' if len(t) % 2 == 0 else 'NO'}" for n, t in texts))
    return out


@query(with_views("ocr", body=f"""{_SEGMENTS}, u AS (SELECT video_id, lower(text) AS norm, arg_min(text, seg_id) AS text, min(seg_id) AS first FROM seg GROUP BY video_id, lower(text)),
n AS (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY first) - 1) // 20 AS batch FROM u), f AS (SELECT *, length(first_value(text) OVER (PARTITION BY video_id, batch ORDER BY first)) % 7 = 0 AS failed FROM n)
SELECT s.video_id, s.seg_id, NOT failed AND length(f.text) % 2 = 0 AS keep FROM seg s JOIN f ON f.video_id = s.video_id AND f.norm = lower(s.text)"""))
def judge_texts(spark, d):
    questions = P.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("uid"), F.col("doc_id").alias("video_id"), F.lit("what?").alias("question"))
    return islands.judge(_segments(spark, d), questions, _stand_in_judge).select("video_id", "seg_id", "keep")


_CLUSTERS = """, conf AS (SELECT video_id, frame_idx FROM frames WHERE (frame_idx * 7) % 11 < 3), fresh AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER w <= 2 THEN 0 ELSE 1 END AS fresh FROM conf WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY frame_idx) AS island FROM fresh), rep AS (SELECT video_id, list_sort(list(frame_idx))[count(*) // 2 + 1] AS frame_idx FROM island GROUP BY video_id, island)"""


def _clusters(spark, d):
    confirmed = P.frames(spark, d).where("(frame_idx * 7) % 11 < 3").select("video_id", "frame_idx")
    return islands.clusters(confirmed, ["video_id"], 2)


@query(with_views("frames", body=f"{_CLUSTERS} SELECT video_id, frame_idx FROM rep"))
def ocr_islands(spark, d):
    return _clusters(spark, d)


@query(with_views(*_RANKED, "merged", body=f"{_CLUSTERS} SELECT video_id, frame_idx, CASE WHEN r.frame_idx IS NOT NULL THEN 1.0::DOUBLE ELSE m.score END AS score, m.score IS NULL AS is_new FROM merged m FULL JOIN rep r USING (video_id, frame_idx)"))
def ocr_inject(spark, d):
    return islands.inject(_merged(spark, d), _clusters(spark, d), ["video_id"])


# ---------------------------------------------------------------- selectors

def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("video_id", F.explode("picks").alias("frame_idx"))


_GRID = "(CASE WHEN i = {k} - 1 THEN {n} - 1 ELSE trunc(i * (({n} - 1)::DOUBLE / ({k} - 1))) END)::INT"


@query("SELECT doc_id AS video_id, unnest(CASE WHEN n_chars <= 8 THEN generate_series(0, n_chars - 1) ELSE [CASE WHEN i = 7 THEN n_chars - 1 ELSE trunc(i * ((n_chars - 1)::DOUBLE / 7))::BIGINT END FOR i IN generate_series(0, 7)] END)::INT AS frame_idx FROM documents")
def uniform_frames(spark, d):
    rows = P.table(spark, d, "documents")
    return _flat(rows.select(F.col("doc_id").alias("video_id"), sampling.uniform(F.col("n_chars"), 8).alias("picks")))


@query(
    """WITH v AS (SELECT doc_id AS video_id, greatest(0, round_even(doc_id % 50 * 3.5, 0))::INT AS a, least(n_chars - 1, round_even((doc_id % 50 + doc_id % 7) * 3.5, 0))::INT AS b FROM documents)
SELECT video_id, unnest(CASE WHEN b - a < 1 THEN [a] WHEN b - a + 1 <= 8 THEN generate_series(a, b) ELSE [CASE WHEN i = 7 THEN b ELSE trunc(a + i * ((b - a)::DOUBLE / 7))::INT END FOR i IN generate_series(0, 7)] END)::INT AS frame_idx FROM v"""
)
def oracle_uniform(spark, d):
    rows = P.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), (F.col("doc_id") % 50).alias("s"), (F.col("doc_id") % 50 + F.col("doc_id") % 7).alias("e"), "n_chars")
    return _flat(rows.select("video_id", sampling.inside(F.col("s"), F.col("e"), F.col("n_chars"), F.lit(3.5), 8).alias("picks")))


_FILL = """, filled AS (SELECT video_id, n, p, CASE WHEN n <= {k} THEN generate_series(0, n - 1)::INT[] WHEN len(p) < {k} THEN list_sort(list_distinct(list_concat(p, [CASE WHEN i = {k} - 1 THEN n - 1 ELSE trunc(i * ((n - 1)::DOUBLE / ({k} - 1))) END::INT FOR i IN generate_series(0, {k} - 1)])))[1:{k}] ELSE p[1:{k}] END AS f FROM picked)
SELECT video_id, unnest(f)::INT AS frame_idx FROM filled"""


def _its_sql(k: int) -> str:
    body = f""", r AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM one WINDOW w AS (PARTITION BY video_id)), p AS (SELECT video_id, frame_idx, (score - lo) / (hi - lo) AS w FROM r),
c AS (SELECT video_id, frame_idx, sum(w / total) OVER (PARTITION BY video_id ORDER BY frame_idx) AS cdf FROM (SELECT *, sum(w) OVER (PARTITION BY video_id) AS total FROM p)),
u AS (SELECT CASE WHEN i = {k - 1} THEN 1 - 1 / {k}.0::DOUBLE ELSE 1 / {k}.0::DOUBLE + i * ((1 - 2 / {k}.0::DOUBLE) / {k - 1}) END AS u FROM (SELECT unnest(generate_series(0, {k - 1})) AS i)),
h AS (SELECT video_id, u, min(frame_idx) AS f FROM c JOIN u ON cdf >= u GROUP BY ALL),
picked AS (SELECT video_id, (SELECT count(*) FROM one o WHERE o.video_id = h.video_id)::INT AS n, list_sort(list_distinct(list(f)))::INT[] AS p FROM h GROUP BY video_id)"""
    return with_views(*_BASE, "one", body=body + _FILL.format(k=k))


@query(_its_sql(8))
def its_sample(spark, d):
    return _flat(sampling.inverse_cdf(_one(spark, d), ["video_id"], 8))


def _split_sql(k: int) -> str:
    text = """, norm AS (SELECT video_id, frame_idx AS f, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s, count(*) OVER w AS n FROM one WINDOW w AS (PARTITION BY video_id)),
d0 AS (SELECT *, 0 AS a, n AS len, NULL::INT AS at_, FALSE AS take FROM norm)"""
    for d in range(4):
        whole = "top - mean > 0.3 AND std > -100" if d < 3 else "TRUE"
        text += f""",
r{d} AS (SELECT *, row_number() OVER (PARTITION BY video_id, a, len ORDER BY s DESC, f) AS rn FROM d{d}),
t{d} AS (SELECT *, avg(s) FILTER (rn <= {k}) OVER w AS top, avg(s) OVER w AS mean, stddev_pop(s) OVER w AS std FROM r{d} WINDOW w AS (PARTITION BY video_id, a, len)),
w{d} AS (SELECT * REPLACE (CASE WHEN at_ IS NULL AND ({whole}) THEN rn <= {k // 2**d} ELSE take END AS take, CASE WHEN at_ IS NULL AND ({whole}) THEN {d} ELSE at_ END AS at_) FROM t{d}),
d{d + 1} AS (SELECT video_id, f, s, n, CASE WHEN at_ IS NULL AND f - a >= len // 2 THEN a + len // 2 ELSE a END AS a, CASE WHEN at_ IS NOT NULL THEN len WHEN f - a < len // 2 THEN len // 2 ELSE len - len // 2 END AS len, at_, take FROM w{d})"""
    fill = _FILL.format(k=k).replace(f"n <= {k}", f"n < {k}")
    return with_views(*_BASE, "one", body=text + ", picked AS (SELECT video_id, any_value(n)::INT AS n, list_sort(coalesce(list(f) FILTER (take), []))::INT[] AS p FROM d4 GROUP BY video_id)" + fill)


@query(_split_sql(8))
def adaptive_split(spark, d):
    return _flat(sampling.adaptive_split(_one(spark, d), ["video_id"], 8, t1=0.3, depth=3))


@query(_fold_sql("one", (*_BASE, "one"), "8", _POOL_GAP, _NEVER, "SELECT video_id, unnest(kept) AS frame_idx FROM last"))
def cosine_nms(spark, d):
    return _flat(nms.gap_select(_one(spark, d), ["video_id"], 8))


def _grid_sql(ks: list[int]) -> str:
    uniform = lambda k: with_views("frames", body=f"SELECT video_id, unnest(CASE WHEN n <= {k} THEN generate_series(0, n - 1) ELSE [CASE WHEN i = {k - 1} THEN n - 1 ELSE trunc(i * ((n - 1)::DOUBLE / {k - 1}))::BIGINT END FOR i IN generate_series(0, {k - 1})] END)::INT AS frame_idx FROM (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id)")
    cosine = lambda k: _fold_sql("one", (*_BASE, "one"), str(k), _POOL_GAP, _NEVER, "SELECT video_id, unnest(kept) AS frame_idx FROM last")
    every = " UNION ALL ".join(f"SELECT '{name}' AS method, {k} AS k, video_id, frame_idx FROM ({sql(k)})" for name, sql in (("uniform", uniform), ("cosine", cosine), ("split", _split_sql), ("cdf", _its_sql)) for k in ks)
    return f"""WITH picks AS ({every}), items AS (SELECT DISTINCT label AS video_id, label * 2.0 AS a, label * 2.0 + 1.5 AS b FROM embeddings), calls AS (SELECT * FROM items, (SELECT unnest(['uniform', 'cosine', 'split', 'cdf']) AS method), (SELECT unnest({ks}) AS k)),
h AS (SELECT c.method, c.k, c.video_id, coalesce(bool_or(frame_idx / 2.0 BETWEEN a AND b), FALSE) AS hit FROM calls c LEFT JOIN picks p ON p.method = c.method AND p.k = c.k AND p.video_id = c.video_id GROUP BY ALL)
SELECT method, k::INT AS k, count(*) FILTER (hit) AS hits, count(*) AS items, round(avg(hit::INT), 4) AS rate FROM h GROUP BY method, k"""


@query(_grid_sql([4, 8]))
def selector_grid(spark, d):
    """Four selectors by two K over one table of scores; an item whose video isn't cached doesn't count."""
    videos = P.frames(spark, d).select("video_id").distinct()
    items = videos.union(videos.groupBy().agg((F.max("video_id") + 1).alias("video_id"))).select("video_id", (F.col("video_id") * 2.0).alias("start_s"), (F.col("video_id") * 2.0 + 1.5).alias("end_s"))
    chosen = selection.SELECTORS | {"split": lambda scores, keys, k: sampling.adaptive_split(scores, keys, k, t1=0.3, depth=3)}
    return selection.hit_table(selection.selector_records(_one(spark, d), items, chosen, [4, 8], ["video_id"]))


@query()
def wavelet_mmr(spark, d):
    scored = _one(spark, d).join(P.frames(spark, d), ["video_id", "frame_idx"]).withColumn("score", (F.col("score") + 1) / 2)
    return _flat(wavelet.wavelet_select(scored, "video_id", 8))


def _stand_in_detector(video, frames, names):
    """Finds every name on frames whose number it divides evenly; for tests and the registered query."""
    return [[(name, 0.9 - 0.01 * i, (4.0 * i, 0.0, 4.0 * i + 6, 6.0)) for i, name in enumerate(names) if f % (i + 2) == 0] for f in frames]


def _searches(spark, d):
    n = P.frames(spark, d).groupBy("video_id").agg(F.count("*").cast("int").alias("n"))
    relation = F.array(F.struct(F.lit("cup").alias("a"), F.lit("hand").alias("b"), F.lit("time").alias("type")))
    return n.select(F.col("video_id").cast("string").alias("uid"), F.col("video_id"), "n", F.array(F.lit("cup")).alias("targets"), F.array(F.lit("hand")).alias("cues"), relation.alias("relations"))


@query()
def relation_search(spark, d):
    return search.relation_search(_searches(spark, d), _stand_in_detector, 8).select("uid", F.explode("picks").alias("frame_idx"))


def _stand_in_detections(requests):
    """The stand-in detector for many videos in one call."""
    return [_stand_in_detector(*r) for r in requests]


def _stand_in_close_look(requests):
    """What single frames show: a name is surer there on frames that 8 divides, and never seen on those that 3 divides."""
    return [[[(name, 0.97 if f % 8 == 0 else 0.3, box) for name, _, box in one if f % 3] for f, one in zip(frames, _stand_in_detector(video, frames, names), strict=True)] for video, frames, names in requests]


@query()
def search_in_rounds(spark, d):
    """The search of all videos together, with a second detection that answers differently from the first."""
    return search.search_rounds(_searches(spark, d), _stand_in_detections, _stand_in_close_look, 8).select("uid", F.posexplode("scores").alias("frame_idx", "score")).withColumn("score", F.round("score", 6))


@query("SELECT uid, unnest([CASE WHEN i = 23 THEN n - 1 ELSE floor(i * ((n - 1) / 23.0::DOUBLE)) END FOR i IN generate_series((b - 1) * 8, b * 8 - 1)])::INT AS frame_idx FROM (SELECT o_orderkey AS uid, o_custkey % 400 + 1 AS n, o_orderkey % 3 + 1 AS b FROM orders)")
def batch_sample(spark, d):
    rows = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), (F.col("o_custkey") % 400 + 1).alias("n"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("b"))
    return rows.select("uid", F.explode(sampling.batch_of_grid(F.col("n"), 8, F.col("b"), 3)).alias("frame_idx"))


@query("SELECT o_orderkey AS uid, unnest(generate_series(0, n - 1, greatest(1, n // 8)))::INT AS frame_idx FROM (SELECT o_orderkey, o_custkey % 400 + 8 AS n FROM orders)")
def stride_sample(spark, d):
    rows = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), (F.col("o_custkey") % 400 + 8).alias("n"))
    return rows.select("uid", F.explode(sampling.stride_sample(F.col("n"), 8)).alias("frame_idx"))


@query(with_views(*_BASE, "one", body="SELECT video_id, frame_idx, round(exp((score - m) / 0.5) / sum(exp((score - m) / 0.5)) OVER (PARTITION BY video_id), 6) AS share FROM (SELECT *, max(score) OVER (PARTITION BY video_id) AS m FROM one)"))
def softmax_share(spark, d):
    return _one(spark, d).select("video_id", "frame_idx", F.round(sampling.softmax(F.col("score"), ["video_id"], 0.5), 6).alias("share"))


@query(with_views(*_BASE, "one", body="SELECT video_id, frame_idx // 10 AS seg, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std, max(score) AS max, round(var_pop(score), 9) AS var FROM one GROUP BY ALL"))
def segment_stats(spark, d):
    out = sampling.segment_stats(_one(spark, d).withColumn("seg", F.floor(F.col("frame_idx") / 10).cast("int")), ["video_id", "seg"])
    return out.select("video_id", "seg", *(F.round(c, 9).alias(c) for c in ("mean", "std")), "max", F.round("var", 9).alias("var"))


# ---------------------------------------------------------------- metrics

_TIMES = ("truth", "picks")


_LISTS = "lists AS (SELECT uid, list(t ORDER BY t) AS ts FROM picks GROUP BY uid)"


def _lists(spark, d):
    return P.picks(spark, d).groupBy("uid").agg(F.array_sort(F.collect_list("t")).alias("ts"))


@query(with_views(*_TIMES, body=f", {_LISTS} SELECT uid, len(list_filter(ts, lambda t: t BETWEEN start_s AND end_s)) > 0 AS hit FROM lists JOIN truth USING (uid)".lstrip()))
def hit_at_k(spark, d):
    return metrics.hit_at_k(_lists(spark, d).withColumnRenamed("ts", "times"), P.truth(spark, d))


@query(with_views(*_TIMES, body=f", {_LISTS}, h AS (SELECT len(list_filter(ts, lambda t: t BETWEEN start_s - 2 AND end_s + 2)) > 0 AS hit FROM lists JOIN truth USING (uid)) SELECT count(*) AS n_items, count(*) FILTER (hit) AS n_hits, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate, count(*) FILTER (NOT hit) AS n_misses FROM h".lstrip()))
def hit_summary(spark, d):
    return metrics.hit_summary(metrics.hit_at_k(_lists(spark, d).withColumnRenamed("ts", "times"), P.truth(spark, d), margin=2.0))


@query(with_views("picks", body=f", {_LISTS} SELECT uid[1:1] AS grp, count(*) AS n_rows, sum(len(ts))::BIGINT AS n_elements FROM lists GROUP BY 1".lstrip()))
def detection_counts(spark, d):
    return metrics.detection_counts(_lists(spark, d).withColumn("grp", F.substring("uid", 1, 1)), ["grp"], "ts")


@query(with_views("frames", "q", "scores", "one", body=""", l AS (SELECT video_id, list(score ORDER BY frame_idx) AS v FROM one GROUP BY video_id), i AS (SELECT video_id, v, unnest(generate_series(1, len(v))) AS i FROM l),
f AS (SELECT *, greatest(0, least(i - 3, len(v) - 5)) AS a FROM i), w AS (SELECT *, v[a + 1 : a + 5] AS p, (i - 1 - a)::INT - 2 AS x FROM f)
SELECT video_id, (i - 1)::INT AS pos, round((17 * list_sum(p) - 5 * (4 * p[1] + p[2] + p[4] + 4 * p[5])) / 35 + x * (-2 * p[1] - p[2] + p[4] + 2 * p[5]) / 10 + x * x * (2 * p[1] - p[2] - 2 * p[3] - p[4] + 2 * p[5]) / 14, 8) AS value FROM w WHERE len(v) >= 5""".lstrip()))
def smoothed_scores(spark, d):
    curves = _one(spark, d).groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "score"))), lambda x: x["score"]).alias("v")).where(F.size("v") >= 5)
    return curves.select("video_id", F.posexplode(metrics.smooth_curve(F.col("v"), 5, 2)).alias("pos", "value")).withColumn("value", F.round("value", 8))


@query(with_views(*_TIMES, body=f", {_LISTS}, m AS (SELECT uid, k, method, CASE method WHEN 'head' THEN ts[1:k] ELSE ts[-k:] END AS times FROM lists, (SELECT unnest([1, 2, 4, 8]) AS k), (SELECT unnest(['head', 'tail']) AS method)) SELECT method, k, sum(len(list_filter(times, lambda t: t BETWEEN start_s AND end_s)) > 0)::BIGINT AS hits, count(*) AS items, round(avg((len(list_filter(times, lambda t: t BETWEEN start_s AND end_s)) > 0)::INT), 4) AS rate FROM m JOIN truth USING (uid) GROUP BY method, k".lstrip()))
def hit_grid(spark, d):
    rows = _lists(spark, d).withColumn("k", F.explode(F.array(*(F.lit(k) for k in (1, 2, 4, 8)))))
    head, tail = F.slice("ts", F.lit(1), F.col("k")), F.slice("ts", F.greatest(F.lit(1), F.size("ts") - F.col("k") + 1), F.col("k"))
    picks = rows.select("uid", "k", F.lit("head").alias("method"), head.alias("times")).union(rows.select("uid", "k", F.lit("tail"), tail))
    return metrics.hit_grid(picks, P.truth(spark, d))


_PAIRS = """pr AS (SELECT user_id::VARCHAR AS uid, floor(epoch(ts) / 3600) AS t, event_type FROM events), both_ AS (SELECT uid, list(t ORDER BY t) FILTER (event_type = 'purchase') AS gt, list(t ORDER BY t) FILTER (event_type = 'click') AS pred FROM pr GROUP BY uid),
near AS (SELECT uid, [list_min([abs(x - y) FOR y IN pred]) FOR x IN gt] AS g, [list_min([abs(x - y) FOR y IN gt]) FOR x IN pred] AS p FROM both_ WHERE len(gt) > 0 AND len(pred) > 0)"""


def _both(spark, d):
    """Truths and predictions (uid, t): purchases and clicks, in whole hours."""
    e = P.table(spark, d, "events").select(F.col("user_id").cast("string").alias("uid"), F.floor(F.unix_timestamp("ts") / 3600).cast("double").alias("t"), "event_type")
    return e.where("event_type = 'purchase'"), e.where("event_type = 'click'")


@query(f"WITH {_PAIRS}, s AS (SELECT uid, len(list_filter(p, lambda x: x <= 5)) / len(p)::DOUBLE AS a, len(list_filter(g, lambda x: x <= 5)) / len(g)::DOUBLE AS b FROM near) SELECT uid, round(a, 6) AS precision, round(b, 6) AS recall, round(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END, 6) AS f1 FROM s")
def prf(spark, d):
    return temporal.prf(*_both(spark, d), 5.0).select("uid", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {_PAIRS}, s AS (SELECT len(list_filter(p, lambda x: x <= 5)) / len(p)::DOUBLE AS a, len(list_filter(g, lambda x: x <= 5)) / len(g)::DOUBLE AS b FROM near) SELECT round(avg(a), 6) AS precision, round(avg(b), 6) AS recall, round(avg(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END), 6) AS f1, round(2 * avg(a) * avg(b) / (avg(a) + avg(b)), 6) AS f1_of_means, count(*) AS n FROM s")
def prf_macro(spark, d):
    return metrics.macro(temporal.prf(*_both(spark, d), 5.0))


@query(f"WITH {_PAIRS} SELECT uid, len(list_filter(g, lambda x: x <= 5))::INT AS covered, round(len(list_filter(g, lambda x: x <= 5)) / len(p)::DOUBLE, 6) AS precision, round(len(list_filter(g, lambda x: x <= 5)) / len(g)::DOUBLE, 6) AS recall FROM near")
def prf_covered(spark, d):
    out = temporal.prf_covered(*_both(spark, d), 5.0)
    return out.select("uid", "covered", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {_PAIRS} SELECT uid, round(list_avg(g), 6) AS to_pred, round(list_avg(p), 6) AS to_truth, round((list_avg(g) + list_avg(p)) / 2, 6) AS annd FROM near")
def annd(spark, d):
    return temporal.annd(*_both(spark, d)).select("uid", *(F.round(c, 6).alias(c) for c in ("to_pred", "to_truth", "annd")))


@query(f"WITH {_PAIRS} SELECT uid::INT % 2 = 0 AS correct, round(avg(dist / 720.0), 6) AS error FROM (SELECT uid, unnest(g) AS dist FROM near) GROUP BY 1")
def relative_errors(spark, d):
    truth, pred = _both(spark, d)
    return temporal.relative_errors(truth.withColumn("correct", F.col("uid").cast("int") % 2 == 0), pred, 720.0).withColumn("error", F.round("error", 6))


_HOURS = "h AS (SELECT event_id, user_id::VARCHAR AS uid, epoch(ts) / 3600.0::DOUBLE AS t, event_type, value FROM events)"


def _hours(spark, d, kind):
    e = P.table(spark, d, "events").where(F.col("event_type") == kind)
    return e.select("event_id", F.col("user_id").cast("string").alias("uid"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t"), "value")


@query(f"WITH {_HOURS}, w AS (SELECT event_id, uid, t - 6 AS a, t + 6 + value % 50 AS b FROM h WHERE event_type = 'purchase') SELECT w.event_id, w.uid, count(c.t) AS n_inside FROM w LEFT JOIN h c ON c.uid = w.uid AND c.event_type = 'click' AND c.t BETWEEN w.a - 1 AND w.b + 1 GROUP BY w.event_id, w.uid")
def interval_hits(spark, d):
    truth = _hours(spark, d, "purchase").select("event_id", "uid", (F.col("t") - 6).alias("start_s"), (F.col("t") + 6 + F.col("value") % 50).alias("end_s"))
    return temporal.interval_hits(_hours(spark, d, "click"), truth, width=24.0, margin=1.0).select("event_id", "uid", "n_inside")


@query(f"WITH {_HOURS}, a AS (SELECT event_id, uid, t AS s, t + value % 40 AS e FROM h WHERE event_type = 'purchase'), b AS (SELECT event_id, uid, t AS s, t + value % 90 AS e FROM h WHERE event_type = 'view') SELECT a.event_id, b.event_id AS other_id FROM a JOIN b ON a.uid = b.uid AND a.s < b.e AND b.s < a.e")
def interval_overlaps(spark, d):
    one = _hours(spark, d, "purchase").select("event_id", "uid", F.col("t").alias("start"), (F.col("t") + F.col("value") % 40).alias("end"))
    two = _hours(spark, d, "view").select(F.col("event_id").alias("other_id"), "uid", F.col("t").alias("other_start"), (F.col("t") + F.col("value") % 90).alias("other_end"))
    return temporal.overlapping(one, two, ["uid"], 36.0).select("event_id", "other_id")


@query(f"""WITH {_HOURS}, f AS (SELECT event_id, uid, t FROM h WHERE event_type = 'click'), s AS (SELECT event_id, uid, t AS a, t + value % 30 / 10 AS b FROM h WHERE event_type = 'purchase'),
m AS (SELECT *, (a + b) / 2 AS m, max((a + b) / 2) OVER (PARTITION BY uid ORDER BY event_id) AS pt FROM s), w AS (SELECT *, CASE WHEN b - a < 1 THEN m - 0.5::DOUBLE ELSE a END AS l, CASE WHEN b - a < 1 THEN m + 0.5::DOUBLE ELSE b END AS r FROM m),
l AS (SELECT uid, t AS pt, 0 AS kind, event_id AS o, event_id::VARCHAR AS value FROM f UNION ALL SELECT uid, pt, 1, event_id, 'said ' || event_id FROM w WHERE EXISTS (SELECT 1 FROM f WHERE f.uid = w.uid AND f.t > w.l AND f.t < w.r))
SELECT uid, (row_number() OVER (PARTITION BY uid ORDER BY pt, kind, o) - 1)::INT AS place, kind, value FROM l""")
def subtitle_frames(spark, d):
    frames = _hours(spark, d, "click").select("uid", F.col("event_id").alias("frame_idx"), "t")
    said = _hours(spark, d, "purchase").select("uid", F.col("event_id").alias("ordinal"), F.col("t").alias("start"), (F.col("t") + F.col("value") % 30 / 10).alias("end"), F.concat(F.lit("said "), F.col("event_id")).alias("text"))
    return temporal.interleave(frames, said, "uid", width=2.0)


@query("""WITH i AS (SELECT user_id::VARCHAR AS uid, CASE user_id % 4 WHEN 0 THEN 30000.0::DOUBLE / 1001 WHEN 1 THEN 25.0 WHEN 2 THEN 2.0 END AS fps, user_id % 2 = 0 AS own FROM events GROUP BY user_id), e AS (SELECT user_id::VARCHAR AS uid, floor(epoch(ts) / 600) AS f, event_type FROM events),
b AS (SELECT uid, list(f) FILTER (event_type = 'purchase') AS g, list(f) FILTER (event_type = 'click') AS p FROM e GROUP BY uid), n AS (SELECT fps, [list_min([abs(x - y) FOR y IN p]) FOR x IN g] AS near, len(p) AS m FROM b JOIN i USING (uid) WHERE own AND fps IS NOT NULL AND len(g) > 0 AND len(p) > 0),
s AS (SELECT len(list_filter(near, lambda x: x <= 3 * fps)) / m::DOUBLE AS a, len(list_filter(near, lambda x: x <= 3 * fps)) / len(near)::DOUBLE AS r FROM n)
SELECT round(sum(a) / any_value(c), 6) AS precision, round(sum(r) / any_value(c), 6) AS recall, round(sum(CASE WHEN a + r > 0 THEN 2 * a * r / (a + r) ELSE 0 END) / any_value(c), 6) AS f1 FROM s, (SELECT count(*) AS c FROM i)""")
def prf_over_all(spark, d):
    """A group's precision and recall over all items, at each item's frame rate."""
    e = P.table(spark, d, "events").select(F.col("user_id").cast("string").alias("uid"), F.floor(F.unix_timestamp("ts") / 600).cast("double").alias("frame"), "event_type", "user_id")
    rate = F.when(F.col("user_id") % 4 == 0, "30000/1001").when(F.col("user_id") % 4 == 1, "25").when(F.col("user_id") % 4 == 2, "2")
    items = e.select("uid", T.fraction(rate).alias("fps"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("grp")).distinct()
    out = temporal.prf_over_all(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), items, 3.0, "even")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def _answers(spark, d):
    letter = lambda c: F.char(65 + F.col(c))
    rows = P.table(spark, d, "labels").join(P.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    error = F.when(F.col("doc_id") % 10 == 0, "failed")
    return rows.select(F.col("doc_id").alias("uid"), F.col("lang").alias("grp"), F.when(F.col("doc_id") % 17 == 0, F.lit(" ")).otherwise(F.lower(letter("quality"))).alias("answer"), letter("toxic").alias("gold"), error.alias("error"))


_ANSWERS = "answers AS (SELECT doc_id AS uid, lang AS grp, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE lower(chr(65 + quality)) END AS answer, chr(65 + toxic) AS gold, CASE WHEN doc_id % 10 = 0 THEN 'failed' END AS error FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_ANSWERS}, f AS (SELECT *, error IS NOT NULL OR trim(answer) = '' AS bad FROM answers) SELECT coalesce(grp, 'total') AS g, sum((NOT bad)::INT)::BIGINT AS answered, sum((NOT bad AND lower(answer) = lower(gold))::INT)::BIGINT AS correct, sum(bad::INT)::BIGINT AS errors, round(coalesce(sum((NOT bad AND lower(answer) = lower(gold))::INT) / nullif(sum((NOT bad)::INT), 0), 0), 6) AS accuracy FROM f GROUP BY GROUPING SETS ((grp), ())")
def accuracy_by_group(spark, d):
    return metrics.accuracy_by_group(_answers(spark, d))


@query(f"WITH {_ANSWERS} SELECT count(*) AS total, sum((upper(answer) IS NOT DISTINCT FROM gold)::INT)::BIGINT AS correct, round(avg((upper(answer) IS NOT DISTINCT FROM gold)::INT), 4) AS accuracy FROM answers")
def accuracy(spark, d):
    return metrics.accuracy(_answers(spark, d).withColumn("answer", F.upper("answer")))


@query(f"WITH {_ANSWERS}, e AS (SELECT uid, CASE WHEN uid % 2 = 0 THEN gold ELSE upper(answer) END AS answer, gold FROM answers WHERE uid % 3 = 0), r AS (SELECT * FROM e UNION ALL SELECT uid, upper(answer), gold FROM answers WHERE uid % 3 > 0) SELECT count(*) AS total, sum((answer IS NOT DISTINCT FROM gold)::INT)::BIGINT AS correct, round(avg((answer IS NOT DISTINCT FROM gold)::INT), 4) AS accuracy FROM r")
def accuracy_resumed(spark, d):
    """A run that goes on after an earlier one, whose results count as they were."""
    rows = _answers(spark, d).withColumn("answer", F.upper("answer"))
    earlier = rows.where("uid % 3 = 0").withColumn("answer", F.when(F.col("uid") % 2 == 0, F.col("gold")).otherwise(F.col("answer")))
    return metrics.accuracy_resumed(rows, earlier)


@query(with_views(*_TIMES, body=", c AS (SELECT uid, start_s, end_s, count(t) FILTER (t BETWEEN start_s AND end_s) AS inside FROM truth LEFT JOIN picks USING (uid) GROUP BY ALL) SELECT uid, round(least(1.0, inside / greatest(1, least(8, floor((end_s - start_s) / 10) + 1))), 6) AS reward FROM c".lstrip()))
def frames_in_gt(spark, d):
    rows = P.truth(spark, d).join(P.picks(spark, d), "uid", "left").groupBy("uid", "start_s", "end_s").agg(F.count_if(F.col("t").between(F.col("start_s"), F.col("end_s"))).alias("inside"))
    return rows.select("uid", F.round(planner.frames_in_truth(F.col("inside"), F.col("start_s"), F.col("end_s"), 8, 0.0), 6).alias("reward"))


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS best, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders), e AS (SELECT *, sum((before IS NULL OR o_totalprice > before)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS era FROM r) SELECT o_custkey, o_orderkey, o_totalprice, best, (row_number() OVER (PARTITION BY o_custkey, era ORDER BY o_orderkey) - 1)::INT AS patience FROM e")
def running_best(spark, d):
    return rank.running_best(P.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice").withColumn("patience", F.col("patience").cast("int"))


@query()
def image_similarity(spark, d):
    e = P.table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("img"))
    first = e.groupBy("label").agg(F.min_by("img", "vec_id").alias("other"))
    return e.join(first, "label").select("vec_id", F.round(metrics.image_ssim(F.col("img"), F.col("other"), F.lit(8)), 6).alias("ssim"))


# ---------------------------------------------------------------- plans, prompts, replies

_REPLY = """CASE conv_id % 9
WHEN 0 THEN 'Plan for ' || role || ':' || chr(10) || '```json' || chr(10) || '{"queries": [{"tool": "image", "query": "' || role || '", "id": "Q1"}, {"tool": "region", "query": "b", "id": "Q' || turn || '"}], "combine": "Q1 AND Q' || turn || '"}' || chr(10) || '```'
WHEN 1 THEN 'so {"queries": [{"tool": "text", "query": "c", "id": "Q1"}], "combine": "Q1 OR Q' || turn || '"} done'
WHEN 2 THEN '{"queries": [{"tool": "image", "id": "Q1"}, {"tool": "image", "query": "d", "id": "Q2"}], "combine": "Q2"}'
WHEN 3 THEN text
WHEN 4 THEN '{"queries": ['
WHEN 5 THEN '{"queries": ["Q1", 7, null, [1], {"tool": "image", "query": {"a": ' || turn || '}, "id": "Q3"}], "combine": "Q3"}'
WHEN 6 THEN '{"queries": [{"tool": "image", "query": "x", "id": "Q1"}], "combine": "Q1"} or {}'
WHEN 7 THEN '```' || '{"queries": {"tool": "image"}, "combine": "Q1"}' || '```'
ELSE '{"combine": "Q' || turn || '", "queries": [{"tool": "image", "query": 5, "id": "Q' || turn || '", "more": [1, 2]}]}' END"""


def _replies(spark, d):
    return P.table(spark, d, "conversations").select("conv_id", "turn", F.expr(_REPLY).alias("reply"))


#: The replies read by the oracle's own JSON functions: part, queries that are whole, all queries, expression.
_READ = f"""WITH r AS (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations),
j AS (SELECT *, CASE WHEN regexp_matches(reply, '```(?:json)?\\s*(.*?)\\s*```', 's') THEN regexp_extract(reply, '```(?:json)?\\s*(.*?)\\s*```', 1, 's') ELSE regexp_extract(reply, '\\{{.*\\}}', 0, 's') END AS part FROM r),
v AS (SELECT *, CASE WHEN json_valid(part) THEN part::JSON END AS v FROM j),
a AS (SELECT *, CASE WHEN json_type(v, '$.queries') = 'ARRAY' THEN json_extract(v, '$.queries[*]') ELSE []::JSON[] END AS emitted, coalesce(json_extract_string(v, '$.combine'), '') AS combine FROM v),
p AS (SELECT *, list_filter(emitted, lambda e: json_type(e) = 'OBJECT' AND json_exists(e, '$.tool') AND json_exists(e, '$.query') AND json_exists(e, '$.id')) AS good FROM a) """


@query(_READ + "SELECT conv_id, turn, len(good) AS n_queries, len(emitted) AS n_emitted, combine, len(list_filter(good, lambda e: json_extract_string(e, '$.tool') = 'image')) AS n_available, array_to_string([json_extract_string(e, '$.query') FOR e IN good], '|') AS texts FROM p")
def plan_parse(spark, d):
    rows = _replies(spark, d).withColumn("plan", planner.parse_plan(F.col("reply")))
    left = planner.available(F.col("plan.queries"), F.array(F.lit("image")))
    size = lambda c: F.size(c).cast("long")
    return rows.select("conv_id", "turn", size("plan.queries").alias("n_queries"), planner.raw_query_count(F.col("reply")).cast("long").alias("n_emitted"), F.col("plan.combine").alias("combine"), size(left).alias("n_available"), F.array_join(F.transform("plan.queries", lambda q: q["query"]), "|").alias("texts"))


@query(_READ + "SELECT conv_id, turn, CASE WHEN len(good) = 0 OR len(good) < len(emitted) THEN -1.0 WHEN len(list_filter(regexp_extract_all(combine, '\\bQ\\d+\\b'), lambda c: NOT list_contains([json_extract_string(e, '$.id') FOR e IN good], c))) > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS reward FROM p")
def consistency(spark, d):
    return _replies(spark, d).select("conv_id", "turn", planner.consistency(F.col("reply")).alias("reward"))


@query("SELECT conv_id, turn, array_to_string(list_distinct(regexp_extract_all(r, '\\bQ\\d+\\b')).list_sort(), ',') AS ids FROM (SELECT conv_id, turn, 'Q' || turn || ' AND (Q2 OR Q' || (conv_id % 9) || ') xQ5' AS r FROM conversations)")
def combine_ids(spark, d):
    rows = P.table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Q"), F.col("turn"), F.lit(" AND (Q2 OR Q"), F.col("conv_id") % 9, F.lit(") xQ5")).alias("r"))
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(planner.combine_ids(F.col("r"))), ",").alias("ids"))


def _options():
    lines = F.split("text", "\n")
    return F.create_map(F.lit("B"), F.element_at(lines, -1), F.lit("A"), F.element_at(lines, 1))


@query("SELECT doc_id, '  B: ' || b || chr(10) || '  A: ' || a AS options, 'A) ' || a || chr(10) || 'B) ' || b AS sorted, text || ' ' || a || ' ' || b AS query FROM (SELECT doc_id, text, string_split(text, chr(10))[1] AS a, string_split(text, chr(10))[-1] AS b FROM documents WHERE text IS NOT NULL)")
def prompt_parts(spark, d):
    """Options are the first and last lines of whole texts."""
    rows = P.table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", X.format_options(_options()).alias("options"), X.format_options(_options(), "bracket").alias("sorted"), X.retrieval_query(F.col("text"), _options()).alias("query"))


_ANSWER = "CASE turn % 4 WHEN 0 THEN 'It is (B). Confidence: ' || conv_id % 8 WHEN 1 THEN 'B? No, A; ' || text WHEN 2 THEN chr(10) || '  ' || lower(text) ELSE text || ' confidence ' || conv_id % 6 END"


@query(f"""WITH r AS (SELECT conv_id, turn, {_ANSWER} AS reply FROM conversations), k AS (SELECT *, list_filter(['C', 'A', 'B'], lambda x: regexp_matches(reply, '(^|[^[:word:]])' || x || '([^[:word:]]|$)')) AS found, upper(regexp_replace(reply, '^[[:space:]]+', '')[1]) AS first FROM r)
SELECT conv_id, turn, CASE WHEN len(found) > 0 THEN found[1] WHEN list_contains(['C', 'A', 'B'], first) THEN first END AS answer, coalesce(try_cast(regexp_extract(reply, '(?i)confidence[:[:space:]]*([0-5])', 1) AS INT), -1) AS confidence FROM k""")
def answer_parse(spark, d):
    rows = P.table(spark, d, "conversations").select("conv_id", "turn", F.expr(_ANSWER).alias("reply"))
    options = F.create_map(F.lit("C"), F.lit("x"), F.lit("A"), F.lit("y"), F.lit("B"), F.lit("z"))
    return rows.select("conv_id", "turn", X.parse_answer(F.col("reply"), options).alias("answer"), F.coalesce(X.parse_confidence(F.col("reply")), F.lit(-1)).alias("confidence"))


_COMPLETION = """CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN to_json(array(named_struct('type', 'text', 'text', text), named_struct('type', 'image', 'text', 'x'), named_struct('type', 'text', 'text', role))) ELSE concat('[', text) END"""


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || role ELSE '[' || text END AS completion FROM conversations")
def completion_text(spark, d):
    """Completions that are plain texts, and lists of parts as JSON."""
    rows = P.table(spark, d, "conversations").select("conv_id", "turn", F.expr(_COMPLETION).alias("reply"))
    return planner.completion_text(rows, "reply", "completion").select("conv_id", "turn", "completion")


@query("SELECT conv_id, turn, 'at ' || CASE turn % 2 WHEN 0 THEN (turn % 7 + 1)::VARCHAR ELSE (turn % 7 + 0.5::DOUBLE)::VARCHAR END || ' fps, ' || (turn + 1) || '.0s: ' || text || ' [image, text]' || chr(10) || '  B: ' || role || chr(10) || '  A: no' AS prompt FROM conversations")
def planner_prompts(spark, d):
    fps = F.when(F.col("turn") % 2 == 0, F.col("turn") % 7 + 1.0).otherwise(F.col("turn") % 7 + 0.5)
    options = F.create_map(F.lit("B"), F.col("role"), F.lit("A"), F.lit("no"))
    made = planner.planner_prompt(F.col("text"), options, F.array(F.lit("image"), F.lit("text")), F.col("turn") + 1.0, "at {fps} fps, {duration}: {question} [{tools}]\n{options}", fps)
    return P.table(spark, d, "conversations").select("conv_id", "turn", made.alias("prompt"))


@query("SELECT conv_id, turn FROM conversations WHERE NOT contains(text, 'the') AND role NOT IN ('system')")
def keep_questions(spark, d):
    rows = P.table(spark, d, "conversations").where(F.col("text").isNotNull() & F.col("role").isNotNull())
    return rows.where(X.keep_question(F.col("text"), F.col("role"), "the", ("system",))).select("conv_id", "turn")


@query("SELECT d.doc_id, l.item_id FROM documents d JOIN (SELECT text, max(doc_id) AS item_id FROM documents WHERE text IS NOT NULL GROUP BY text) l USING (text)")
def join_by_question(spark, d):
    """Whole texts against whole texts: the last document of each text."""
    docs = P.table(spark, d, "documents")
    items = docs.select(F.col("text").alias("question"), F.col("doc_id").alias("item_id"), F.col("doc_id").alias("ordinal"))
    return tables.join_by_question(docs.select("doc_id", F.col("text").alias("question")), items).select("doc_id", "item_id")


@query("WITH u AS (SELECT 0 AS run, o_custkey AS uid, o_orderkey AS ordinal FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 1, o_custkey, o_orderkey FROM orders) SELECT run, uid, ordinal FROM u QUALIFY row_number() OVER (PARTITION BY uid ORDER BY run, ordinal) = 1")
def union_runs(spark, d):
    rows = P.table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("ordinal"), "o_totalprice")
    return tables.union_runs([rows.where("o_totalprice > 200000").drop("o_totalprice"), rows.drop("o_totalprice")]).select("run", "uid", "ordinal")


@query("SELECT conv_id, turn, i, CASE i WHEN 1 THEN FALSE WHEN 3 THEN turn % 2 = 0 ELSE TRUE END AS vote FROM conversations, (SELECT unnest([1, 2, 3, 4]) AS i)")
def judge_votes(spark, d):
    rows = P.table(spark, d, "conversations")
    reply = F.concat(F.lit("1. NO\n2) yes\n3: "), F.when(F.col("turn") % 2 == 0, "YES").otherwise("NO"), F.lit("\nnothing"))
    out = rows.select("conv_id", "turn", F.posexplode(X.judge_votes(reply, F.lit(4))).alias("i", "vote"))
    return out.withColumn("i", F.col("i") + 1)


_GROUNDING = "'Key Objects: ' || replace(text, chr(10), ',') || ', table' || chr(10) || 'Cue Objects: ' || replace(replace(text, chr(10), ' '), ' ', ' , ') || ' , lamp,' || chr(10) || 'Rel: (' || translate(text, chr(10) || '();', '    ') || '; spatial; table), (broken; x), (a ; time; ' || item_id || ')'"


@query(rf"""WITH r AS (SELECT item_id, {_GROUNDING} AS r FROM benchmark), g AS (SELECT item_id, list_filter([trim(x) FOR x IN string_split(regexp_extract(r, '(?m)^\s*Key Objects:\s*(.*)$', 1), ',')], lambda x: x <> '') AS targets,
list_filter([trim(x) FOR x IN string_split(regexp_extract(r, '(?m)^\s*Cue Objects:\s*(.*)$', 1), ',')], lambda x: x <> '') AS cues, regexp_extract_all(regexp_extract(r, '(?m)^\s*Rel:\s*(.*)$', 1), '\(([^;()]*;[^;()]*;[^;()]*)\)', 1) AS rel FROM r)
SELECT item_id, array_to_string(targets, '|') AS targets, array_to_string(cues, '|') AS cues, trim(string_split(t, ';')[1]) AS a, trim(string_split(t, ';')[3]) AS b, trim(string_split(t, ';')[2]) AS type FROM (SELECT *, unnest(rel) AS t FROM g)""")
def grounding_parse(spark, d):
    g = P.table(spark, d, "benchmark").select("item_id", X.parse_grounding(F.expr(_GROUNDING)).alias("g"))
    return g.select("item_id", F.array_join("g.targets", "|").alias("targets"), F.array_join("g.cues", "|").alias("cues"), F.explode("g.relations").alias("r")).select("item_id", "targets", "cues", "r.*")


# ---------------------------------------------------------------- times

@query("SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN epoch(ts) % 86400 WHEN 1 THEN minute(ts) * 60 + second(ts) WHEN 2 THEN value END, 6) AS seconds FROM events")
def parse_hms(spark, d):
    e = P.table(spark, d, "events")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.date_format("ts", "HH:mm:ss.SSSSSS")).when(kind == 1, F.date_format("ts", "mm:ss")).when(kind == 2, F.col("value").cast("string")).otherwise("soon")
    return e.select("event_id", F.round(T.parse_clock(text, (2, 3)), 6).alias("seconds"))


@query("SELECT o_orderkey, unnest(list_sort(list_distinct([trunc(i * (1.0::DOUBLE / 2))::INT FOR i IN generate_series(0, o_orderkey % 40)]))) AS frame FROM orders")
def fps_rescale(spark, d):
    rows = P.table(spark, d, "orders").select("o_orderkey", F.sequence(F.lit(0), (F.col("o_orderkey") % 40).cast("int")).alias("f"))
    return rows.select("o_orderkey", F.explode(T.rescale_frames(F.col("f"), F.lit(2.0), F.lit(1.0))).alias("frame"))


@query("WITH v AS (SELECT o_orderkey, o_custkey % 900 + 30 AS total FROM orders), n AS (SELECT *, greatest(2, floor(least(total / 29.97::DOUBLE * 2.0, total) / 2) * 2)::INT AS nf FROM v) SELECT o_orderkey, nf, k::INT AS k, least(trunc(k / 2.0::DOUBLE * 29.97::DOUBLE)::INT, total - 1)::INT AS native FROM (SELECT *, unnest(generate_series(0, nf - 1)) AS k FROM n)")
def frame_index_plan(spark, d):
    rows = P.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 900 + 30).alias("total"))
    plan = rows.select("o_orderkey", T.cached_frames(F.col("total"), F.lit(29.97)).alias("nf"), F.posexplode(T.frame_plan(F.col("total"), F.lit(29.97))).alias("k", "native"))
    return plan.select("o_orderkey", "nf", "k", "native")


# ---------------------------------------------------------------- boxes

@query(with_views("boxes", body="SELECT image_id, a AS box_id, round(max(v), 6) AS best, count(*) FILTER (v > 0.5) AS n_over FROM (SELECT image_id, a, ix * iy / (aa + ab - ix * iy) AS v FROM (SELECT a.image_id, a.box_id AS a, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS ix, greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS iy, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.label = b.label AND a.box_id <> b.box_id)) GROUP BY image_id, a"))
def box_iou(spark, d):
    """Each box against all others of its image and label: the best overlap, and how many overlap by more than half."""
    return nms.best_overlaps(P.boxes(spark, d)).withColumn("best", F.round("best", 6))


_BOX_FOLD = with_views(
    "boxes",
    recursive=True,
    body=""", o AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, box_id) AS rn FROM boxes WHERE score > 0.3),
fold(image_id, label, rn, kept) AS (
  SELECT DISTINCT image_id, label, 0::BIGINT, []::STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, s DOUBLE)[] FROM o
  UNION ALL
  SELECT f.image_id, f.label, f.rn + 1, CASE WHEN coalesce(list_bool_or([greatest(0, least(y.x2, o.x2) - greatest(y.x1, o.x1)) * greatest(0, least(y.y2, o.y2) - greatest(y.y1, o.y1)) / ((y.x2 - y.x1) * (y.y2 - y.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0, least(y.x2, o.x2) - greatest(y.x1, o.x1)) * greatest(0, least(y.y2, o.y2) - greatest(y.y1, o.y1))) > 0.5 FOR y IN f.kept]), FALSE) THEN f.kept ELSE list_append(f.kept, {'id': o.box_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2, 's': o.score}) END
  FROM fold f JOIN o ON o.image_id = f.image_id AND o.label = f.label AND o.rn = f.rn + 1
), last AS (SELECT image_id, label, arg_max(kept, rn) AS kept FROM fold GROUP BY ALL), flat AS (SELECT image_id, label, unnest(kept) AS b FROM last)
SELECT * FROM (SELECT image_id, label, b.id AS box_id, b.s AS score, row_number() OVER (PARTITION BY image_id ORDER BY b.s DESC, b.id) AS rank FROM flat) WHERE rank <= 20""".lstrip(),
)


@query(_BOX_FOLD)
def box_nms(spark, d):
    return nms.box_nms(P.boxes(spark, d), 0.5, 0.3, keep=20).select("image_id", "label", "box_id", "score", F.col("rank").cast("long").alias("rank"))


@query(with_views("boxes", body="SELECT image_id, box_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS rank FROM boxes WHERE score > 0.5) WHERE rank <= 10"))
def top_detections(spark, d):
    return nms.top_detections(P.boxes(spark, d), 0.5, 10).select("image_id", "box_id", "score", F.col("rank").cast("long").alias("rank"))


@query(with_views("boxes", body="SELECT image_id, box_id, least(x1, 40) AS left, least(y1, 30) AS top, least(x2, 40) - least(x1, 40) AS width, least(y2, 30) - least(y1, 30) AS height, score FROM boxes WHERE label = 0 AND score >= 0.4"))
def left_top_boxes(spark, d):
    return nms.left_top(P.boxes(spark, d), 0.4, 40.0, 30.0)


@query(with_views("boxes", body="SELECT image_id, box_id, round(greatest(0, least((x1 - 2) / 1.5, 20)), 6) AS x1, round(greatest(0, least((y1 - 1) / 2, 16)), 6) AS y1, round(greatest(0, least((x2 - 2) / 1.5, 20)), 6) AS x2, round(greatest(0, least((y2 - 1) / 2, 16)), 6) AS y2 FROM boxes"))
def rescale_boxes(spark, d):
    out = nms.finish_boxes(P.boxes(spark, d), F.lit(20), F.lit(16), 2.0, 1.0, 1.5, 2.0)
    return out.select("image_id", "box_id", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(with_views("boxes", body="SELECT image_id, cell, max(score * CASE WHEN label = 0 THEN 1.0 ELSE 0.5 END) AS score FROM (SELECT *, (least(3, floor((y1 + y2) / 2 / 12)) * 4 + least(3, floor((x1 + x2) / 2 / 14)))::INT AS cell FROM boxes) GROUP BY ALL"))
def grid_cells(spark, d):
    rows = P.boxes(spark, d).withColumn("kind", F.when(F.col("label") == 0, "target").otherwise("cue"))
    return search.cell_scores(rows, 56.0, 48.0, 4, 4)


@query(with_views("boxes", body="SELECT image_id, label, box_id FROM boxes WHERE (x2 - x1) * (y2 - y1) >= 200 QUALIFY row_number() OVER (PARTITION BY image_id, label ORDER BY md5(image_id || ':' || label || ':' || box_id || ':0'), box_id) = 1"))
def one_box_per_class(spark, d):
    return nms.one_box_per_class(P.boxes(spark, d), 200.0).select("image_id", "label", "box_id")


# ---------------------------------------------------------------- sources and sinks

def _stand_in_boxes(images):
    """The lines of a text as boxes (first byte, end); for tests and the registered query."""
    out = []
    for image in images:
        ends = [k for k, c in enumerate(image) if c == 10] + [len(image)]
        out.append(list(zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)))
    return out


def _stand_in_reader(pairs):
    return [image[a:b].decode() for image, (a, b) in pairs]


@query("SELECT doc_id AS video_id, (n_chars % 7)::INT AS frame_idx, array_to_string(list_filter([trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) FOR x IN string_split(coalesce(text, ''), chr(10))], lambda x: x <> ''), '|') AS texts FROM documents")
def extracted_texts(spark, d):
    """Whole texts as images: each line is a box, found in one batch of calls and read in another."""
    frames = P.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), (F.col("n_chars") % 7).cast("int").alias("frame_idx"), F.encode("text", "utf-8").alias("image"))
    return extraction.extract_texts(frames, _stand_in_boxes, _stand_in_reader).select("video_id", "frame_idx", F.array_join("texts", "|").alias("texts"))


def _stand_in_work(row):
    """The number of words of a text; fails on texts whose first word's length divides by 5."""
    words = row["text"].split(" ")
    if len(words[0]) % 5 == 0:
        raise ValueError(f"no answer for {row['uid']}")
    return {"n": len(words), "first": words[0]}


@query("SELECT conv_id || ':' || turn AS uid, CASE WHEN NOT bad THEN len(w) END AS n, CASE WHEN NOT bad THEN w[1] END AS first, CASE WHEN bad THEN 'ValueError: no answer for ' || conv_id || ':' || turn END AS error FROM (SELECT *, length(w[1]) % 5 = 0 AS bad FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))")
def attempted(spark, d):
    """Values and errors, row by row."""
    rows = P.table(spark, d, "conversations").select(F.concat("conv_id", F.lit(":"), "turn").alias("uid"), "text")
    return attempts.attempt(rows, _stand_in_work, "struct<n: bigint, first: string>").select("uid", "value.n", "value.first", "error")


@query("SELECT o_orderkey AS uid FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def resume_anti(spark, d):
    orders = P.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("uid"))
    done = P.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("uid"))
    return sinks.not_done(orders, done).select(F.col("o_orderkey").alias("uid"))


@query("SELECT o_custkey::VARCHAR AS uid, o_orderkey AS ordinal, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def dedup_last_wins(spark, d):
    rows = P.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("uid"), F.col("o_orderkey").alias("ordinal"), "o_totalprice")
    return rank.last_by(rows, "uid", "ordinal")


@query("SELECT doc_id AS video_id, CASE WHEN doc_id % 2 = 0 THEN n_chars WHEN doc_id % 3 = 0 THEN doc_id ELSE 0 END AS num_frames, CASE WHEN doc_id % 3 = 0 THEN 5.0 ELSE 2.0 END::DOUBLE AS fps FROM documents")
def bind_caches(spark, d):
    docs = P.table(spark, d, "documents")
    items = docs.select(F.col("doc_id").alias("video_id"))
    feats = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("video_id"), F.col("n_chars").alias("num_frames"))
    text = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("video_id"), F.col("doc_id").alias("num_frames"), F.lit(5.0).alias("fps"))
    return tables.bind_caches(items, feats, text, None)


@query("SELECT o_orderkey::VARCHAR AS uid, CASE WHEN o_orderkey % 4 = 0 THEN -1 WHEN o_orderkey % 4 = 1 THEN 0 ELSE o_orderkey % 6 // 2 + 1 END::INT AS n FROM orders")
def judged_frames(spark, d):
    rows = P.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), "o_orderkey")
    frames = F.when(F.col("o_orderkey") % 4 == 1, F.lit([]).cast("array<int>")).otherwise(F.sequence(F.lit(0), (F.col("o_orderkey") % 6).cast("int")))
    judged = rows.where("o_orderkey % 4 > 0").select("uid", frames.alias("frames"), F.lit(None).cast("double").alias("fps"))
    out = tables.judged_frames(rows, judged, 1.0)
    return out.select("uid", F.when(F.col("frames").isNotNull(), F.size("frames")).otherwise(-1).alias("n"))


@query("SELECT c_nationkey AS video_id, place, n FROM (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) - 1 AS place, count(*) AS n FROM customer GROUP BY c_nationkey) WHERE place >= 3 AND place < 15".replace("AS place,", "::INT AS place,").replace("- 1 ::INT", "- 1"))
def video_ids(spark, d):
    items = P.table(spark, d, "customer").select(F.col("c_nationkey").alias("video_id"), F.col("c_custkey").alias("uid"))
    return tables.video_ids(items, 3, 20, 12).select("video_id", F.col("place").cast("long").alias("place"), F.size("uids").cast("long").alias("n"))


@query("SELECT count(*) AS n_clips, sum(p_size)::DOUBLE AS seconds FROM (SELECT DISTINCT ON (p_brand) p_brand, p_size FROM part ORDER BY p_brand, p_partkey)")
def distinct_clip_seconds(spark, d):
    rows = P.table(spark, d, "part").select(F.col("p_brand").alias("uid"), F.col("p_partkey").alias("ordinal"), F.lit(0.0).alias("start"), F.col("p_size").cast("double").alias("end"))
    return tables.distinct_clip_seconds(rows)


@query("SELECT p_partkey AS box, dense_rank() OVER (ORDER BY p_type) - 1 AS label FROM part")
def merge_class_texts(spark, d):
    rows = P.table(spark, d, "part").select(F.col("p_partkey").alias("box"), F.col("p_type").alias("text"))
    return tables.merge_class_texts(rows).select("box", F.col("label").cast("long").alias("label"))


@query("WITH b AS (SELECT * FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 100 >= 32 AND o_orderkey % 7 > 0 AND l_linenumber < 7), f AS (SELECT l_returnflag || l_linestatus AS name, min(l_orderkey * 10 + l_linenumber) AS first FROM b GROUP BY 1), ids AS (SELECT name, row_number() OVER (ORDER BY first, name) - 1 AS label FROM f) SELECT l_orderkey AS image_id, l_orderkey * 10 + l_linenumber AS ordinal, label FROM b JOIN ids ON name = l_returnflag || l_linestatus")
def grounding_boxes(spark, d):
    orders, items = P.table(spark, d, "orders"), P.table(spark, d, "lineitem")
    images = orders.select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 100).alias("width"), F.lit(100).alias("height"))
    boxes = items.select(F.col("l_orderkey").alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(5.0).alias("w"), F.lit(5.0).alias("h"), F.lit(25.0).alias("area"), (F.col("l_linenumber") >= 7).alias("ignore"), F.lit(None).cast("int").alias("iscrowd"))
    ignored = orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("image_id"))
    out = tables.grounding_boxes(images, boxes, 32, True, ignored)
    return out.select("image_id", "ordinal", F.col("label").cast("long").alias("label"))


def _annotation_files(spark, d):
    """Captions and spans from two tables, written as JSON files of images and annotations; returns their folder."""
    texts = P.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.concat(F.col("doc_id"), F.lit(".jpg")).alias("file_name"), F.col("text").alias("caption"), F.lit(80.0).alias("height"), (F.col("doc_id") % 70 + 20).cast("double").alias("width"))
    items = P.table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("image_id"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000).alias("id"), (F.col("l_partkey") % 97).cast("double").alias("x"), F.col("l_quantity").cast("double").alias("q"), (F.col("l_suppkey") % 6).cast("int").alias("a"), F.col("l_linenumber").cast("int").alias("n"))
    span = lambda a, b: F.array(a, b)
    spans = F.when(F.col("n") % 3 == 0, F.array(span(F.lit(0), F.col("a") + 1), span(F.col("a") + 3, F.col("a") + 5))).otherwise(F.array(span(F.col("a"), F.col("a") + F.col("n"))))
    boxes = items.select("image_id", "id", F.array("x", F.lit(5.0), F.col("q") % 9, F.col("q") % 7 + 1).alias("bbox"), (F.col("q") - 3).alias("area"), (F.col("n") % 5 == 0).cast("int").alias("iscrowd"), (F.col("n") == 7).alias("ignore"), spans.alias("tokens_positive"))
    path = scratch.new_path(spark, "annotations")
    phrases.write_annotations(texts, boxes, path, ["image_id", "id"])
    return path


@query("""WITH i AS (SELECT doc_id AS image_id, text AS caption, 80.0 AS height, doc_id % 70 + 20 AS width FROM documents WHERE text IS NOT NULL),
a AS (SELECT l_orderkey % 1000 AS image_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS id, l_partkey % 97 AS x, l_quantity % 9 AS w, l_quantity % 7 + 1 AS h, l_quantity - 3 AS area, l_linenumber % 5 = 0 AS iscrowd, l_linenumber = 7 AS ignore, l_suppkey % 6 AS s, l_linenumber AS n FROM lineitem),
p AS (SELECT a.*, i.width, i.height, CASE WHEN n % 3 = 0 THEN substring(caption, 1, s + 1) || ' ' || substring(caption, s + 4, 2) ELSE substring(caption, s + 1, n) END AS phrase FROM a JOIN i USING (image_id)),
l AS (SELECT image_id, phrase, row_number() OVER (PARTITION BY image_id ORDER BY min(id)) - 1 AS label FROM p GROUP BY image_id, phrase)
SELECT p.image_id, p.phrase, label::INT AS label, x::DOUBLE AS x1, (x + w)::DOUBLE AS x2, (5 + h)::DOUBLE AS y2, iscrowd, count(*) AS n FROM p JOIN l ON l.image_id = p.image_id AND l.phrase = p.phrase
WHERE NOT ignore AND area > 0 AND w >= 1 AND h >= 1 AND least(x + w, width) - greatest(x, 0) > 0 AND least(5 + h, height) - 5 > 0 GROUP BY ALL""")
def phrase_boxes(spark, d):
    """Annotation files: phrases cut out of whole captions, labels by first appearance."""
    boxes, _ = phrases.phrase_boxes(*phrases.read_annotations(spark, _annotation_files(spark, d)))
    return boxes.groupBy("image_id", "phrase", "label", "x1", "x2", "y2", "iscrowd").agg(F.count("*").alias("n"))


_LEVELS = [(8, 10, 8), (4, 5, 16), (2, 3, 32)]
_BASES = [[(10.0, 13.0), (16.0, 30.0)], [(30.0, 61.0), (62.0, 45.0)], [(116.0, 90.0), (156.0, 198.0)]]
_PRIORS = "g AS (SELECT *, row_number() OVER (ORDER BY level, r, cl, base) - 1 AS prior FROM (SELECT level, r, cl, base, stride, (cl + 0.5) * stride AS px, (r + 0.5) * stride AS py, CASE WHEN base = 0 THEN w0 ELSE w1 END AS bw, CASE WHEN base = 0 THEN h0 ELSE h1 END AS bh FROM (SELECT level, stride, w0, h0, w1, h1, unnest(generate_series(0, height - 1)) AS r, width FROM (VALUES (0, 8, 10, 8, 10, 13, 16, 30), (1, 4, 5, 16, 30, 61, 62, 45), (2, 2, 3, 32, 116, 90, 156, 198)) AS t(level, height, width, stride, w0, h0, w1, h1)), LATERAL (SELECT unnest(generate_series(0, width - 1)) AS cl), (SELECT unnest([0, 1]) AS base)))"
_HEAD = "h AS (SELECT l_orderkey * 10 + l_linenumber AS box_id, l_partkey % 212 AS prior, (l_quantity - 25) / 10.0::DOUBLE AS a, (l_suppkey % 9 - 4) / 3.0::DOUBLE AS b, l_discount * 10 AS c, l_tax * 10 AS d FROM lineitem)"


def _head(spark, d):
    return P.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"), (F.col("l_partkey") % 212).alias("prior"), ((F.col("l_quantity") - 25) / 10.0).alias("a"), ((F.col("l_suppkey") % 9 - 4) / 3.0).alias("b"), (F.col("l_discount") * 10).alias("c"), (F.col("l_tax") * 10).alias("d"))


def _decoded(spark, d, name, bases=None):
    out = priors.decoded(_head(spark, d), priors.prior_grid(spark, _LEVELS, bases=bases or [[(1.0, 1.0)] * 2] * 3), name, ["a", "b", "c", "d"])
    return out.select("box_id", *(F.round(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")))


_ROUNDED = "round(cx - w / 2, 5) AS x1, round(cy - h / 2, 5) AS y1, round(cx + w / 2, 5) AS x2, round(cy + h / 2, 5) AS y2"


@query(f"WITH {_PRIORS}, {_HEAD}, s AS (SELECT box_id, (1 / (1 + exp(-a)) - 0.5) * 2 * stride + px AS cx, (1 / (1 + exp(-b)) - 0.5) * 2 * stride + py AS cy, pow(2 / (1 + exp(-c)), 2) * bw AS w, pow(2 / (1 + exp(-d)), 2) * bh AS h FROM h JOIN g USING (prior)) SELECT box_id, {_ROUNDED} FROM s")
def decode_anchors(spark, d):
    return _decoded(spark, d, "anchor", _BASES)


@query(f"WITH {_PRIORS}, {_HEAD} SELECT box_id, round(px - a * stride, 5) AS x1, round(py - b * stride, 5) AS y1, round(px + c * stride, 5) AS x2, round(py + d * stride, 5) AS y2 FROM h JOIN g USING (prior)")
def decode_distances(spark, d):
    return _decoded(spark, d, "distances")


@query(f"WITH {_PRIORS}, {_HEAD}, s AS (SELECT box_id, a * stride + px AS cx, b * stride + py AS cy, exp(c) * stride AS w, exp(d) * stride AS h FROM h JOIN g USING (prior)) SELECT box_id, {_ROUNDED} FROM s")
def decode_offsets(spark, d):
    return _decoded(spark, d, "offsets")


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders), b AS (SELECT o_orderkey, n // 16 AS batch, n % 16 AS place FROM o), l AS (SELECT batch, place, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY batch ORDER BY place, l_linenumber) - 1 AS at_ FROM lineitem JOIN b ON o_orderkey = l_orderkey),
k AS (SELECT b.batch, b.place, count(l_orderkey) AS k FROM b LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), e AS (SELECT batch, place, k, sum(k) OVER (PARTITION BY batch ORDER BY place) - k AS start FROM k)
SELECT e.batch, e.place::INT AS place, start::INT AS start, k::INT AS n_boxes, min(at_)::INT AS first_at FROM e LEFT JOIN l ON l.batch = e.batch AND l.place = e.place GROUP BY ALL""")
def collated(spark, d):
    """Orders in batches of 16, their lines end to end: where each order's lines begin."""
    samples = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderkey").alias("ordinal"))
    lines = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("box_id"))
    whole, flat = collate.collate(samples, lines, 16)
    starts = whole.select("batch", F.posexplode("keys").alias("place", "key"), "offsets").select("batch", "place", F.get("offsets", F.col("place")).alias("start"), (F.get("offsets", F.col("place") + 1) - F.get("offsets", F.col("place"))).alias("n_boxes"))
    return starts.join(flat.groupBy("batch", "place").agg(F.min("at").alias("first_at")), ["batch", "place"], "left")


def _choices(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = P.table(spark, d, "documents").where("text is not null").select("doc_id", lines.alias("l"), "lang", "source")
    return rows.where("size(l) > 2").select("doc_id", F.col("doc_id").cast("string").alias("video_id"), F.concat("doc_id", F.lit(".mp4")).alias("video_path"), F.col("l")[0].alias("question"), F.slice("l", 2, 3).alias("candidates"), (F.col("doc_id") % 6).cast("int").alias("correct_choice"), F.concat("lang", F.when(F.col("doc_id") % 5 == 0, "T").otherwise("S")).alias("question_category"), F.col("source").alias("duration_group"), F.lit(None).cast("array<int>").alias("position"))


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l, lang FROM documents WHERE text IS NOT NULL)
SELECT doc_id::VARCHAR AS video_id, 'v/' || doc_id || '.mp4' AS video_path, l[1] AS question, 'A) ' || l[2] || chr(10) || 'B) ' || l[3] || CASE WHEN len(l) > 3 THEN chr(10) || 'C) ' || l[4] ELSE '' END AS options, chr(65 + (doc_id % 6)::INT) AS answer FROM l WHERE len(l) > 2 AND doc_id % 5 > 0 AND doc_id % 6 < 5""")
def choice_questions(spark, d):
    """Questions with candidates made of whole lines; categories with a T and answers without a letter go."""
    return adapters.from_choices(_choices(spark, d), "v/").select("video_id", "video_path", "question", "options", "answer")
