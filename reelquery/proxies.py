"""Views of the driver tables as videos: embeddings are frames, documents on-screen text, events times, lineitems boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id (the label), frame_idx (in order of vec_id), emb."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), (F.row_number().over(w) - 1).alias("frame_idx"), F.col("embedding").cast("array<double>").alias("emb"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, qid, q: the first embeddings of labels 0, 1 and 2, asked of every video."""
    given = table(spark, sf_dir, "embeddings")
    first = given.where("label in (0, 1, 2)").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    vectors = first.select(F.concat(F.lit("Q"), (F.col("label") + 1).cast("string")).alias("qid"), F.col("q").cast("array<double>").alias("q"))
    calls = given.select(F.col("label").alias("video_id")).distinct().withColumn("qid", F.explode(F.array(F.lit("Q1"), F.lit("Q2"), F.lit("Q3"))))
    return calls.join(vectors, "qid").select("video_id", "qid", "q")


def screen_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id (the document), frame_idx (ten per line), txt."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("pos", "txt"))
    return lines.select("video_id", (F.col("pos") * 10).alias("frame_idx"), "txt")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, start_s, end_s: from a user's first to last purchase in hours."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("uid"), F.floor(F.unix_timestamp("ts") / 3600).cast("double").alias("h"))
    return e.groupBy("uid").agg(F.min("h").alias("start_s"), (F.min("h") + 24).alias("end_s"))


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, t: a user's clicks in hours."""
    return table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").cast("string").alias("uid"), F.floor(F.unix_timestamp("ts") / 3600).cast("double").alias("t"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, label, box_id, corners, score from line items."""
    x, y = F.col("l_partkey") % 37, F.col("l_suppkey") % 29
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("image_id"), (F.col("l_linenumber") % 3).alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 10 + F.col("l_quantity") % 11).alias("x2"), (y + 10 + F.col("l_quantity") % 7).alias("y2"), F.round((F.col("l_extendedprice") % 1000) / 1000, 5).alias("score"))


#: The same views for the oracle, as common table expressions.
SQL = {
    "frames": "frames AS (SELECT label AS video_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS frame_idx, embedding::DOUBLE[] AS emb FROM embeddings)",
    "q": "q AS (SELECT 'Q' || (label + 1) AS qid, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings WHERE label IN (0, 1, 2) GROUP BY label)",
    "scores": "scores AS (SELECT qid, video_id, frame_idx, round(list_cosine_similarity(emb, q), 6) AS score FROM frames CROSS JOIN q)",
    "one": "one AS (SELECT video_id, frame_idx, score FROM scores WHERE qid = 'Q1')",
    "pct": "pct AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN 1.0::DOUBLE ELSE (row_number() OVER (PARTITION BY qid, video_id ORDER BY score, frame_idx) - 1)::DOUBLE / (count(*) OVER w - 1) END AS pct FROM scores WINDOW w AS (PARTITION BY qid, video_id))",
    "ranks": "ranks AS (SELECT video_id, frame_idx, max(pct) FILTER (qid = 'Q1') AS q1, max(pct) FILTER (qid = 'Q2') AS q2, max(pct) FILTER (qid = 'Q3') AS q3 FROM pct GROUP BY ALL)",
    "merged": "merged AS (SELECT video_id, frame_idx, least(q1, greatest(q2, q3)) AS score FROM ranks)",
    "ocr": "ocr AS (SELECT doc_id AS video_id, (unnest(generate_series(0, len(l) - 1)) * 10)::INT AS frame_idx, unnest(l) AS txt FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    "truth": "truth AS (SELECT user_id::VARCHAR AS uid, min(floor(epoch(ts) / 3600)) AS start_s, min(floor(epoch(ts) / 3600)) + 24 AS end_s FROM events WHERE event_type = 'purchase' GROUP BY 1)",
    "picks": "picks AS (SELECT user_id::VARCHAR AS uid, floor(epoch(ts) / 3600) AS t FROM events WHERE event_type = 'click')",
    "boxes": "boxes AS (SELECT l_orderkey % 500 AS image_id, l_linenumber % 3 AS label, l_orderkey * 10 + l_linenumber AS box_id, (l_partkey % 37)::DOUBLE AS x1, (l_suppkey % 29)::DOUBLE AS y1, l_partkey % 37 + 10 + l_quantity % 11 AS x2, l_suppkey % 29 + 10 + l_quantity % 7 AS y2, round((l_extendedprice % 1000) / 1000, 5) AS score FROM lineitem)",
}


def with_views(*names: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(SQL[n] for n in names)} {body}"
