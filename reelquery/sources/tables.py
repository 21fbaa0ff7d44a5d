"""Reading: question files, feature and text caches, judged frames, earlier results, annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import item_uid, options_of_list
from ..functions.times import CACHE_FPS, rescale_frames
from ..operators.rank import numbered
from ..operators.temporal import holding

ITEM = "uid string, question_id string, video_id string, question string, options map<string,string>, answer string, start string, end string"
TRAINING_ITEM = "uid string, question_id string, video_id string, question string, options map<string,string>, choices array<string>, answer string, start string, end string, clip_start double, clip_end double"


def read_items(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, schema: str = ITEM) -> DataFrame:
    """A JSON list of items with ``ordinal``, its place in the file; the slice [start, end) of places."""
    raw = spark.read.option("wholetext", True).text(path)
    return _slice(raw.select(F.posexplode(F.from_json("value", f"array<struct<{_fields(schema)}>>")).alias("ordinal", "i")).select("ordinal", "i.*"), start, end).withColumn("uid", item_uid(F.col("uid"), F.col("question_id")))


def read_training_items(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The same from a list or a list under data, items, questions or train; choices become options, clips bounds."""
    raw = spark.read.option("wholetext", True).text(path)
    kind = f"array<struct<{_fields(TRAINING_ITEM)}>>"
    boxed = F.from_json("value", f"struct<data:{kind},items:{kind},questions:{kind},train:{kind}>")
    rows = F.coalesce(F.from_json("value", kind), *(boxed[k] for k in ("data", "items", "questions", "train")))
    rows = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", kind)).otherwise(F.coalesce(*(boxed[k] for k in ("data", "items", "questions", "train"))))
    out = _slice(raw.select(F.posexplode(rows).alias("ordinal", "i")).select("ordinal", "i.*"), start, end)
    return out.withColumn("options", F.coalesce("options", F.when(F.size("choices") > 0, options_of_list(F.col("choices"))))).withColumn("uid", item_uid(F.col("uid"), F.col("question_id")))


def _fields(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def _slice(rows: DataFrame, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col("ordinal") >= start)
    return rows.where(F.col("ordinal") < end) if end is not None else rows


def bind_caches(items: DataFrame, frames: DataFrame | None, text: DataFrame | None, regions: DataFrame | None) -> DataFrame:
    """Items with num_frames (features, else text, else regions, else 0) and fps (of the text cache, else 2)."""
    out = items
    for name, cache in (("n_feat", frames), ("n_text", text), ("n_reg", regions)):
        if cache is None:
            out = out.withColumn(name, F.lit(None).cast("int"))
        else:
            cols = ["video_id", F.col("num_frames").alias(name), *([F.col("fps")] if name == "n_text" and "fps" in cache.columns else [])]
            out = out.join(cache.select(*cols), "video_id", "left")
    fps = F.coalesce("fps", F.lit(CACHE_FPS)) if "fps" in out.columns else F.lit(CACHE_FPS)
    return out.withColumns({"num_frames": F.coalesce("n_feat", "n_text", "n_reg", F.lit(0)), "fps": fps}).drop("n_feat", "n_text", "n_reg")


def judged_frames(items: DataFrame, judged: DataFrame, current_fps: float | None = None) -> DataFrame:
    """uid, frames (null: never judged; empty: judged, none found), moved to the current rate if one is given."""
    rows = items.select("uid").join(judged.select("uid", "frames", F.col("fps").alias("cached_fps")), "uid", "left")
    frames = rescale_frames(F.col("frames"), F.col("cached_fps"), F.lit(float(current_fps))) if current_fps is not None else F.col("frames")
    return rows.select("uid", frames.alias("frames"))


def prior_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Earlier results, or none if the path can't be read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def video_ids(items: DataFrame, start: int | None = None, end: int | None = None, most: int | None = None) -> DataFrame:
    """video_id, place, uids: distinct videos in order, the slice [start, end) of them, at most ``most``."""
    rows = items.groupBy("video_id").agg(F.array_sort(F.collect_list("uid")).alias("uids"))
    rows = numbered(rows, ["video_id"], "place")
    low = start or 0
    rows = rows.where(F.col("place") >= low)
    high = min(x for x in (end, low + most if most else None, 1 << 40) if x is not None)
    return rows.where(F.col("place") < high)


def zip_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """A struct of arrays as rows."""
    return table.select(F.inline(F.arrays_zip(*columns)))


def letters_for_answers(rows: DataFrame, skip_containing: str | None = None) -> DataFrame:
    """Index answers as letters; categories that hold a given letter are dropped; rows with missing fields too."""
    out = rows.dropna(subset=["video_id", "question", "answer"])
    if skip_containing:
        out = out.where(~F.contains("category", F.lit(skip_containing)))
    return out.withColumn("answer", F.char(65 + F.col("answer").cast("int")))


def interleave(frames: DataFrame, subtitles: DataFrame, key: str = "video_id") -> DataFrame:
    """key, at, kind, value: frames and the subtitles that strictly hold a frame time, merged by time, subtitles by middle."""
    shown = holding(frames.select(key, "t"), subtitles, [key], 30.0, strict=True).select(key, "start", "end", "text").distinct()
    a = frames.select(key, F.col("t").cast("double").alias("at"), F.lit(0).alias("kind"), F.col("frame_idx").cast("string").alias("value"))
    return a.union(shown.select(key, ((F.col("start") + F.col("end")) / 2).alias("at"), F.lit(1), "text"))


def files_by_key(spark: SparkSession, path: str, depth: int = 2) -> DataFrame:
    """Files of a nested folder with their last folders as keys k1.. and a frame number where the name has one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    keys = [F.element_at(parts, -(i + 2)).alias(f"k{depth - i}") for i in range(depth)]
    number = F.regexp_extract(F.element_at(parts, -1), r"frame_(\d+)", 1)
    return files.select("path", "length", *keys[::-1], F.when(number != "", number.cast("int")).alias("frame_idx"))


def distinct_clip_seconds(rows: DataFrame) -> DataFrame:
    """n_clips and total seconds, each uid once (its first row by ordinal)."""
    w = Window.partitionBy("uid").orderBy("ordinal")
    first = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return first.agg(F.count("*").alias("n_clips"), F.sum(F.col("end") - F.col("start")).alias("seconds"))


def clips_to_cut(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct clips per video, bounds to the millisecond, without those done."""
    return rows.dropDuplicates(["video_id", "clip_uid"]).withColumns({"start": F.round("start", 3), "end": F.round("end", 3)}).join(done.select("clip_uid"), "clip_uid", "left_anti")


def grounding_boxes(images: DataFrame, boxes: DataFrame, least_side: int = 32, drop_empty: bool = True, ignored: DataFrame | None = None) -> DataFrame:
    """Image annotations: boxes (x, y, w, h) inside large enough images as corners with label ids by first appearance.

    Boxes to ignore, off the image, without area or thinner than a pixel go; ``ignored`` (image_id) drops whole images.
    """
    if ignored is not None:
        images = images.join(ignored, "image_id", "left_anti")
    big = images.where(F.least("width", "height") >= least_side)
    joined = big.join(boxes, "image_id", "inner" if drop_empty else "left")
    w = F.greatest(F.lit(0), F.least(F.col("x") + F.col("w"), F.col("width")) - F.greatest(F.col("x"), F.lit(0)))
    h = F.greatest(F.lit(0), F.least(F.col("y") + F.col("h"), F.col("height")) - F.greatest(F.col("y"), F.lit(0)))
    good = joined.where(~F.coalesce("ignore", F.lit(False)) & (w * h > 0) & (F.col("area") > 0) & (F.col("w") >= 1) & (F.col("h") >= 1))
    first = good.groupBy("name").agg(F.min("ordinal").alias("first"))
    ids = numbered(first, ["first", "name"], "label").select("name", "label")
    return good.join(ids, "name").select("image_id", "ordinal", "name", "label", "x", "y", (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"))


def merge_class_texts(boxes: DataFrame) -> DataFrame:
    """Boxes of several images with one label space: equal class texts share an id."""
    names = numbered(boxes.select("text").distinct(), ["text"], "label")
    return boxes.join(names, "text")


def join_by_question(predictions: DataFrame, items: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Predictions with the columns of the item of the same question text; of equal questions the last item by ordinal counts."""
    w = Window.partitionBy("question").orderBy(F.col(ordinal).desc())
    last = items.where(F.col("question").isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", ordinal)
    return predictions.join(last, "question")


def union_runs(runs: list[DataFrame], key: str = "uid") -> DataFrame:
    """Several runs as one, each key once: the first run that has it counts, and its first row by ``ordinal``."""
    if not runs:
        raise ValueError("no runs")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.withColumn("run", F.lit(k)) for k, r in enumerate(runs)])
    w = Window.partitionBy(key).orderBy("run", "ordinal")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def sample_texts(texts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n negative class texts per image, by a seeded hash (a sampling operator)."""
    w = Window.partitionBy("image_id").orderBy(F.xxhash64("image_id", "text", F.lit(seed)), "text")
    return texts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
