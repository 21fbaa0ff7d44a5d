"""Question sets of three layouts as one table: video_id, video_path, question, options, answer, frames, position, groups.

Rows without a video, a question or options are dropped, as are rows whose answer has no letter where one is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"


def _lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def _whole(rows: DataFrame, options: Column, root: str, path: Column | None = None, **more: Column) -> DataFrame:
    complete = (F.coalesce("video_id", F.lit("")) != "") & (F.coalesce("question", F.lit("")) != "") & (F.coalesce(options, F.lit("")) != "")
    where = F.concat(F.lit(root.rstrip("/") + "/"), path if path is not None else F.concat("video_id", F.lit(".mp4")))
    return rows.where(complete).select("video_id", where.alias("video_path"), "question", options.alias("options"), *(c.alias(k) for k, c in more.items()))


def from_columns(table: DataFrame, root: str) -> DataFrame:
    """One row of parallel arrays (video_id, question, answer, options, frame_indexes); options are maps by letter, in key order."""
    rows = table.select(F.inline(F.arrays_zip("video_id", "question", "answer", "options", "frame_indexes")))
    listed = F.transform(F.array_sort(F.map_keys("options")), lambda k: F.concat(k, F.lit(") "), F.coalesce(F.try_element_at("options", k), F.lit(""))))
    return _whole(rows, _lines(listed), root, answer=F.col("answer"), gt_frame_index=F.col("frame_indexes"), position=F.lit([]).cast("array<int>"))


def from_lettered(rows: DataFrame, root: str) -> DataFrame:
    """Rows whose options are texts like ``A. red``: a letter, two characters, the option (``duration`` is the group)."""
    listed = F.transform("options", lambda o: F.concat(F.substring(o, 1, 1), F.lit(") "), F.substring(o, 4, 1 << 30)))
    none = F.lit([]).cast("array<int>")
    return _whole(rows, _lines(listed), root, answer=F.coalesce("answer", F.lit("")), gt_frame_index=F.coalesce("frame_indexes", none), duration_group=F.col("duration"), position=F.coalesce("position", none))


def from_choices(rows: DataFrame, root: str, without: str | None = "T") -> DataFrame:
    """Rows with a list of candidates and the place of the right one, which becomes a letter of A to E.

    Categories that contain ``without`` are left out (None: none are); ``video_path`` is the file's name.
    """
    if without is not None:
        rows = rows.where(~F.contains("question_category", F.lit(without)))
    letter = lambda i: F.get(F.array(*(F.lit(c) for c in LETTERS)), i.cast("int"))
    rows = rows.where(letter(F.col("correct_choice")).isNotNull())
    listed = F.transform("candidates", lambda c, i: F.concat(letter(i), F.lit(") "), c))
    return _whole(rows, _lines(listed), root, F.col("video_path"), answer=letter(F.col("correct_choice")), question_category=F.col("question_category"), duration_group=F.col("duration_group"), position=F.coalesce("position", F.lit([]).cast("array<int>")))


def model_inputs(questions: DataFrame, frames: DataFrame, subtitles: DataFrame, most: int) -> DataFrame:
    """The columns of ``questions`` with ``inputs``, what a model is shown in order: frames, subtitles, or both interleaved.

    ``most`` frames of the video on an even grid with the subtitles among them; 0: nothing; -1: all subtitles alone.
    ``frames``: video_id, frame_idx, t; ``subtitles``: video_id, ordinal, start, end, text.
    """
    from ..operators.sampling import uniform
    from ..operators.temporal import interleave

    if most == 0:
        return questions.withColumn("inputs", F.lit([]).cast("array<string>"))
    if most < 0:
        listed = subtitles.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]).alias("__i"))
    else:
        asked = frames.join(questions.select("video_id").distinct(), "video_id", "left_semi")
        grid = asked.groupBy("video_id").agg(F.count("*").cast("int").alias("n")).select("video_id", F.explode(uniform(F.col("n"), most)).alias("frame_idx"))
        rows = interleave(asked.join(grid, ["video_id", "frame_idx"], "left_semi"), subtitles)
        listed = rows.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind", "value"))), lambda s: F.when(s["kind"] == 0, F.concat(F.lit("frame "), s["value"])).otherwise(s["value"])).alias("__i"))
    return questions.join(listed, "video_id", "left").withColumn("inputs", F.coalesce("__i", F.lit([]).cast("array<string>"))).drop("__i")


def questions_by_video(rows: DataFrame, long_from: float = 600.0) -> tuple[DataFrame, DataFrame]:
    """(short, long) videos with parallel lists of their questions in the given order (``ordinal``); the first one's duration decides."""
    fields = ["question", "candidates", "position", "correct_choice", "duration"]
    listed = rows.groupBy(F.col("video_path").alias("video_name")).agg(F.array_sort(F.collect_list(F.struct("ordinal", *fields))).alias("q"))
    of = lambda c: F.transform("q", lambda x: x[c])
    out = listed.select("video_name", *(of(c).alias(c + "s") for c in fields))
    return out.where(F.col("durations")[0] <= long_from), out.where(F.col("durations")[0] > long_from)


def clips_by_video(rows: DataFrame) -> DataFrame:
    """video_name, questions, clips: queries of clips with the last interval found, relative to the clip's start; rows without a query go."""
    last = F.transform(F.element_at("trajectory", -1), lambda t: t - F.col("clip_start"))
    given = rows.where("query is not null and size(trajectory) > 0").select(F.concat("clip_uid", F.lit(".mp4")).alias("video_name"), F.struct("ordinal", "query", last.alias("clip")).alias("x"))
    listed = given.groupBy("video_name").agg(F.array_sort(F.collect_list("x")).alias("q"))
    return listed.select("video_name", F.transform("q", lambda x: x["query"]).alias("questions"), F.transform("q", lambda x: x["clip"]).alias("clips"))


def snapshots_by_video(questions: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of ``questions`` (video, n_questions) with frames and answers of each question, from its folder's files.

    ``files``: video, question (its place), name, text.  Frame numbers come out of names like ``frame_12.jpg``, in the
    order of names; the first text file is the answer; the lists of frames are sorted, as they are compared as sets.
    """
    number = F.regexp_extract("name", r"_(\d+)\.", 1).cast("int")
    per = files.groupBy("video", "question").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.endswith("name", F.lit(".jpg")), F.struct("name", number.alias("n"))))), lambda x: x["n"]).alias("f"),
        F.min(F.when(F.endswith("name", F.lit(".txt")), F.struct("name", F.regexp_replace("text", r"^\s+|\s+$", "").alias("t"))))["t"].alias("a"),
    )
    listed = per.groupBy("video").agg(F.array_sort(F.collect_list("f")).alias("frames"), F.transform(F.array_sort(F.collect_list(F.struct("question", "a"))), lambda x: x["a"]).alias("answers"))
    return questions.join(listed, "video", "left")
