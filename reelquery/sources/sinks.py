"""Writing: results, caches that are never written twice, summaries and manifests."""

from __future__ import annotations

import json
import platform
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def not_done(items: DataFrame, done: DataFrame, key: str = "uid") -> DataFrame:
    """Items whose key has no result yet."""
    return items.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def write_bucketed(rows: DataFrame, name: str, path: str, by: str = "video_id", order: str = "frame_idx", buckets: int = 64) -> DataFrame:
    """A cache as a table bucketed by ``by`` and sorted by ``order``, and what the table then holds.

    Joins of two such tables of as many buckets, and groups and windows by ``by``, need no exchange.  Rows are dealt to
    their buckets before they are written, so a bucket is one file.  A video that the table has is not written again.
    """
    spark = rows.sparkSession
    if spark.catalog.tableExists(name):
        rows = not_done(rows, spark.table(name), by)
    dealt = rows.repartition(buckets, by)
    dealt.write.bucketBy(buckets, by).sortBy(order).option("path", path).mode("append").format("parquet").saveAsTable(name)
    return spark.table(name)


def write_cache(rows: DataFrame, path: str, key: str = "video_id") -> DataFrame:
    """Append the rows whose key isn't in the table yet; returns what is there now.  A retry writes nothing twice."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        rows = not_done(rows, spark.read.parquet(path), key)
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_in_parts(items: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, every: int, key: str = "uid") -> DataFrame:
    """Run ``work`` (rows with ``key`` in and out) over the items in parts of about ``every``, each written when it is done.

    Parts are dealt by the key's hash and their number is kept with the results, so a run that is started again skips the
    parts that are there and does the others, and one that is cut off loses a part at most.  Returns all results.
    """
    spark = items.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    there = lambda p: fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs.Path(p))
    if there(f"{path}/parts/_SUCCESS"):
        parts = spark.read.parquet(f"{path}/parts").first()["n"]
    else:
        parts = max(1, -(-items.count() // every))
        spark.range(1).select(F.lit(parts).alias("n")).write.mode("overwrite").parquet(f"{path}/parts")
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts))
    for k in range(parts):
        if not there(f"{path}/results/part={k}/_SUCCESS"):
            work(items.where(part == k)).write.mode("overwrite").parquet(f"{path}/results/part={k}")
    return spark.read.option("basePath", f"{path}/results").parquet(*(f"{path}/results/part={k}" for k in range(parts))).drop("part")


def write_results(rows: DataFrame, path: str, form: str = "parquet") -> None:
    rows.write.mode("append").format(form).save(path)


def summary(rows: DataFrame) -> DataFrame:
    """One row: total, correct, accuracy."""
    from ..operators.metrics import accuracy

    return accuracy(rows)


def manifest(spark: SparkSession, config: dict) -> DataFrame:
    """One row: sha256 of the configuration, its JSON, versions."""
    text = json.dumps(config, sort_keys=True)
    return spark.range(1).select(F.sha2(F.lit(text), 256).alias("config_sha256"), F.lit(text).alias("config"), F.lit(spark.version).alias("spark"), F.lit(platform.python_version()).alias("python"))


def keyframes(items: DataFrame, picks: DataFrame, fps: float = 2.0) -> DataFrame:
    """The output contract that all selectors share (``picks``: uid, picks)."""
    return items.join(picks, "uid").select("uid", "video_id", "question", "options", F.col("answer").alias("ground_truth"), F.array_sort("picks").alias("frames_used")).withColumn("timestamps_used", F.transform("frames_used", lambda i: i / F.lit(fps)))


def completion_log(steps: DataFrame) -> DataFrame:
    """One row per (step, place) from parallel lists of completions, rewards and advantages; short lists give nulls."""
    return steps.select("step", F.posexplode(F.arrays_zip("completions", "rewards", "advantages")).alias("place", "r")).select("step", "place", "r.*")


def write_grid(records: DataFrame, truth: DataFrame, path: str, margin: float = 0.0) -> DataFrame:
    """Append the retrieval records (uid, method, k, times) that aren't under ``path`` yet, one folder per method and k,
    and return the hit table over all records there.  A run that is started again goes on where the last one stopped.
    """
    from ..operators.metrics import hit_grid

    spark = records.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        records = records.join(spark.read.schema(records.schema).parquet(path).select("uid", "method", "k"), ["uid", "method", "k"], "left_anti")
    records.write.mode("append").partitionBy("method", "k").parquet(path)
    return hit_grid(spark.read.schema(records.schema).parquet(path), truth, margin=margin)
