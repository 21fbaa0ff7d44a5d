"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = spark.conf.get("spark.reelquery.scratch", None)
    if not made:
        made = "file://" + tempfile.mkdtemp(prefix="reelquery-")
        spark.conf.set("spark.reelquery.scratch", made)
    return made


def _remove_all() -> None:
    for spark, path in _made:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone already
            return


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, deleted when the application ends."""
    if not _made:
        atexit.register(_remove_all)
    path = f"{shared_dir(spark)}/reelquery/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written and read back: computed once, whatever its plan leaves open, and safe from lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
