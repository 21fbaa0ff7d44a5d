"""Work that may fail: a value or an error for each row, a time limit for each item, and errors that a resumed run reads."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

Work = Callable[[dict[str, Any]], Any]
#: Most characters of an error that are kept, its last ones.
ERROR_CHARS = 500


def _answer(work: Work, row: dict[str, Any]) -> tuple[Any, str | None]:
    try:
        return work(row), None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"[-ERROR_CHARS:]


def _limited(work: Work, row: dict[str, Any], seconds: float) -> tuple[Any, str | None]:
    """The same in a process of its own, which is ended after ``seconds``, whatever it does."""
    fork = multiprocessing.get_context("fork")
    ours, theirs = fork.Pipe(duplex=False)
    child = fork.Process(target=lambda: theirs.send(_answer(work, row)), daemon=True)
    child.start()
    theirs.close()
    try:
        return ours.recv() if ours.poll(seconds) else (None, f"Timeout (>{seconds:g}s)")
    except EOFError:  # it died without an answer
        return None, "the work's process ended without an answer"
    finally:
        child.kill()
        child.join()
        ours.close()


def attempt(rows: DataFrame, work: Work, value: str, key: str = "uid", seconds: float | None = None) -> DataFrame:
    """key, value, error of every row: what ``work`` returns for it (of type ``value``, as DDL), or its error, never both.

    ``seconds`` limits each item; then every item runs in a process of its own.  A value that doesn't fit the type is that
    row's error too.  The row's columns are given as a dictionary.
    """
    out = StructType.fromDDL(f"value {value}")["value"].dataType
    kind, own = to_arrow_type(out), rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for row in batch.to_pylist():
                got, error = _answer(work, row) if seconds is None else _limited(work, row, seconds)
                if error is None:
                    try:
                        pa.array([got], kind)
                    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError) as e:
                        got, error = None, f"{type(e).__name__}: {e}"[-ERROR_CHARS:]
                values.append(got)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array(values, kind), pa.array(errors, pa.string())], [key, "value", "error"])

    return rows.mapInArrow(run, f"`{key}` {own}, value {out.simpleString()}, error string")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def left_to_do(items: DataFrame, path: str, key: str = "uid", most: int | None = None, but: str | None = None) -> DataFrame:
    """Items without a value under ``path``; those that failed come again, unless they did ``most`` times already.

    What the run ``but`` wrote doesn't count.
    """
    other = lambda t: t if t is None or but is None else t.where(F.col("run").cast("string") != but)
    spark = items.sparkSession
    done, failed = other(_table(spark, f"{path}/values")), other(_table(spark, f"{path}/errors"))
    if done is not None:
        items = items.join(done.select(key).distinct(), key, "left_anti")
    if failed is not None and most is not None:
        items = items.join(failed.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= most).select(key), key, "left_anti")
    return items


def run_attempts(items: DataFrame, work: Work, value: str, path: str, run: str, key: str = "uid", seconds: float | None = None, most: int | None = None) -> None:
    """Work on what is left and add values and errors under ``path``; ``run`` names this run's files.

    Every item is tried once: the answers are written before they are told apart.  A run that is repeated under its name
    works on the same items again and replaces what it wrote, so nothing is lost or there twice.
    """
    spark = items.sparkSession
    left_to_do(items, path, key, most, run).transform(lambda d: attempt(d, work, value, key, seconds)).write.mode("overwrite").parquet(f"{path}/tried/{run}")
    tried = spark.read.parquet(f"{path}/tried/{run}")
    for name, part in (("values", tried.where("error is null").drop("error")), ("errors", tried.where("error is not null").drop("value"))):
        part.write.mode("overwrite").parquet(f"{path}/{name}/run={run}")


def results(spark: SparkSession, path: str, key: str = "uid") -> DataFrame:
    """key, value, error: each item once, its value if any run has one, else its last error."""
    done, failed = _table(spark, f"{path}/values"), _table(spark, f"{path}/errors")
    if done is None or failed is None:
        raise ValueError("no run was written here")
    last = Window.partitionBy(key).orderBy(F.col("run").desc())
    errors = failed.join(done.select(key).distinct(), key, "left_anti").withColumn("rn", F.row_number().over(last)).where("rn = 1")
    return done.dropDuplicates([key]).select(key, "value", F.lit(None).cast("string").alias("error")).unionByName(errors.select(key, F.lit(None).cast(done.schema["value"].dataType).alias("value"), "error"))
