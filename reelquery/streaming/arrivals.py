"""Questions that arrive as files: each key is evaluated once, and a micro-batch that is retried replaces what it wrote.

The keys that were seen are state of the stream, kept with its checkpoint, so a micro-batch costs what it holds and not
what was ever written.  Each micro-batch is a folder named by its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def evaluate_arrivals(spark: SparkSession, source: str, schema: str, evaluate: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, key: str = "uid", once: bool = True) -> StreamingQuery:
    """Run ``evaluate`` (a batch function, rows with ``key`` in and out) over the JSON files of a folder as they arrive.

    ``results`` is a Parquet folder (by ``batch``) that holds each key once; of a key that arrives several times the first
    arrival counts.  With ``once`` the query ends when it has caught up, else it keeps watching.  ``checkpoint`` and ``results``
    have to lie in storage that driver and executors share.
    """

    def write(batch: DataFrame, number: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{results}/batch={number}")

    lines = spark.readStream.schema(schema).json(source).dropDuplicates([key])
    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
