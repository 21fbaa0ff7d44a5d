"""Caption annotations: images with captions, boxes whose phrases are character spans of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_IMAGE = "struct<id:bigint,file_name:string,caption:string,height:double,width:double>"
_ANNOTATION = "struct<id:bigint,image_id:bigint,bbox:array<double>,area:double,iscrowd:int,ignore:boolean,tokens_positive:array<array<int>>,segmentation:array<array<double>>>"


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of the JSON files under a path, each one object with both lists; ``ordinal``: place in its list.

    A file is read whole by one task, so write large sets as many files (``write_annotations``).  A missing list gives no
    rows.  ``info.first`` of a file is the ordinal of its first annotation (missing: 0).
    """
    raw = spark.read.option("wholetext", True).text(path)
    parsed = lambda fields: raw.select(F.from_json("value", f"struct<{fields}>").alias("v"))
    images = parsed(f"images:array<{_IMAGE}>").select(F.posexplode("v.images").alias("ordinal", "i")).select("ordinal", F.col("i.id").alias("image_id"), "i.file_name", "i.caption", "i.height", "i.width")
    lists = parsed(f"info:struct<first:bigint>,annotations:array<{_ANNOTATION}>").select(F.coalesce("v.info.first", F.lit(0).cast("long")).alias("start"), F.col("v.annotations").alias("list"))
    marks = lists.select("start", F.posexplode("list").alias("place", "a"))
    boxes = marks.select((F.col("start") + F.col("place")).alias("ordinal"), "a.image_id", "a.bbox", "a.area", (F.coalesce("a.iscrowd", F.lit(0)) != 0).alias("iscrowd"), F.coalesce("a.ignore", F.lit(False)).alias("ignore"), F.col("a.tokens_positive").alias("spans"), "a.segmentation")
    return images, boxes


def _listed(name: str, most: int, size: int):
    """A function for mapInArrow: JSON objects as text, in files of at most ``most`` rows that end at about ``size`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rows, held = TaskContext.get().partitionId() << 33, [], 0
        file = lambda: pa.RecordBatch.from_pydict({"value": [f'{{"info":{{"first":{first}}},"{name}":[{",".join(rows)}]}}']})
        for batch in batches:
            for row in batch.column(0).to_pylist():
                rows.append(row)
                held += len(row)
                if len(rows) == most or held >= size:
                    yield file()
                    first, rows, held = first + len(rows), [], 0
        if rows:
            yield file()

    return run


def write_annotations(images: DataFrame, annotations: DataFrame, path: str, order: list[str], most: int = 20_000, size: int = 4 << 20) -> None:
    """Write JSON files for ``read_annotations``, each of at most ``most`` annotations or images and about ``size`` characters.

    ``order``: columns in whose order annotations are listed.  It holds over all files, as each says where it begins, so
    an image with any number of annotations is in as many files as it takes.
    """
    by = [*order, *(c for c in annotations.columns if c not in order)]  # all columns: a task that runs again lists rows the same way
    for name, rows in (("images", images), ("annotations", annotations.repartitionByRange(*by).sortWithinPartitions(*by))):
        files = rows.select(F.to_json(F.struct(*rows.columns))).mapInArrow(_listed(name, most, size), "value string")
        files.write.mode("append").option("maxRecordsPerFile", 1).text(path)


def phrase(caption, spans):
    """The spans (start, end in characters, end exclusive) of a caption, joined by blanks; a span past the end is cut."""
    return F.array_join(F.transform(spans, lambda s: F.substring(caption, s[0] + 1, F.greatest(F.lit(0), s[1] - s[0]))), " ")


def phrase_boxes(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes: image_id, ordinal, phrase, label, x1, y1, x2, y2, iscrowd; texts: image_id, phrases by label).

    Labels count an image's phrases in the order in which its annotations first name them, from 0, whatever becomes of the
    boxes.  Boxes to ignore, off the image, without area or thinner than a pixel go.  Annotations without an image go too.
    """
    marks = annotations.withColumn("spans", F.coalesce("spans", F.lit([]).cast("array<array<int>>")))
    # captions meet each list of spans once, not each box
    cut = marks.groupBy("image_id", "spans").agg(F.min("ordinal").alias("first")).join(images.select("image_id", "caption", "width", "height"), "image_id")
    named = cut.select("image_id", "spans", "first", "width", "height", phrase(F.col("caption"), F.col("spans")).alias("phrase"))
    first = named.groupBy("image_id", "phrase").agg(F.min("first").alias("first"))
    labels = first.withColumn("label", F.row_number().over(Window.partitionBy("image_id").orderBy("first")) - 1)
    known = named.drop("first").join(labels.drop("first"), ["image_id", "phrase"])
    x, y, w, h = (F.get("bbox", k) for k in range(4))
    inner = lambda at, size, most: F.greatest(F.lit(0.0), F.least(at + size, most) - F.greatest(at, F.lit(0.0)))
    good = marks.join(known, ["image_id", "spans"]).where(~F.col("ignore") & (inner(x, w, F.col("width")) * inner(y, h, F.col("height")) > 0) & (F.col("area") > 0) & (w >= 1) & (h >= 1))
    boxes = good.select("image_id", "ordinal", "phrase", "label", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), "iscrowd")
    texts = labels.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "phrase"))), lambda s: s["phrase"]).alias("phrases"))
    return boxes, texts


def remap(boxes: DataFrame, classes: DataFrame, unknown: int | None = None) -> DataFrame:
    """Boxes with the label of their phrase in a list of classes (phrase, class_id); others get ``unknown``, or go if that is None."""
    joined = boxes.drop("label").join(classes.select("phrase", F.col("class_id").alias("label")), "phrase", "inner" if unknown is None else "left")
    return joined if unknown is None else joined.withColumn("label", F.coalesce("label", F.lit(unknown)))
