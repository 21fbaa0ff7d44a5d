"""Model interfaces as Arrow batches, with deterministic stand-ins; weights and services are not part of the engine.

A text or image encoder is a function from a list of texts (or image bytes) to a 2-d array; a language model is a
function from a list of prompts to a list of replies.  Real ones are given by the caller and loaded once per worker.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Encoder = Callable[[Sequence], np.ndarray]
Model = Callable[[Sequence[str]], Sequence[str]]


def hashed_encoder(width: int = 64) -> Encoder:
    """Unit vectors seeded by each input's hash."""

    def encode(values: Sequence) -> np.ndarray:
        out = []
        for v in values:
            raw = v if isinstance(v, bytes) else str(v).encode()
            rng = np.random.RandomState(int.from_bytes(hashlib.sha256(raw).digest()[:4], "little"))
            out.append(rng.standard_normal(width))
        out = np.array(out).reshape(-1, width)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


#: Bounds of the Arrow batches that models get: prompts, texts and images can be long.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def _small_batches() -> None:
    """Lower the session's bounds of Arrow batches to ours, so that what a worker holds doesn't grow with its partition."""
    spark = SparkSession.active()
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= most:
            spark.conf.set(key, str(most))


def encode(column: Column, encoder: Encoder) -> Column:
    """Vectors of a column of texts or bytes."""
    _small_batches()

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(list(encoder(values.tolist()).astype(np.float32)), index=values.index)

    return run(column)


def region_text(column: Column, encoder: Encoder) -> Column:
    """The region tool's text vector: the second half of the encoding of ``photo of a ...``."""
    v = encode(F.concat(F.lit("photo of a "), column), encoder)
    return F.slice(v, (F.size(v) / 2).cast("int") + 1, F.size(v))


def with_retries(model: Model, tries: int = 5, base: float = 2.0, cap: float = 120.0) -> Model:
    """A model that waits and tries again: doubling pauses up to a cap, with a tenth of jitter."""

    def call(prompts: Sequence[str]) -> Sequence[str]:
        for k in range(tries):
            try:
                return model(prompts)
            except Exception:
                if k + 1 == tries:
                    raise
                time.sleep(min(cap, base * 2**k) * (1 + 0.1 * random.random()))
        return []

    return call


def ask(column: Column, model: Model) -> Column:
    """Replies to a column of prompts, a batch at a time."""
    _small_batches()

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(list(model(prompts.tolist())), index=prompts.index)

    return run(column)


def ask_or_none(column: Column, model: Model) -> Column:
    """Replies to prompts asked one by one; a call that raises has none."""
    _small_batches()

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            try:
                out.append(model([p])[0])
            except Exception:  # whatever a service raises, the call has no reply
                out.append(None)
        return pd.Series(out, index=prompts.index, dtype=object)

    return run(column)


def encode_regions(column: Column, encoder: Callable[[Sequence], Sequence[np.ndarray]]) -> Column:
    """Region vectors of each image (bytes): ``encoder`` gives an array (regions, width) per image; images may have none."""
    _small_batches()

    @F.pandas_udf("array<array<float>>")
    def run(images: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(r, np.float32).tolist() for r in encoder(images.tolist())], index=images.index, dtype=object)

    return run(column)


def ask_once(rows: DataFrame, prompt: str, reply: str, model: Model) -> DataFrame:
    """Adds replies, asking each distinct prompt once."""
    asked = rows.select(prompt).distinct().withColumn(reply, ask(F.col(prompt), model))
    return rows.join(asked, prompt, "left")


def _unit(encoder: Encoder) -> Encoder:
    """The encoder's vectors over their lengths."""
    def encode_unit(values: Sequence) -> np.ndarray:
        out = np.asarray(encoder(values), float)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode_unit


def class_prompts(classes: DataFrame, encoder: Encoder) -> DataFrame:
    """class_id, emb: the unit vector of each class's first caption (``classes``: class_id, captions); a class without one has none."""
    named = classes.where("size(captions) > 0").select("class_id", F.col("captions")[0].alias("caption"))
    vectors = named.select("caption").distinct().select("caption", encode(F.col("caption"), _unit(encoder)).alias("emb"))
    return named.join(vectors, "caption").select("class_id", "emb")


def image_prompts(images: DataFrame, vision: Encoder, text: Encoder) -> DataFrame:
    """place, class_id, emb: the unit vector of each class's image (class_id, image), and one of a blank text at the end that pads."""
    from .operators.rank import numbered

    one = numbered(images.select("class_id", "image"), ["class_id"], "place").select("class_id", encode(F.col("image"), _unit(vision)).alias("emb"), "place")
    pad = images.sparkSession.range(1).select(F.lit(None).cast(images.schema["class_id"].dataType).alias("class_id"), encode(F.lit(" "), _unit(text)).alias("emb"))
    return one.union(pad.crossJoin(images.agg(F.count("*").alias("place")))).select("place", "class_id", "emb")


def status(n_queries: Column, n_scores: Column, n_frames: Column, options: Column) -> Column:
    """How far a question came."""
    return F.when(n_queries == 0, "no_queries").when(n_scores == 0, "no_scores").when(n_frames == 0, "no_frames").when(F.coalesce(F.size(options), F.lit(0)) <= 0, "retrieval_only").otherwise("answered")
