"""Per-query scores to one score per frame: min/max rank algebra, compiled to Catalyst expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import Leaf, Node, parse, postfix


def score_column(node: Node, by_query: Column) -> tuple[Column, Column]:
    """(score, present) of a tree over a map column from query id to score; a side without the frame counts 0."""
    if isinstance(node, Leaf):
        found = F.try_element_at(by_query, F.lit(node.query_id))
        return F.coalesce(found, F.lit(0.0)), found.isNotNull()
    (a, pa), (b, pb) = score_column(node.left, by_query), score_column(node.right, by_query)
    return (F.least if node.name == "AND" else F.greatest)(a, b), pa | pb


def query_map(scores: DataFrame, keys: list[str], frame: str = "frame_idx", qid: str = "qid", score: str = "pct") -> DataFrame:
    """One row per frame with a map from query id to score: a pivot whose queries needn't be known."""
    return scores.groupBy(*keys, frame).agg(F.map_from_entries(F.collect_list(F.struct(qid, score))).alias("by_query"))


def combine(scores: DataFrame, expression: str, keys: list[str], frame: str = "frame_idx", qid: str = "qid", score: str = "pct") -> DataFrame:
    """Scores of one expression for all groups; a blank or broken expression is the OR of all queries."""
    try:
        node = parse(expression)
    except ValueError:
        return combine_any(scores, keys, frame, score)
    rows = query_map(scores, keys, frame, qid, score)
    value, present = score_column(node, F.col("by_query"))
    return rows.where(present).select(*keys, frame, value.alias("score"))


def combine_any(scores: DataFrame, keys: list[str], frame: str = "frame_idx", score: str = "pct") -> DataFrame:
    """OR over every query: the best score of each frame."""
    return scores.groupBy(*keys, frame).agg(F.max(score).alias("score"))


def _program(expression: Column) -> Column:
    """The postfix program of an expression, null where it doesn't parse."""

    def one(t: str | None) -> list[str] | None:
        try:
            return postfix(parse(t or ""))
        except ValueError:
            return None

    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(one)

    return run(expression)


def combine_plans(scores: DataFrame, plans: DataFrame, key: str = "uid", frame: str = "frame_idx", qid: str = "qid", score: str = "pct") -> DataFrame:
    """Each group by its own expression (``plans``: key, combine).

    A group with one scored query takes that query's scores, whatever the expression; a blank or broken expression is
    the OR of all.  Distinct expressions are parsed once, in Arrow batches; evaluation is a stack fold in the JVM, so
    neither the number of expressions nor of queries is bounded.
    """
    programs = plans.select("combine").distinct().withColumn("program", _program(F.col("combine")))
    program = plans.join(programs, plans["combine"].eqNullSafe(programs["combine"]), "left").select(plans[key].alias(key), "program")
    single = scores.groupBy(key).agg((F.min(qid) == F.max(qid)).alias("single"))
    rows = query_map(scores, [key], frame, qid, score).join(program.join(single, key), key)

    def push(stack: Column, word: Column) -> Column:
        n = F.size(stack)
        a, b = F.try_element_at(stack, F.lit(-2)), F.try_element_at(stack, F.lit(-1))
        found = F.try_element_at(F.col("by_query"), word)
        leaf = F.struct(F.coalesce(found, F.lit(0.0)).alias("v"), found.isNotNull().alias("p"))
        both = F.struct(F.when(word == "\0AND", F.least(a["v"], b["v"])).otherwise(F.greatest(a["v"], b["v"])).alias("v"), (a["p"] | b["p"]).alias("p"))
        return F.when(F.startswith(word, F.lit("\0")), F.concat(F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(both))).otherwise(F.concat(stack, F.array(leaf)))

    empty = F.lit([]).cast("array<struct<v:double,p:boolean>>")
    last = F.try_element_at(F.aggregate("program", empty, push), F.lit(-1))
    best = F.struct(F.array_max(F.map_values("by_query")).alias("v"), F.lit(True).alias("p"))
    result = F.when(F.col("single") | F.col("program").isNull(), best).otherwise(last)
    return rows.select(key, frame, result.alias("r")).where("r.p").select(key, frame, F.col("r.v").alias("score"))
