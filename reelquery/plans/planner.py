"""Planner replies: JSON plans out of free text, availability of tools, and rewards over plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

QUERIES = "array<struct<tool:string,query:string,id:string>>"
#: Where a reply's JSON may stand.
_FENCED, _BARE = r"(?s)```(?:json)?\s*(.*?)\s*```", r"(?s)\{.*\}"


def json_part(reply: Column) -> Column:
    """The first fenced block, else the widest braces, else null."""
    return F.nullif(F.when(F.regexp_like(reply, F.lit(_FENCED)), F.regexp_extract(reply, _FENCED, 1)).otherwise(F.regexp_extract(reply, _BARE, 0)), F.lit(""))


def _data(reply: Column) -> Column:
    """The JSON value of a reply as a variant; null unless the whole part is one value."""
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), json_part(reply), F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(alone) == 1, F.get(alone, F.lit(0)))


def _emitted(reply: Column) -> Column:
    """The elements of ``queries``, whatever they are; null where there is no list."""
    return F.try_variant_get(_data(reply), "$.queries", "array<variant>")


def parse_plan(reply: Column) -> Column:
    """struct(queries, combine): elements that aren't objects with tool, query and id are dropped one by one; no queries
    and '' if nothing can be read."""
    has = lambda q, k: F.try_variant_get(q, f"$.{k}", "variant").isNotNull()
    text = lambda q, k: F.try_variant_get(q, f"$.{k}", "string").alias(k)
    good = F.filter(_emitted(reply), lambda q: has(q, "tool") & has(q, "query") & has(q, "id"))
    queries = F.transform(good, lambda q: F.struct(text(q, "tool"), text(q, "query"), text(q, "id")))
    return F.struct(F.coalesce(queries, F.lit([]).cast(QUERIES)).alias("queries"), F.coalesce(F.try_variant_get(_data(reply), "$.combine", "string"), F.lit("")).alias("combine"))


def raw_query_count(reply: Column) -> Column:
    """How many queries the reply emitted, dropped ones included."""
    return F.coalesce(F.size(_emitted(reply)), F.lit(0))


def is_malformed(reply: Column) -> Column:
    """Some emitted query was dropped."""
    return (raw_query_count(reply) > 0) & (F.size(parse_plan(reply)["queries"]) < raw_query_count(reply))


def available(queries: Column, tools: Column) -> Column:
    """Queries whose tool is available."""
    return F.filter(queries, lambda q: F.array_contains(tools, q["tool"]))


def combine_ids(expression: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(expression, F.lit(r"\bQ\d+\b"), F.lit(0)))


def consistency(reply: Column) -> Column:
    """-1 for an unreadable plan or a dropped query, 0 for unknown ids in the expression, else 1."""
    plan = parse_plan(reply)
    unknown = F.array_except(combine_ids(plan["combine"]), F.transform(plan["queries"], lambda q: q["id"]))
    return F.when((F.size(plan["queries"]) == 0) | is_malformed(reply), -1.0).when(F.size(unknown) > 0, 0.0).otherwise(1.0)


def frames_in_truth(inside: Column, start: Column, end: Column, most: int, gap: float) -> Column:
    """Share of the frames that could lie in the interval under the gap that do; gaps of 0 or less count as 10 s."""
    g = gap if gap > 0 else 10.0
    possible = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.greatest(F.lit(0.0), end - start) / g).cast("int") + 1))
    return F.when(start.isNull() | end.isNull(), 0.0).otherwise(F.least(F.lit(1.0), inside / possible))


def message_text(messages: Column) -> Column:
    """The texts of a list of (type, text) parts, one per line."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["type"] == "text"), lambda m: m["text"]), "\n")


def completion_text(rows: DataFrame, column: str, out: str = "text") -> DataFrame:
    """Adds the text of a completion: a plain text as it is, a list of parts as their texts, one per line.

    ``column`` is a string, an array of struct (type, text), or a string that holds such a list as JSON.
    """
    kind = rows.schema[column].dataType
    if not isinstance(kind, StringType):
        return rows.withColumn(out, message_text(F.col(column)))
    parts = F.from_json(column, "array<struct<type:string,text:string>>")
    return rows.withColumn(out, F.when(F.startswith(F.ltrim(column), F.lit("[")) & parts.isNotNull() & F.coalesce(F.forall(parts, lambda p: p["type"].isNotNull()), F.lit(False)), message_text(parts)).otherwise(F.col(column)))


def rate_label(fps: Column) -> Column:
    """A frame rate as text, without a fraction if it is whole."""
    return F.when(fps == F.floor(fps), fps.cast("long").cast("string")).otherwise(fps.cast("string"))


def fill(template: Column, **values: Column) -> Column:
    """A prompt template with {name} placeholders."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


#: A planner's prompt; it names the tools of ``tools`` only.
PLANNER_TEMPLATE = (
    "Video length: {duration}\nQuestion: {question}\nOptions:\n{options}\n\nTools: {tools}\n\n"
    'Name what has to be seen to answer. Reply with JSON: {"queries": [{"tool": ..., "query": ..., "id": "Q1"}, ...], '
    '"combine": "Q1 AND (Q2 OR Q3)"}; combine uses AND, OR and brackets over the ids.'
)


def planner_prompt(question: Column, options: Column, tools: Column, seconds: Column, template: str = PLANNER_TEMPLATE, fps: Column | None = None) -> Column:
    """The prompt of the planner, options in the given order, the length as ``12.0s``, the rate (if the template has it) as ``2``."""
    from ..functions.text import format_options, seconds_label

    text = fill(F.lit(template), fps=rate_label(fps)) if fps is not None else F.lit(template)
    return fill(text, duration=seconds_label(seconds), tools=F.array_join(tools, ", "), options=format_options(options), question=question)


def plan(items: DataFrame, prompt: str, model, tools: list[str]) -> DataFrame:
    """uid, reply, queries, combine: each distinct prompt is asked once, and queries of missing tools are dropped."""
    from .. import models

    read = parse_plan(F.col("reply"))
    asked = models.ask_once(items, prompt, "reply", model).withColumn("plan", read)
    return asked.select("uid", "reply", available(F.col("plan.queries"), F.array(*(F.lit(t) for t in tools))).alias("queries"), F.col("plan.combine").alias("combine"))
