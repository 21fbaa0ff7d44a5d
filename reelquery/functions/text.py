"""Prompts, replies and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def item_uid(uid: Column, question_id: Column) -> Column:
    """The first non-empty of uid and question id, else the empty text."""
    return F.coalesce(F.nullif(uid, F.lit("")), F.nullif(question_id, F.lit("")), F.lit(""))


def options_of_text(text: Column) -> Column:
    """A map from lines such as ``A) foo`` or ``B. bar``."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*[A-Z][).:]\s*")))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*([A-Z])", 1), F.trim(F.regexp_extract(x, r"^\s*[A-Z][).:]\s*(.*)$", 1)))))


def options_of_list(values: Column) -> Column:
    """A list of choices by letter."""
    return F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.char(65 + i)), values)


def _sorted_entries(options: Column) -> Column:
    return F.array_sort(F.map_entries(options))


def format_options(options: Column, style: str = "colon") -> Column:
    """One option per line: ``  A: x`` in the given order, or ``A) x`` by key."""
    if style == "bracket":
        return F.array_join(F.transform(_sorted_entries(options), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")
    if style != "colon":
        raise ValueError(style)
    return F.array_join(F.transform(F.map_entries(options), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])), "\n")


def retrieval_query(question: Column, options: Column) -> Column:
    """The question and the option texts by key; without options a space still follows."""
    return F.concat_ws(" ", question, F.array_join(F.transform(_sorted_entries(options), lambda e: e["value"]), " "))


def seconds_label(t: Column) -> Column:
    return F.format_string("%.1fs", t.cast("double"))


def numbered(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v)), "\n")


def parse_answer(reply: Column, options: Column) -> Column:
    """The first option key, in the options' order, that stands as a word in the reply; else the reply's first character
    in upper case if it is a key; else null."""
    keys = F.map_keys(options)
    found = F.get(F.filter(keys, lambda k: F.regexp_like(reply, F.concat(F.lit(r"(?U)\b"), k, F.lit(r"\b")))), F.lit(0))
    first = F.upper(F.regexp_extract(reply, r"(?U)^\s*(\S)", 1))
    return F.coalesce(found, F.when(F.array_contains(keys, first), first))


def parse_confidence(reply: Column) -> Column:
    """The number from 0 to 5 after ``confidence``; null without one."""
    return F.nullif(F.regexp_extract(reply, r"(?i)confidence[:\s]*([0-5])", 1), F.lit("")).cast("int")


#: Prompts by name: with the option letters spelled out, and short.
ANSWER_TEMPLATES = {
    "letters": "Question: {question}\nOptions:\n{options}\n\nLook at the frames above. Reply with one letter out of {option_letters} and nothing else.",
    "short": "{question}\n{options}\nAnswer with the letter of the best option only.",
}


def answer_prompt(question: Column, options: Column, template: str = "letters", style: str = "bracket") -> Column:
    """The prompt of the answering model; ``template``: a name in ANSWER_TEMPLATES."""
    from ..plans.planner import fill

    letters = F.array_join(F.map_keys(options), ", ")
    return fill(F.lit(ANSWER_TEMPLATES[template]), option_letters=letters, options=format_options(options, style), question=question)


def keep_question(question: Column, task: Column | None = None, without: str = "subtitle", skip_tasks: tuple[str, ...] = ()) -> Column:
    """Whether a question stays: it doesn't hold a word (case counts), and its task isn't in a list."""
    keep = ~F.contains(question, F.lit(without)) if without else F.lit(True)
    if task is not None and skip_tasks:
        keep = keep & ~F.coalesce(task.isin(*skip_tasks), F.lit(False))
    return F.coalesce(keep, F.lit(False))


def judge_votes(reply: Column, n: Column) -> Column:
    """n booleans from lines ``<number>. YES|NO``; a number without a line is true, the last of several lines wins."""
    lines = F.regexp_extract_all(F.upper(reply), F.lit(r"(?m)^\s*(\d{1,9})\s*[.):-]\s*(?:YES|NO)"), F.lit(0))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("i"), F.endswith(x, F.lit("YES")).alias("v")))
    last = lambda i: F.element_at(F.concat(F.array(F.lit(True)), F.transform(F.filter(pairs, lambda p: p["i"] == i), lambda p: p["v"])), -1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), last)).otherwise(F.lit([]).cast("array<boolean>"))


def parse_grounding(reply: Column) -> Column:
    """struct(targets, cues, relations) from ``Key Objects:``, ``Cue Objects:`` and ``Rel:`` lines; (a; type; b) -> (a, b, type)."""
    names = lambda label: F.filter(F.transform(F.split(F.regexp_extract(reply, rf"(?m)^\s*{label}:\s*(.*)$", 1), ","), lambda t: F.trim(t)), lambda x: x != "")
    triples = F.regexp_extract_all(F.regexp_extract(reply, r"(?m)^\s*Rel:\s*(.*)$", 1), F.lit(r"\(([^;()]*;[^;()]*;[^;()]*)\)"), F.lit(1))
    part = lambda t, i: F.trim(F.get(F.split(t, ";"), F.lit(i)))
    return F.struct(names("Key Objects").alias("targets"), names("Cue Objects").alias("cues"), F.transform(triples, lambda t: F.struct(part(t, 0).alias("a"), part(t, 2).alias("b"), part(t, 1).alias("type"))).alias("relations"))


def letter_index(letter: Column) -> Column:
    return F.ascii(letter) - 65


def content_key(value: Column) -> Column:
    """md5 of a plan's JSON, the memo key of its evaluation."""
    return F.md5(F.to_json(value).cast("binary"))


def resize(height: Column, width: Column, factor: int = 28, least: int = 3136, most: int = 12845056) -> Column:
    """struct(h, w): multiples of ``factor`` near the size whose area lies in bounds; a side ratio over 200 is an error."""
    ratio = F.greatest(height, width) / F.least(height, width)
    h, w = (F.greatest(F.lit(factor), F.bround(x / factor).cast("int") * factor) for x in (height, width))
    big, small = F.sqrt(height * width / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (height * width))
    down = lambda x: F.greatest(F.lit(factor), (F.floor(x / big / factor) * factor).cast("int"))
    up = lambda x: (F.ceil(x * small / factor) * factor).cast("int")
    pick = lambda fit, x: F.when(h * w > most, down(x)).when(h * w < least, up(x)).otherwise(fit)
    return F.when(ratio > 200, F.raise_error("aspect ratio over 200")).otherwise(F.struct(pick(h, height).alias("h"), pick(w, width).alias("w")))
