"""The combine language and its evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from reelquery.plans import combine as pc
from reelquery.plans.language import Leaf, Op, leaves, parse, postfix, simplify, tokens


@pytest.mark.parametrize(
    "text, tree",
    [
        ("Q1 OR Q2 AND Q3", "(Q1 OR (Q2 AND Q3))"),
        ("(Q1 AND Q2) OR Q3", "((Q1 AND Q2) OR Q3)"),
        ("q1 and Q2 or Q3", "((q1 AND Q2) OR Q3)"),
        ("Q1 AND Q2 AND Q3", "((Q1 AND Q2) AND Q3)"),
        ("(Q1 OR Q2", "(Q1 OR Q2)"),
        ("Q1 Q2 AND", "Q1"),
        (")", ")"),
        ("Q1AND", "Q1AND"),
        ("((Q1))", "Q1"),
    ],
)
def test_grammar(text, tree):
    assert str(parse(text)) == tree


@pytest.mark.parametrize("text", ["", "  ", "Q1 AND", "(", "Q1 OR ("])
def test_missing_operand(text):
    with pytest.raises(ValueError):
        parse(text)


def test_tree_helpers():
    node = parse("Q1 AND (Q2 OR Q2)")
    assert tokens(" (a)b ") == ["(", "a", ")", "b"]
    assert leaves(node) == ["Q1", "Q2", "Q2"] and postfix(node) == ["Q1", "Q2", "Q2", "\0OR", "\0AND"]
    assert simplify(node) == Op("AND", Leaf("Q1"), Leaf("Q2")) and simplify(parse("A OR A")) == Leaf("A")


def scores(spark, maps):
    rows = [(v, q, f, s) for v, by in maps.items() for q, m in by.items() for f, s in m.items()]
    return spark.createDataFrame(rows, "uid string, qid string, frame_idx int, pct double")


def value(node, maps):
    if isinstance(node, Leaf):
        return dict(maps.get(node.query_id, {}))
    a, b = value(node.left, maps), value(node.right, maps)
    return {f: (min if node.name == "AND" else max)(a.get(f, 0.0), b.get(f, 0.0)) for f in {*a, *b}}


def by_hand(text, maps):
    any_ = {}
    for m in maps.values():
        for f, s in m.items():
            any_[f] = max(s, any_.get(f, s))
    if len(maps) == 1:
        return any_
    try:
        return value(parse(text), maps)
    except ValueError:
        return any_


@pytest.mark.parametrize("text", ["Q1 AND Q2", "Q1 OR Q2", "Q1 AND (Q2 OR Q3)", "Q9", "Q1 AND Q9", "", "Q1 OR"])
def test_expression_matches_hand_evaluation(spark, text):
    maps = {"Q1": {0: 0.9, 1: 0.1, 2: 0.5}, "Q2": {0: 0.2, 1: 0.8, 3: 0.6}, "Q3": {2: 0.4, 4: 1.0}}
    got = pc.combine(scores(spark, {"u": maps}), text, ["uid"])
    assert {r.frame_idx: r.score for r in got.collect()} == by_hand(text, maps)


def test_plans_by_row(spark):
    rnd = random.Random(1)
    texts = ["Q1 AND Q2", "Q1 OR Q2 AND Q3", "(Q1 OR Q2) AND Q3", "", "Q1 AND", "Q7", "q1 AND Q2", "((Q1 or Q3", "Q2 Q1", "Q3 AND (Q1 OR (Q2 AND Q4))", None]
    given, expected = {}, {}
    for i in range(40):
        maps = {q: {f: round(rnd.random(), 2) for f in rnd.sample(range(12), rnd.randint(1, 9))} for q in rnd.sample(["Q1", "Q2", "Q3", "Q4"], rnd.randint(1, 4))}
        given[str(i)] = maps
        expected[str(i)] = by_hand(texts[i % len(texts)] or "", maps)
    plans = spark.createDataFrame([(str(i), texts[i % len(texts)]) for i in range(40)], "uid string, combine string")
    got = {}
    for r in pc.combine_plans(scores(spark, given), plans).collect():
        got.setdefault(r.uid, {})[r.frame_idx] = r.score
    assert got == {k: v for k, v in expected.items() if v}


def test_bounds_and_commutativity(spark):
    maps = {"Q1": {f: f / 10 for f in range(10)}, "Q2": {f: 1 - f / 9 for f in range(10)}}
    run = lambda t: {r.frame_idx: r.score for r in pc.combine(scores(spark, {"u": maps}), t, ["uid"]).collect()}
    both, any_ = run("Q1 AND Q2"), run("Q1 OR Q2")
    assert both == run("Q2 AND Q1") and any_ == run("Q2 OR Q1")
    assert all(both[f] <= maps["Q1"][f] <= any_[f] for f in range(10))
    assert run("Q1 AND (Q2 OR Q1)").keys() == both.keys()


def test_plan_replies(spark):
    from reelquery.plans import planner

    good = '{"queries": [{"tool": "image", "query": "a", "id": "Q1"}], "combine": "Q1"}'
    rows = [("x\n```json\n" + good + "\n```", 1, "Q1", 1.0), ("so " + good + " ok", 1, "Q1", 1.0), ("nothing", 0, "", -1.0), ("{broken", 0, "", -1.0), ('{"queries": [{"tool": "t", "id": "Q1"}, {"tool": "t", "query": "q", "id": "Q2"}], "combine": "Q2"}', 1, "Q2", -1.0), (good.replace('"combine": "Q1"', '"combine": "Q1 AND Q4"'), 1, "Q1 AND Q4", 0.0)]
    df = spark.createDataFrame([(r[0],) for r in rows], "reply string")
    got = df.select("reply", F.size(planner.parse_plan(F.col("reply"))["queries"]).alias("n"), planner.parse_plan(F.col("reply"))["combine"].alias("c"), planner.consistency(F.col("reply")).alias("r")).collect()
    assert [(g.reply, g.n, g.c, g.r) for g in got] == rows
