"""What one pass over texts finds equals what each term, pattern and fact finds by itself, and no plan compares all with all."""

import random

import pytest
from pyspark.sql import functions as F

from turnweave.functions.text import form, form_hit, tight_ordered_hit
from turnweave.operators import patterns, values
from turnweave.operators.matching import element_terms
from turnweave.operators.term_index import Term, TermIndex, mark_terms
from turnweave.plans import graph as gr
from turnweave.plans.catalogue import compile_rules

LETTERS = "甲乙丙丁戊己的了会可以就不能1点 "


def text_of(rng, most=14):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, most)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_marks_are_the_hits_of_each_term(spark):
    rng = random.Random(2)
    terms = [text_of(rng, 8) for _ in range(120)] + ["甲乙丙丁戊己", "丁戊甲乙丙己己", "就", "的甲"]
    rules = [{"id": f"r{i}", "type": "node_positive", "groups": [{"elements": [{"value": t, "main": True}]}]} for i, t in enumerate(terms) if t.strip()]
    rows = element_terms(compile_rules(spark, rules).elements)
    texts = spark.createDataFrame([(i, text_of(rng, 30)) for i in range(200)] + [(200, "甲" + "x" * 10 + "乙丙丁戊己"), (201, None)], "id int, text string")
    prepared = texts.select("id", form("text").alias("form"))
    listed = rows.collect()
    found = mark_terms(prepared, [Term(r.t.tight, r.t.rest, tuple(r.t.chars), r.t.exact, r.in_order) for r in listed], ordered=True)
    got = {(r.id, listed[m].element_id, listed[m].t.tight) for r in found.collect() for m in r.marks}
    said = form_hit(F.col("t"), F.col("form")) | (F.col("in_order") & tight_ordered_hit(F.col("t.tight"), F.col("form.tight")))
    want = {(r.id, r.element_id, r.tight) for r in prepared.crossJoin(rows).where(said).select("id", "element_id", F.col("t.tight").alias("tight")).collect()}
    assert got == want and len(want) > 100


def test_an_index_of_nothing():
    assert TermIndex([]).marks("甲", "甲") == [] and TermIndex([Term("", "", (), True)]).marks("甲", "") == []


WORDS = ["ab", "B", "c", "abc", "x", "é"]


def pattern_of(rng):
    some = lambda most: [rng.choice(WORDS) for _ in range(rng.randint(0, most))]
    raw = {"any": some(3), "all": some(2), "none": some(1), "speaker": rng.choice(["", "user", "assistant"]), "min_any_hits": rng.randint(1, 2)}
    if rng.random() < 0.3:
        raw["regex_any"] = [rng.choice(["a.c", "^x", "B$"])]
    return gr.pattern(raw)


def test_patterns_together_and_one_by_one(spark):
    rng = random.Random(3)
    turns = spark.createDataFrame([("d%d" % (i % 7), i, rng.choice(["user", "assistant"]), "".join(rng.choice(["ab", "b", "C", "x", " ", "É"]) for _ in range(rng.randint(0, 6)))) for i in range(80)], "dialogue_id string, turn_index int, speaker string, text string")
    listed = [(f"p{i}", p) for i, p in enumerate(pattern_of(rng) for _ in range(40)) if p and patterns.indexable(p)]
    got = {(r.dialogue_id, r.turn_index, r.pattern_id) for r in patterns.indexed_turns(turns, listed).collect()}
    want = {(r.dialogue_id, r.turn_index, name) for name, p in listed for r in patterns.pattern_turns(turns, p).collect()}
    assert got == want and len(listed) > 20 and want


def test_a_thousand_patterns_are_one_plan(spark):
    turns = spark.createDataFrame([("d", 0, "user", "词77 和 词78")], "dialogue_id string, turn_index int, speaker string, text string")
    found = patterns.indexed_turns(turns, [(f"p{i}", gr.pattern({"any": [f"词{i}x"], "all": ["和"]})) for i in range(1000)])
    assert found.count() == 0
    found = patterns.indexed_turns(turns, [(f"p{i}", gr.pattern({"any": [f"词{i} "], "all": ["和"]})) for i in range(1000)])
    assert {r.pattern_id for r in found.collect()} == {"p7", "p77", "p78"}
    plan = plan_of(found)
    assert "Union" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


FACTS = [
    {"id": "days", "selector_groups": [{"elements": [{"value": "标准协议", "main": True}]}], "correct_groups": [{"elements": [{"value": "标准协议", "main": True}, {"value": "10天", "fact": True}]}], "value_check": {"expected_value": "10天", "unit": "天"}},
    {"id": "free", "correct_groups": [{"elements": [{"value": "5单", "fact": True}]}], "value_check": {"expected_value": "5单", "unit": "单"}},
    {"id": "goes_on", "selector_groups": [{"elements": [{"value": "取消方式", "main": True}, {"value": "入口", "main": False}]}], "correct_groups": [{"elements": [{"value": "取消方式", "main": True}, {"value": "3天", "fact": True}]}], "value_check": {"expected_value": "3天", "unit": "天", "allow_continuation": True}},
]


def test_facts_meet_the_spans_that_speak_of_them(spark):
    graph = gr.compile_graph(spark, {"nodes": [{"id": "n"}], "knowledge_table": FACTS})
    said = ["标准协议是10天", "标准的8天", "标准协议8天", "5单", "是7单", "取消方式要5天", "入口在3天后", "入口4天", "无关", "标准", "次日"]
    spans = spark.createDataFrame([("d", i, 1, t) for i, t in enumerate(said)], "dialogue_id string, turn_index int, seq int, text string")
    every = spans.crossJoin(graph.values.select("fact_id"))
    want = sorted(map(tuple, values.value_results(every, graph.values).collect()))
    found = values.value_results(spans, graph.values)
    assert sorted(map(tuple, found.collect())) == want and want
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


@pytest.mark.parametrize("expected, text", [("价格较高", "外卖价格更低"), ("适合您", "这个不适合您"), ("已生效", "协议未生效"), ("价格较高", "别的更低")])
def test_directions_meet_their_words(spark, expected, text):
    from turnweave.operators.judges import direction_conflict

    facts = spark.createDataFrame([("f", ["外卖价格"], [expected])], "fact_id string, subjects array<string>, expected array<string>")
    spans = spark.createDataFrame([("d", 0, 1, text)], "dialogue_id string, turn_index int, seq int, text string")
    turned = spans.crossJoin(facts).where(direction_conflict(F.col("text"), F.col("subjects"), F.col("expected")).isNotNull()).count()
    met = values.spans_of_facts(spans, values.direction_words(facts)).count()
    assert met >= turned


def test_tags_are_worked_out_only_where_an_element_is_one(spark, monkeypatch):
    from turnweave.operators import atoms as spans
    from turnweave.operators import matching
    from turnweave.plans.catalogue import compile_rules

    made = []
    monkeypatch.setattr(matching, "tags", lambda *a: made.append(1) or spans.tags(*a))
    rows = spans.atoms(spark.createDataFrame([("d", 1, "user", "the cat?"), ("d", 2, "assistant", "a dog")], "dialogue_id string, turn_index int, speaker string, text string"))
    element = lambda value, kind: {"value": value, "main": True, "type": kind}
    hits = lambda *own: {(r.rule_id, r.turn_index) for r in matching.element_hits(rows, compile_rules(spark, [{"id": f"r{i}", "type": "node_positive", "groups": [{"elements": [x]}]} for i, x in enumerate(own)]).elements).collect()}
    assert hits(element("cat", "surface")) == {("r0", 1)} and not made
    assert hits(element("cat", "surface"), element("question", "form"), element("Assistant", "speaker_role")) == {("r0", 1), ("r1", 1), ("r2", 2)} and made
