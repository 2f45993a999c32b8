"""Graphs of JSON, and the evaluation of dialogues by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from turnweave.operators import diagnosis, patterns
from turnweave.plans import checks as ck
from turnweave.plans import graph as gr
from turnweave.plans.evaluate import evaluate
from turnweave.sources import packs
from turnweave.sources.dialogues import read_dialogues


def test_loose_shapes_become_groups():
    assert [e["value"] for g in gr.groups(["甲", {"value": "乙"}]) for e in g["elements"]] == ["甲", "乙"]
    made = gr.groups([{"element": "对象", "value": "相反", "pool": ["反"]}])
    assert [(e["value"], e["main"], e["fact"]) for e in made[0]["elements"]] == [("对象", True, False), ("相反", False, True)]
    assert gr.groups({"selector_groups": [{"elements": ["x"]}]})[0]["elements"][0]["value"] == "x"
    assert gr.groups(None) == gr.groups("text") == [] and gr.groups([{"elements": []}]) == []
    selector = gr.with_main(gr.groups([{"elements": ["协议"]}]))
    bound = gr.bound_facts(gr.groups([{"elements": [{"value": "十天", "fact": True, "main": True}]}]), selector)
    assert [(e["value"], e["main"]) for e in bound[0]["elements"]] == [("协议", True), ("十天", False)]
    assert all(not e["fact"] for g in gr.with_main(gr.groups([{"elements": [{"value": "x", "fact": True}]}]), facts=False) for e in g["elements"])


def test_sides_pools_and_speakers():
    wrong, correct = gr.groups(["甲"]), gr.groups(["甲", "乙"])
    assert gr.usable_wrong(wrong, correct, None) == [] and gr.usable_wrong(correct, wrong, None) == correct
    assert gr.usable_wrong(correct, wrong, {"expected_value": "10单"}) == [] and not gr.comparable_check({"expected": "说明"})
    role = [{"elements": [{"type": "speaker_role", "value": "用户", "main": False, "fact": False, "pool": []}]}]
    assert gr.requested_speaker(role, "assistant") == "user" and gr.requested_speaker([], "assistant") == "assistant"
    assert gr.union_pools({"a": ["x"]}, {"a": ["y", "x"], "b": ["z"]}) == {"a": ["x", "y"], "b": ["z"]}
    held = gr.with_pools(gr.groups([{"value": "费用"}]), {"surface:费用": ["价格"]})
    assert held[0]["elements"][0]["pool"] == ["价格"]


def test_patterns_as_they_are_executed():
    p = gr.pattern({"any": ["取消", "次日", "费用"]}, "assistant")
    made = gr.executable(p, "说明取消后次日生效", frozenset({"费用"}))
    assert made[0]["any"] == ["取消", "次日"] and made[0]["least"] == 2 and made[1]["window_union"] and len(made) == 2
    assert gr.executable(p, "核对身份")[-1]["cross_turn"] and gr.pattern({}) is None and gr.pattern("x")["any"] == ["x"]
    row = gr.constraint({"id": "c", "negative_object": {"surface_forms": ["保证收到"]}, "trigger_object": {"elements": ["在开车"]}}, "hard")
    assert row["negative"][0]["elements"][0]["main"] and row["trigger"][0]["elements"][0]["value"] == "在开车"


def test_tables_are_flattened_merged_and_capped():
    table = [{"id": "p", "severity": "high", "atoms": [{"id": "x"}, {"id": "y", "severity": "low"}]}, {"id": "z"}]
    assert [(r["id"], r.get("severity")) for r in gr.flattened(table)] == [("x", "high"), ("y", "low"), ("z", None)]
    many = [{"id": f"c{i}", "negative_groups": [{"elements": [f"话{i}"]}]} for i in range(25)] + [{"id": "c0"}]
    merged = gr.merged_constraints({"hard_constraint_table": many})
    assert len(merged) == 25 and merged[0]["negative"] and len(gr.same_meaning(merged, gr.HARD_MOST)) == 10
    assert gr.version({"a": 1, "b": 2}) == gr.version({"b": 2, "a": 1}) != gr.version({"a": 1})


def test_bad_graphs_are_refused_and_atoms_replace_requirements():
    for bad in ({"nodes": [{"name": "x"}]}, {"nodes": [{"id": "a"}], "edges": [{"source": "a", "target": "b"}]}, {"knowledge_table": [{"name": "k"}]}, {"hard_constraint_table": [{}]}):
        with pytest.raises(ValueError):
            gr.normalized(bad)
    made = gr.normalized({"nodes": [{"id": "a", "requirements": [{"id": "r"}], "atoms": [{"id": "t"}]}], "relation_groups": [{"nodes": ["a", "gone"]}]})
    assert [r["id"] for r in made.nodes[0]["requirements"]] == ["t"] and made.groups[0]["nodes"] == ["a"]


def test_lint_gates_and_repairs():
    graph = {"nodes": [{"id": "n", "activation": "odd"}, {"id": "f", "type": "main", "activation": {"mode": "condition", "trigger_groups": [{"elements": [{"value": "询问", "main": True}, {"value": "费用", "main": True}]}]}, "atoms": [{"id": "x", "text": "确认号码"}]}], "relation_groups": [{"id": "g", "type": "sequential", "required": True, "nodes": ["n", "f"]}]}
    assert gr.lint_counts(gr.lint(graph))["unknown_activation_mode"] == 1
    better, said = ck.tightened(graph)
    kinds = {k for k, _ in said}
    assert "main_node_in_required_sequence_forced_always" in kinds and "information_atom_accepts_user_provided_state" in kinds
    assert ck.tightened(better)[1] == [] and graph["nodes"][1]["activation"]["mode"] == "condition"
    assert gr.english_only({"name": "only english words"})[1] is False and gr.english_only({"name": "中文"})[1]
    assert gr.rule_coverage(gr.normalized(graph))[1] is False
    assert [k for k, _ in ck.scoring_issues({"nodes": [{"id": "q", "type": "faq", "atoms": [{"text": "价格多少"}, {"text": "如何开通"}, {"text": "几点上课"}]}]})] == ["faq_overpacked"]
    assert ck.repair_need({"nodes": []}, ["k9"]) == [("unknown_target", "k9")]


def test_legacy_shapes_deltas_and_differences():
    old = {"stages": [{"name": "开场", "requirements": ["问好"]}, {"name": "说明", "requirements": ["规则"]}], "knowledge": [{"id": "k", "facts": ["十天"]}]}
    new = gr.from_legacy(old)
    assert [n["id"] for n in new["nodes"]] == ["s0", "s1"] and gr.normalized(new).edges[0]["type"] == "strict_before" and gr.from_legacy(new) is new
    grown = gr.merged_elements(new, [{"atom_id": "s0.r0", "elements": [{"value": "问好", "pool": ["您好"]}, {"value": "称呼"}]}])
    made = gr.normalized(grown).nodes[0]["requirements"][0]["groups"]
    assert made[0]["elements"][0]["pool"] == ["您好"] and made[1]["elements"][0]["value"] == "称呼"
    assert gr.difference({"nodes": [{"id": "a", "name": "说明规则"}]}, {"nodes": [{"id": "b", "name": "规则说明"}]}) == [("node", "missing", "a", "b"), ("node", "extra", "b", "a")]
    assert [a[3] for a in gr.atoms_of(gr.normalized({"nodes": [{"id": "n", "requirements": [{} for _ in range(9)]}]}))] == [0] * 8 + [1]


def test_graph_files(spark, tmp_path):
    path = tmp_path / "graph.json"
    path.write_text(json.dumps({"nodes": [{"id": "a", "requirements": [{"element_groups": ["甲"]}]}]}), encoding="utf-8")
    graph = gr.compile_graph_file(spark, str(path), str(tmp_path / "out"))
    assert graph.requirements.first().requirement_id == "a.r0"
    folder = tmp_path / "out" / gr.version(gr.read_graph(str(path)))
    assert spark.read.parquet(str(folder / "elements")).first().value == "甲"
    path.write_text("[1]", encoding="utf-8")
    with pytest.raises(ValueError):
        gr.read_graph(str(path))


def test_packs(spark, tmp_path):
    for i, (domain, kind, text) in enumerate([("rider", "positive", "骑手配送订单"), ("rider", "negative", "骑手取消报名"), ("shop", "positive", "商家课程签约")]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": str(i), "domain": domain, "sample_type": kind, "turns": [{"role": "agent", "text": text}]}, ensure_ascii=False), encoding="utf-8")
    rows = read_dialogues(spark, str(tmp_path))
    ids = lambda df: sorted(r.dialogue_id for r in df.collect())
    assert ids(packs.selected(rows, "positive")) == ["0", "2"] and ids(packs.selected(rows, domain="rider", limit=1)) == ["0"]
    assert ids(packs.selected(rows, graph_text="骑手配送订单骑手取消")) == ["0", "1"] and ids(packs.selected(rows, domain="gone")) == ["0", "1", "2"]
    assert packs.pack_folder(str(tmp_path), "positive") == str(tmp_path)
    (tmp_path / "positive_pack").mkdir()
    assert packs.pack_folder(str(tmp_path), "positive").endswith("positive_pack")
    packs.write_run(spark, str(tmp_path / "run"), {"rows": rows.select("dialogue_id", "domain", "sample_type")}, {"graph": "g"})
    assert spark.read.parquet(str(tmp_path / "run/rows")).where("domain = 'shop'").count() == 1
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "run/manifest")).collect()))["graph"] == "g"
    packs.write_text(str(tmp_path / "x/note.txt"), "甲")
    assert packs.read_text(str(tmp_path / "x/note.txt")) == "甲"
    (tmp_path / "answers").mkdir()
    (tmp_path / "answers/01_x.json").write_text('[{"candidate_id": "c", "verdict": "hit", "confidence": 0.5}]')
    assert packs.replayed_answers(spark, str(tmp_path / "answers")).first().verdict == "hit"
    pages = spark.createDataFrame([("d1", "t<", ["a&b"])], "dialogue_id string, title string, lines array<string>")
    packs.case_pages(spark, pages, str(tmp_path / "pages"))
    assert "a&amp;b" in "".join(r.value for r in spark.read.text(str(tmp_path / "pages")).collect())
    assert ck.forbidden_terms(spark, [str(tmp_path / "x/note.txt")], ["甲", "乙"]).first().term == "甲"


def test_scans_prefer_direct_terms_then_slots_then_the_most(spark):
    turns = spark.createDataFrame([("d", 0, "user", "取消一下"), ("d", 1, "user", "取消报名入口"), ("d", 2, "assistant", "直接表达"), ("e", 0, "user", "取消"), ("f", 0, "user", "取消报名，开玩笑")], "dialogue_id string, turn_index int, speaker string, text string")
    objects = spark.createDataFrame([("o", "user", ["直接表达"], [["取消"], ["报名"]], ["开玩笑"], 2)], "object_id string, speaker string, direct array<string>, slots array<array<string>>, none array<string>, least int")
    found = {r.dialogue_id: (r.matched, r.turn_index, r.share) for r in patterns.scan_objects(turns, objects).collect()}
    assert found == {"d": (True, 1, 1.0), "e": (False, 0, 0.5)}



GRAPH = {
    "nodes": [
        {"id": "greet", "type": "start", "requirements": [{"id": "greet.name", "element_groups": [{"elements": [{"value": "请问您是负责人", "main": True}]}]}]},
        {"id": "rule", "type": "main", "requirements": [{"id": "rule.say", "element_groups": [{"elements": [{"value": "取消报名", "main": True}]}]}, {"id": "rule.when", "element_groups": [{"elements": [{"value": "次日生效", "main": True}]}]}],
         "atom_relations": [{"id": "order", "type": "before", "left": "rule.say", "right": "rule.when"}]},
        {"id": "faq", "type": "faq", "activation": {"mode": "user_triggered", "trigger_groups": [{"elements": [{"value": "费用", "main": True}, {"value": "多少", "main": False}]}]},
         "requirements": [{"id": "faq.cost", "text": "费用多少", "element_groups": [{"elements": [{"value": "免费", "main": True}]}]}, {"id": "faq.place", "text": "上课地点", "element_groups": [{"elements": [{"value": "线上教室", "main": True}]}]}]},
        {"id": "end", "type": "terminal", "required": False, "activation": {"mode": "condition", "trigger_groups": [{"elements": [{"value": "在开车", "main": True}]}]}, "requirements": [{"id": "end.bye", "required": False, "element_groups": [{"elements": [{"value": "稍后联系", "main": True}]}]}]},
    ],
    "edges": [{"source": "greet", "target": "rule", "type": "strict_order"}],
    "knowledge_table": [
        {"id": "days", "severity": "high", "selector_groups": [{"elements": [{"value": "标准协议", "main": True}]}], "correct_groups": [{"elements": [{"value": "标准协议", "main": True}, {"value": "10天", "fact": True}]}], "value_check": {"expected_value": "10天", "unit": "天"}},
    ],
    "hard_constraint_table": [{"id": "promise", "severity": "critical", "negative_groups": [{"elements": [{"value": "保证收到", "main": True}]}], "safe_groups": [{"elements": [{"value": "不能保证", "main": True, "fact": True}]}]}],
    "soft_constraint_table": [{"id": "long", "metric": {"type": "max_chars_per_assistant_turn", "max_chars": 60}}],
    "terminal_policies": [{"id": "driving", "trigger": [{"any": ["在开车"]}], "safe_response": [{"any": ["注意安全"]}], "forbidden_after_safe_response": [{"any": ["再确认一下"]}], "suppress_nodes": ["rule"]}],
}
DIALOGUES = {
    "good": [("assistant", "您好，请问您是负责人吗？"), ("user", "是的。"), ("assistant", "取消报名在页面操作。"), ("assistant", "操作后次日生效。"), ("assistant", "标准协议是10天。")],
    "order": [("assistant", "请问您是负责人吗？"), ("assistant", "次日生效。"), ("assistant", "取消报名可以操作。")],
    "wrong": [("assistant", "请问您是负责人吗？"), ("assistant", "取消报名。"), ("assistant", "次日生效。"), ("assistant", "标准协议是8天。"), ("assistant", "我保证收到。")],
    "safe": [("assistant", "请问您是负责人吗？"), ("assistant", "取消报名。"), ("assistant", "次日生效。"), ("assistant", "不能保证收到。")],
    "asked": [("assistant", "请问您是负责人吗？"), ("user", "费用多少？"), ("assistant", "免费的。"), ("assistant", "取消报名。"), ("assistant", "次日生效。")],
    "drive": [("assistant", "请问您是负责人吗？"), ("user", "我在开车。"), ("assistant", "那您注意安全。")],
    "pushed": [("assistant", "请问您是负责人吗？"), ("user", "我在开车。"), ("assistant", "注意安全。"), ("assistant", "再确认一下。")],
    "ignored": [("assistant", "请问您是负责人吗？"), ("user", "我在开车。"), ("assistant", "取消报名。"), ("assistant", "长" * 90)],
}


@pytest.fixture(scope="module")
def evaluated(spark):
    rows = [(name, i, who, text) for name, turns in DIALOGUES.items() for i, (who, text) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "dialogue_id string, turn_index int, speaker string, text string")
    out = evaluate(turns, gr.compile_graph(spark, GRAPH))
    return {name: table.toPandas() for name, table in out.items()}


def test_evaluation_of_steps(evaluated):
    steps = {(r.dialogue_id, r.node_id): r for r in evaluated["steps"].itertuples()}
    assert steps["good", "rule"].score == 1 and steps["good", "rule"].status == "已完成"
    assert not steps["good", "faq"].active and not steps["good", "end"].active and steps["good", "faq"].score == 1
    # Only the answer that was asked for counts; the other is as good as given, at turn 0.
    assert steps["asked", "faq"].active and steps["asked", "faq"].score == 1 and steps["asked", "faq"].first_hit_turn == 0
    # A policy that was handled ends the steps behind it; one that was not handled ends none.
    assert not steps["drive", "rule"].active and steps["ignored", "rule"].active and steps["ignored", "rule"].missing_required == 1


def test_evaluation_of_facts_constraints_and_context(evaluated):
    checks = {(r.dialogue_id, r.fact_id): r.verdict for r in evaluated["checks"].itertuples()}
    assert checks == {("good", "days"): "支持", ("wrong", "days"): "冲突"}
    limits = {(r.dialogue_id, r.constraint_id): r.verdict for r in evaluated["limits"].itertuples()}
    assert limits["wrong", "promise"] == "违规" and limits["safe", "promise"] == "安全" and limits["ignored", "long"] == "软问题"
    events = {r.dialogue_id: r.status for r in evaluated["events"].itertuples()}
    assert events == {"drive": "已处理", "pushed": "已处理但后续违背转场", "ignored": "触发但未处理"}


def test_evaluation_of_scores(evaluated):
    scores = {r.dialogue_id: r for r in evaluated["scores"].itertuples()}
    assert scores["good"].total == 100
    assert scores["order"].relation_score < 100 and {(r.dialogue_id, r.relation_id) for r in evaluated["inner"].itertuples()} == {("order", "order")}
    # High, of facts: 28 x 0.8; the cap of high facts is 52. Critical, of constraints: the cap is 38. Two families: 42 at most.
    assert scores["wrong"].knowledge_score == 52 and scores["wrong"].constraint_score == 38 and scores["wrong"].total == 38
    assert scores["ignored"].soft_score < 100 and scores["ignored"].context_problem and not scores["drive"].context_problem
    assert scores["pushed"].relation_score <= 62
    for row in scores.values():
        assert 0 <= row.total <= 100
