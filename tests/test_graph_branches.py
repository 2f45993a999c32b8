"""Dialogues worked out by hand from what each branch of the evaluation has to give."""

import pytest

from turnweave.plans import graph as gr
from turnweave.plans.evaluate import evaluate


def main(*words, other=()):
    return [{"elements": [{"value": w, "main": True} for w in words] + [{"value": w} for w in other]}]


def step(name, *requirements, **more):
    rows = [{"id": f"{name}.{k}", **({"element_groups": r} if isinstance(r, list) else r)} for k, r in enumerate(requirements)]
    return {"id": name, "name": name, "requirements": rows, **more}


GOES_ON = {"required": False, "match_policy": {"conditional_required_when_no_early_user_stop": True}}
GRAPH = {
    "nodes": [
        step("open", main("核对身份", other=("负责人",)), type="start"),
        step("detail", main("说明规则"), {"element_groups": main("奖励金额"), **GOES_ON}, type="main"),
        step("price", {"element_groups": main("免费领取"), "required": False}, type="faq", activation={"mode": "optional", "trigger_groups": main("费用多少")}),
        step("open_page", main("点击配置按钮"), type="branch", activation={"mode": "condition", "patterns": [{"any": ["入口不可见", "入口"], "speaker": "user"}], "trigger_groups": main("入口不可见")}),
        step("stop", main("祝您生活愉快"), type="terminal", required=False, activation={"mode": "condition", "trigger_groups": main("我要挂了")}),
        step("after", main("后续安排"), type="main"),
        step("kept", main("留下方式"), type="main"),
        step("bare", type="faq", activation={"mode": "optional", "trigger_groups": main("在哪里上课")}),
    ],
    "edges": [
        {"source": "open", "target": "detail", "type": "before"},
        {"source": "detail", "target": "stop", "type": "terminal_after", "terminal_effect": {"suppress_nodes": ["after"]}},
        {"source": "stop", "target": "after", "type": "before"},
        {"source": "stop", "target": "kept", "type": "before"},
    ],
    "relation_groups": [
        {"id": "order", "type": "sequential", "nodes": ["open", "detail"], "weight": 3},
        {"id": "free", "type": "any_of", "nodes": ["price"], "weight": 1},
        {"id": "all", "type": "all_of", "nodes": ["after", "kept"], "min_completed": 1, "weight": 0},
    ],
    "knowledge_table": [{"id": "days", "severity": "high", "selector_groups": main("生效时间"), "correct_groups": main("生效时间", other=("次日",))}],
}
DIALOGUES = {
    # What was asked for stands in the turn before the one that recalls it: the step begins there.
    "window": [("assistant", "我们来电，负责人在"), ("assistant", "核对身份，您好啊"), ("assistant", "说明规则"), ("assistant", "奖励金额")],
    "asked": [("user", "请问费用多少"), ("assistant", "核对身份，负责人"), ("assistant", "说明规则"), ("assistant", "奖励金额")],
    "stops": [("assistant", "核对身份，负责人"), ("user", "我在开车"), ("assistant", "说明规则")],
    "late": [("assistant", "核对身份，负责人"), ("assistant", "说明规则"), ("user", "好的"), ("user", "我在开车")],
    "denied": [("assistant", "生效时间次日。不能改动。")],
    "plain": [("assistant", "生效时间次日。可以改动。")],
    "ended": [("assistant", "核对身份，负责人"), ("user", "我要挂了"), ("assistant", "祝您生活愉快")],
    "broken": [("user", "入口不可见"), ("assistant", "入口可以在这里处理")],
    "seen": [("user", "入口已显示"), ("assistant", "入口可以在这里处理")],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, i, who, text) for name, turns in DIALOGUES.items() for i, (who, text) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "dialogue_id string, turn_index int, speaker string, text string")
    return {name: table.toPandas() for name, table in evaluate(turns, gr.compile_graph(spark, GRAPH)).items() if name in ("steps", "requirements", "checks", "groups", "matches", "scores")}


@pytest.fixture(scope="module")
def steps(found):
    return {(r.dialogue_id, r.node_id): r for r in found["steps"].itertuples()}


def test_a_step_begins_where_its_window_does(steps, found):
    assert steps["window", "open"].first_hit_turn == 0
    place = found["matches"].set_index(["dialogue_id", "rule_id"]).loc[("window", "open.0")]
    assert place.turn_index == 1 and place.first_turn == 0


def test_optional_requirements_and_triggers(steps):
    # Nothing of it is required: the answer counts as given, from where it was asked for.
    assert steps["asked", "price"].active and steps["asked", "price"].score == 1 and steps["asked", "price"].first_hit_turn == 0
    assert not steps["window", "price"].active


def test_a_step_without_requirements_has_no_score(steps):
    assert all(not r.active for (_, node), r in steps.items() if node == "bare") and ("window", "bare") in steps


def test_duties_of_calls_that_go_on(steps, found):
    required = {(r.dialogue_id, r.requirement_id): r.required for r in found["requirements"].itertuples()}
    assert not required["stops", "detail.1"] and required["late", "detail.1"] and required["asked", "detail.1"]
    assert steps["stops", "detail"].score == 1 and steps["late", "detail"].score <= 0.58 and steps["late", "detail"].missing_required == 1


def test_a_denial_near_a_fact_is_reviewed(found):
    verdicts = {r.dialogue_id: r.verdict for r in found["checks"].itertuples()}
    assert verdicts["denied"] == "证据不足" and verdicts["plain"] == "支持"


def test_edges_end_the_steps_they_name(steps):
    assert not steps["ended", "after"].active and steps["ended", "kept"].active
    assert steps["window", "after"].active


def test_branches_that_are_taken_up(steps):
    assert steps["broken", "open_page"].active and steps["broken", "open_page"].score == 0.75 and steps["broken", "open_page"].first_hit_turn == 0
    assert not steps["seen", "open_page"].active


def test_groups_by_their_weights(found):
    events = {(r.dialogue_id, r.group_id): (r.relation, r.penalty) for r in found["groups"].itertuples()}
    assert events["asked", "all"] == ("group:all_of", 6.0) and ("asked", "order") not in events
    # Pairs: open and detail 1; detail and stop, stop and others inactive. Groups: (3 x 100 + 1 x 100 + 0 x 0) / 4.
    scores = {r.dialogue_id: r for r in found["scores"].itertuples()}
    assert scores["asked"].relation_score == pytest.approx(100)
    # Nothing was said of either: a pair of 0 and 0, a group of 0 by weight 3 and an empty one of 100 by weight 1.
    assert scores["plain"].relation_score == pytest.approx(0.45 * 25)
