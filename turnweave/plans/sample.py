"""A small rule graph over the words of the test tables, for queries, benches and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnweave.plans.catalogue import Catalogue, compile_rules
from turnweave.plans.evaluate import evaluate
from turnweave.plans.graph import Graph, compile_graph


def latin_rules(spark: SparkSession, values: str) -> Catalogue:
    """A rule per rule_id of a VALUES text (rule_id, term), each term a main element of its one group."""
    found: dict[str, list[str]] = {}
    for row in spark.sql(f"SELECT * FROM {values}").collect():
        found.setdefault(row.rule_id, []).append(row.term)
    rules = [{"id": k, "type": "node_positive", "groups": [{"elements": [{"value": t, "main": True} for t in terms]}]} for k, terms in sorted(found.items())]
    return compile_rules(spark, rules)


def _group(*main: str, other: tuple[str, ...] = (), fact: tuple[str, ...] = ()) -> list[dict]:
    return [{"elements": [{"value": x, "main": True} for x in main] + [{"value": x} for x in other] + [{"value": x, "fact": True} for x in fact]}]


def _step(name: str, *requirements: list[dict] | dict, **more) -> dict:
    own = [g if isinstance(g, dict) else {"element_groups": g} for g in requirements]
    return {"id": name, "name": name, "requirements": [{"id": f"{name}.{k}", "text": name, **r} for k, r in enumerate(own)], **more}


#: A requirement that holds where no user stops early.
_GOES_ON = {"required": False, "match_policy": {"conditional_required_when_no_early_user_stop": True}}


GRAPH = {
    "nodes": [
        _step("greet", _group("the", other=("and",)), _group("er"), type="start", atom_relations=[{"id": "greet.order", "type": "before", "left": "greet.0", "right": "greet.1"}]),
        _step("explain", _group("tion", "ing", other=("of",)), {"element_groups": _group("con"), **_GOES_ON}, {"element_groups": _group("ier"), "required": False}, type="main"),
        _step("answers", _group("que"), _group("und"), _group("los"), type="faq", activation={"mode": "optional", "trigger_groups": _group("est")}),
        _step("extra", {"element_groups": _group("ent"), "required": False}, type="faq", activation={"mode": "optional", "trigger_groups": _group("ons")}),
        _step("close", _group("that", other=("with",)), type="terminal", required=False, activation={"mode": "optional", "trigger_groups": _group("ungen")}),
    ],
    "edges": [
        {"source": "greet", "target": "explain", "type": "strict_order"},
        {"source": "explain", "target": "answers", "type": "before"},
        {"source": "explain", "target": "close", "type": "terminal_after"},
        {"source": "close", "target": "answers", "type": "optional_after"},
    ],
    "relation_groups": [
        {"id": "main", "type": "sequential", "nodes": ["greet", "explain"], "weight": 2.0},
        {"id": "one", "type": "any_of", "nodes": ["answers", "close"]},
        {"id": "none", "type": "all_of", "nodes": [], "weight": 0.5},
    ],
    "knowledge_table": [
        {"id": "fact", "severity": "medium", "selector_groups": _group("ent"), "correct_groups": _group("the", "ent"), "wrong_groups": _group("eaux")},
        {"id": "other", "severity": "high", "selector_groups": _group("er"), "correct_groups": _group("er", fact=("an",)), "wrong_groups": _group("er", fact=("schlich",))},
    ],
    "hard_constraint_table": [
        {"id": "ban", "severity": "high", "negative_groups": _group("schlich"), "safe_groups": _group("nicht")},
        {"id": "later", "severity": "low", "trigger_policy": "requires_user_trigger", "trigger_groups": _group("on"), "negative_groups": _group("eaux")},
    ],
    "soft_constraint_table": [
        {"id": "kind", "global_elements": [{"value": "er"}, {"value": "est"}], "metric": {"direction": "higher_better", "good_threshold": 0.9}},
        {"id": "short", "metric": {"type": "max_chars_per_assistant_turn", "max_chars": 150}},
    ],
    "terminal_policies": [{"id": "stop", "trigger": [{"any": ["eau"]}], "safe_response": [{"any": ["ing", "ung"]}], "forbidden_after_safe_response": [{"any": ["schlich"]}], "suppress_nodes": ["close"]}],
}


def graph(spark: SparkSession) -> Graph:
    return compile_graph(spark, GRAPH)


def catalogue(spark: SparkSession) -> Catalogue:
    return graph(spark).catalogue


def evaluated(spark: SparkSession, turns: DataFrame) -> dict[str, DataFrame]:
    return evaluate(turns, graph(spark))
