"""Windows and hits are dealt once, up to a rule's best window."""

from turnweave.operators import matching
from turnweave.operators.atoms import atoms
from turnweave.plans.catalogue import compile_rules


def test_windows_are_judged_where_they_were_dealt(spark):
    turns = spark.createDataFrame([("d", 1, "assistant", "次日生效。规则说明"), ("d", 2, "user", "好的"), ("d", 3, "assistant", "奖励十元，次日到账")], "dialogue_id string, turn_index int, speaker string, text string")
    rules = [{"id": "r", "type": "node_positive", "groups": [{"id": "g", "elements": [{"value": "次日生效", "main": True}, {"value": "奖励"}]}, {"id": "h", "elements": [{"value": "没有"}]}]}]
    found = matching.best_matches(matching.settled_windows(atoms(turns), compile_rules(spark, rules).elements))
    assert [(r.verdict, r.turn_index, r.seq) for r in found.collect()] == [("hit", 1, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next((i for i, line in enumerate(plan) if "REPARTITION_BY_COL" in line), len(plan))
    assert dealt < len(plan) and not any("Exchange hashpartitioning" in line for line in plan[:dealt])
