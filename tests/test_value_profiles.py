"""A text's values are worked out once a row."""

from turnweave.operators import values
from turnweave.plans.local import local_table


def test_one_profile_a_row(spark):
    spans = spark.createDataFrame([("d", 1, 0, "一共20元"), ("d", 2, 0, "今天10元"), ("d", 3, 0, "没有10元")], "dialogue_id string, turn_index int, seq int, text string")
    facts = local_table(spark, [("v", "v", [], [], [{"expected": "10元", "unit": "", "anchors": [], "condition": ""}], False, [])], values.VALUE_FACT)
    found = values.value_results(spans, facts)
    assert sorted((r.turn_index, r.result) for r in found.collect()) == [(1, "conflict"), (2, "support"), (3, "support")]
    # What compares is above what makes the profile; nothing else has a copy of its numbers.
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    generated = next(i for i, line in enumerate(lines) if "Generate explode(transform" in line)
    assert not any("regexp_extract_all" in line for line in lines[:generated])
    assert lines[generated].count("regexp_extract_all") == 4
