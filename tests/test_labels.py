"""Labels are prepared once a label."""

from turnweave.operators import diagnosis


def test_tokens_are_worked_out_before_labels_meet(spark):
    labels = spark.createDataFrame([(1, "n1", "", ""), (2, "x", "取消报名", "报名入口"), (3, None, None, "以后")], "label_id int, node string, core string, hint string")
    targets = spark.createDataFrame([("n1", "n1", "生效 时间"), ("n2", "n2", "取消 报名入口")], "target_id string, node string, anchor string")
    found = diagnosis.bound_labels(labels, targets)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "n1", 1.0), (2, "n2", 1.0)]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = next(i for i, line in enumerate(lines) if "Join" in line)
    assert not any("regexp" in line for line in lines[:joined])
    # Of each of the four columns two expressions cut tokens.
    assert sum(line.count("regexp_extract_all") for line in lines) == 8


def test_hints_and_rows_are_prepared_before_they_meet(spark):
    errors = spark.createDataFrame([("d", "e", "次日生效 规则")], "dialogue_id string, error_id string, hint string")
    rows = spark.createDataFrame([("d", "a", "支持", "生效时间是次日"), ("d", "b", "冲突", "别的")], "dialogue_id string, target string, verdict string, label string")
    found = diagnosis.nearest(errors, rows, 2)
    assert [r.target for r in found.orderBy("place").collect()] == ["a", "b"]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("regexp" in line for line in lines[: next(i for i, line in enumerate(lines) if "Join" in line)])
