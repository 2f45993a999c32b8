"""Parts that run on the driver: the tolerant JSON reader, pages and bundles; and streams of turns."""

import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnweave.functions.loose_json import read_object
from turnweave.plans.catalogue import compile_rules
from turnweave.sources import reports

LEAVES = st.none() | st.booleans() | st.integers(-1000, 1000) | st.text(max_size=8)
OBJECTS = st.dictionaries(st.text(max_size=5), st.recursive(LEAVES, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8), max_size=4)


@settings(max_examples=100, deadline=None)
@given(OBJECTS)
def test_what_is_json_stays_as_it_is(value):
    assert read_object(json.dumps(value, ensure_ascii=False)) == value
    assert read_object("```json\n" + json.dumps(value) + "\n```") == value


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Here it is: {a: 1, 'b': [1, 2,], } done", {"a": 1, "b": [1, 2]}),
        ('{"a": "say "hi" now", "b": true}', {"a": 'say "hi" now', "b": True}),
        ('{"a": 1 "b": {"c": [1 2]}}', {"a": 1, "b": {"c": [1, 2]}}),
        ('{"a": [1, {"b": "cut o', {"a": [1, {"b": "cut o"}]}),
        ('{"a": 1, // note\n "b": None}', {"a": 1, "b": None}),
        ('{"a": "x\\u00e9\\n"}', {"a": "xé\n"}),
    ],
)
def test_what_models_write_is_read(text, expected):
    assert read_object(text) == expected


def test_no_object_is_an_error():
    for text in ("", "nothing", "[1, 2]"):
        with pytest.raises(ValueError):
            read_object(text)


def test_pages_escape_and_refuse_long_tables(spark, tmp_path):
    few = spark.createDataFrame([("a<b", 1.5), (None, 2.0)], "name string, mean double")
    page = reports.render_page("run", {"means": few})
    assert "a&lt;b" in page and "1.50" in page and "<b" not in page.replace("<body", "")
    with pytest.raises(ValueError):
        reports.render_page("run", {"long": spark.range(reports.PAGE_ROWS + 1)})
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "page.html").write_text(page)
    target = tmp_path / "all.zip"
    assert reports.bundle(str(tmp_path), str(target)) == 1
    assert zipfile.ZipFile(target).namelist() == ["x/page.html"]


def test_a_catalogue_with_dangling_edges_or_twice_the_same_rule_is_refused(spark):
    rule = {"id": "a", "groups": [{"elements": ["x"]}]}
    with pytest.raises(ValueError):
        compile_rules(spark, [rule, rule])
    with pytest.raises(ValueError):
        compile_rules(spark, [rule], [{"id": "a"}], [{"source": "a", "target": "b"}])


def test_terminals_end_what_is_behind_them(spark):
    from turnweave.operators.nodes import closure, suppressed_by_terminals

    edges = spark.createDataFrame([("a", "t", "terminal_after"), ("t", "x", "before"), ("x", "y", "before")], "source string, target string, kind string")
    results = spark.createDataFrame([("d", "t", True, 3), ("e", "t", True, None)], "dialogue_id string, node_id string, active boolean, first_hit_turn int")
    gone = suppressed_by_terminals(results, edges.withColumn("weight", F.lit(1.0)), closure(spark, edges)).collect()
    assert sorted((r.dialogue_id, r.node_id) for r in gone) == [("d", "x"), ("d", "y")]
