"""Whole runs: results are found again, dead runs leave nothing, candidates are asked for once."""

import os

import pytest
from pyspark.sql import functions as F

from tests.test_graph import DIALOGUES, GRAPH
from turnweave.plans import graph as gr
from turnweave.plans import run as rn

TURNS = "dialogue_id string, turn_index int, speaker string, text string"


def turns_of(spark, dialogues):
    return spark.createDataFrame([(name, i, who, text) for name, turns in dialogues.items() for i, (who, text) in enumerate(turns)], TURNS)


@pytest.fixture(scope="module")
def graph(spark):
    return gr.compile_graph(spark, GRAPH)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("runs"))


@pytest.fixture(scope="module")
def first(spark, graph, folder):
    dialogues = {k: DIALOGUES[k] for k in ("good", "wrong", "asked")} | {"copy": DIALOGUES["good"]}
    out = rn.run(turns_of(spark, dialogues), graph, "v1", folder)
    return {"evaluated": out["evaluated"], "decisions": {r.dialogue_id: r for r in out["decisions"].collect()}}


def test_digests(spark):
    same = {"a": DIALOGUES["good"], "b": DIALOGUES["good"], "c": DIALOGUES["good"][:-1], "d": DIALOGUES["good"][::-1]}
    found = {r.dialogue_id: r.digest for r in rn.dialogue_digests(turns_of(spark, same).repartition(3)).collect()}
    assert found["a"] == found["b"] and len(set(found.values())) == 3
    twice = turns_of(spark, {"a": DIALOGUES["good"]})
    assert rn.dialogue_digests(twice.union(twice)).first().digest != found["a"]


def test_a_first_run_evaluates_each_content_once(first):
    assert first["evaluated"] == 3
    got = first["decisions"]
    assert got["good"].decision == got["copy"].decision == "accepted" and got["good"].reasons == ""
    assert got["wrong"].decision == "blocked" and "bad_event" in got["wrong"].reasons and not got["wrong"].passed


def test_a_second_run_starts_no_evaluation(spark, graph, folder, first, monkeypatch):
    def never(*_):
        raise AssertionError("evaluated again")

    monkeypatch.setattr(rn, "evaluate", never)
    out = rn.run(turns_of(spark, {"other": DIALOGUES["wrong"], "good": DIALOGUES["good"]}), graph, "v1", folder)
    assert out["evaluated"] == 0 and {r.dialogue_id: r.decision for r in out["decisions"].collect()} == {"other": "blocked", "good": "accepted"}
    with pytest.raises(AssertionError):
        rn.run(turns_of(spark, {"good": DIALOGUES["good"]}), graph, "v2", folder)


def test_a_run_that_died_leaves_nothing_that_is_read(spark, graph, folder, first, monkeypatch):
    write = rn.Store.write

    def dies(self, tables, digests):
        write(self, {"scores": tables["scores"].withColumn("total", F.lit(-1.0))}, digests.limit(0))
        os.remove(os.path.join(self.root, "done", sorted(os.listdir(os.path.join(self.root, "done")))[-1], "_SUCCESS"))
        raise OSError("an executor too many was lost")

    turns = turns_of(spark, {"order": DIALOGUES["order"], "good": DIALOGUES["good"]})
    monkeypatch.setattr(rn.Store, "write", dies)
    with pytest.raises(OSError):
        rn.run(turns, graph, "v1", folder)
    monkeypatch.setattr(rn.Store, "write", write)
    out = rn.run(turns, graph, "v1", folder)
    found = {r.dialogue_id: r.total for r in out["decisions"].collect()}
    assert out["evaluated"] == 1 and set(found) == {"order", "good"} and min(found.values()) > 0


def test_candidates_are_asked_for_once(spark, folder):
    calls = spark.sparkContext.accumulator(0)
    rows = [(f"d{i}:k", "知识核验灰区", f"k{i % 5}", ["同样的话"] if i % 2 else []) for i in range(30)]
    chosen = spark.createDataFrame(rows, "candidate_id string, kind string, target string, evidence array<string>")
    path = f"{folder}/asked"

    def fails(part):
        calls.add(len(part))
        if any(x["target"] == "k3" for x in part):
            raise OSError("no answer")
        return [{"candidate_id": x["candidate_id"], "verdict": "hit", "confidence": 0.5} for x in part]

    assert rn.ask_once(chosen, fails, path, chunk=3) == 10
    assert rn.answers_of(spark, path).where("failure IS NULL").count() == 8

    def works(part):
        calls.add(len(part))
        return [{"candidate_id": x["candidate_id"], "verdict": "miss", "confidence": 0.9} for x in part]

    before = calls.value
    assert rn.ask_once(chosen, works, path, chunk=3) == 2 and calls.value == before + 2
    assert rn.ask_once(chosen, works, path, chunk=3) == 0 and calls.value == before + 2
    assert {r.verdict: r["count"] for r in rn.answers_of(spark, path).groupBy("verdict").count().collect()} == {"hit": 8, "miss": 2}


def test_a_chunk_that_dies_keeps_the_chunks_before(spark, folder):
    chosen = spark.createDataFrame([(f"c{i}", "k", f"t{i}", ["x"]) for i in range(24)], "candidate_id string, kind string, target string, evidence array<string>")
    path, seen = f"{folder}/dying", spark.sparkContext.accumulator(0)

    def dies(part):
        if any(x["target"] == "t7" for x in part):
            raise RuntimeError("a bug of the arbiter")
        seen.add(len(part))
        return [{"candidate_id": x["candidate_id"], "verdict": "hit", "confidence": 1.0} for x in part]

    with pytest.raises(Exception, match="a bug of the arbiter"):
        rn.ask_once(chosen, dies, path, chunk=4)
    kept = rn.answers_of(spark, path)
    n = 0 if kept is None else kept.count()
    works = lambda part: [{"candidate_id": x["candidate_id"], "verdict": "hit", "confidence": 1.0} for x in part]
    assert rn.ask_once(chosen, works, path, chunk=4) == 24 - n and rn.answers_of(spark, path).count() == 24


def test_grey_zones_and_planted_errors(spark, graph, folder, first):
    dialogues = {"grey": [("assistant", "请问您是负责人吗？"), ("assistant", "标准协议不能改。")], "wrong": DIALOGUES["wrong"]}
    errors = spark.createDataFrame(
        [("wrong", "e1", "knowledge", "days", "", False), ("wrong", "e2", "constraint", "", "我保证收到", False), ("grey", "e3", "knowledge", "other", "没有的话", False)],
        "dialogue_id string, error_id string, family string, target_id string, span string, eligible boolean",
    )
    out = rn.run(turns_of(spark, dialogues), graph, "v1", folder, errors=errors)
    found = {r.dialogue_id: r for r in out["labelled"].collect()}
    assert found["wrong"].passed and found["wrong"].n_matched == 2 and not found["grey"].passed
    rows = out["candidates"].collect()
    assert {r.decision for r in rows} <= {"route_to_arbiter", "keep_local_low_value", "merged_local_no_issue", "ignore_noise"}
    assert out["ledger"].where("effect = 'against' AND family = 'knowledge'").count() == 1 and out["losses"].count() > 0


def test_digests_are_not_in_the_rows_of_the_evaluation(spark, graph, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(rn, "evaluate", lambda turns, g: seen.append({r.dialogue_id for r in turns.select("dialogue_id").distinct().collect()}) or {name: turns for name in rn.KEPT})
    turns = turns_of(spark, {"good": DIALOGUES["good"], "copy": DIALOGUES["good"], "wrong": DIALOGUES["wrong"]})
    digests = rn.dialogue_digests(turns)
    store = rn.Store(spark, str(tmp_path), "v")
    assert rn.evaluate_missing(turns, digests, graph, store) == 2
    assert seen == [{"copy", "wrong"}]
    of = {r.dialogue_id: r.digest for r in digests.collect()}
    kept = store.table("scores").groupBy("dialogue_id").count().collect()
    assert {r.dialogue_id: r["count"] for r in kept} == {of["good"]: len(DIALOGUES["good"]), of["wrong"]: len(DIALOGUES["wrong"])}
