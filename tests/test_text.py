"""Column expressions against plain Python, on generated pairs."""

import random
import re

from pyspark.sql import functions as F

from turnweave.functions import text as ft
from turnweave.operators import patterns
from turnweave.operators.routing import arbitrate, diverse_budget
from turnweave.plans import graph
from turnweave.sources.dialogues import read_dialogues, turns_of

ALPHABET = "取消生效次日的会就可以 3单"


def tight(x):
    return re.sub(r"\s+", "", x).lower()


def rest(x):
    x = tight(x)
    for word in ft.FILLERS:
        x = x.replace(word, "")
    return x


def text_hit(a, b):
    x, y = tight(a), tight(b)
    if not x or not y:
        return False
    if x in y or (rest(a) and rest(a) in rest(b)):
        return True
    if re.search(r"\d", x) or any(m in x for m in ft.EXACT_MARKS) or len(x) < 5:
        return False
    common = len(set(x) & set(y))
    return common >= 4 and common / len(set(x)) >= 0.9


def ordered(a, b):
    x, y, at = tight(a), tight(b), -1
    if not x or not y or len(x) < 6 or re.search(r"\d", x) or any(m in x for m in ft.MODAL_MARKS):
        return False
    for c in x:
        after = y.find(c, at + 1)
        if after < 0 or (at >= 0 and after - at - 1 > ft.MAX_GAP):
            return False
        at = after
    return True


def test_hits_are_those_of_the_specification(spark):
    random.seed(4)
    make = lambda n: "".join(random.choice(ALPHABET) for _ in range(random.randint(0, n)))
    pairs = [(i, make(8), make(30)) for i in range(1500)]
    rows = spark.createDataFrame(pairs, "i int, a string, b string").select("i", ft.text_hit("a", "b").alias("h"), ft.ordered_hit("a", "b").alias("o")).collect()
    found = {r.i: (r.h, r.o) for r in rows}
    assert found == {i: (text_hit(a, b), ordered(a, b)) for i, a, b in pairs}
    assert 100 < sum(h for h, _ in found.values()) < 1400


def test_diverse_budget_is_the_round_robin(spark):
    random.seed(5)
    items = [(k, random.choice("abc"), k) for k in range(40)]
    buckets, order, chosen = {}, [], []
    for k, bucket, _ in items:
        if bucket not in buckets:
            order.append(bucket)
        buckets.setdefault(bucket, []).append(k)
    turn = 0
    while len(chosen) < 17:
        own = buckets[order[turn % len(order)]]
        turn += 1
        if own:
            chosen.append(own.pop(0))
    df = spark.createDataFrame(items, "k int, bucket string, rank int")
    assert sorted(r.k for r in diverse_budget(df, 17, ["bucket"]).collect()) == sorted(chosen)


def test_a_failing_arbiter_leaves_candidates_unsure(spark):
    def arbiter(batch):
        if any(x["candidate_id"] == "bad" for x in batch):
            raise OSError("no answer")
        return [{"candidate_id": x["candidate_id"], "verdict": "hit", "confidence": 0.9} for x in batch]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "candidate_id string").coalesce(1)
    found = {r.candidate_id: r.verdict for r in arbitrate(df, arbiter, batch=1).collect()}
    assert found == {"a": "hit", "bad": "uncertain", "c": "hit"}


def test_dialogue_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.json").write_text('{"id": "a", "sample_type": "正包", "turns": [{"role": "客服", "text": "好"}, {"speaker": "user", "content": "嗯"}]}', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"domain": "x", "pack_type": "负包", "dialogue": [{"role": "system", "text": "t"}]}', encoding="utf-8")
    (tmp_path / "bad.json").write_text('{"id": ', encoding="utf-8")
    (tmp_path / "graph1.json").write_text('{"id": "g", "turns": []}', encoding="utf-8")
    rows = {r.dialogue_id: r.sample_type for r in read_dialogues(spark, str(tmp_path)).collect()}
    assert rows == {"a": "positive", "b": "negative"}
    turns = sorted((r.dialogue_id, r.turn_index, r.speaker, r.text) for r in turns_of(read_dialogues(spark, str(tmp_path))).collect())
    assert turns == [("a", 0, "assistant", "好"), ("a", 1, "user", "嗯"), ("b", 0, "unknown", "t")]


def test_pattern_parts(spark):
    df = spark.createDataFrame([("abc",), ("abx",), ("bcz",)], "text string")
    pattern = graph.pattern({"all": ["b"], "any": ["a", "c", "z"], "none": ["x"], "min_any_hits": 2, "regex_any": ["^a", "z$"]})
    hit = patterns.turn_matches(pattern, F.col("text"), F.lit(""))
    assert [r.text for r in df.where(hit).collect()] == ["abc", "bcz"]


def test_closed_dialogues_stream(spark, tmp_path):
    from turnweave.streaming.turns import closed_dialogues, read_turns

    lines = ['{"dialogue_id":"d","turn_index":0,"speaker":"user","text":"a","at":"2024-01-01T00:00:00Z"}', '{"dialogue_id":"d","turn_index":1,"speaker":"assistant","text":"b","at":"2024-01-01T00:01:00Z"}', '{"dialogue_id":"e","turn_index":0,"speaker":"user","text":"c","at":"2024-01-01T05:00:00Z"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(lines))
    stream = closed_dialogues(read_turns(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    stream.processAllAvailable()
    stream.stop()
    assert [(r.dialogue_id, r.n_turns) for r in spark.table("closed").collect()] == [("d", 2)]
