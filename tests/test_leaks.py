"""Passages in texts of any script, against plain search."""

import random

from pyspark.sql import functions as F

from turnweave.operators import reports


def test_leaks_in_any_script(spark):
    rng = random.Random(8)
    letters = "甲乙丙丁戊己庚辛    ab\n🙂"
    said = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [None, "", "甲"] + [said(rng.randint(0, 300)) for _ in range(60)]
    passages = [None, "", "甲", "乙丙", "🙂"]
    for _ in range(80):
        text = rng.choice(texts[3:])
        at, size = rng.randint(0, max(0, len(text) - 1)), rng.choice([1, 3, 4, 5, 7, 8, 12, 39, 40, 60])
        passages.append(text[at : at + size] if rng.random() < 0.8 else said(size))
    documents = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    known = spark.createDataFrame([(i, p) for i, p in enumerate(passages)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in reports.leaks(documents.drop("item_id"), known).collect())
    want = sorted((i, k) for i, t in enumerate(texts) for k, p in enumerate(passages) if t and p and p in t)
    assert got == want and len(want) > 80
    assert reports.leaks(documents, known.limit(0)).count() == 0 and reports.leaks(documents.limit(0), known).count() == 0


def test_thousands_of_short_passages(spark):
    known = spark.createDataFrame([(i, chr(0x4E00 + i)) for i in range(3000)], "item_id long, text string")
    documents = spark.createDataFrame([(0, "一丁七" * 40)], "doc_id long, text string")
    assert sorted(r.item_id for r in reports.leaks(documents, known).collect()) == [0, 1, 3]


def test_label_spans_in_patterns(spark):
    spans = spark.createDataFrame([("我们 今天就生效",), ("短的",), ("别的话没有说过",)], "span string")
    patterns = spark.createDataFrame([("说：我们今天就生效。",), ("其他",)], "pattern string")
    assert [tuple(r) for r in reports.span_leaks(spans, patterns).collect()] == [("我们今天就生效", "说：我们今天就生效。")]


def test_windows_share_keys(spark):
    text = "abcdefghijklmnopqrstuvwxyz" * 3
    rows = spark.createDataFrame([(text,), (text[20:63],)], "t string").select(reports.winnowed(reports.grams(F.col("t"), 9), 32).alias("k")).collect()
    assert set(rows[1].k) and set(rows[1].k) <= set(rows[0].k)


def test_short_passages_are_found_without_a_shuffle(spark, capsys):
    texts = ["thatthe" * 9 + chr(97 + i) for i in range(20)]
    passages = ["thattheth" + chr(98 + i) for i in range(20)] + ["thethatt"] * 3 + ["theb", "c"]
    documents, known = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    found = reports.leaks(documents, known)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == sorted((i, k) for i, t in enumerate(texts) for k, p in enumerate(passages) if p in t)
    found.explain()
    assert "MapInArrow" in (plan := capsys.readouterr().out) and "Exchange" not in plan


def test_short_passages_in_parts(spark, monkeypatch):
    monkeypatch.setattr(reports, "HELD_AT_ONCE", 3)
    documents = spark.createDataFrame([(0, "abcdefgh"), (1, None), (2, "xx" * 40)], "doc_id long, text string")
    known = spark.createDataFrame([(i, "abcdefgh"[i : i + 2]) for i in range(8)] + [(9, "x" * 50), (10, "x" * 90)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in reports.leaks(documents, known).collect()) == [*((0, i) for i in range(8)), (2, 9)]
