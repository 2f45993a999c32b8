"""Raw answers of models, read in the tasks; none is lost."""

from turnweave.functions.loose_json import read_any, records_with
from turnweave.sources import packs


def test_tolerant_reader_of_any():
    assert read_any('[{"a": 1}, {"a": 2},') == [{"a": 1}, {"a": 2}] and read_any("so: {a: [1, 2}") == {"a": [1, 2]}
    assert records_with({"r": [{"k": 1, "in": {"k": 2}}, [{"k": 3}]], "k2": {"k": 4}}, "k") == [{"k": 1, "in": {"k": 2}}, {"k": 3}, {"k": 4}]
    assert len(read_any('{"x": "' + 'a" b ' * 20_000 + '"}')["x"]) == 100_000


def test_raw_answers(spark, tmp_path):
    files = {
        "a.json": '{"candidate_id": "a", "verdict": "hit", "confidence": "0.5", "reason": "直接"}',
        "b.txt": '```json\n[{"candidate_id": "b1", "verdict": "miss",}, {"candidate_id": "b2", verdict: review, "confidence": high}\n```',
        "c.txt": 'Sure. {"answers": {"first": {"candidate_id": 7, "verdict": null, "reason": {"why": "x"}}}} bye',
        "d.txt": "no answer at all",
        "e.txt": "",
        "i.txt": " \n",
        "f.txt": '{"verdict": "hit"}',
        "g.txt": "[" * 50_000,
        "sub/h.txt": '{"candidate_id": "h", "verdict": "hit", "reason": "she said "yes" to it", "confidence": 0.25',
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = [(r.file.rsplit("/", 1)[1], r.candidate_id, r.verdict, r.confidence, r.reason, r.problem) for r in packs.raw_answers(spark, str(tmp_path)).collect()]
    assert sorted(rows, key=str) == [
        ("a.json", "a", "hit", 0.5, "直接", None),
        ("b.txt", "b1", "miss", None, None, None),
        ("b.txt", "b2", "review", None, None, None),
        ("c.txt", "7", None, None, '{"why": "x"}', None),
        ("d.txt", None, None, None, None, "no JSON in the text"),
        ("f.txt", None, None, None, None, "no answer in the JSON"),
        ("g.txt", None, None, None, None, "JSON of too many levels"),
        ("h.txt", "h", "hit", 0.25, 'she said "yes" to it', None),
        ("i.txt", None, None, None, None, "no JSON in the text"),
    ]
    nothing = spark.createDataFrame([], "file string, raw string, verdict string")
    assert packs.parsed_answers(nothing).count() == 0
    assert packs.parsed_answers(spark.createDataFrame([("x", None, "clash")], nothing.schema)).first().problem == "no JSON in the text"
