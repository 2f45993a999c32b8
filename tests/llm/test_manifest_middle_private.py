"""Merkle manifest, fill-in-the-middle and personal data against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from turnweave.llm import fill_in_middle as fim
from turnweave.llm import merkle
from turnweave.llm import personal_data as pii

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# The manifest


def leaf_of(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(leaves):
    """The root and, of each leaf, its levels as (place in the run, the run's others)."""
    paths, own, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        above, held = [], []
        for j in range(0, len(level), 3):
            run = level[j : j + 3]
            for k in range(len(run)):
                for i in own[j + k]:
                    paths[i].append((k, run[:k] + run[k + 1 :]))
            above.append(sha("".join(run)))
            held.append(sum(own[j : j + 3], []))
        level, own = above, held
    return level[0], paths


def audited(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    built = []
    for group in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(groups[group], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built.append((own, *tree([leaf_of(r) for r in own])))
    if not built:
        return []
    root, tops = tree([x[1] for x in built])
    out = []
    for (own, subroot, paths), top in zip(built, tops):
        for row, path in zip(own, paths):
            said = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                said = (*row[:4], row[4] and row[4].replace("\n", ""))
            folded = leaf_of(said)
            for place, others in path + top:
                folded = sha("".join([*others[:place], folded, *others[place:]]))
            proof = sha("".join(x for _, others in path + top for x in others))
            out.append((row[0], leaf_of(row), subroot, root, proof, folded, folded == root))
    return out


def many(n, sources):
    random.seed(n)
    ids = [random.choice([i, None]) if i % 17 == 0 else i for i in range(n)]
    return [(i, random.choice(sources), random.choice(["en", None]), k, random.choice([None, "", "a\nb", f"ü\n{k}"])) for k, i in enumerate(ids)]


CASES = [
    [],
    [(5, "a", "e", 1, "x\n")],
    many(60, ["a", None, "", "é", "b"]),
    many(300, ["hot", "hot", "hot", None, "z"]),
    many(260, [f"s{i}" for i in range(150)] + ["hot"] * 80),
    [(1, "s", "l", 2, "same\n")] * 150 + many(60, ["s"]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_manifest(spark, monkeypatch, case):
    monkeypatch.setattr(merkle, "PART_ROWS", 19)
    rows = CASES[case]
    schema = "doc_id long, source string, lang string, n_chars long, text string, key string, part int"
    documents = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema).repartition(3)
    found = [tuple(r) for r in merkle.audit(documents).collect()]
    assert sorted(found, key=str) == sorted(audited(rows), key=str)


def test_manifest_upper_levels_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART_ROWS", 2)
    monkeypatch.setattr(merkle, "ROUND_LEVELS", 1)
    rows = [(i, "s", None, i, None) for i in range(100)]
    documents = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, merkle.audit(documents).collect())) == sorted(audited(rows))


def test_manifest_where_a_session_deals_to_more_partitions(spark, monkeypatch):
    from pyspark import RDD

    monkeypatch.setattr(merkle, "PART_ROWS", 19)
    deal = RDD.partitionBy
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, *rest: deal(self, max(n, 11), *rest))
    documents = spark.createDataFrame(CASES[3], "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, merkle.audit(documents).collect()), key=str) == sorted(audited(CASES[3]), key=str)


def test_proofs_have_levels(spark):
    rows = [(i, "s", None, i, "t") for i in range(10)]
    documents = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(documents).orderBy("doc_id").collect()
    assert found[0].proof[0].left == "" and found[0].proof[0].right == found[1].leaf + found[2].leaf
    assert found[9].proof[0] == ("", "") and len(found[9].proof) == 3
    assert merkle.manifest(documents).select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).where("ok").count() == 10


def test_offsets():
    ends = [(0, "a", 4, "b", 2), (2, "b", 5, "b", 5), (3, "b", 1, "c", 3), (1, "b", 7, "b", 7)]
    assert merkle.offsets(ends) == {0: (0, 4, 15), 1: (2, 15, 15), 2: (9, 15, 15), 3: (14, 15, 3)}


# Fill in the middle


def test_ropes(monkeypatch):
    monkeypatch.setattr(fim, "LEAF", 3)
    random.seed(1)
    marks = fim.Sentinels()
    for _ in range(4000):
        text = "".join(random.choice(["a", " ", "\n", "é", "🙂", "\x1c", "<", ">", "P", "\x85"]) for _ in range(random.randint(0, 60)))
        numbers = [random.getrandbits(32) for _ in range(4)]
        units = UNIT.findall(text)
        n, form, prefix, middle, output = fim.rearranged(text, numbers, 50, 80, marks)
        assert n == len(units) and fim.restored(output, form, marks) == text
        if form == "plain":
            assert output == text and (not text or numbers[2] % 100 >= 50 or re.search("<[PSM]>", text))
            continue
        low, high = sorted(x % (n + 1) for x in numbers[:2])
        p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        assert (prefix, middle) == (len(p), len(m))
        assert output == (f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_ropes_stay_balanced(monkeypatch):
    monkeypatch.setattr(fim, "LEAF", 4)
    tree_ = fim.rope("word " * 4000)
    for k in range(200):
        a, b = fim.split_at(tree_, (k * 37) % (tree_.units + 1), "units")
        tree_ = fim.joined(b, a)
        assert tree_.height < 30
    assert sorted(str(tree_)) == sorted("word " * 4000)


def test_fill_in_middle_of_tables(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate([None, "", " ", "one", "<P>", "a <M> b", "long word " * 30_000, "x" * 200_000, "same text here"] + ["same text here"] * 3)]
    rows += [(None, "no id", "x", "y"), (3, "one", "x", "y")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, form string, restored string")
    there = fim.transform(documents, percent=100)
    found = fim.restore(there.withColumn("restored", F.lit("clash"))).collect()
    assert sorted(str((r.doc_id, r.restored)) for r in found) == sorted(str((i, t or "")) for i, t, *_ in rows)
    assert {r.form for r in found if r.doc_id in (0, 1, 4, 5)} == {"plain"} and {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(documents.limit(0))).count() == 0
    broken = spark.createDataFrame([("<P>a", "psm"), (None, "plain"), ("a", None)], "output string, form string")
    assert [r.restored for r in fim.restore(broken).collect()] == [None, None, None]


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BITS = ["a@b.c", "x", "@", ".", "..", "1", "23", "256", "255", ".", "-", " ", "+", "+1 (23) 456-7890", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "é", "🙂", "_", "@b.de", "%", "(", ")", "0", "000", "a.b@c-d.e.f", "\n"]


def luhn(digits):
    each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in each) % 10 == 0


def base_of(text):
    def holds(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(x) <= 255 for x in match.split("."))
        return kind == "email" or (16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15)

    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in BASE.items() for m in re.finditer(pattern, text or "") if holds(kind, m.group())]


def test_personal_data_base_spans(spark):
    random.seed(5)
    texts = [None, "", " ", "+"] + ["".join(random.choice(BITS) for _ in range(random.randint(0, 40))) for _ in range(500)]
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts)] + [(None, "+12345678 a@b.c", 1, ""), (4, texts[4], 1, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, base int, spans string").repartition(3)
    found = pii.span_digests(documents).collect()
    assert len(found) == len(rows)
    for r in found:
        base = base_of(texts[r.doc_id] if r.doc_id is not None else "+12345678 a@b.c")
        assert r.base_sha256 == sha(",".join(base))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(kind + ":") for x in base) for kind in BASE]
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("weak_")] == base
        taken = [tuple(map(int, x.split(":")[1:])) for x in base]
        for x in spans[len(base) :]:
            start, end = map(int, x.split(":")[1:])
            assert all(end <= a or b <= start for a, b in taken)
    assert pii.span_digests(documents.limit(0)).count() == 0


def test_personal_data_the_method_adds_spans(spark):
    good = ["call me: (743) 555-3824 today", "mail john (at) example (dot) com now", "phone 030-555-3824"]
    bad = ["order 2024-01-15 of it", "see page 12 13 14", "isbn 978-3-16-148410-0", "in 2019 2020 2021 2022 we", "sum 1234567.89", "id a4785380592391139b"]
    plain = [f"write to a{i}@mail.com or call +1 ({200 + i}) 555-{1000 + i} from 10.0.0.{i}" for i in range(50)]
    texts = (good + bad) * 20 + plain
    found = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    added = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if not s.base] for r in found}
    assert all(not added[i] for i, t in enumerate(texts) if t in bad or t in plain)
    assert ("weak_phone", "(743) 555-3824") in added[0] and ("weak_email", "john (at) example (dot) com") in added[1]


def test_reliabilities_against_plain_counting(spark):
    random.seed(9)
    rows = []
    for _ in range(400):
        true = random.random() < 0.4
        votes = [random.choices([0, 1 if true else 2, 2 if true else 1], [0.3, 0.6, 0.1])[0] for _ in pii.LABELERS]
        rows.append(("card", *votes, random.randint(1, 5)))
    patterns = spark.createDataFrame(rows, f"kind string, {', '.join(f'{x} int' for x in pii.LABELERS)}, n long")
    found = pii.estimate(patterns, rounds=4)["card"]
    first = pii._start()["card"]
    prior, tables = first
    for _ in range(4):
        weights = []
        for _, *votes, n in rows:
            a, b = prior, 1 - prior
            for x, v in zip(pii.LABELERS, votes):
                a, b = a * tables[x][0][v], b * tables[x][1][v]
            weights.append((n * a / (a + b), n * b / (a + b)))
        true, false = map(sum, zip(*weights))
        tables = {
            x: tuple(
                {v: (sum(w[side] for w, r in zip(weights, rows) if r[k + 1] == v) + 12 * first[1][x][side][v]) / ((true, false)[side] + 12) for v in range(3)}
                for side in (0, 1)
            )
            for k, x in enumerate(pii.LABELERS)
        }
        prior = (true + 2) / (true + false + 4)
    assert abs(found[0] - prior) < 1e-9
    assert all(abs(found[1][x][s][v] - tables[x][s][v]) < 1e-9 for x in pii.LABELERS for s in (0, 1) for v in range(3))
    assert 0.3 < prior < 0.5


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "1." * 60_000, "a@" * 60_000, "a@b" + ".c" * 60_000, "+1" + "(" * 100_000, "1 " * 60_000, "a-" * 60_000 + "@"])
def test_personal_data_of_endless_runs(spark, text):
    spans = pii.base_spans(F.col("text"), "email"), pii.base_spans(F.col("text"), "ip"), pii.base_spans(F.col("text"), "card"), pii.base_spans(F.col("text"), "phone")
    found = spark.createDataFrame([(text,)], "text string").select(*[F.size(x) for x in spans]).first()
    assert tuple(found) == ((1 if text.startswith("a@b") else 0), (15_000 if text.startswith("1.") else 0), 0, 0)


def test_personal_data_redacted(spark):
    texts = spark.createDataFrame([("ä a@b.c, +12345678.",), ("none",)], "text string")
    spans = F.concat(pii.base_spans(F.col("text"), "email"), pii.base_spans(F.col("text"), "phone"))
    named = F.transform(spans, lambda c: F.struct(F.lit("pii").alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    assert [r[0] for r in texts.select(pii.redacted(F.col("text"), named)).collect()] == ["ä [PII], [PII].", "none"]
