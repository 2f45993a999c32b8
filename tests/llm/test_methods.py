"""The methods of the operators against plain versions, and texts that once crashed, hung or lost something."""

import random
import re
import time
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnweave.llm import bpe, common, html_text, langid, line_dedup, minhash, simhash, token_counts, topk
from turnweave.llm.queries import QUERIES
from turnweave.llm.word_tokens import own_merges, word_tokens

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------ HTML


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p title=it's>Hello</p><p>World</p>", "Hello\n\nWorld"),
        ("<img alt='a>b'>t <p a=\"1>2\" b='3>4' c=5>x", "t\n\nx"),
        ("<b a = 'q' hidden>no</b>yes<a href=x/>link</a>", "yeslink"),
        ("<div>" * 205 + "<span hidden>SECRET</span>", ""),
        ("<p style='visibility:hidden'>no<b style='visibility: visible'>yes</b></p>", "yes"),
        ("<p style='display:none'>no<b style='visibility: visible'>no</b></p>z", "z"),
        ("<p style='display:none;display:block'>yes</p>", "yes"),
        ("<table><tr><td colspan=2>wide cell here<td>z<tr><td>a<td>b<td>c</table>", "wide cell here  z\na  b            c"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "- a\n  - b\n  - c\n- d"),
        ("<!-->shown<!-- x --!>too<dialog>no</dialog>a</>b</ x>c", "showntooabc"),
        ("<dl><dt>t<dd>one<br>two</dl>", "t\n  one\n  two"),
    ],
)
def test_html_cases(page, text):
    assert html_text.render(page) == text


def test_html_of_any_depth_and_size():
    began = time.time()
    for page in ("<div>" * 200_000 + "x", "<blockquote>" * 50_000 + "x", "<ul><li>" * 50_000 + "x", "<table><tr><td>" * 10_000 + "x", "<b>" * 200_000 + "x", "<table><tr>" + "<td colspan=1000 rowspan=65534>x" * 5_000, "<p a" + " " * 1_000_000 + ">x", "word " * 200_000 + "x"):
        assert html_text.render(page).rstrip().endswith("x")
    assert time.time() - began < 60


def plain_walk(page):
    """A second, plain reader of pages without tables, lists or white space that is kept: words in order."""
    out, hidden, at = [], [], 0
    for found in re.finditer(r"<(/?)([a-z]+)([^>]*)>|([^<]+)", page):
        if found[4]:
            if not any(hidden):
                out += found[4].split()
        elif found[1]:
            hidden.pop()
        elif found[2] != "br":
            hidden.append("hidden" in found[3] or "none" in found[3])
        at = found.end()
    assert at == len(page)
    return out


def test_html_words_are_those_of_a_plain_reader():
    random.seed(4)
    for _ in range(300):
        def part(depth):
            name = random.choice(["div", "span", "b", "section", "em"])
            mark = random.choice(["", "", "", " hidden", ' style="display:none"'])
            inner = "".join(part(depth - 1) if depth and random.random() < 0.6 else random.choice([" one two ", " three ", " x<br> y "]) for _ in range(random.randint(1, 4)))
            return f"<{name}{mark}> {inner} </{name}>"

        page = part(4)
        assert html_text.render(page).split() == plain_walk(page)


# ------------------------------------------------------------------ tokens


def test_byte_bpe_of_long_white_space():
    pairs = bpe.byte_pairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    random.seed(5)
    pieces = [" " * 1100, "\n" * 1003, "word", " ", "\t" * 1000 + " ", "!", "\x1c", "\x85" * 1001, "x\n "]
    for _ in range(150):
        text = "".join(random.choice(pieces) for _ in range(random.randint(0, 6)))
        assert np.frombuffer(pairs.encode(text), "<u4").tolist() == pairs.encoding.encode_ordinary(text)
    for text in (" " * 3_000_000, "\n" * 3_000_000, "a" + " " * 1_500_000 + "b", "ab" * 500_000):
        assert pairs.decode(pairs.encode(text)).decode() == text
    other = bpe.BytePairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), r"\S+|\s+")
    assert np.frombuffer(other.encode("a b  c"), "<u4").tolist() == other.encoding.encode_ordinary("a b  c")


def test_every_prefix_count_is_the_library_s():
    tokens = word_tokens(WORDS, True)
    exact = lambda t: len(tokens.tokenizer.encode(t, add_special_tokens=False).ids)
    random.seed(3)
    odd = [" ", "\n", "a", "B", "é", unicodedata.normalize("NFD", "é"), "e", "́", "1", ".", "'s", "'", "re", "ll", "The", "İ", "Σ", "--", "　", "🙂", "<|endoftext|>", "<|", "<|start", "ing", "don't", "中", "文字", "ᄒ", "ᅡ", "ᆫ", "한", "ß", "\x00", "zzz", "你好"]
    for _ in range(800):
        text = "".join(random.choice(odd) for _ in range(random.randint(0, 9)))
        assert token_counts.PrefixCounts(text, tokens).table.tolist() == [exact(text[:i]) for i in range(len(text) + 1)]


def test_long_units_take_time_in_proportion():
    tokens = word_tokens(WORDS, True)
    random.seed(1)
    for text in ("".join(chr(0x4E00 + random.randrange(3000)) for _ in range(300_000)), "".join(random.choice("abcdefghij") for _ in range(300_000)), "." * 300_000, "don't " * 50_000, unicodedata.normalize("NFD", "é") * 50_000):
        began = time.time()
        table = token_counts.PrefixCounts(text, tokens)
        assert time.time() - began < 60 and table.total == len(tokens.tokenizer.encode(text, add_special_tokens=False).ids)
        assert table.table[table.longest(100)] <= 100


def test_files_of_other_kinds_are_told_apart(spark):
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert own_merges(WORDS) and not own_merges(other)
    with pytest.raises(ValueError):
        token_counts.count_tokens(spark.createDataFrame([(1, "x")], "doc_id long, text string"), other)
    whole = word_tokens(other, False)
    text = "Two  words\n and 3"
    assert np.frombuffer(whole.ids(text), "<u4").tolist() == whole.tokenizer.encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------------ languages


def test_filters_return_all_languages_that_hold_a_gram():
    random.seed(6)
    texts = {k: ["".join(random.choice("abcde ") for _ in range(300)) for _ in range(4)] for k in "pqr"}
    model = langid.LanguageFilters.learn(texts)
    sets = {k: {x for t in v for x in langid.gram_hashes(t).tolist()} for k, v in texts.items()}
    grams = np.unique(langid.gram_hashes(" ".join(t for v in texts.values() for t in v)))
    masks = model.rows[model.places(grams, 0, langid.BITS)] & model.rows[model.places(grams, 1, langid.BITS)]
    false = 0
    for gram, mask in zip(grams.tolist(), masks.tolist(), strict=True):
        for i, language in enumerate(model.languages):
            held = bool(mask >> i & 1)
            assert held or gram not in sets[language]
            false += held and gram not in sets[language]
    assert false < 0.05 * len(grams) and any(m == 7 for m in masks.tolist())


def test_filters_learned_in_tasks_are_those_of_the_sample(spark):
    rows = [(i, f"text {i % 7} of {'ab' if i % 2 else 'cd'}{i}", "x" if i % 2 else "y") for i in range(40)] + [(None, "no id", "x"), (50, None, "y"), (51, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = langid.learn_filters(docs, F.lit(False))
    plain = langid.LanguageFilters.learn({k: [t or "" for i, t, name in rows if name == k and i is not None] for k in "xy"})
    assert learned.languages == plain.languages and np.array_equal(learned.rows, plain.rows)
    with pytest.raises(ValueError):
        langid.learn_filters(spark.createDataFrame([(i, "t", f"l{i}") for i in range(65)], "doc_id long, text string, lang string"), F.lit(False))


def test_filters_learn_from_all_documents(spark):
    rows = [(i, "common words " + ("late ones" if i >= 300 else ""), "x") for i in range(600)] + [(1000 + i, "other " + ("common" if i < 2 else "text"), "y") for i in range(600)]
    learned = langid.learn_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), F.lit(False))
    # Half of the texts have "late", whatever their order; 2 of 600 are less than one in 250.
    plain = langid.LanguageFilters.learn({"x": ["common words ", "common words late ones"], "y": ["other text"]})
    other = set(langid.gram_hashes("other common").tolist()) - set(langid.gram_hashes("other text").tolist())
    assert np.array_equal(learned.rows, plain.rows) and other
    assert learned.predict("late ones")[0] == "x" and learned.predict("common")[0] == "x"


def test_foreign_texts_go_and_short_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn_filters(docs, F.lit(False), with_floor=True)
    assert 0.2 < model.floor < 0.6
    random.seed(7)
    noise = " ".join("".join(random.choice("qxzwvkjy") for _ in range(7)) for _ in range(60))
    made = spark.createDataFrame([(1, noise), (2, "Erö."), (3, "12 34"), (4, None), (5, "これは日本語の文章です。" * 20)], "doc_id long, text string")
    assert [r.doc_id for r in langid.keep_identified(made, model).collect()] == [2]
    assert langid.keep_identified(docs, model).count() == docs.count()


# ------------------------------------------------------------------ fingerprints, minima, lines, top-k


def votes(spark, texts):
    """Fingerprints by a plain count of votes; the hashes of terms are Spark's."""
    out = {}
    for text in texts:
        words = [w for w in re.split(r"[^\w]+", text.lower().replace("_", " ")) if w]
        terms = [tuple(words[i : i + 2]) for i in range(len(words) - 1)] or ([tuple(words)] if words else [])
        if terms and len(words) > 1:
            rows = spark.createDataFrame(terms, "a string, b string").select(F.xxhash64("a", "b").alias("h")).collect()
        else:
            rows = spark.createDataFrame([(list(t),) for t in terms], "a array<string>").select(F.xxhash64("a").alias("h")).collect()
        n = len(rows)
        out[text] = sum((2 * sum(r.h >> i & 1 for r in rows) > n) << i for i in range(64))
    return out


def test_fingerprints_are_the_votes(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "one", "", "a b a b a b", "Ünïcode wörds äre hére too 12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in simhash.edited_fingerprints(docs).collect()}
    want = votes(spark, texts)
    assert {i: int(found[i].fingerprint, 16) for i in found} == {i: want[t] for i, t in enumerate(texts)}
    order = list(range(len(texts)))[::-1]
    edited = {}
    for k, i in enumerate(order):
        half = len(texts[i]) // 2
        edited[i] = texts[i][: len(texts[i]) - half] + texts[order[(k + 1) % len(order)]][:half]
    more = votes(spark, edited.values())
    for i in found:
        assert int(found[i].edited_fingerprint, 16) == more[edited[i]]
        assert found[i].near_edited == pytest.approx(1 - (want[texts[i]] ^ more[edited[i]]).bit_count() / 64)


def test_signatures_keep_what_is_similar(spark):
    assert minhash.least_equal(0.85, 80) < 0.85 * 80 and minhash.least_equal(0.8, 112) > 50
    minima = minhash.Minima()
    random.seed(9)
    for _ in range(200):
        base = np.unique(np.array([random.getrandbits(64) for _ in range(300)], np.uint64))
        other = np.unique(np.concatenate([base[:-24], np.array([random.getrandbits(64) for _ in range(24)], np.uint64)]))
        equal = (minima.signature(base) == minima.signature(other)).sum()
        assert equal >= minhash.least_equal(0.85, 80)
    rows = [("b", 0, 0, 0, 1, [1] * 8), ("b", 0, 0, 0, 2, [1] * 7 + [9]), ("b", 0, 0, 0, 3, [5] * 8), ("c", 0, 0, 0, 4, [1] * 8)]
    made = [(hash(b) % 100, o, t, s, rep, np.array(x, "<u4").tobytes()) for b, o, t, s, rep, x in rows]
    frame = spark.createDataFrame(made, "bucket long, one int, two int, side int, rep long, signature binary").coalesce(1).sortWithinPartitions("bucket")
    assert sorted(r.rep for r in minhash._agreeing(frame, 6, "bigint").collect()) == [1, 2]


def brute_runs(docs):
    """Of each place the longest run that stands earlier, those inside the run of the place before left out."""
    sequences = [(i, line_dedup.text_lines(t or "")) for i, t in sorted(docs)]
    out = set()
    for a, (i, own) in enumerate(sequences):
        before = 0
        for s in range(len(own)):
            best = 0
            for b in range(a + 1):
                other = sequences[b][1]
                for q in range(len(other)):
                    if b == a and q >= s:
                        break
                    n = 0
                    while s + n < len(own) and q + n < len(other) and own[s + n] == other[q + n]:
                        n += 1
                    best = max(best, n)
            if best and before <= best:
                out.add((i, s, best))
            before = best
    return out


def test_runs_are_the_maximal_repeats(spark):
    random.seed(12)
    base = ["\n".join(random.choice("abcdef") for _ in range(40)) for _ in range(2)]
    docs = [(i, base[i % 2] if i < 4 else "\n".join(random.choice("abc") for _ in range(random.randint(1, 30)))) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    runs = line_dedup.later_copies(df).collect()
    assert {(r.doc_id, r["at"], r["size"]) for r in runs} == brute_runs(docs) and max(r["size"] for r in runs) == 40
    assert all(r.copies >= 2 for r in runs)


def test_hot_keys_are_dealt_and_lose_nothing(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, F.lit(1)).otherwise(F.col("id") % 50).alias("k"), "id").unionByName(spark.createDataFrame([(None, 9999)], "k long, id long"))
    classes = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.col("k") * 10)
    for most in (4020, 10):
        out = common.join_counted(rows, classes, ["k"], ["id"], 5000, most)
        assert out.count() == 5001 and out.where("k IS NOT NULL AND (name IS NULL OR name <> k * 10)").count() == 0 and out.where("name IS NULL").count() == 1


def test_top_k_reads_lists_to_a_depth_and_is_exact():
    random_ = np.random.default_rng(8)
    vectors = np.zeros((5000, 6))
    vectors[:, 0] = random_.integers(0, 100_000, 5000)
    lists = topk.SortedLists(np.arange(5000), vectors)
    found, depth = lists.top(-1, np.array([3.0, 0, 0, 0, 0, 0]), 5)
    best = sorted(((-int(3 * v[0]), i) for i, v in enumerate(vectors)))[:5]
    assert found == [(i, -s) for s, i in best] and depth <= 0.125
    big = np.array([[1e30, -1.0], [3e38, 2], [-3e38, 5], [1, 1], [7e25, 0]] * 30)
    rows = topk.block_top_k(np.arange(150), big, np.array([0]), big[:1], 3)
    assert rows == [(0, 1, 2**63 - 1), (0, 3, 2**63 - 1), (0, 4, 2**63 - 1)]
    assert topk.exact_scores(np.array([[2.0**40, 1]]), np.array([2.0**20, 3])).tolist() == [2**60 + 3]


# ------------------------------------------------------------------ the pipeline


def test_pipeline_against_a_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    model = langid.learn_filters(spark.read.parquet(f"{SF}/documents.parquet"), F.lit(False), with_floor=True)
    kept = [(i, t) for i, t in docs if t and any(map(str.isalpha, t)) and not model.foreign(t)]
    texts = {}
    sequences = {i: line_dedup.text_lines(t) for i, t in kept}
    gone = {i: set() for i in sequences}
    order = sorted(sequences)
    places: dict[str, list[tuple[int, int]]] = {}
    for i in order:
        own = sequences[i]
        for s, line in enumerate(own):
            best = 0
            for j, q in places.get(line, ()):
                other, n = sequences[j], 0
                while s + n < len(own) and q + n < len(other) and own[s + n] == other[q + n]:
                    n += 1
                best = max(best, n)
            if sum(len(x.split()) for x in own[s : s + best]) >= line_dedup.MIN_WORDS:
                gone[i] |= set(range(s, s + best))
            places.setdefault(line, []).append((i, s))
    for i, t in kept:
        if len(gone[i]) < len(sequences[i]) or not sequences[i]:
            texts[i] = line_dedup.delete_lines(t, gone[i])
    sets = {i: set(minhash.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
                common_ = len(sets[a] & sets[b])
                if common_ * 100 >= 80 * (len(sets[a]) + len(sets[b]) - common_):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    left = {i for i in sets if find(i) == i}
    tokens = word_tokens(WORDS, True)
    packed = corpus_pipeline.run(spark, SF).collect()
    sizes = {}
    for p in packed:
        sizes[p.doc_id] = sizes.get(p.doc_id, 0) + p.length
    assert sizes == {i: tokens.count(texts[i]) + 1 for i in left}


def test_empty_and_odd_tables_pass_every_query_operator(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate([None, "", " \n ", "one", "x" * 3000, "a b c d\na b c d"])], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([(1, None, None), (2, "http://A.b/c?d", "<p>x")], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(0, None), (50, [1.0, 2.0]), (3, [1.0]), (4, [float("nan"), 1.0])], "vec_id long, embedding array<float>")
    for name, table in (("documents", docs), ("pages", pages), ("embeddings", vectors)):
        for part, frame in (("some", table), ("none", table.limit(0))):
            frame.coalesce(1).write.parquet(str(tmp_path / part / f"{name}.parquet"))
    for name, query in QUERIES.items():
        rows = query(spark, str(tmp_path / "some")).count()
        assert query(spark, str(tmp_path / "none")).count() == 0, name
        assert rows >= (1 if name == "op2_top_k" else 2 if name in ("op1_url_filter", "op7_html_text") else 6), name
