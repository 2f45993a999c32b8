"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from turnweave.llm import bpe, components, html_text, langid, line_dedup, minhash, packing, simhash, token_counts, topk, url_filter
from turnweave.llm.queries import URL_RULES
from turnweave.llm.word_tokens import own_merges, word_tokens

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, n_lines int, score string"  # the last two clash with own names
ODD = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "2", ".", "'s", "The", "   ", "İ", "Σ", "ß", "--", "\x1c", "\x85", "　", "🙂", "́", "<|endoftext|>", "ing", "don't", "\x00"]


def odd_text(n):
    return "".join(random.choice(ODD) for _ in range(random.randint(0, n)))


@pytest.fixture(scope="module")
def texts():
    random.seed(11)
    base = [None, "", " \n ", "one", "word " * 3000, "x" * 5000, "same line here now\nsame line here now", "the quick brown fox jumps over it " * 9]
    return [(i, t) for i, t in enumerate(base + [odd_text(30) for _ in range(60)] + ["the quick brown fox jumps over it " * 9] * 3)]


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, i, "s") for i, t in texts] + [(None, "no id", "en", 0, "s"), (3, "one", "en", 0, "s")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_urls(spark):
    assert url_filter.split_url("HTTP://WWW.Ex.com?x/y") == ("www.ex.com", "")
    assert url_filter.split_url("no scheme") == url_filter.split_url(None) == ("", "")
    urls = ["https://a.example.com/en/1", "https://www.example.com/en/1", "https://www.example.com/en", "https://example.com", "http://x.net/es/", "http://net/fr/a#b", "http://xnet/fr/", "ftp://EXAMPLE.COM/EN/", None, "junk"]

    def brute(url):
        host, path = url_filter.split_url(url)
        fits = [(len(r), r, v) for v, r in URL_RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        return max(fits)[1:] if fits else (None, "allow")

    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id long, url string, rule string")
    found = url_filter.judge_urls(pages, URL_RULES).collect()
    assert len(found) == len(urls) + 1
    assert all((r.rule, r.verdict) == brute(urls[r.page_id]) for r in found)
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, URL_RULES, max_rules=2)
    trie = url_filter.UrlTrie([("block", "a.com/x/yz"), ("allow", "a.com/x/"), ("block", "b.com")])
    assert trie.find("a.com", "/x/yzz")[1] == "block" and trie.find("a.com", "/x/y")[1] == "allow" and trie.find("c.b.com", "") == ("b.com", "block")


def test_top_k(spark):
    random.seed(1)
    rows = [(i, [random.choice([-0.5, 0.25, 0.5, 0.1]) for _ in range(6)], 0) for i in range(300)]
    rows += [(300, None, 0), (350, [float("nan")] * 6, 0), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (450, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (7, rows[7][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    sound = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if i is not None and i < 300]
    for sizes in ({}, {"candidates": 90, "queries": 2}):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, **sizes).collect()}
        for q, v in sound:
            if q % 50 == 0:
                best = sorted((-int(v @ w), i) for i, w in sound if i != q)[:5]
                assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
        assert len(got) == 30
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id IN (0, 1)")).count() == 1


def test_block_top_k_reads_lists_and_resolves():
    random_ = np.random.default_rng(3)
    vectors = random_.integers(-90, 90, (700, 8))
    ids = np.arange(700)
    for scale in (1, 10**6, 10**9):
        found = topk.block_top_k(ids, vectors * scale, ids[::100], vectors[::100], 5)
        for q in range(0, 700, 100):
            scores = (vectors * scale) @ vectors[q]
            best = sorted((-int(scores[i]), i) for i in range(700) if i != q)[:5]
            assert sorted((-s, i) for a, i, s in found if a == q) == best


def test_simhash(spark, documents, nothing):
    rows = documents.where("doc_id IS NOT NULL AND doc_id <> 3").select("doc_id", "text", F.lit(1).alias("fingerprint"))
    got = {r.doc_id: r for r in simhash.edited_fingerprints(rows).collect()}
    order = sorted(((r.doc_id, r.text or "") for r in rows.collect()), reverse=True)
    assert len(got) == len(order)
    for k, (i, text) in enumerate(order):
        half = len(text) // 2
        after = order[(k + 1) % len(order)]
        edited = text[: len(text) - half] + after[1][:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        bits = bin(int(got[i].fingerprint, 16) ^ int(got[after[0]].fingerprint, 16)).count("1")
        assert got[i].near_next == pytest.approx(1 - bits / 64)
        if text == edited:
            assert got[i].near_edited == 1
    same = {got[i].fingerprint for i, text in order if text.startswith("the quick")}
    assert len(same) == 1
    assert simhash.edited_fingerprints(nothing).count() == 0
    assert simhash.edited_fingerprints(documents).count() == documents.count()
    assert simhash.edited_fingerprints(documents.where("text = 'no id'")).first().near_next == 1


def test_hamming_radius(spark):
    random.seed(3)
    prints = [random.getrandbits(64) - 2**63 for _ in range(40)]
    for _ in range(200):
        x = random.choice(prints)
        for _ in range(random.randint(0, 4)):
            x ^= 1 << random.randint(0, 62)
        prints.append(x)
    found = {(r.a, r.b) for r in simhash.within_radius(spark.createDataFrame([(x,) for x in prints] + [(None,)], "fingerprint long"), 3).collect()}
    own = sorted(set(prints))
    assert found == {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}


def test_byte_bpe(spark, documents, texts, nothing):
    pairs = bpe.byte_pairs(RANKS, PATTERN)
    found = bpe.token_digests(documents, RANKS, PATTERN).collect()
    of = dict(texts) | {None: "no id"}
    assert len(found) == documents.count()
    for r in found:
        ids = pairs.encoding.encode_ordinary(of[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((of[r.doc_id] or "").encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_texts(documents, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert all(bytes(r.raw).decode() == (of[r.doc_id] or "") for r in back)
    assert bpe.token_digests(nothing, RANKS, PATTERN).count() == 0
    random.seed(8)
    for _ in range(3000):
        text = odd_text(12)
        assert np.frombuffer(pairs.encode(text), "<u4").tolist() == pairs.encoding.encode_ordinary(text)


def test_word_tokens_and_prefix_counts():
    assert own_merges(WORDS)
    tokens = word_tokens(WORDS, True)
    exact = lambda t: tokens.tokenizer.encode(t, add_special_tokens=False).ids
    random.seed(9)
    for _ in range(1500):
        text = odd_text(10)
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == exact(text)
        table = token_counts.PrefixCounts(text, tokens)
        counts = [len(exact(text[:k])) for k in range(len(text) + 1)]
        assert [table.at(k) for k in range(len(text) + 1)] == counts and table.total == counts[-1]
        assert table.longest(3) == max(k for k, c in enumerate(counts) if c <= 3)


def test_token_counts(documents, texts, nothing):
    tokens = word_tokens(WORDS, True)
    of = dict(texts) | {None: "no id"}
    for r in token_counts.count_tokens(documents, WORDS, 50).collect():
        text = of[r.doc_id] or ""
        n = len(tokens.tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 50)
        assert (r.fit_chars is None) == (n <= 50)
    assert token_counts.count_tokens(nothing, WORDS).count() == 0


def test_language_id(spark, documents, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    filters = langid.learn_filters(docs, langid.crc_held_out(), 100)
    got = {r.doc_id: r for r in langid.predict_languages(docs, filters).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 200 and sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert filters.predict(None) == filters.predict(" 12 .") == ("und", 0.0)
    # The AND of an n-gram's rows names every language that holds it.
    model = langid.LanguageFilters.learn({"a": ["abcd " * 9], "b": ["wxyz " * 9]})
    gram = langid.gram_hashes("abcd")[:1]
    rows = [model.rows[model.places(gram, i, 18)] for i in range(2)]
    assert (rows[0] & rows[1])[0] & 1
    empty = langid.learn_filters(nothing, F.lit(False))
    kept = langid.keep_identified(documents, empty)
    assert kept.columns == documents.columns and kept.where("text IS NULL OR text = ''").count() == 0 and kept.where("text = 'one'").count() == 2
    assert langid.predict_languages(nothing, filters).count() == 0


def test_html(spark):
    show = html_text.render
    assert show("<ul><li>a<li>b</ul><p>one<div>two<br>three</div>") == "- a\n- b\n\none\n\ntwo\nthree"
    assert show("<ol start=3><li>x<li>y</ol>") == "3. x\n4. y"
    assert show("<table><tr><th>Name<th>N<tr><td>alpha beta<td>2</table>") == "Name        N\nalpha beta  2"
    assert show("<head><title>t</title></head><p hidden>no</p><b style='display: none'>no</b>a&amp;b &amp;lt;<script>if(a<b){}</script><!-- c -->q") == "a&b &lt;q"
    assert show("<pre> k\n  m</pre>") == " k\n  m"
    assert show(None) is None and show("") == "" and show("plain  text") == "plain text" and show("<p>open <b>bold") == "open bold"
    assert show("<div>" * 3000 + "deep") == "deep" and show("a<!-- never closed") == "a" and show("<script>x") == ""
    pages = spark.createDataFrame([(1, "<p>x", "u"), (1, "<p>x", "u"), (2, None, "u")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text or "") for r in html_text.extract_text(pages).collect()) == [(1, "x"), (1, "x"), (2, "")]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def shingles(text, n):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute_components(sets, up, down):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and down * len(sets[a] & sets[b]) >= up * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(spark, nothing, block):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[random.choice(vocabulary) for _ in range(60)] for _ in range(4)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Two words"), (4, "two WORDS"), (5, "word " * 4000)]
    for i in range(6, 90):
        words = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 3])):
            words[random.randrange(60)] = random.choice(vocabulary)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows] + [(None, "alone here", "x", "y")], "doc_id long, text string, rep string, kept string").repartition(3)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, words=3, percent=85, block=block).collect()}
    sets = {i: shingles(t, 3) for i, t in rows}
    want = brute_components(sets, 85, 100)
    assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in want} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}
    assert got[None].kept and len(set(want.values())) < len(want)
    left = minhash.without_near_duplicates(docs, words=3, percent=85)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, c in want.items() if i == c} | {None}
    assert minhash.near_duplicates(nothing.drop("score"), words=3, percent=85).count() == 0


def test_components(spark):
    random.seed(6)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(400, 450)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root}


def test_packing(spark, documents, texts, nothing):
    for capacity, group in ((2048, 2000), (16, 5)):
        pieces = packing.pack_documents(documents, WORDS, 1, capacity=capacity, group_documents=group).collect()
        tokens = word_tokens(WORDS, True)
        of = dict(texts) | {None: "no id"}
        sequences, whole = {}, {}
        for p in pieces:
            ids = np.frombuffer(tokens.ids(of[p.doc_id] or ""), "<u4").tolist() + [1]
            assert p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
            sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
            whole.setdefault(p.doc_id, []).append((p.start, p.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity and at & (at - 1) == 0  # no padding is left
        for key, parts in whole.items():
            copies = 2 if key == 3 else 1
            n = len(np.frombuffer(tokens.ids(of[key] or ""), "<u4")) + 1
            covered = sorted(x for start, length in parts for x in range(start, start + length))
            assert covered == sorted(list(range(n)) * copies)
    assert packing.pack_documents(nothing, WORDS, 1).count() == 0


def test_packing_balances_cost():
    lengths = [random.Random(1).randint(1, 900) for _ in range(400)]
    cost = {}
    for d, _, n, s, _ in packing.pack_lengths(lengths):
        cost[s] = cost.get(s, 0) + n + n * n / 2048
    full = [c for s, c in cost.items() if s < sum(lengths) // 2048]
    assert max(full) < 1.5 * sum(full) / len(full)


def brute_lines(docs, least):
    sequences = [(i, [(x, len(x.split())) for x in line_dedup.text_lines(t or "")]) for i, t in sorted(docs)]
    gone = {i: set() for i, _ in sequences}
    for a, (i, own) in enumerate(sequences):
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
            if sum(w for _, w in own[s : s + best]) >= least:
                gone[i] |= set(range(s, s + best))
    return gone


@pytest.mark.parametrize("least", [1, 4, 6])
def test_line_dedup(spark, nothing, least):
    random.seed(least)
    lines = ["a", "b", "c d", "e f g", "h i j k", "l m n o p", "", " a ", "q"]
    docs = [(i, "\n".join(random.choice(lines) for _ in range(random.randint(0, 9)))) for i in range(14)] + [(100, None), (101, ""), (102, "long line here " * 2000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs] + [(102, docs[-1][1], 1, "x")], "doc_id long, text string, n_lines int, at string").repartition(2)
    rows = line_dedup.dedup_lines(df, least).collect()
    assert len(rows) == len(docs) + 1
    want = brute_lines(docs, least)
    got = {r.doc_id: r for r in rows}
    for i, t in docs:
        assert got[i].text == line_dedup.delete_lines(t, want[i]) and got[i].n_deleted == len(want[i])
    same = line_dedup.dedup_lines(df, least, counts=False, keep_empty=False)
    assert same.columns == df.columns and same.where("doc_id = 100").count() == 1
    assert line_dedup.dedup_lines(nothing, least).count() == 0
