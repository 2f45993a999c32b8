"""Cases in which an operator did less than its whole job."""

import numpy as np
import public_tokenizers
import pytest

from turnweave.llm import html_text, langid, token_counts, topk
from turnweave.llm.queries import QUERIES
from turnweave.llm.word_tokens import WordTokens, word_tokens


def test_html_tables_keep_what_is_not_a_cell():
    show = html_text.render
    assert show("<table><tr><form><td>x</td></form></tr></table>") == "x"
    assert show("<table><form><tr><td>a<td>b</tr></form><tr><td>c<td></td><td>d</table>") == "a  b\nc     d"
    assert show("<table><tr>bare<td>x</td></tr><tbody><div>block</div><tr><p>para</p><td>y</tr></tbody></table>").split() == ["bare", "block", "para", "x", "y"]
    assert show("<table><td>a<td>b</table>") == "a  b"
    assert show("<table><tr hidden><form><td>no</form></tr><tr><form hidden><td>no</td></form><td>x</table>") == "x"
    assert show("<table><tr><td>a<table><tr><td>in</table></table>") == "a\nin"


def test_html_shows_controls_and_drawings():
    show = html_text.render
    assert show("<p>pick <select><option>one<option>two</select>") == "pick\none\ntwo"
    assert show("<textarea>\na &amp;  b</textarea>") == "a &  b"
    assert show("<svg><title>no</title><desc>no</desc><text>one</text><text>two</text></svg>") == "one two"
    assert show("x <math><mi>y</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>") == "x y=2"
    assert show("<desc>shown</desc>") == "shown"


def test_html_hidden_below_the_greatest_depth():
    show = html_text.render
    deep = "<div>" * 300
    for hidden in ("<div hidden><div>no</div>no<p>no</div>", "<p style='display:none'>no</p>", "<ul><li hidden>no<li>"):
        assert show(deep + hidden + "yes").strip("- ") == "yes"
    assert show(deep + "a" + "</div>" * 300 + "<p>b") == "a\n\nb"
    assert show("<table><tr><td>" * 300 + "x").strip() == "x"
    assert show("<div>" * 20_000 + "<p hidden>no</p>deep") == "deep"


def test_top_k_with_many_rows_of_a_query_id():
    random_ = np.random.default_rng(5)
    for copies in (5, 6, 9, 150):
        vectors = random_.integers(-9, 10, (400, 8))
        ids = np.arange(400)
        vectors[:copies], ids[:copies] = 90, 0  # the query's own rows have the largest products
        found = topk.block_top_k(ids, vectors, ids[:1], vectors[:1], 5)
        best = sorted((-int(vectors[i] @ vectors[0]), int(ids[i])) for i in range(copies, 400))[:5]
        assert sorted((-int(s), int(i)) for _, i, s in found) == best
    few = topk.block_top_k(np.array([0] * 97 + [1, 2, 3]), np.full((100, 4), 3), np.array([0]), np.full((1, 4), 3), 5)
    assert sorted(int(i) for _, i, _ in few) == [1, 2, 3]


def test_top_k_bounds_many_queries_at_once():
    random_ = np.random.default_rng(6)
    vectors = random_.integers(-90, 91, (3000, 16)).astype(float)
    vectors[5] = 0
    lists = topk.SortedLists(np.arange(3000), vectors)
    found, read = lists.top_of_all(np.arange(200), vectors[:200], 5)
    for q in range(200):
        assert found[q] == [(i, -s) for s, i in sorted((-int(vectors[i] @ vectors[q]), i) for i in range(3000) if i != q)[:5]]
        assert (found[q], read[q]) == lists.top(q, vectors[q], 5)
    assert ((read > 0) & (read <= 1)).all()


def test_language_filters_hold_shared_grams():
    model = langid.LanguageFilters.learn({"a": ["same abcd " * 9], "b": ["same wxyz " * 9], "c": ["other " * 9]})
    gram = langid.gram_hashes("same")[1:2]
    rows = [model.rows[model.places(gram, i, 18)] for i in range(2)]
    assert (rows[0] & rows[1])[0] == 0b011
    assert model.predict("same")[1] > 0 and model.predict("same wxyz")[0] == "b"
    many = {f"l{i:02}": [f"x{chr(97 + i % 26)}{chr(97 + i // 26)}q same"] for i in range(64)}
    wide = langid.LanguageFilters.learn(many)
    assert wide.predict("xcaq")[0] == "l02" and wide.predict("xkcq")[0] == "l62"
    with pytest.raises(ValueError):
        langid.LanguageFilters.learn(many | {"more": ["text"]})


def test_simhash_query_searches_the_radius(spark):
    found = QUERIES["op3_simhash"](spark, "/root/testdata/sf0.001").collect()
    prints = {int(r.fingerprint, 16) for r in found}
    near = {x: sum(0 < (x ^ y).bit_count() <= 3 for y in prints) for x in prints}
    assert all(r.n_near == near[int(r.fingerprint, 16)] for r in found)
    assert any(near.values()) and any(x >> 63 for x in prints)


def test_token_counts_come_from_one_table_of_prefixes(monkeypatch):
    tokens = word_tokens(public_tokenizers.path("word_bpe_49k.json"), True)
    text = "the quick brown fox jumps over it " * 9
    total, spans, asked = tokens.count(text), tokens.spans, []
    monkeypatch.setattr(tokens, "spans", lambda x: asked.append(x) or spans(x))
    assert token_counts.measure(text, tokens, total) == (len(text), total, False, None)
    n_bytes, n_tokens, over, fit = token_counts.measure(text, tokens, 10)
    assert (n_bytes, n_tokens, over) == (len(text), total, True) and tokens.count(text[:fit]) <= 10 < tokens.count(text[: fit + 2])
    assert asked == [text, text]


def test_ids_of_texts_need_no_tables_of_prefixes():
    tokens = WordTokens(public_tokenizers.path("word_bpe_49k.json"), True)
    assert tokens.ids("the cat") and "merges" not in vars(tokens)
    assert token_counts.UnitTables(tokens).merges is tokens.merges
