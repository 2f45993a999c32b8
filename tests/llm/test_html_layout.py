"""Layout of pages: what the standard's parser does to odd ones, and a plain reader of lists, tables and preformatted text."""

import random
import unicodedata

from turnweave.llm import html_text

show = html_text.render


def test_text_ends_the_head():
    assert show("<head><title>x</title>Hello<p>World") == "Hello\n\nWorld"
    assert show("<html><head>Intro text</head><body>b") == "Intro text\nb"
    assert show("<head> \n <meta charset=x> <title>no</title> </head>yes") == "yes"
    assert show("<head>&nbsp;<style>no</style>yes") .endswith("yes")


def test_content_that_browsers_hide_or_show_as_it_is():
    assert show("a<noframes>hid</noframes>b<noembed><p>hid</noembed>c") == "abc"
    assert show("a<xmp><b>x</b> &amp;</xmp>b") == "a\n\n<b>x</b> &amp;\n\nb"
    assert show("a<plaintext>b<c>\n  d</plaintext>e") == "a\n\nb<c>\n  d</plaintext>e"
    assert show("<p>a<pre>\n b</pre>c") == "a\n\n b\n\nc" and show("<listing>\nx  y</listing>") == "x  y"


def test_numbers_of_lists():
    assert show("<ol start=3 reversed><li>a<li value=9>b<li>c</ol>") == "3. a\n9. b\n8. c"
    assert show("<ol reversed><li>a<li hidden>no<li>b</ol>") == "2. a\n1. b"
    assert show("<ol start=x><li>a<li value=x>b<li value=-1>c<li>d</ol>") == "1. a\n2. b\n-1. c\n0. d"
    assert show("<ul><li value=5>a<li>b</ul>") == "- a\n- b"
    assert show("<table><tr><td>x</td></tr><ol start=4><li>in</ol></table>").split("\n")[0] == "4. in"


def test_wide_characters_line_up():
    assert show("<table><tr><td>名前<td>x<tr><td>abc<td>y</table>") == "名前  x\nabc   y"
    assert show("<table><tr><td>é<td>x<tr><td>ab<td>y</table>") == "é   x\nab  y"


# A plain reader: nested lists, tables of single cells, paragraphs and pre, of known trees.


def width(text):
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def made(depth, rng):
    """(html, lines, spaced) of a random block."""
    word = lambda: rng.choice(["alpha", "be ta", "名前", "x", "ü", "1 < 2"])
    shown = lambda w: w.replace("<", "&lt;")
    kind = rng.choice(["p", "div", "pre", "table", "ul", "ol"] if depth < 3 else ["p", "div"])
    if kind in ("p", "div"):
        w = word()
        return f"<{kind}>{shown(w)}</{kind}>", [w], kind == "p"
    if kind == "pre":
        lines = [rng.choice(["  a", "b  b", "c"]) for _ in range(rng.randint(1, 3))]
        return "<pre>" + "\n".join(lines) + "</pre>", lines, True
    if kind == "table":
        rows = [[word() for _ in range(3)] for _ in range(rng.randint(1, 3))]
        widths = [max(width(r[c]) for r in rows) for c in range(3)]
        lines = []
        for r in rows:
            line = ""
            for c in range(3):
                line += " " * (sum(widths[:c]) + 2 * c - width(line)) + r[c]
            lines.append(line)
        return "<table>" + "".join("<tr>" + "".join(f"<td>{shown(w)}</td>" for w in r) + "</tr>" for r in rows) + "</table>", lines, True
    start, step = rng.choice([(1, 1), (4, 1), (7, -1)])
    source, lines = "", []
    for k in range(rng.randint(1, 3)):
        w = word()
        inner, below = "", []
        if depth < 2 and rng.random() < 0.4:
            inner, below, spaced = made(depth + 3, rng)
            below = ([""] if spaced else []) + below
        mark = "- " if kind == "ul" else f"{start + k * step}. "
        # An item's text and a block in it: the block stands below the text, two columns in.
        lines += [mark + w] + [("  " + x if x else x) for x in below]
        source += f"<li>{shown(w)}{inner}</li>"
        if inner and below[0] == "":
            lines.append("\x00")  # a paragraph is followed by an empty line, if anything follows
    attributes = "" if kind == "ul" else f" start={start}" + (" reversed" if step < 0 else "")
    return f"<{kind}{attributes}>{source}</{kind}>", lines, True


def read(blocks):
    out, gap = [], 0
    for _, lines, spaced in blocks:
        need = 2 if spaced else 1
        if out and max(gap, need) == 2:
            out.append("")
        out += lines
        gap = need
    flat = []
    for line in out:
        if line == "\x00":
            line = ""
        if line or (flat and flat[-1]):
            flat.append(line)
    while flat and not flat[-1]:
        flat.pop()
    return "\n".join(flat)


def test_plain_reader():
    rng = random.Random(4)
    for _ in range(600):
        blocks = [made(0, rng) for _ in range(rng.randint(1, 4))]
        source = "".join(b[0] for b in blocks)
        assert show(source) == read(blocks), source
