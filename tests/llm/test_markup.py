"""Problem 2."""

import time

import pytest

from quillon.llm.markup import parse, render
from quillon.llm.wrapper import Node, align, clean_markup, fold, template_nodes, tree

PLAIN = [
    "If a < b and b > c then the two lists of X differ.", "The price of $5 to $9 per study.", "Both C# 7 and F# 4 were used.", "sold 40 % of it (see #12) in 1803",
    "The set {1, 2, 3} gives 2 * 3 = 6 for X [4].", "About ~20 meteors | 30 things were counted.", "says 2^10 things -> one envoy; see p. 3",
    "under D:\\store\\journal until 1757", "The names doc_count and is_live and __init__ stand.", "Fenn & Tarr sold AT&T", "the verbs - Each of them\n- and one wrapped line here",
    "wrapped 2\n* 3 = 6 melodies", "a < b and b\n> c then", "40\n% of it", "one\ntwo\n\nthree", "In 1984\n2020. Then more",
]
MARKED = [
    "<p>x", "a <b>b</b> c", "x <!-- c --> y", "x &nbsp; y", "a &#8217; b", "&lt;p&gt;x&lt;/p&gt;", '<a href="/pih', "x &amp;amp; y", "# Head\n\ntext", "Head\n----\n\nx", "* a\n* b", "1. a\n2. b",
    "x **b c** y", "x *b c* y", "x `c d` y", "x [l](http://a.b) y", "x[^1] y", "![i](a.png)", "~~a b~~", "| a | b |\n|---|---|\n| 1 | 2 |", "```\ncode\n```", "> quote", "[a b][1]",
    "== H ==", "[[a|b]]", "{{x|y}}", "''i j''", "#REDIRECT [[x]]", "{| class=x\n|-\n| a || b\n|}", "[http://x.y z]", "x<ref name=r /> y", "__NOTOC__", "; a\n: b", "# a\n## b",
    "\\section{H}", "x \\textbf{b} y", "$x_{1}$", "$$a^2$$", "\\(a\\)", "\\begin{itemize}\n\\item a\n\\end{itemize}", "``a b''", "x~\\cite{k}", "a\n\n% draft, X", "40 \\% of", "<math>x_1</math>",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    blocks, n = parse(text)
    assert n == 0
    assert "".join(" ".join(t for _, t in blocks).split()) == "".join(text.split())


@pytest.mark.parametrize("text", MARKED)
def test_marked(text):
    assert parse(text)[1] > 0


LONG = "many words of one passage " * 40 + "end"


@pytest.mark.parametrize(
    ("text", "clean"),
    [(f"x *{LONG}* y", f"x {LONG} y"), (f"x _{LONG}_ y", f"x {LONG} y"), (f"{LONG}\n====\n\nx", f"# {LONG}\n\nx"), (f"a [b c][{LONG}] d", "a b c d"), (f"a[^{'n' * 90}] b", "a b"), (f"a b\n\n[{LONG}]: http://x.y", "a b"), (f"x *{LONG}\n\n{LONG}* y", None)],
)
def test_long_pieces(text, clean):
    """A piece ends with its paragraph, not after some number of characters."""
    blocks, n = parse(text)
    assert (render(blocks), n) == (clean or text, int(clean is not None))


@pytest.mark.parametrize("text", ["*a " * 50_000, "_a " * 50_000, "[a" * 50_000, "[a]" * 50_000, "[a] [b " * 20_000, "[^a" * 50_000, "[a\n" * 50_000, "{{a|" * 50_000 + "}}" * 50_000, "[[a|" * 50_000 + "x" + "]]" * 50_000, "\\a{" * 50_000 + "x" + "}" * 50_000, "&" + "amp;" * 100_000 + "lt;b>", "<td>" * 50_000, "<ul><li>" * 20_000, "*" + "a " * 100_000, "_" + "a " * 100_000])
def test_long_texts_end_soon(text):
    began = time.perf_counter()
    parse(text)
    assert time.perf_counter() - began < 20


def test_structure_stays():
    html = "<h2>Head &amp; more</h2><p>One <b>two</b></p><ul><li>a</li><li>b</li></ul><pre><code>x &lt; 1\n  y</code></pre><table><tr><th>A</th><td>1</td></tr></table><blockquote>q</blockquote>"
    assert render(parse(html)[0]) == "## Head & more\n\nOne two\n\n- a\n- b\n\n```\nx < 1\n  y\n```\n\nA | 1\n\n> q"
    wiki = "== Head ==\nOne [[x|two]]{{cite|{{y}}}}<ref>r</ref>.\n\n* a\n** b\n\n<math>x_1</math>\n\n{| class=w\n! A !! B\n|-\n| 1 || 2\n|}\n[[Category:C]]"
    assert render(parse(wiki)[0]) == "## Head\n\nOne two.\n\n- a\n  - b\n\n$$x_1$$\n\nA | B\n1 | 2"
    tex = "\\section{Head}\nOne \\textbf{two}\\footnote{f} \\(a_1\\).\n\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\n$$\\sum_i$$\n\n\\begin{verbatim}\nx = {1}\n\\end{verbatim}\n\n\\begin{tabular}{lr}\nA & B \\\\\n1 & 2 \\\\\n\\end{tabular}"
    assert render(parse(tex)[0]) == "## Head\n\nOne two $a_1$.\n\n- a\n- b\n\n$$\\sum_i$$\n\n```\nx = {1}\n```\n\nA | B\n1 | 2"
    md = "Head\n====\n\nOne **two** [l](http://x).\n\n1. a\n2. b\n\n~~~\nx\n~~~\n\n| A | B |\n|---|---|\n| 1 | 2 |"
    assert render(parse(md)[0]) == "# Head\n\nOne two l.\n\n1. a\n2. b\n\n```\nx\n```\n\nA | B\n1 | 2"


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("{{t0|" * 40 + "x" + "}}" * 40 + " tail", "tail"), ("[[a|" * 40 + "x" + "]]" * 40 + " tail", "x tail"), ("\\emph{" * 40 + "x" + "}" * 40 + " tail", "x tail"),
        ("&" + "amp;" * 40 + "lt;b>x&lt;/b>", "x"), ("{{a|{{{1}}}}} b", "b"), ("\\textbf{a {b} c}", "a {b} c"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a | b\nc"), ("<table>\n<tr>\n<td>a</td>\n<td>b</td>\n</tr>\n</table>", "a | b"), ("<table><tr><td>a</td><td></td><td>b</td></tr></table>", "a |  | b"),
        ("<ol><li>x<ul><li>y</li></ul></li><li>z</li></ol>", "1. x\n  - y\n2. z"), ("- a\n  - b\n    - c\n- d", "- a\n  - b\n    - c\n- d"), ("3) a\n4) b", None), ("# a\n# b\n## c\n# d", "1. a\n2. b\n  1. c\n3. d"),
        ("\\begin{enumerate}\n\\item a\n\\begin{itemize}\n\\item b\n\\end{itemize}\n\\item c\n\\end{enumerate}", "1. a\n  - b\n2. c"),
        ("```python\nx = 1\n```", "```python\nx = 1\n```"), ('<syntaxhighlight lang="rust">fn</syntaxhighlight>', "```rust\nfn\n```"),
    ],
)
def test_any_depth_and_what_lists_and_code_say(text, clean):
    blocks, n = parse(text)
    assert (render(blocks), n > 0) == (text if clean is None else clean, clean is not None)


@pytest.mark.parametrize("text", [None, "", "   ", "<", "&", "[[", "{{" * 500, "<p" * 500, "*" * 3000, "$" * 999, "`" * 999, "\\" * 500, "a" * 300_000, "''" * 999, "<b>" * 2000, "[" * 2000, "= " * 2000, "{|\n" * 300])
def test_odd_texts_end(text):
    blocks, _ = parse(text)
    render(blocks)


def test_alignment():
    a = tree(["h2", "p", "li", "li", "p"], [1, 2, 3, 4, 9])
    b = tree(["p", "li", "p"], [7, 3, 9])
    weight, pairs = align(a, b)
    assert [(a[i].tag, b[j].tag) for i, j in pairs] == [("p", "p"), ("ul", "ul"), ("p", "p")]
    assert weight == 2 + (2 + 2 + 1) + 3
    template = fold(a, b)
    assert [n.tag for n in template] == ["h2", "p", "ul", "p"]
    assert template[3].texts == {9: 2} and template[1].texts == {2: 1, 7: 1}
    assert fold([], b) == b and isinstance(b[0], Node)


def test_template_is_left_out(spark):
    rows = [("document", i, "h", f"<h1>Title</h1><p>content number {i}</p><p>This page is kept by h.</p>", "x") for i in range(40)]
    rows += [("document", 100 + i, "h", f"plain {i}\n\nThis page is kept by h.", "x") for i in range(5)]
    rows += [("document", 200, "other", "This page is kept by h.", "x"), ("document", 201, None, None, "x"), ("document", 202, "h", "", "x"), ("document", 203, "h", "copied", "x")] + [("document", 300, "h", "copied", "x")] * 30
    df = spark.createDataFrame(rows, "kind string, id long, host string, text string, clean string")
    found = {}
    for r in clean_markup(df, block=16).collect():
        found[r["record_id"]] = r
    assert found[3]["clean"] == "# Title\n\ncontent number 3" and found[3]["template_blocks"] == 1 and found[3]["pieces"] > 0
    assert found[101]["clean"] == "plain 1" and found[101]["pieces"] == 0
    assert found[200]["clean"] == "This page is kept by h."
    assert found[201]["clean"] == "" and found[202]["clean"] == "" and found[300]["clean"] == "copied"
    assert clean_markup(df).count() == len(rows)
    assert clean_markup(df.limit(0)).count() == 0


def test_template_of_a_small_share(spark):
    """Five pages make a template on a large host too, with templates broadcast or joined."""
    rows = [("document", i, "h", f"text number {i}" + ("\n\nThis page is kept by h." if i < 5 else "\n\nKept by few." if i < 9 else "")) for i in range(600)]
    df = spark.createDataFrame([*rows, rows[0], ("document", 600, "h", ""), ("document", 601, "g", "This page is kept by h.")], "kind string, id long, host string, text string")
    for limit in (100, 0):
        found = {r["record_id"]: r for r in clean_markup(df, block=1000, limit=limit).collect()}
        assert [found[i]["clean"] for i in (0, 4, 9)] == ["text number 0", "text number 4", "text number 9"]
        assert found[5]["clean"] == "text number 5\n\nKept by few." and found[601]["clean"] == "This page is kept by h."
        assert sum(r["template_blocks"] for r in found.values()) == 5 and len(found) == 602


def test_template_over_blocks(spark):
    """Pages are counted exactly, also where no block has a text twice, or has it twice a page."""
    rows = [("document", i, "h", f"text number {i}" + ("\n\nKept by h." if i < 6 else "\n\nKept by few.\n\nKept by few." if i < 10 else "")) for i in range(40)]
    df = spark.createDataFrame(rows, "kind string, id long, host string, text string")
    for block in (1, 8, 64):
        found = {r["record_id"]: r for r in clean_markup(df, block=block).collect()}
        assert [found[i]["clean"] for i in range(6)] == [f"text number {i}" for i in range(6)]
        assert found[6]["clean"] == "text number 6\n\nKept by few.\n\nKept by few."
        assert sum(r["template_blocks"] for r in found.values()) == 6


@pytest.mark.parametrize("block", [16, 64, 500])
def test_footers_of_a_large_host_at_any_block(spark, block):
    """A footer on 1.1 % of the pages of a host is found and counted exactly, whatever the blocks."""
    footers = {"Kept by one.": 18, "Kept by  two.": 20, "Kept by three.": 25, "Kept by four.": 4}
    rows = []
    for text, n in footers.items():
        rows += [("document", len(rows) + i, "h", f"page number {len(rows) + i}\n\n{text}") for i in range(n)]
    rows += [("document", i, "h", f"page number {i}\n\nend of {i}") for i in range(len(rows), 1600)]
    df = spark.createDataFrame(rows, "kind string, id long, host string, text string").repartition(4)
    assert {tuple(r) for r in template_nodes(df, block=block).collect()} == {("h", "Kept by one.", 18), ("h", "Kept by two.", 20), ("h", "Kept by three.", 25)}
