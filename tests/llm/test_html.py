"""Rendering of pages: structure, visibility, repair of broken markup."""

from __future__ import annotations

import random
import time

import pytest

from arealis.llm.html import extract, visible_text

CASES = {
    "": "",
    "plain &amp; simple &lt;b&gt;": "plain & simple <b>",
    "<p>one<p>two <b>bo</b>ld": "one\n\ntwo bold",
    "a<br>b<div>c</div>d": "a\nb\nc\nd",
    "<ul><li>x<li>y<ol><li>1st<li>2nd</ol><li>z</ul>": "- x\n- y\n  1. 1st\n  2. 2nd\n- z",
    "<ol start=7><li>a</li><li>b</li></ol>": "7. a\n8. b",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>b<td>22</table>": "Name       N\nlong name  1\nb          22",
    "<table><caption>T</caption><tr><td colspan=2>wide</td><td>x</td></tr><tr><td>a<td>b<td>c</table>": "T\nwide     x\na     b  c",
    "<head><title>t</title><style>p{}</style></head><body>seen<script>var a='</p>'</script></body>": "seen",
    "<div hidden>no</div><span style='display: none'>no</span><i style='color:red'>yes</i>": "yes",
    "<noscript>no</noscript><template>no</template><input type=hidden value=no><input value=ok>": "ok",
    "<pre> a\n  b</pre>": " a\n  b",
    "<!-- <p>no</p> -->yes<!-- open": "yes",
    "<p title=\"a>b\">x</p><img alt='a cat'>": "x\n\na cat",
    "<div>open <span>never closed": "open never closed",
    "</p></div>text</b>": "text",
    "a < b and c > d": "a < b and c > d",
    "<blockquote>q</blockquote>": "  q",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "<table>before<tr><td>in<div>side</div></td>stray<b>bold</b></tr></table>": "beforestraybold\n\nin side",
    "<h1>A</h1>b<hr>c": "A\n\nb\n\nc",
    "&eacute;&#233;&#x1F600;&nope;": "éé😀&nope;",
}


@pytest.mark.parametrize("page", CASES)
def test_rendering(page):
    assert visible_text(page) == CASES[page]


def test_nothing_visible_is_lost_and_nothing_hidden_shown():
    words = [f"w{i}" for i in range(200)]
    tags = ["p", "div", "b", "td", "li", "h2", "span", "section", "blockquote", "tr", "table"]
    page = "".join(f"<{tags[i % len(tags)]}> {w} " + (f"</{tags[i % 7]}>" if i % 3 == 0 else "") + "<script>zz</script>" for i, w in enumerate(words))
    got = visible_text(page).split()
    assert sorted(x for x in got if x.startswith("w")) == sorted(words) and "zz" not in got


def test_past_the_depth_hidden_stays_hidden():
    deep = "<div>" * 1000
    assert visible_text(deep + "a<p hidden>no<b>no<p>b<span style='display:none'>no<i>no</i></span> c").split() == ["a", "b", "c"]
    assert visible_text(deep + "<table><tr><td>a<td hidden>no<td>b<tr><td>c</table>d").split() == ["a", "b", "c", "d"]
    assert visible_text(deep + "<div hidden>" + "<div>" * 1000 + "no" + "</div>" * 1001 + "yes") == "yes"
    assert visible_text(deep + "<script>no</script><textarea>kept</textarea>").split() == ["kept"]


def test_open_elements_are_not_searched():
    page = "<x><button>" + "<b>" * 40000 + "</x>" * 40000 + "<p>" + "<b>" * 40000 + "</p>end"
    start = time.process_time()
    assert visible_text(page) == "end" and time.process_time() - start < 10


def test_inputs_that_show_a_value():
    showing = "text email tel url number date time search submit button reset odd".split()
    silent = "hidden password checkbox radio file color range".split()
    page = " ".join(f"<input type={t} value=v-{t}>" for t in [*showing, *silent]) + " <input type=image alt=pic value=no> <input value=plain>"
    assert visible_text(page).split() == [*(f"v-{t}" for t in showing), "pic", "plain"]


def test_cells_stand_at_the_place_of_their_column():
    rng = random.Random(3)
    for long in (5, 60, 119, 300):
        rows = [["".join(rng.choice("abc") for _ in range(rng.randint(1, long))) + f"{r}.{c}" for c in range(rng.randint(1, 5))] for r in range(20)]
        rows[7][0] += "<br>more"
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in row) for row in rows) + "</table>"
        got = visible_text(page).split("\n")
        flat = [[x.replace("<br>", " ") for x in row] for row in rows]
        width = [max((len(row[c]) for row in flat if c < len(row) and len(row[c]) <= 120), default=0) for c in range(5)]
        at = 0
        for row in flat:
            left = list(enumerate(row))
            while left:  # a line of output holds the next cells, each at its column
                line, first = got[at], True
                while left and (c := left[0][0]) is not None and line[(start := sum(width[:c]) + 2 * c) :].startswith(left[0][1]) and (first or line[start - 2 : start] == "  "):
                    del left[0]
                    first = False
                assert not first, (line, left)
                at += 1
        assert at == len(got)


def _random_tree(rng, depth):
    """A tag with attributes and children, or a word."""
    if depth == 0 or rng.random() < 0.3:
        return rng.choice("red green blue black white".split())
    tag = rng.choice("div div p b span ul section h2 script i".split())
    hide = rng.random() < 0.15
    kinds = {"p": ("b", "span", "i"), "h2": ("b", "span", "i"), "b": ("b", "i"), "span": ("b", "span"), "i": ("b", "i")}
    if tag == "ul":
        return tag, hide, [("li", rng.random() < 0.2, [_random_inline(rng)]) for _ in range(rng.randint(1, 3))]
    if tag == "script":
        return tag, hide, ["var", "x"]
    if tag in kinds:
        return tag, hide, [_random_inline(rng) for _ in range(rng.randint(1, 3))]
    return tag, hide, [_random_tree(rng, depth - 1) for _ in range(rng.randint(1, 4))]


def _random_inline(rng):
    word = rng.choice("one two three four".split())
    return word if rng.random() < 0.6 else (rng.choice(["b", "span", "i"]), rng.random() < 0.2, [word])


def _source(tree):
    if isinstance(tree, str):
        return tree + " "
    tag, hide, children = tree
    return f"<{tag}{' hidden' if hide else ''}>" + "".join(map(_source, children)) + f"</{tag}>"


def _blocks(tree):
    """By recursion: words, and breaks of one line (1) or with an empty line (2) between them."""
    if isinstance(tree, str):
        return [tree]
    tag, hide, children = tree
    if hide or tag == "script":
        return []
    inner = [x for c in children for x in _blocks(c)]
    if tag == "li":
        words = [x for x in inner if isinstance(x, str)]
        return [1, "- " + " ".join(words), 1] if words else [1]
    edge = {"div": [1], "section": [1], "p": [2], "h2": [2], "ul": [2]}.get(tag, [])
    return edge + inner + edge


def test_random_pages_against_a_recursive_renderer():
    rng = random.Random(11)
    for _ in range(500):
        tree = ("div", False, [_random_tree(rng, 4) for _ in range(4)])
        want, gap = "", 0
        for x in _blocks(tree):
            if isinstance(x, int):
                gap = max(gap, x)
            else:
                want += ({0: " ", 1: "\n", 2: "\n\n"}[gap] if want else "") + x
                gap = 0
        assert visible_text(_source(tree)) == want, _source(tree)


def test_deep_wide_and_odd_pages():
    assert visible_text("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    assert visible_text("<table><tr><td>" * 300 + "cell").split() == ["cell"]
    assert len(visible_text("<p>x" * 30000).split()) == 30000
    assert visible_text("<" * 5000) == "<" * 5000
    assert visible_text("<a " + "x='" * 3000) == ""
    assert visible_text(None) == "" and visible_text("\x00a") == "a"


def test_extraction_of_a_table(spark):
    rows = [(1, "<p>a", "old", None), (1, "<p>a", "old", None), (2, None, "old", 3), (3, "", None, None)]
    out = extract(spark.createDataFrame(rows, "page_id long, html string, text string, at int"))
    assert out.columns == ["page_id", "at", "text"]
    assert sorted((r["page_id"], r["text"]) for r in out.collect()) == [(1, "a"), (1, "a"), (2, ""), (3, "")]
    assert extract(spark.createDataFrame(rows, "page_id long, html string, text string, at int").limit(0)).count() == 0
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = [r["text"] for r in extract(pages).collect()]
    assert len(texts) == pages.count() and all(texts) and not any("track(" in t or "<p>" in t or "margin:0" in t for t in texts)
