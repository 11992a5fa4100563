from html.parser import HTMLParser

import pyarrow as pa
import pytest

from termweave.llm.html_text import extract_text, page_text, text_lengths


class Plain(HTMLParser):
    """The words that stand outside unpainted elements, found by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "template", "noscript") or "hidden" in dict(attrs):
            self.off.append(tag)

    def handle_endtag(self, tag):
        if self.off and self.off[-1] == tag:
            self.off.pop()

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_words_equal_the_standard_parser(duck):
    for (page,) in duck.execute("select html from pages").fetchall():
        plain = Plain()
        plain.feed(page)
        plain.close()
        text = "\n".join(x.removeprefix("- ") for x in page_text(page).split("\n"))
        assert "".join(text.split()) == "".join("".join(plain.words).split())


def test_blocks_and_inline_spacing():
    assert page_text("<p>a<b>b</b>  c<br>d<p>e<div>f</div><div> g </div>h") == "ab c\nd\n\ne\n\nf\ng\nh"
    assert page_text("<h1>t</h1>\n\n<section>x</section><hr>y") == "t\n\nx\n\ny"
    assert page_text("<pre>\n a  b\n\tc</pre>z") == " a  b\n        c\n\nz"
    assert page_text("a<br><br>b &lt;i&gt; &amp;amp; 1 < 2") == "a\n\nb <i> &amp; 1 < 2"
    assert page_text("<blockquote>q<p>r</blockquote><dl><dt>t<dd>d</dl>") == "    q\n\n    r\n\nt\n    d"


def test_lists():
    assert page_text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "- a\n- b\n  - c\n- d"
    assert page_text('<ol start=9><li>a<li>b<br>c<li value="20">d</ol>') == "9. a\n10. b\n    c\n20. d"


def test_tables_are_aligned():
    assert page_text("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td>Tea<td>12</table>") == "Name       Qty\nApple pie  3\nTea        12"
    assert page_text("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide cell</table>") == "a  b\n   c\nwide cell"
    assert page_text("<table><td>in<table><td>x<td>y</table><td>z</table>") == "in    z\n\nx  y"
    assert page_text("<table><caption>cap</caption><tr><td>1<br>2<td>3</table>") == "cap\n1  3\n2"


def test_visibility():
    page = "<style>.x, #i {display:none} b.k{visibility:hidden}</style><p class='a x'>1</p><p id=i>2</p><p style='DISPLAY: none'>3</p><p hidden>4</p>"
    page += "<div style='visibility:hidden'>5<i style='visibility:visible'>6</i></div><b class=k>7</b><script>8</script><noscript>9</noscript><details>10<summary>11</summary>12</details><details open>13</details>"
    page += "<select><option>14<option selected>15</select><input value=16><input type=hidden value=17><textarea>18</textarea><template>19</template>"
    assert page_text(page).split() == ["6", "11", "13", "151618"] or page_text(page).split() == ["6", "11", "13", "15", "16", "18"]


def test_broken_and_deep_pages():
    for page in ("<", "<a", "<a href='x", "<!--", "<!-- a -- b", "<script>x", "</p></div>", "<p <b>>x", "&#xD800;&#0;&bogus;", "<![CDATA[x", "<?php x", "<table><li><td></ul>"):
        page_text(page)
    assert page_text("<div>" * 20000 + "x") == "x"
    assert page_text("<ul><li>" * 200 + "x").endswith("x")
    assert page_text("<p>a" * 5000).count("a") == 5000


def test_frames(spark, sf_dir):
    rows = spark.createDataFrame([(1, "<p>a", "u", "old"), (2, None, None, None), (2, None, None, None), (3, "", "u", "x"), (4, "&#xD800;", "u", "x")], "page_id long, html string, url string, text string")
    got = extract_text(rows)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(str, ((r["page_id"], r["text"]) for r in got.collect())))[:4] == ["(1, 'a')", "(2, '')", "(2, '')", "(3, '')"]
    assert text_lengths(rows.limit(0).drop("text")).count() == 0


def test_conditional_rules_count_only_on_a_screen():
    hide = lambda block: page_text(f"<style>{block}</style><p class=x>a</p><p>b</p>").split()
    for block in ("@media print{.x{display:none}}", "@media (max-width: 600px){.x{display:none}}", "@media print{@media all{.x{display:none}}} p{color:red}", "@media not screen{.x{display:none}}", "@supports not (display: grid){.x{display:none}}", "@media (unknown: 3){.x{display:none}}", "@media print{.x{display:none}", ".x{@media print{display:none}}", "@container (min-width: 1px){.x{display:none}}", "@media print{p{content:'}'} .x{display:none}}"):
        assert hide(block) == ["a", "b"], block
    for block in (".x{display:none}", "@media screen{.x{display:none}}", "@media print,screen and (min-width:40em){.x{display:none}}", "@import url(a);.x{display:none}", "@supports (display: grid){.x{display:none}}", "@layer a{.x{display:none}}", "@media print{p{color:red}} .x{display:none}", "@media not print{.x{display:none}}", ".x{display:none", ".x{@media screen{display:none}}"):
        assert hide(block) == ["b"], block
    assert page_text("<style media=print>.x{display:none}</style><p class=x>a") == "a"
    assert hide("@media all{" * 20000 + ".x{display:none}") == ["b"]


def test_inherited_and_initial_visibility():
    shown = lambda outer, inner: page_text(f"<div style='visibility:{outer}'><i style='visibility:{inner}'>a</i></div>") == "a"
    for value in ("inherit", "unset", "revert", "bogus"):
        assert shown("visible", value) and not shown("hidden", value)
    assert shown("hidden", "initial") and shown("hidden", "visible")
    assert not shown("visible", "hidden") and not shown("visible", "collapse")


def test_the_strongest_rule_counts():
    shown = lambda css, tag="<p id=i class=x>": page_text(f"<style>{css}</style>{tag}a</p>") == "a"
    assert shown("#i{display:block} p{display:none}") and not shown("p{display:block} #i{display:none}")
    assert shown(".x{display:block} p{display:none}") and shown("#i{display:block} .x{display:none} p.x{display:none}")
    assert shown("p{display:block !important} #i{display:none}") and not shown("p{display:none! important} #i{display:block}")
    assert shown("p{display:none} p{display:block}") and not shown("p{display:block} p{display:none}") and shown("p{display:block!important;display:none}")
    assert not shown("#i{display:block}", "<p id=i style='display:none'>") and shown("p{display:block !important}", "<p style='display:none'>")
    assert not shown("p{display:block !important}", "<p style='display:none !important'>")


def test_spans_of_any_length():
    assert page_text(f"<table><tr><td colspan={'9' * 5000}>a<td>b<tr><td rowspan={'1' * 5000}>c<td>d<tr><td>e</table>").split() == ["a", "b", "c", "d", "e"]
    assert page_text("<table><tr><td colspan=00002>wide<tr><td>a<td colspan=x>b<td colspan=0>c<td colspan=-1>d</table>") == "wide\na  b  c  d"


def test_long_and_deep_pages_take_linear_time():
    import time

    n = 20_000
    pages = {
        "lists": "<ul><li>x" * n, "divs": "<div>" * n + "x", "object": "<p><object>" + "<div>" * n, "items": "<ul>" + "<div>" * n + "<li>y" * n, "quotes": "<blockquote>x" * n,
        "ends": "<b><table>" + "<i>" * n + "</b>" * n, "cells": "<table><tr>" + "<td colspan=1000>x" * 2000, "tables": "<table><td>x" * 5000, "rows": "<table>" + "<tr><td colspan=1000>x" * n,
        "rules": "<style>" + "".join(f".c{k}{{display:none}}" for k in range(4000)) + "</style>" + "".join(f"<p class=c{k + 1} id=i{k}>x" for k in range(4000)),
        "same": "<style>" + ".x{display:none}" * 4000 + "</style>" + "".join(f"<p class=x id=i{k}>x" for k in range(4000)),
    }
    for name, page in pages.items():
        began = time.process_time()
        text = page_text(page)
        assert time.process_time() - began < 5, name
        assert len(text) < 100 * len(page), name
    assert page_text(pages["lists"]).count("x") == n and page_text(pages["tables"]).count("x") == 5000


def test_items_that_begin_with_blocks():
    assert page_text("<ul><li><p>a<p>b</li><li></li><li><ul><li>c</ul></ul>z") == "- a\n\n  b\n- - c\n\nz"
    assert page_text("<p>k<ul><li>a<br><br></li></ul><p>b") == "k\n\n- a\n\nb"
    assert page_text("<ol><li><table><tr><td>a<td>b<tr><td>c<td>d</table>e</ol>") == "1. a  b\n   c  d\n\n   e"


def test_a_page_that_fails_gives_its_bare_text(spark, monkeypatch):
    from termweave.llm import html_text

    monkeypatch.setattr(html_text, "render", lambda *a: 1 / 0)
    assert html_text.safe_text("<p>a &amp; <b>b</b><!-- c -->\n<i>d") == "a & b d" and html_text.safe_text(None) == ""


def test_a_page_that_fails_is_told_from_one_that_does_not(spark, monkeypatch):
    from termweave.llm import html_text

    class Here:
        """A table whose functions run in this process, where they can be made to fail."""

        columns, schema = ["page_id", "html"], spark.createDataFrame([], "page_id long, html string").schema

        def mapInArrow(self, function, schema):
            rows = pa.RecordBatch.from_pydict({"page_id": [1, 2], "html": ["<p>a<p>b", "<style>bad</style><p>a<p>b"]})
            return [list(b.to_pydict().items()) for b in function(iter([rows]))]

    whole = html_text.render

    def render(root, sheets=None):
        if "bad" in sheets:
            raise KeyError("x")
        return whole(root, sheets)

    monkeypatch.setattr(html_text, "render", render)
    assert extract_text(Here(), error="error") == [[("page_id", [1, 2]), ("text", ["a\n\nb", "bad a b"]), ("error", [None, "KeyError: 'x'"])]]
    with pytest.raises(KeyError):
        extract_text(Here())

    def full(*a):
        raise MemoryError

    monkeypatch.setattr(html_text, "render", full)
    with pytest.raises(MemoryError):
        html_text.safe_text("<p>a")


def test_long_numeric_references(spark):
    texts = {"<p>a&#" + "9" * 5000 + ";b": "a\ufffdb", "<p>&#" + "0" * 5000 + "65;": "A", "<p>&#65;&#x42;&#0;&#;&#y": "AB\ufffd&#;&#y"}
    rows = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    assert [(r["text"], r["error"]) for r in text_lengths(rows).orderBy("page_id").collect()] == [(x, None) for x in texts.values()]


def make_block(rnd, depth, inside_item=False):
    """A random block as (html, lines, margin), rendered from its structure without any parsing."""
    words = lambda: [rnd.choice(["alpha", "be", "c&d", "<x>", "long-word", "é中"]) for _ in range(rnd.randint(1, 4))]
    escape = lambda x: x.replace("&", "&amp;").replace("<", "&lt;")

    def inline():
        parts = words()
        shown = [rnd.choice(["{}", "<b>{}</b>", "<i> {} </i>", "<span style='color:red'>{}</span>"]).format(escape(w)) for w in parts]
        gone = rnd.choice(["", "<script>no</script>", "<b hidden>no</b>", "<i style='display:none'>no</i>", "<!-- no -->"])
        return rnd.choice([" ", "\n  "]).join(shown) + gone, " ".join(parts)

    kind = rnd.choice(["p", "h2", "pre", "table", "text"] + (["div", "ul", "ol", "blockquote", "hidden"] * 2 if depth else []))
    if kind in ("p", "h2"):
        code, text = inline()
        return f"<{kind}>{code}</{kind}>" if kind == "h2" or rnd.random() < 0.7 else f"<p>{code}", [text], 1
    if kind == "text":
        (code, text), (more, other) = inline(), inline()
        return f"<div>{code}<br>{more}</div>", [text, other], 0
    if kind == "pre":
        lines = [" " * rnd.randint(0, 3) + "  ".join(words()) for _ in range(rnd.randint(1, 3))]
        return "<pre>" + escape("\n".join(lines)) + "</pre>", lines, 1
    if kind == "table":
        rows = [[inline() for _ in range(3)] for _ in range(rnd.randint(1, 3))]
        wide = [max(len(r[c][1]) for r in rows) for c in range(3)]
        starts = [0, wide[0] + 2, wide[0] + wide[1] + 4]
        lines = []
        for r in rows:
            line = ""
            for c in range(3):
                line = line.ljust(starts[c]) + r[c][1]
            lines.append(line)
        cell = rnd.choice(["<td>{}</td>", "<td>{}"])
        return "<table>" + "".join("<tr>" + "".join(cell.format(code) for code, _ in r) for r in rows) + "</table>", lines, 1
    if kind == "hidden":
        code, _, _ = make_block(rnd, depth - 1)
        kept = make_block(rnd, depth - 1, inside_item)
        return f"<div style='display: none'>{code}</div>" + kept[0], kept[1], kept[2]
    if kind == "div":
        code, lines, first, last = make_blocks(rnd, depth - 1)
        return f"<div>{code}</div>", lines, (first, last)
    if kind == "blockquote":
        code, lines, _, _ = make_blocks(rnd, depth - 1)
        return f"<blockquote>{code}</blockquote>", ["    " + x if x else x for x in lines], 1
    codes, lines = [], []
    for k in range(rnd.randint(1, 3)):
        code, own, _, _ = make_blocks(rnd, depth - 1, True)
        marker = "- " if kind == "ul" else f"{k + 1}. "
        codes.append(f"<li>{code}" + rnd.choice(["", "</li>"]))
        lines += [(marker if n == 0 else " " * len(marker)) + x if x else x for n, x in enumerate(own)]
    return f"<{kind}>{''.join(codes)}</{kind}>", lines, 0 if inside_item else 1


def make_blocks(rnd, depth, inside_item=False):
    """Blocks one after the other, (html, lines, margin before, margin after); the wider of two margins parts them."""
    code, lines, margin, first = "", [], 0, 0
    for k in range(rnd.randint(1, 3)):
        more, own, around = make_block(rnd, depth, inside_item)
        before, after = around if isinstance(around, tuple) else (around, around)
        lines += ([""] * max(margin, before) if k else []) + own
        first = first if k else before
        margin = after
        code += more
    return code, lines, first, margin


def test_random_pages_equal_a_renderer_of_their_structure():
    import random

    rnd = random.Random(12)
    for _ in range(1500):
        code, lines, _, _ = make_blocks(rnd, 3)
        assert page_text(code) == "\n".join(x.rstrip() for x in lines), code
