"""Layout-aware text of HTML pages (operator 10).

A tokenizer of one regular expression feeds a tree builder that closes elements where HTML implies their end and opens
those that HTML implies (cells of a row). A renderer then walks the tree with a stack of its own, so depth is bounded
by memory alone, and emits every visible text: blocks on lines of their own, blank lines where browsers have margins,
list items behind markers with their lines aligned, preformatted text as it is, and table cells in padded columns.

Invisible: what browsers never paint (head, scripts, templates, media fallbacks), ``hidden`` and closed ``details`` or
``dialog`` elements, ``display: none``, and ``visibility: hidden`` down to a descendant that is made visible; from
``style`` attributes and from rules of ``style`` elements whose selector is a tag, a class, an id or a tag with one
of these, the strongest first: ``!important``, then the style attribute, then ids, classes, tags, and the later of equals. Rules in
conditional blocks count where the condition holds on a screen of 1280 by 720 pixels with a mouse; a condition that is not understood
does not hold, so its rules hide nothing.

Long and deep pages take linear time: what is open is counted by scope, indents are written once and no wider than ``INDENT``, a
cell spans no more columns than the table's longest row has cells, and tables inside ``TABLES`` others are not aligned but flow as blocks.

Defined cases: null and empty pages give an empty text; unclosed tags, comments and quotes never fail; a page whose tree can't be
rendered for an error of this module gives its text without tags and says so in the column ``error``, or ends the job where there is none; repeated rows and extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import pieces

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_NUMBER = re.compile(r"&#0*([0-9]+)")  # 8 digits are beyond any character
_WHITE = re.compile(r"[ \t\n\f\r]+")
_CSS = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|[{};]", re.S)
_AT_RULE = re.compile(r"@([\w-]+)(.*)\Z", re.S)
_FEATURE = re.compile(r"\(\s*([\w-]+)\s*(?::\s*([^()]+?)\s*)?\)\Z")
_LENGTH = re.compile(r"(\d*\.?\d+)(px|r?em)?\Z")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?\Z")

_words = lambda x: frozenset(x.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style xmp iframe noembed noframes textarea title plaintext")
NEVER = _words("head script style template title noscript iframe noembed noframes canvas audio video object datalist rp map colgroup")
BLOCK = _words("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption")
MARGIN = _words("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir")
LISTS = _words("ul ol menu dir")
ENDS_P = BLOCK - _words("body html li dd dt td th tr tbody thead tfoot caption option optgroup legend summary")
#: A start tag closes these open elements, up to one that bounds the search.
CLOSES = {
    "li": (_words("li"), LISTS),
    "dt": (_words("dt dd"), _words("dl")),
    "dd": (_words("dt dd"), _words("dl")),
    "option": (_words("option"), _words("select datalist")),
    "optgroup": (_words("option optgroup"), _words("select")),
    "tr": (_words("tr td th caption colgroup"), _words("table")),
    "td": (_words("td th"), _words("tr table")),
    "th": (_words("td th"), _words("tr table")),
    "tbody": (_words("tbody thead tfoot tr td th caption colgroup"), _words("table")),
    "thead": (_words("tbody thead tfoot tr td th caption colgroup"), _words("table")),
    "tfoot": (_words("tbody thead tfoot tr td th caption colgroup"), _words("table")),
    "rt": (_words("rt rp"), _words("ruby")),
    "rp": (_words("rt rp"), _words("ruby")),
    "body": (_words("head"), frozenset()),
}
SCOPE = _words("table td th caption html template object")
CELLS = _words("tr td th tbody thead tfoot")
INDENT = 64
TABLES = 16
SPAN = 1000


def _unescape(text: str) -> str:
    """``html.unescape``, which fails on references of more digits than an integer may have."""
    return html.unescape(_NUMBER.sub(lambda m: f"&#{m[1][:8]}", text) if "&#" in text else text)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if raw and not raw.isspace():
        for name, a, b, c in _ATTR.findall(raw):
            out.setdefault(name.lower(), _unescape(a or b or c))
    return out


class Tracker:
    """How many elements of ``tags`` are open above the innermost one of ``bound``."""

    def __init__(self, tags: frozenset[str], bound: frozenset[str]) -> None:
        self.tags, self.bound, self.counts = tags, bound, [0]

    def push(self, tag: str) -> None:
        if tag in self.bound:
            self.counts.append(0)
        if tag in self.tags:
            self.counts[-1] += 1

    def pop(self, tag: str) -> None:
        if tag in self.tags:
            self.counts[-1] -= 1
        if tag in self.bound:
            self.counts.pop()


class Stack:
    """The open elements. Every search for one ends at an element that the search closes, so all searches together are linear."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.opened, self.scopes = [root], {root.tag: 1}, [{}]
        self.trackers: dict[tuple[frozenset[str], frozenset[str]], Tracker] = {}
        self.by_tag: dict[str, list[Tracker]] = {}
        ends = [(frozenset([t]), (LISTS if t == "li" else _words("table")) - {t}) for t in (*sorted(CELLS), "li")]
        for tags, bound in {*CLOSES.values(), *ends, (_words("p"), SCOPE)}:
            self.trackers[tags, bound] = tracker = Tracker(tags, bound)
            for t in tags | bound:
                self.by_tag.setdefault(t, []).append(tracker)

    def push(self, node: Node) -> None:
        self.nodes[-1].children.append(node)
        tag = node.tag
        if tag in VOID:
            return
        self.nodes.append(node)
        self.opened[tag] = self.opened.get(tag, 0) + 1
        self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1
        if tag in SCOPE:
            self.scopes.append({})
        for tracker in self.by_tag.get(tag, ()):
            tracker.push(tag)

    def pop(self) -> str:
        tag = self.nodes.pop().tag
        self.opened[tag] -= 1
        if tag in SCOPE:
            self.scopes.pop()
        self.scopes[-1][tag] -= 1
        for tracker in self.by_tag.get(tag, ()):
            tracker.pop(tag)
        return tag

    def close_all(self, tags: frozenset[str], bound: frozenset[str]) -> None:
        """Close the outermost of ``tags`` above the innermost of ``bound``."""
        tracker = self.trackers[tags, bound]
        while len(self.nodes) > 1 and tracker.counts[-1]:
            self.pop()

    def close(self, tag: str, anywhere: bool) -> None:
        """Close the innermost ``tag``, unless it is outside the innermost scope."""
        if self.opened.get(tag) if anywhere else self.scopes[-1].get(tag):
            while len(self.nodes) > 1 and self.pop() != tag:
                pass


def build_tree(page: str) -> tuple[Node, list[str]]:
    """The document's root and the texts of its style sheets."""
    root = Node("html", {})
    stack, sheets, at = Stack(root), [], 0
    ends_p = (_words("p"), SCOPE)
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack.nodes[-1].children.append(_unescape(text) if "&" in text else text)
        if not m:
            return root, sheets
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack.nodes[-1].children.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack.push(Node("br", {}))
            elif tag in CELLS or tag == "li":
                stack.close_all(frozenset([tag]), (LISTS if tag == "li" else _words("table")) - {tag})
            elif tag not in ("html", "body"):
                stack.close(tag, tag in SCOPE)
            continue
        attrs = _attributes(m[3])
        if tag == "html" or tag == "body" and stack.opened.get("body"):
            continue
        if tag in ENDS_P:
            stack.close_all(*ends_p)
        if tag in CLOSES:
            stack.close_all(*CLOSES[tag])
        if tag in ("td", "th") and stack.nodes[-1].tag in ("table", "tbody", "thead", "tfoot"):
            stack.push(Node("tr", {}))
        stack.push(Node(tag, attrs))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            raw = page[at : end.start() if end else len(page)]
            if tag == "style":
                if _media(attrs.get("media", "")):
                    sheets.append(raw)
            elif tag in ("textarea", "title", "xmp", "plaintext"):
                stack.nodes[-1].children.append(_unescape(raw) if tag in ("textarea", "title") else raw)
            stack.pop()
            at = end.end() if end else len(page)


# --- visibility ---------------------------------------------------------------------------------------------


INHERITED = _words("inherit unset revert revert-layer")
VISIBILITY = INHERITED | _words("visible initial hidden collapse")
SCREEN = {"width": 1280.0, "height": 720.0}
FEATURES = {"orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference", "scripting": "none"}


def _feature(said: str) -> bool:
    """Whether a media feature in brackets holds on the assumed screen."""
    m = _FEATURE.match(said.strip())
    if not m:
        return False
    name, value = m[1].lower(), (m[2] or "").lower()
    side, _, base = name.rpartition("-")
    if base in SCREEN and side in ("", "min", "max"):
        if not value:
            return not side
        n = _LENGTH.match(value)
        if not n or not n[2] and float(n[1]):
            return False
        length = float(n[1]) * (1 if n[2] in (None, "px") else 16)
        return SCREEN[base] >= length if side == "min" else SCREEN[base] <= length if side == "max" else SCREEN[base] == length
    if name in FEATURES:
        return FEATURES[name] == value if value else FEATURES[name] not in ("none", "no-preference")
    return False


def _media(said: str) -> bool:
    """Whether a list of media queries holds on a screen."""
    for query in said.lower().split(",") if said.strip() else ["all"]:
        parts = re.split(r"\s+and\s+|\s+and(?=\()", query.strip())
        negated = re.match(r"not\s+(?=\w)", parts[0])
        parts[0] = re.sub(r"(?:not|only)\s+(?=\w)", "", parts[0], count=1)
        known = all(p in ("all", "screen", "print", "speech") or _FEATURE.match(p) for p in parts)
        if known and all(p in ("all", "screen") or _feature(p) for p in parts) != bool(negated):
            return True
    return False


def _applies(name: str, said: str) -> bool:
    """Whether the rules in a block of an at-rule count. Browsers support the declarations that ``@supports`` asks for, one by one or joined by ``and``."""
    if name == "media":
        return _media(said)
    if name == "supports":
        return all(_FEATURE.match(p.strip()) for p in re.split(r"\s+and\s+", said.strip()))
    return name == "layer"


def _css(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declaration) in the blocks that count. Blocks still open at the end close there."""
    stack: list[tuple[bool, str | None]] = [(True, None)]
    start = 0
    for m in _CSS.finditer(sheet + "}"):
        if m[0][0] in "\"'":
            continue
        text, start = sheet[start : m.start()].strip(), m.end()
        counts, selectors = stack[-1]
        if m[0] != "{":
            if counts and selectors is not None and text:
                yield selectors, text
            if m[0] == "}" and len(stack) > 1:
                stack.pop()
        elif text.startswith("@"):
            rule = _AT_RULE.match(text)
            stack.append((bool(counts and rule and _applies(rule[1].lower(), rule[2])), selectors))
        else:  # selectors in a rule are relative to its own
            stack.append((counts and selectors is None, text))


def _declared(style: str) -> dict[str, tuple[bool, str]]:
    """Of the properties that matter here, whether they are important and their values; the later of equally important ones."""
    out: dict[str, tuple[bool, str]] = {}
    for part in re.sub(r"/\*.*?\*/", "", style, flags=re.S).split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        value, mark, _ = value.partition("!")
        value = value.strip()
        if colon and name in ("display", "visibility", "white-space") and (name != "visibility" or value in VISIBILITY) and (bool(mark) or not out.get(name, (False,))[0]):
            out[name] = bool(mark), value
    return out


class Rules:
    """For each simple selector what it declares. A node asks for those that can name it, however many rules there are."""

    def __init__(self, sheets: list[str]) -> None:
        self.of: dict[tuple[str, str, str], dict[str, tuple]] = {}
        order = 0
        for sheet in sheets:
            for selectors, body in _css(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
                said = _declared(body)
                order += 1
                for s in selectors.split(",") if said else ():
                    m = _SELECTOR.match(s.strip())
                    if m and (m[1] or m[2]):
                        own = self.of.setdefault(((m[1] or "").lower(), m[2] or "", m[3] or ""), {})
                        strength = (m[2] == "#", m[2] == ".", bool(m[1]))
                        for name, (important, value) in said.items():
                            own[name] = max(own.get(name, ((False,),)), ((important, False, *strength, order), value))

    def style(self, node: Node) -> dict[str, str]:
        """The declarations that win for a node."""
        found: dict[str, tuple] = {}
        if self.of:
            marks = [(".", c) for c in set(node.attrs.get("class", "").split())] + [("#", node.attrs.get("id", ""))] + [("", "")]
            for mark, name in marks:
                for tag in (node.tag, ""):
                    for said, rated in self.of.get((tag, mark, name), {}).items():
                        found[said] = max(found.get(said, ((False,),)), rated)
        if "style" in node.attrs:
            for said, (important, value) in _declared(node.attrs["style"]).items():
                found[said] = max(found.get(said, ((False,),)), ((important, True), value))
        return {said: rated[1] for said, rated in found.items()}


def _unpainted(node: Node, said: dict[str, str], parent: Node) -> bool:
    if node.tag in NEVER or said.get("display") == "none":
        return True
    if "hidden" in node.attrs and "display" not in said:
        return True
    if node.tag == "dialog" and "open" not in node.attrs:
        return True
    return parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary"


# --- rendering ----------------------------------------------------------------------------------------------


class Lines:
    """Text that grows by words, lines and blocks of lines, some of which are indented behind a marker."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space, self.margin = False, 0
        self.opened = 0  # how many lines were begun
        self.indent, self.markers = 0, []  # what stands before a line: the width of markers used up, and those still to come
        self.items: list[tuple[str, int, int]] = []

    def word(self, text: str) -> None:
        if not self.now:
            self._open()
            self.now.append(self._before())
        elif self.space:
            self.now.append(" ")
        self.space = False
        self.now.append(text)

    def flow(self, text: str) -> None:
        """Inline text: white space is one space, and none at a line's ends."""
        text = _WHITE.sub(" ", text)
        if text[:1] == " ":
            self.space, text = True, text[1:]
        after = text[-1:] == " "
        if text[: len(text) - after]:
            self.word(text[: len(text) - after])
        self.space = self.space or after

    def _open(self) -> None:
        if self.lines:
            self.lines += [""] * self.margin
        self.margin = 0
        self.opened += 1

    def _before(self) -> str:
        """The indent of a line, with the markers of items that begin in it."""
        out = " " * min(self.indent, INDENT) + "".join(self.markers)
        self.indent += sum(map(len, self.markers))
        self.markers = []
        return out

    def line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now))
            self.now = []
        self.space = False

    def forced(self) -> None:
        """A line end that also makes empty lines."""
        if not self.now:
            self._open()
            self._before()
            self.lines.append("")
        self.line()

    def block(self, margin: int) -> None:
        self.line()
        if not self.items or self.items[-1][1] != self.opened:  # an item begins at its marker
            self.margin = max(self.margin, margin)

    def begin_item(self, marker: str, margin: int) -> None:
        self.block(margin)
        self.items.append((marker, self.opened, len(self.lines)))
        self.markers.append(marker)

    def end_item(self, margin: int) -> None:
        self.line()
        marker, opened, lines = self.items.pop()
        if opened == self.opened:
            self.markers.pop()
        else:
            self.indent -= len(marker)
            while len(self.lines) > lines and not self.lines[-1]:
                self.lines.pop()
            self.margin = 0
        self.block(margin)

    def exact(self, text: str) -> None:
        first, *rest = text.expandtabs(8).split("\n")
        if first:
            self.word(first)
        for x in rest:
            self.forced()
            if x:
                self.word(x)

    def add(self, lines: list[str]) -> None:
        if lines:
            self.line()
            self._open()
            self.lines += [self._before() + x if x else x for x in lines]

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns, rows) as lines with padded columns."""
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}
    most = max(map(len, rows), default=0)  # columns beyond that hold nothing of their own
    for row in rows:
        placed, col = {}, 0
        for lines, wide, tall in row:
            wide = min(wide, most)
            while taken.get(col, 0):
                col += 1
            placed[col] = (lines, wide)
            if tall > 1 or taken:
                for k in range(col, col + wide):
                    taken[k] = max(taken.get(k, 0), tall)
            col += wide
        grid.append(placed)
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
    widths: dict[int, int] = {}
    for narrow in (True, False):
        for placed in grid:
            for col, (lines, wide) in placed.items():
                need = max(map(len, lines), default=0)
                if (wide == 1) == narrow:
                    have = sum(widths.get(k, 0) for k in range(col, col + wide)) + 2 * (wide - 1)
                    if need > have:
                        widths[col + wide - 1] = widths.get(col + wide - 1, 0) + need - have
    starts, at = {}, 0
    for k in range(max(widths, default=-1) + 1):
        starts[k] = at
        at += widths.get(k, 0) + (2 if widths.get(k, 0) else 0)
    out = []
    for placed in grid:
        for n in range(max((len(lines) for lines, _ in placed.values()), default=0)):
            line, size = [], 0
            for col in sorted(placed):
                lines = placed[col][0]
                if n < len(lines) and lines[n]:
                    gap = max(0, starts.get(col, 0) - size)
                    line += [" " * gap, lines[n]]
                    size += gap + len(lines[n])
            out.append("".join(line).rstrip())
    return out


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "1").strip().lstrip("+0")
    if not (value.isascii() and value.isdigit()):
        return 1
    return min(SPAN, int(value[:5]))


def render(root: Node, sheets: list[str] | None = None) -> str:
    """All visible text below ``root``."""
    rules = Rules(sheets or [])
    out = Lines()
    buffers, tables, counters = [out], [], []
    # (node, parent, visible, preformatted), or a function to call when what stands above is done
    todo: list = [(root, root, True, False)]
    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        node, parent, visible, exact = item
        out = buffers[-1]
        if isinstance(node, str):
            if parent.tag == "details" and "open" not in parent.attrs:
                continue
            if visible and not (tables and tables[-1] is not None and parent.tag in ("table", "tr", "tbody", "thead", "tfoot")):
                out.exact(node) if exact else out.flow(node)
            elif visible and node.strip():
                buffers[0 if len(buffers) < 2 else -1].flow(node)
            continue
        said = rules.style(node)
        if node is not root and _unpainted(node, said, parent):
            continue
        if said.get("visibility", "inherit") not in INHERITED:
            visible = said["visibility"] in ("visible", "initial")
        tag = node.tag
        exact = said["white-space"].startswith(("pre", "break-spaces")) if "white-space" in said else exact or tag in ("pre", "textarea", "xmp", "plaintext")
        if tag == "br":
            if visible:
                out.forced()
            continue
        if tag == "input":
            kind = node.attrs.get("type", "text").lower()
            if visible and kind in ("button", "email", "number", "reset", "search", "submit", "tel", "text", "url") and node.attrs.get("value"):
                out.flow(node.attrs["value"])
            continue
        inner: list = [(c, node, visible, exact) for c in node.children]
        if tag == "pre" and inner and isinstance(inner[0][0], str):
            inner[0] = (inner[0][0].removeprefix("\r").removeprefix("\n"), *inner[0][1:])
        display = said.get("display", "")
        margin = int(tag in MARGIN and not (tag in LISTS and len(counters) > 0 and parent.tag == "li"))
        if tag == "select":
            options = [c for c in node.children if not isinstance(c, str)]
            options = [o for c in options for o in (c.children if c.tag == "optgroup" else [c]) if not isinstance(o, str)]
            inner = [(c, node, visible, exact) for o in ([o for o in options if "selected" in o.attrs] or options[:1]) for c in o.children]
        elif tag == "q":
            inner = [("“", node, visible, exact), *inner, ("”", node, visible, exact)]
        elif tag in ("tr", "td", "th") and tables and tables[-1] is not None:
            if tag == "tr":
                tables[-1].append([])
            else:
                if not tables[-1]:
                    tables[-1].append([])
                buffers.append(Lines())

                def cell(node: Node = node) -> None:
                    lines = buffers.pop().done()
                    tables[-1][-1].append((lines, _span(node, "colspan"), _span(node, "rowspan")))

                inner.append(cell)
        elif tag == "table":
            out.block(1)
            tables.append([] if len(tables) < TABLES else None)

            def table() -> None:
                rows = tables.pop()
                if rows is not None:
                    buffers[-1].add(_aligned([r for r in rows if r]))
                buffers[-1].block(1)

            inner.append(table)
        elif tag == "caption" and tables:
            buffers[-1].block(0)
            inner.append(lambda: buffers[-1].block(0))
        elif tag == "li" or tag in ("blockquote", "dd"):
            marker = "    "
            if tag == "li":
                marker = "- "
                if counters and counters[-1] is not None:
                    value = node.attrs.get("value", "").strip()
                    counters[-1] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else counters[-1]
                    marker = f"{counters[-1]}. "
                    counters[-1] += 1
            out.begin_item(marker, margin)
            inner.append(lambda out=out, margin=margin: out.end_item(margin))
        elif tag in LISTS:
            start = node.attrs.get("start", "1").strip()
            counters.append(None if tag != "ol" else int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)
            out.block(margin)

            def list_done(margin: int = margin) -> None:
                counters.pop()
                buffers[-1].block(margin)

            inner.append(list_done)
        elif (tag in BLOCK and not display.startswith("inline")) or display in ("block", "flex", "grid", "list-item", "table"):
            out.block(margin)
            inner.append(lambda margin=margin: buffers[-1].block(margin))
        todo.extend(reversed(inner))
    return "\n".join(x.rstrip() for x in buffers[0].done())


def page_text(page: str | None) -> str:
    """The visible text of a page."""
    return render(*build_tree(page)) if page else ""


def bare_text(page: str) -> str:
    """A page without its tags and comments, as a last resort."""
    return _WHITE.sub(" ", _unescape(_TOKEN.sub(" ", page))).strip()


def checked_text(page: str | None) -> tuple[str, str | None]:
    """``page_text`` and null, or of a page that it fails on ``bare_text`` and the error. Want of memory is not the page's."""
    try:
        return page_text(page), None
    except MemoryError:
        raise
    except Exception as e:  # noqa: BLE001
        return bare_text(page or ""), f"{type(e).__name__}: {e}"


def safe_text(page: str | None) -> str:
    """The text of ``checked_text``."""
    return checked_text(page)[0]


def extract_text(pages: DataFrame, page: str = "html", text: str = "text", error: str | None = None) -> DataFrame:
    """``pages`` with the column ``text`` in place of ``page``.

    With a column ``error``, null for every page that was rendered, one page does not end a job over many: it holds the error of
    ``checked_text``. Without one, a page that fails does.
    """
    at = pages.columns.index(page)
    made = [text] if error is None else [text, error]
    schema = T.StructType([*(f for f in pages.schema if f.name not in (page, *made)), *(T.StructField(c, T.StringType()) for c in made)])
    keep = [k for k, c in enumerate(pages.columns) if c not in (page, *made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [checked_text(x) if error is not None else (page_text(x), None) for x in b.column(at).to_pylist()]
            # characters that UTF-8 can't hold come from numeric references
            columns = [[None if x is None else x.encode("utf-8", "replace").decode() for x in c] for c in (zip(*found, strict=True) if found else ([], []))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(c, pa.string()) for c in columns[: len(made)])], schema.names)

    return pages.mapInArrow(run, schema)


def text_lengths(pages: DataFrame) -> DataFrame:
    """``extract_text`` with its errors and the number of characters and lines."""
    done = extract_text(pages, error="error")
    return done.withColumn("n_chars", F.length("text").cast("long")).withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
