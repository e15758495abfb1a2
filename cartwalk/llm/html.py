"""HTML extraction by layout-aware rendering.

A tree builder supplies the tags HTML lets authors leave out, visibility rules
take out what a browser would not show, and a renderer emits all visible text
the way it is laid out: blocks on lines of their own with the spacing of their
kind, lists with bullets, numbers and indentation, preformatted text as it is, and
tables with aligned cells.  Nothing is scored or dropped as boilerplate.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartwalk.llm.common import plain, quoted, ready

# Fixed values of the HTML standard, as far as the renderer needs them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split())
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
UNSEEN = set("area audio base basefont canvas col colgroup datalist embed frame frameset head iframe link meta noembed noframes "
             "noscript object param rp script source style template title track video".split())
# Inside svg or math only.
FOREIGN_UNSEEN = {"svg": set("clippath defs desc marker mask metadata pattern symbol title".split()),
                  "math": set("annotation annotation-xml mphantom".split())}
# Parts of these stand at places of their own, so their words don't run together.
MATH_APART = set("mfrac mmultiscripts mover mroot msub msubsup msup mtable mtr munder munderover".split())
# An opening tag closes these, unless one of the walls lies between.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th", "caption"), "td": ("td", "th"), "th": ("td", "th"), "rt": ("rt", "rp"), "rp": ("rt", "rp"),
    "thead": ("caption", "thead", "tbody", "tfoot", "tr", "td", "th"), "tbody": ("caption", "thead", "tbody", "tfoot", "tr", "td", "th"),
    "tfoot": ("caption", "thead", "tbody", "tfoot", "tr", "td", "th"), "body": ("head",),
}
WALLS = {
    "li": {"ul", "ol", "menu", "dir", "table"}, "dt": {"dl", "table"}, "dd": {"dl", "table"}, "option": {"select", "datalist"},
    "optgroup": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"},
    "tfoot": {"table"}, "rt": {"ruby"}, "rp": {"ruby"}, "body": set(),
}
P_CLOSERS = BLOCK - {"body", "html", "legend"}
P_WALLS = {"button", "caption", "table", "td", "th", "object"}
# Deeper elements become siblings, deeper tables plain blocks.
MAX_DEPTH, MAX_TABLES = 512, 30
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Tags to a tree of nodes and strings, with implied tags supplied."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.title: list[str] = []

    def _close(self, tags, walls) -> None:
        """Close the innermost of ``tags`` above any wall, repeatedly."""
        while True:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in tags:
                    del self.open[i:]
                    break
                if self.open[i].tag in walls:
                    return
            else:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in P_CLOSERS:
            self._close(("p",), P_WALLS)
        if tag in CLOSES:
            self._close(CLOSES[tag], WALLS[tag])
        here = self.open[-1].tag
        if tag in ("td", "th") and here in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", {})  # a row is implied
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", here):
            self.open.pop()
        if here == "head" and tag not in UNSEEN:
            self.open.pop()
        given, foreign = {k: v or "" for k, v in attrs}, self._foreign()
        if foreign and (tag in FOREIGN_UNSEEN[foreign] or given.get("display") == "none" or given.get("visibility") in ("hidden", "collapse")):
            given["hidden"] = ""
        if (foreign == "svg" and tag == "text") or (foreign == "math" and here in MATH_APART):
            self.open[-1].children.append(" ")
        self._push(tag, given)
        if tag in VOID:
            self.open.pop()

    def _foreign(self) -> str | None:
        """The innermost of svg and math that is open."""
        return next((n.tag for n in reversed(self.open) if n.tag in FOREIGN_UNSEEN), None)

    def _push(self, tag, attrs):
        if len(self.open) > MAX_DEPTH:
            self.open.pop()
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash has no effect in HTML, but in svg and math
        if self._foreign() and tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.handle_starttag("p", [])
        walls = {"table"} if tag not in ("table", "body", "html") else set()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in walls:
                return

    def handle_data(self, data):
        top = self.open[-1]
        if top.tag == "head" and data.strip():
            self.open.pop()
            top = self.open[-1]
        if top.tag == "title" and len(self.open) <= 4 and not self._foreign():
            self.title.append(data)
        top.children.append(data)


def visible(node: Node, parent: Node | None) -> bool:
    """Whether a browser shows the node, by the default style sheet, the
    hidden attribute and inline style."""
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    if parent is not None and parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary":
        return False
    style = node.attrs.get("style")
    return not (style and HIDING.search(style))


class Page:
    """Lines under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.indent, self.mark = "", "", ""
        self.want_blank, self.space = False, False

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.expandtabs(8).split("\n")
            self._put(first)
            for r in rest:
                self.end(force=True)
                self._put(r)
            return
        flat = SPACES.sub(" ", data)
        if flat.startswith(" "):
            self.space = True
            flat = flat[1:]
        after = flat.endswith(" ")
        if after:
            flat = flat[:-1]
        if flat:
            if self.space and self.line:
                flat = " " + flat
            self.space = False
            self._put(flat)
        if after:
            self.space = True

    def _put(self, s: str) -> None:
        if s:
            if self.want_blank and not self.line:
                if self.lines:
                    self.lines.append("")
                self.want_blank = False
            self.line += s

    def end(self, force: bool = False) -> None:
        if self.line.strip() or (force and (self.line or self.lines)):
            lead = self.indent
            if self.mark:
                lead = self.indent[:len(self.indent) - len(self.mark)] + self.mark
                self.mark = ""
            self.lines.append((lead + self.line).rstrip())
        self.line, self.space = "", False

    def blank(self) -> None:
        self.want_blank = True


def _inline(node: Node, tables: int) -> str:
    """Visible text of a table cell on one line."""
    page = render(node, tables)
    return " ".join(x.strip() for x in page if x.strip())


def _table(node: Node, tables: int) -> list[str]:
    """Lines of a table: captions, then rows with columns padded to the same
    width.  Cells that span columns push later ones on without widening them."""
    rows: list[list[tuple[str, int]]] = []
    captions: list[str] = []
    stack = [(c, node) for c in reversed(node.children)]
    while stack:
        child, parent = stack.pop()
        if isinstance(child, str):
            if child.strip():
                captions.append(SPACES.sub(" ", child).strip())
            continue
        if not visible(child, parent):
            continue
        if child.tag == "tr":
            cells = []
            for c in child.children:
                if isinstance(c, str):
                    if c.strip():
                        captions.append(SPACES.sub(" ", c).strip())
                elif visible(c, child):
                    span = c.attrs.get("colspan", "1")
                    cells.append((_inline(c, tables), min(1000, max(1, int(span))) if span.isdecimal() else 1))
            rows.append(cells)
        elif child.tag in ("thead", "tbody", "tfoot"):
            stack += [(c, child) for c in reversed(child.children)]
        else:
            text = _inline(child, tables)
            if text:
                captions.append(text)
    width: list[int] = []
    for cells in rows:
        at = 0
        for text, span in cells:
            width += [0] * (at + span - len(width))
            if span == 1:
                width[at] = max(width[at], len(text))
            at += span
    out = list(captions)
    for cells in rows:
        line, at, edge = "", 0, 0
        for text, span in cells:
            line = line.ljust(edge) + text + "  "
            edge += sum(width[at:at + span]) + 2 * span
            at += span
        if line.strip():
            out.append(line.rstrip())
    return out


def render(root: Node, tables: int = 0) -> list[str]:
    """Lines of the visible text under ``root``, which lies in ``tables``
    tables."""
    page = Page()
    # Steps to take: a node or string to show, or a function to call after one.
    stack: list = [(c, root, False, 0) for c in reversed(root.children)]
    while stack:
        step = stack.pop()
        if callable(step):
            step()
            continue
        node, parent, pre, depth = step
        if isinstance(node, str):
            if parent.tag == "details" and "open" not in parent.attrs:
                continue
            if parent.tag not in ("ul", "ol", "menu", "dir", "select", "datalist") or node.strip():
                page.text(node, pre)
            continue
        if not visible(node, parent):
            continue
        tag = node.tag
        if tag == "br":
            page.end(force=True)
            continue
        if tag == "table" and tables < MAX_TABLES:
            page.end()
            page.blank()
            for line in _table(node, tables + 1):
                page._put(line)
                page.end()
            page.blank()
            continue
        if tag == "select":
            options = [o for o in node.children if isinstance(o, Node) and o.tag in ("option", "optgroup")]
            flat = [x for o in options for x in (o.children if o.tag == "optgroup" else [o]) if isinstance(x, Node)]
            chosen = [o for o in flat if "selected" in o.attrs] or ([] if "multiple" in node.attrs else flat[:1])
            stack += [(o, node, False, depth) for o in reversed(chosen)]
            continue
        if tag == "input":
            if node.attrs.get("type", "text").lower() in ("submit", "reset", "button"):
                page.text(" " + node.attrs.get("value", "") + " ", False)
            continue
        if tag not in BLOCK:
            stack += [(c, node, pre, depth) for c in reversed(node.children)]
            continue
        page.end()
        if tag in SPACED and not (tag in ("ul", "ol", "menu") and depth):
            page.blank()
        if tag == "hr":
            page._put("---")
            page.end()
            page.blank()
            continue
        before, mark = page.indent, ""
        if tag == "li":
            if parent.tag == "ol":
                start = parent.attrs.get("start", "1")
                first = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
                number = parent.attrs.setdefault(" next", first)
                parent.attrs[" next"] = number + 1
                mark = f"{number}. "
            else:
                mark = "- "
            page.indent = before + " " * len(mark)
        elif tag in ("blockquote", "dd"):
            page.indent = before + "  "
        if mark:
            page.mark = mark

        def leave(before=before, tag=tag, depth=depth, mark=mark):
            page.end()
            page.indent = before
            if mark and page.mark == mark:
                page.mark = ""
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and depth):
                page.blank()
        stack.append(leave)
        inner = depth + (tag in ("ul", "ol", "menu"))
        stack += [(c, node, pre or tag == "pre", inner) for c in reversed(node.children)]
    page.end()
    lines = page.lines
    while lines and not lines[-1]:
        lines.pop()
    return lines


def extract(html: str | None) -> tuple[str | None, str | None]:
    """(title, visible text) of a page; (None, None) for null."""
    if html is None:
        return None, None
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    title = SPACES.sub(" ", "".join(builder.title)).strip()
    return title or None, "\n".join(render(builder.root))


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``title`` (null if there is none) and ``text``, the
    visible text with its layout; both replace columns of those names.

    A null page gives nulls; an empty one, and one without visible text, the
    empty string.  Damaged markup never fails: what can't be parsed as a tag is text, as in
    a browser.
    """
    ready(pages.sparkSession)
    pages = pages.select(*[quoted(c) for c in pages.columns if c == html_col or c.lower() not in ("title", "text")])
    at = pages.columns.index(html_col)
    pages, old = plain(pages)
    schema = T.StructType([*pages.schema.fields, T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            got = [extract(h) for h in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())],
                                             names=schema.names)
    return pages.mapInArrow(run, schema).toDF(*old, "title", "text")
