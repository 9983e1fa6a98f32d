"""Layout-aware HTML rendering: a tree builder with implied tags, and a renderer that emits all
visible text with block spacing, lists and aligned table cells.

Builder: tag names are case-insensitive; a start tag closes the elements that cannot hold it (p
before a block, li before li, cells and rows before the next ones, options); an end tag closes up to
its element or is ignored; void elements have no content; elements left open close at the end, where
an unfinished tag or comment is dropped. Head
ends at the first tag or text that it cannot hold. Below svg and math a slash closes a tag, and HTML
tags such as p end them.
Shown of math: all but annotations and mphantom; of svg: text and foreignObject.
Hidden: head, title, script, style, template, noscript, datalist, the fallback content of object,
iframe, audio, video and canvas, the rest of svg (also what use elements show of defs and symbol),
comments, declarations, the attribute hidden, hidden inputs, and inline styles display:none (in svg
also as attributes), with everything below them. visibility:hidden hides text until an element below
is visibility:visible again.
Rendering: white space (not the no-break space) collapses outside pre and textarea; br is a line end;
paragraphs, headings, lists, tables and quotes stand apart by a blank line, other blocks by a line
end; list items carry "- " or their number, indented by depth, and a block that begins an item stays
on that line. Table cells are padded to their column's width; a cell of several columns takes their
width, a cell of several rows leaves its place free in the rows below.
No page is an error, and the builder's work is in proportion to the page's tags, however deep.
"""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript object iframe audio video canvas datalist".split())
HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template head".split())
FOREIGN_HIDDEN = {"svg": frozenset("defs symbol clippath mask pattern marker title desc metadata style script".split()),
                  "math": frozenset("annotation annotation-xml mphantom".split()), "": frozenset()}
SVG_TEXT = frozenset("text tspan textpath a foreignobject".split())
HTML_BELOW = {"svg": frozenset("foreignobject desc title".split()),          # these hold HTML
              "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
                     "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address form figcaption "
                           "details summary li dt dd tr caption thead tbody tfoot legend center dir menu hgroup option".split())
CLOSES_P = BLOCK - frozenset("html body li dt dd tr caption thead tbody tfoot option legend".split())
# a start tag of the first closes open elements of the second, but not through the third
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
BARRIER = frozenset("table td th caption button object html body".split())   # p does not close through these
TABLE_ENDS = frozenset("table tr td th thead tbody tfoot body html".split())  # end tags that cells let through
MOST_COLUMNS, MOST_ROWS = 1000, 65534                                          # of colspan and rowspan
SPACE = " \t\n\r\f"


class Node:
    __slots__ = ("tag", "attrs", "kids", "kind")

    def __init__(self, tag: str, attrs: dict, kind: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.kind = kind                # svg, math or '' for HTML


class Builder(HTMLParser):
    """Tree of elements and strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}      # places of the open elements by tag

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 for none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _cut(self, place: int) -> None:
        """Close the open elements from ``place`` on."""
        for n in self.open[place:]:
            self.at[n.tag].pop()
        del self.open[place:]

    def _close(self, tags, through) -> None:
        while (i := self._last(tags)) > self._last(through):
            tag = self.open[i].tag
            self._cut(i)
            if tag not in ("tr", "td", "th"):
                return

    def _kind(self) -> str:
        """Kind of the content of the open element."""
        top = self.open[-1]
        return "" if not top.kind or top.tag in HTML_BELOW[top.kind] else top.kind

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.at.get(tag):
            return
        if tag in BREAKOUT or (tag == "font" and any(k in ("color", "face", "size") for k, _ in attrs)):
            while self._kind():
                self._cut(len(self.open) - 1)
        kind = tag if tag in ("svg", "math") else self._kind()
        if kind and self.open[-1].tag != "head":
            self._push(tag, attrs, kind)
            return
        if tag in CLOSES_P:
            self._close({"p"}, BARRIER)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if self.open[-1].tag == "head" and tag not in HEAD:
            self._cut(len(self.open) - 1)
        self._push(tag, attrs, kind)

    def _push(self, tag, attrs, kind):
        node = Node(tag, dict(attrs), kind)
        self.open[-1].kids.append(node)
        if kind or tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)     # the slash means nothing in HTML on other than void elements
        if self.open[-1].kind and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in VOID and not self._kind():
            if tag == "br":
                if self.open[-1].tag == "head":
                    self._cut(len(self.open) - 1)
                self.open[-1].kids.append(Node("br", {}))
            return
        i = self._last((tag,))
        if i and (tag in TABLE_ENDS or i > self._last(("table", "td", "th"))):
            self._cut(i)

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip(SPACE):
            self._cut(len(self.open) - 1)
        self.open[-1].kids.append(data)

    def parse_html_declaration(self, i):
        """Comments; a doctype with what it declares inside; CDATA below svg and math, as text; other
        declarations up to the next >, of whatever kind."""
        raw = self.rawdata
        if raw.startswith("<!--", i):
            return self.parse_comment(i)
        if raw.startswith("<![CDATA[", i) and self._kind():
            end = raw.find("]]>", i)
            if end < 0:
                return -1
            self.handle_data(raw[i + 9:end])
            return end + 3
        inner = DOCTYPE.match(raw, i)
        if inner:
            return inner.end()
        end = raw.find(">", i)
        return end + 1 if end >= 0 else -1

    def finish(self):
        """The end of the page, all of which was fed: a tag or comment that it leaves open is none."""
        if self.cdata_elem is None and UNFINISHED.match(self.rawdata):
            self.rawdata = ""
        self.close()


UNFINISHED = re.compile("<(?:[a-zA-Z!?]|/[^>])", re.DOTALL)
DOCTYPE = re.compile(r"<!doctype[^>\[]{0,1000}\[[^\]]*\][ \t\n\r\f]*>", re.IGNORECASE)
NUMBER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})(?![0-9])")


def number(text: str | None, default: int, least: int, most: int) -> int:
    """A whole number as HTML reads it from an attribute, within bounds."""
    m = NUMBER.match(text or "")
    return min(max(int(m[1]), least), most) if m else default


def _style(n: Node) -> dict[str, str]:
    out = {}
    for part in (n.attrs.get("style") or "").lower().split(";"):
        name, _, value = part.partition(":")
        out[name.strip()] = value.replace("!important", "").strip()
    return out


def seen(n: Node, visible: bool) -> bool | None:
    """Whether the text of an element shows, given its parent's; None where all of it is gone."""
    if n.tag in (FOREIGN_HIDDEN[n.kind] if n.kind else HIDDEN) or "hidden" in n.attrs:
        return None
    if n.tag == "input" and (n.attrs.get("type") or "").lower() == "hidden":
        return None
    own = _style(n) if "style" in n.attrs else {}
    if n.kind == "svg":
        own = {k: n.attrs.get(k) or "" for k in ("display", "visibility")} | own
    if own.get("display") == "none":
        return None
    shown = own.get("visibility")
    return False if shown in ("hidden", "collapse") else True if shown == "visible" else visible


class Page:
    """Text of a run of blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = False        # a blank line is due before the next text
        self.blank = False      # a collapsed space is due
        self.mark = False       # the line holds an item's mark only, and waits for its text

    def begin(self, mark: str, indent: str):
        """A list item's mark."""
        self.close()
        self._add(mark, indent)
        self.mark = True

    def text(self, data: str, indent: str, pre: bool = False):
        if pre:
            first, *rest = data.split("\n")
            self._add(first, indent)
            for r in rest:
                self.end(True)
                self._add(r, indent)
            return
        words = [w for w in WHITE.split(data) if w]
        if data[:1] in SPACE:
            self.blank = True
        if words:
            self._add(" ".join(words), indent)
            self.blank = data[-1:] in SPACE

    def _add(self, s: str, indent: str):
        if not s:
            return
        if not self.line:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            self.line = indent + s
        else:
            self.line += (" " if self.blank and not self.line.endswith(" ") else "") + s
        self.blank = self.mark = False

    def end(self, keep: bool = False):
        """A line end, unless the line is a mark that waits; a forced one (``keep``) is one anyway."""
        if self.mark and not keep:
            return
        if self.line or (keep and self.lines and not self.gap):
            self.lines.append(self.line.rstrip(SPACE))
        self.line, self.blank, self.mark = "", False, False

    def close(self):
        """The end of an item or of the page: a mark without text is a line."""
        self.mark = False
        self.end()

    def apart(self):
        if not self.mark:
            self.end()
            self.gap = True

    def done(self) -> str:
        self.close()
        return "\n".join(self.lines).strip("\n")


WHITE = re.compile("[ \t\n\r\f]+")


def _table(rows: list[list[tuple[str, int, int]]], indent: str) -> list[str]:
    """Lines of a table of (text, columns, rows) cells. Columns are counted between the places
    where some cell begins or ends, so wide spans cost nothing."""
    placed, held = [], []                        # held: (first column, end, rows left) of cells from above
    for r in rows:
        line, at, k = [], 0, 0
        for text, columns, depth in r:
            while k < len(held) and held[k][0] <= at:
                at, k = max(at, held[k][1]), k + 1
            end = min(at + columns, held[k][0]) if k < len(held) else at + columns
            line.append((at, end, " ".join(x for x in WHITE.split(text) if x), depth))
            at = end
        placed.append(line)
        new = [(a, e, d - 1) for a, e, _, d in line if d > 1]
        held = [(a, e, d - 1) for a, e, d in held if d > 1]
        if new:
            held = sorted(held + new)
    cuts = sorted({x for line in placed for a, e, _, _ in line for x in (a, e)})
    place = {c: i for i, c in enumerate(cuts)}
    wide = [0] * max(len(cuts) - 1, 0)
    spans = []
    for line in placed:
        for a, e, text, _ in line:
            if place[e] - place[a] == 1:
                wide[place[a]] = max(wide[place[a]], len(text))
            else:
                spans.append((place[a], place[e], len(text)))
    for a, e, n in sorted(spans, key=lambda s: (s[1] - s[0], s)):   # narrow spans first; the last column gives way
        wide[e - 1] += max(0, n - sum(wide[a:e]) - 3 * (e - a - 1))
    left = [0]
    for w in wide:
        left.append(left[-1] + w + 3)
    out = []
    for line in placed:
        if any(text for _, _, text, _ in line):
            row = ""
            for a, _, text, _ in line:
                gap = left[place[a]] - len(row)
                row += (" " * (gap - 3) + " | " if gap >= 3 else "") + text
            out.append((indent + row).rstrip(SPACE))
    return out


def render(html: str | None) -> str:
    """Visible text of a page; '' for null. Depth is no limit: the walk keeps its own stack."""
    if not html:
        return ""
    b = Builder()
    b.feed(html)
    b.finish()
    pages, tables, lists = [Page()], [], []
    indents, pre = [0], 0
    todo: list = [("in", b.root, True)]
    while todo:
        what, n, visible = todo.pop()
        page = pages[-1]
        if what == "in":
            if isinstance(n, str):
                if visible:
                    page.text(n, " " * indents[-1], pre > 0)
                continue
            visible = seen(n, visible)
            if visible is None:
                continue
            tag = n.tag
            if n.kind:
                kids = n.kids if n.kind == "math" or tag in SVG_TEXT else [k for k in n.kids if isinstance(k, Node)]
                apart = [" "] if tag in ("text", "foreignobject") else []
                todo.extend(("in", k, visible) for k in reversed([*apart, *kids, *apart]))
                continue
            if tag == "br":
                page.end(True)
                continue
            if tag in ("td", "th"):
                if tables:
                    pages.append(Page())
                    indents.append(0)
            elif tag in SPACED and not (tag in ("ul", "ol") and lists):
                page.apart()
            elif tag in BLOCK:
                page.end()
            if tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", number(n.attrs.get("start"), 1, -10**9, 10**9)])
                indents.append(indents[-1] + (2 if len(lists) > 1 else 0))
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                if visible:
                    page.begin(mark, " " * indents[-1])
            elif tag in ("blockquote", "dd"):
                indents.append(indents[-1] + 2)
            elif tag in ("pre", "textarea"):
                pre += 1
            todo.append(("out", n, visible))
            todo.extend(("in", k, visible) for k in reversed(n.kids))
            continue
        tag = n.tag
        if tag in ("td", "th"):
            if tables:
                indents.pop()
                cell = pages.pop().done()
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((cell, number(n.attrs.get("colspan"), 1, 1, MOST_COLUMNS),
                                       number(n.attrs.get("rowspan"), 1, 1, MOST_ROWS)))
            continue
        if tag == "table":
            for line in _table(tables.pop(), " " * indents[-1]):
                page.close()                 # a mark has a line of its own, so that columns stay aligned
                page._add(line, "")
                page.end()
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            indents.pop()
        elif tag == "li":
            page.close()
        elif tag in ("blockquote", "dd"):
            page.end()
            indents.pop()
        elif tag in ("pre", "textarea"):
            pre -= 1
        if tag in SPACED and not (tag in ("ul", "ol") and lists):
            page.apart()
        elif tag in BLOCK:
            page.end()
    return pages[0].done()


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``: the visible text of each whole page, '' for null and empty ones.
    Repeated rows are rendered each; extra columns pass through (one named ``out`` is replaced)."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([render(t) for t in texts], dtype=object)

    return pages.withColumn(out, run(F.col(html)))
