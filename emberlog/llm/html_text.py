"""Layout-aware rendering of HTML pages to plain text.

A tree builder adds the end tags that HTML lets authors leave out, a few visibility rules drop what a reader
never sees, and the rest is laid out as a browser without styles would: blocks on lines of their own, blank lines
around paragraphs, list markers with indents, preformatted text as it stands, and table cells in aligned columns. All
visible text is kept, navigation and footers included.

Pages are independent; there is no shuffle, and a page needs memory in proportion to its own length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from unicodedata import category, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that show nothing.
UNSEEN = frozenset("head title style script template datalist iframe object audio video canvas noframes".split())
#: Elements inside svg and math that show nothing, and those whose content is HTML again.
UNSEEN_IN = {"svg": frozenset("title desc metadata defs symbol clippath mask pattern marker filter lineargradient radialgradient style script".split()),
             "math": frozenset("annotation annotation-xml mphantom style script".split())}
TOKENS = frozenset("mi mn mo ms mtext".split())
HTML_IN = {"svg": frozenset(["foreignobject", "title", "desc"]), "math": TOKENS}
#: HTML elements whose start ends an svg or math that is still open.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Elements on lines of their own, without and with a blank line around.
LINES = frozenset("html body div section article aside header footer nav main address center form fieldset legend dt dd figcaption summary details hgroup option optgroup caption tr td th thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure hr listing".split())
#: What a start tag ends if it is open, and the elements beyond which it does not look.
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "table", "td", "th"])),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    **dict.fromkeys(["thead", "tbody", "tfoot"], (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"]))),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
_BEFORE_P = frozenset(["button", "td", "th", "caption", "table", "object"])
_CELL_EDGE = frozenset(["table", "td", "th", "caption"])
#: Lists, quotes and tables nested deeper than this are laid out line by line, without further indents or columns.
DEEPEST = 200
#: Columns are not aligned further than this many characters.
WIDEST = 60
#: Elements whose content is text up to their end tag, with and without character references.
RAW = {**dict.fromkeys("script style xmp iframe noembed noframes".split(), False), "title": True, "textarea": True}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_BETWEEN = re.compile(r"[\s/=]*")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT_END = re.compile("--!?>")
_STYLE_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Values that a style has to name to count; others are passed over, as browsers do.
DISPLAYS = frozenset("none contents block inline inline-block flow-root flex inline-flex grid inline-grid list-item ruby inherit initial unset revert table inline-table table-row table-cell table-caption table-column table-column-group table-row-group table-header-group table-footer-group".split())
VISIBILITIES = frozenset("visible hidden collapse inherit initial unset revert".split())
ROWS = frozenset("tr thead tbody tfoot".split())


def styled(style: str | None) -> dict[str, str]:
    """The display and visibility that a style gives: the last declaration, or the last one that is marked important."""
    found: dict[str, tuple[bool, str]] = {}
    for declaration in _STYLE_COMMENT.sub(" ", style or "").lower().split(";"):
        name, _, value = declaration.partition(":")
        name, words = name.strip(), value.replace("!", " !").split()
        important = words[-1:] == ["!important"] or words[-2:] == ["!", "important"]
        values = {"display": DISPLAYS, "visibility": VISIBILITIES}.get(name)
        if values and words and words[0] in values and len(words) == 1 + (words[-1] == "!important") + 2 * (words[-2:] == ["!", "important"]):
            if important or not found.get(name, (False, ""))[0]:
                found[name] = (important, words[0])
    return {name: value for name, (_, value) in found.items()}


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for marks that combine with the one before."""
    if text.isascii():
        return len(text)
    return sum(0 if category(c) in ("Mn", "Me", "Cf") else 2 if east_asian_width(c) in "WF" else 1 for c in text)


class Element:
    __slots__ = ("tag", "attrs", "inside", "space", "shows", "style", "seen")

    def __init__(self, tag: str, attrs: dict[str, str | None], space: str = "", shows: bool = True, seen: bool = True) -> None:
        """`space`: svg, math, or nothing for HTML; `shows`: does the element show text that stands in it? `seen`: are
        the elements around it visible? It inherits that unless its style says otherwise."""
        self.tag, self.attrs, self.inside, self.space, self.shows = tag, attrs, [], space, shows
        # Attributes of a drawing are styles of the lowest rank.
        plain = styled(";".join(f"{k}:{attrs.get(k) or ''}" for k in ("display", "visibility"))) if space else {}
        self.style = plain | styled(attrs["style"]) if attrs.get("style") else plain
        own = self.style.get("visibility", "inherit")
        self.seen = seen if own in ("inherit", "unset", "revert") else own in ("visible", "initial")

    def hidden(self) -> bool:
        """Is the element left out with all that it holds? Invisible elements are not: what they hold may be visible."""
        if self.tag in (UNSEEN_IN[self.space] if self.space else UNSEEN):
            return True
        if self.tag in ROWS and self.style.get("visibility") == "collapse":
            return True
        if self.tag == "input" and (self.attrs.get("type") or "text").lower() == "hidden":
            return True
        display = self.style.get("display")
        if display and display != "revert":
            return display == "none"
        return "hidden" in self.attrs or self.tag == "dialog" and "open" not in self.attrs


class TreeBuilder:
    """Builds the tree of a page in one pass; any input gives one."""

    def __init__(self) -> None:
        self.root = Element("html", {})
        self.open = [self.root]
        #: Places in `open` by tag, and of the elements that are not HTML.
        self.places: dict[str, list[int]] = {}
        self.foreign: list[int] = []

    def read(self, html: str) -> Element:
        at, n = 0, len(html)
        while at < n:
            mark = html.find("<", at)
            if mark < 0:
                mark = n
            if mark > at:
                self.data(unescape(html[at:mark]))
            at = self.markup(html, mark) if mark < n else n
        return self.root

    def markup(self, html: str, at: int) -> int:
        """Handles what begins with the < at a position; the position behind it."""
        if html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):
                return html.index(">", at) + 1
            end = _COMMENT_END.search(html, at + 4)
            return end.end() if end else len(html)
        if html.startswith("<![CDATA[", at) and self.open[-1].space:
            end = html.find("]]>", at)
            end = len(html) if end < 0 else end
            self.data(html[at + 9:end])
            return end + 3
        if html[at + 1:at + 2] in ("!", "?"):
            end = html.find(">", at)
            return len(html) if end < 0 else end + 1
        ends = html[at + 1:at + 2] == "/"
        name = _NAME.match(html, at + 1 + ends)
        if not name:
            self.data("<")
            return at + 1
        tag, attrs, at = name[0].lower(), {}, name.end()
        while (at := (between := _BETWEEN.match(html, at)).end()) < len(html) and html[at] != ">":
            found = _ATTRIBUTE.match(html, at)
            attrs.setdefault(found[1].lower(), next((unescape(v) for v in found.groups()[1:] if v is not None), None))
            at = found.end()
        if at >= len(html):
            return at
        if ends:
            self.end(tag)
        else:
            element = self.start(tag, attrs, between[0].endswith("/"))
            if tag in RAW and not element.space:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at + 1)
                stop = close.start() if close else len(html)
                raw = html[at + 1:stop]
                self.data(unescape(raw) if RAW[tag] else raw)
                self.end(tag)
                return stop
        return at + 1

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.open))
        if element.space:
            self.foreign.append(len(self.open))
        self.open.append(element)

    def cut(self, at: int) -> None:
        """Ends the open elements from a place on."""
        for element in reversed(self.open[at:]):
            self.places[element.tag].pop()
            if element.space:
                self.foreign.pop()
        del self.open[at:]

    def last(self, tag: str) -> int:
        return places[-1] if (places := self.places.get(tag)) else 0

    def close_from(self, tags: frozenset[str], edge: frozenset[str]) -> None:
        """Ends the outermost open element among `tags` inside the nearest element of `edge`, or of svg or math."""
        low = max([self.last(t) for t in edge] + self.foreign[-1:], default=0)
        found = [places[i] for t in tags if (places := self.places.get(t)) and (i := bisect_right(places, low)) < len(places)]
        if found:
            self.cut(min(found))

    def start(self, tag: str, attrs: dict[str, str | None], closed: bool = False) -> Element:
        """Adds an element; `closed`: its tag ends in a slash, which counts in svg and math only."""
        top = self.open[-1]
        if top.space and top.tag not in HTML_IN[top.space] and (tag in BREAKS_OUT or tag == "font" and attrs.keys() & {"color", "face", "size"}):
            while self.open[-1].space and self.open[-1].tag not in HTML_IN[self.open[-1].space]:
                self.cut(len(self.open) - 1)
            top = self.open[-1]
        if tag in ("svg", "math"):
            space = tag
        else:
            space = "" if not top.space or top.tag in HTML_IN[top.space] else top.space
        if space:
            shows = tag in TOKENS if space == "math" else tag in ("text", "foreignobject") or tag != "svg" and top.space == "svg" and top.shows
            element = Element(tag, attrs, space, shows, top.seen)
            top.inside.append(element)
            if not closed:
                self.push(element)
            return element
        if tag in ("html", "body"):
            if self.last("head"):
                rest = [e for e in self.open[1:] if e.tag != "head"]
                self.cut(1)
                for e in rest:
                    self.push(e)
            return self.root
        if tag == "head" or (tag in LINES or tag in SPACED) and tag != "option":
            self.close_from(frozenset(["p", "head"]), _BEFORE_P)
        if tag in ENDS:
            self.close_from(*ENDS[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.start("tr", {})
        element = Element(tag, attrs, seen=self.open[-1].seen)
        self.open[-1].inside.append(element)
        if tag not in VOID:
            self.push(element)
        return element

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        at = self.last(tag)
        edge = frozenset(["table"]) if tag in _CELL_EDGE or tag in ("tr", "thead", "tbody", "tfoot") else _CELL_EDGE
        if not at or tag != "table" and any(self.last(e) > at for e in edge):
            return
        # HTML inside svg or math doesn't end HTML around it.
        if self.foreign and self.foreign[-1] > at and not self.open[at].space and not self.open[-1].space:
            return
        self.cut(at)

    def data(self, data: str) -> None:
        self.open[-1].inside.append(data)


class Flow:
    """Lines laid out so far, the inline text that is still open, and the blank line that may have to follow."""

    def __init__(self, pre: bool = False, depth: int = 0) -> None:
        """`depth`: flows around this one."""
        self.depth = depth
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap, self.pre = False, pre

    def text(self, data: str) -> None:
        # A zero byte marks a line break; it never is text in a page.
        data = data.replace("\0", "")
        self.run.append(data.replace("\n", "\0") if self.pre else _SPACE.sub(" ", data))

    def end_line(self) -> None:
        parts = "".join(self.run).split("\0")
        self.run = []
        if self.pre:
            parts = parts[:-1] if not parts[-1] else parts
        else:
            parts = [re.sub(" +", " ", p).strip(" ") for p in parts]
            while parts and not parts[-1]:
                parts.pop()
        self.add(parts, False)

    def add(self, lines: list[str], spaced: bool) -> None:
        if self.run:
            self.end_line()
        self.gap = self.gap or spaced
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines += lines
            self.gap = spaced


def laid_out(element: Element, pre: bool = False, depth: int = 0, nested: bool = False) -> list[str]:
    flow = Flow(pre, depth)
    walk(element, flow, nested)
    flow.add([], False)
    return flow.lines


class Visit:
    """An element whose content is being laid out, and what follows it: a line's end, a blank line, or a space."""

    __slots__ = ("element", "rest", "number", "shut", "nested", "after", "pre")

    def __init__(self, element: Element, nested: bool = False, after: bool | str | None = None, pre: bool | None = None) -> None:
        self.element, self.nested, self.after, self.pre = element, nested, after, pre
        self.rest = iter(element.inside)
        self.number = _integer(element.attrs.get("start"), 1)
        self.shut = element.tag == "details" and "open" not in element.attrs

    def leave(self, flow: Flow) -> None:
        if isinstance(self.after, str):
            flow.text(self.after)
        elif self.after is not None:
            flow.add([], self.after)
        if self.pre is not None:
            flow.pre = self.pre


def walk(element: Element, flow: Flow, nested: bool = False) -> None:
    """Lays the content of an element out into the flow. `nested`: inside a list.

    Open elements stand on a list of their own, so that any depth will do; only content with a layout of its own
    is a call, and that only down to DEEPEST.
    """
    todo = [Visit(element, nested)]
    while todo:
        at = todo[-1]
        for child in at.rest:
            if isinstance(child, str):
                if at.element.shows and at.element.seen and not at.shut:
                    flow.text(_SPACE.sub(" ", child).strip(" ") if at.element.space == "math" else child)
            elif not (child.hidden() or at.shut and child.tag != "summary"):
                inner = list(_entered(child, at, flow))
                if inner:
                    todo += inner
                    break
        else:
            todo.pop().leave(flow)


def _entered(child: Element, at: Visit, flow: Flow) -> Iterator[Visit]:
    """Lays out a child that is a unit, or begins it and gives the visits that lay out its content, the last one first."""
    tag, deep = child.tag, flow.depth >= DEEPEST
    if child.space:
        yield _foreign(child, flow)
    elif tag == "br":
        flow.run.append("\0")
    elif tag == "input":
        if child.seen and (child.attrs.get("type") or "text").lower() not in ("checkbox", "radio", "file", "image", "password"):
            flow.text(child.attrs.get("value") or "")
    elif tag == "select":
        options = [e for e in _all(child, "option") if not e.hidden()]
        yield from map(Visit, reversed([e for e in options if "selected" in e.attrs] or options[:1]))
    elif tag == "li":
        mark = (f"{at.number}. " if at.element.tag == "ol" else "- ") if child.seen else ""
        at.number += 1
        if not deep:
            flow.add(_indented(laid_out(child, False, flow.depth + 1, True), mark), False)
            return
        flow.add([], False)
        flow.text(mark)
        yield Visit(child, True, False)
    elif tag in ("ul", "ol", "menu"):
        flow.add([], not at.nested)
        yield Visit(child, True, not at.nested)
    elif tag == "table" and not deep:
        flow.add(table_lines(child, flow.depth + 1), True)
    elif tag in ("pre", "listing", "textarea"):
        if not deep:
            flow.add(laid_out(child, True, flow.depth + 1), tag != "textarea")
            return
        flow.add([], tag != "textarea")
        yield Visit(child, False, tag != "textarea", flow.pre)
        flow.pre = True
    elif tag in ("blockquote", "dd") and not deep:
        flow.add(_indented(laid_out(child, False, flow.depth + 1), "    ", "    "), tag == "blockquote")
    elif tag in LINES or tag in SPACED:
        flow.add([], tag in SPACED)
        yield Visit(child, at.nested, tag in SPACED)
    else:
        yield Visit(child, at.nested)


def _foreign(child: Element, flow: Flow) -> Visit:
    """Begins an element of svg or math. Texts of a drawing stand apart, parts of a fraction have a slash between."""
    tag, after = child.tag, None
    if tag == "text" or tag in ("mtr", "mtd") or tag == "tspan" and child.attrs.keys() & {"x", "y"}:
        flow.text(" ")
        after = " "
    elif tag == "foreignobject" or tag == "math" and child.attrs.get("display") == "block":
        flow.add([], False)
        after = False
    if tag in ("mfrac", "semantics", "maction"):
        parts = [e for e in child.inside if not isinstance(e, str)]
        shown = Element(tag, {}, "math", seen=child.seen)
        shown.inside = [x for e in parts for x in ("/", e)][1:] if tag == "mfrac" else parts[:1]
        child = shown
    return Visit(child, False, after)


def _indented(lines: list[str], first: str, rest: str | None = None) -> list[str]:
    rest = " " * len(first) if rest is None else rest
    return [(rest if i else first) + line if line else line for i, line in enumerate(lines)]


def _integer(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"-?\d{1,9}", text.strip()) else default


def _all(element: Element, tag: str) -> Iterator[Element]:
    todo = [iter(element.inside)]
    while todo:
        for child in todo[-1]:
            if isinstance(child, str):
                continue
            if child.tag == tag:
                yield child
            else:
                todo.append(iter(child.inside))
                break
        else:
            todo.pop()


def _rows(element: Element) -> Iterator[Element]:
    for child in element.inside:
        if not isinstance(child, str) and not child.hidden():
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def table_lines(table: Element, depth: int = 0) -> list[str]:
    """Caption, then rows with their cells in aligned columns, cells of several lines side by side. Content that stands in
    no cell comes first, as browsers move it there."""
    stray = Element("div", {}, seen=table.seen)
    captions: list[Element] = []
    todo = [table]
    while todo:
        for child in todo.pop().inside:
            if isinstance(child, str):
                stray.inside += [child] if child.strip() else []
            elif child.tag in ("thead", "tbody", "tfoot", "tr"):
                todo.append(child)
            elif child.tag == "caption":
                captions.append(child)
            elif child.tag not in ("td", "th", "col", "colgroup"):
                stray.inside.append(child)
    lines = laid_out(stray, False, depth) + [line for c in captions if not c.hidden() for line in laid_out(c, False, depth)]
    grid: list[dict[int, tuple[list[str], int]]] = []
    covered: dict[int, int] = {}
    for row in _rows(table):
        cells: dict[int, tuple[list[str], int]] = {}
        at = 0
        still = {c: n - 1 for c, n in covered.items() if n > 1}
        for cell in row.inside:
            if isinstance(cell, str) or cell.tag not in ("td", "th") or cell.hidden():
                continue
            while at in covered:
                at += 1
            wide = min(max(_integer(cell.attrs.get("colspan"), 1), 1), 100)
            tall = min(max(_integer(cell.attrs.get("rowspan"), 1), 1), 1000)
            cells[at] = (laid_out(cell, False, depth), wide)
            for c in range(at, at + wide):
                if tall > 1:
                    still[c] = tall - 1
            at += wide
        covered = still
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for c, (text, wide) in cells.items():
            if wide == 1:
                widths[c] = max(widths.get(c, 0), min(max(map(width, text), default=0), WIDEST))
    columns = sorted({c for cells in grid for c in cells} | set(widths))
    for cells in grid:
        for k in range(max((len(text) for text, _ in cells.values()), default=0)):
            line, edge = "", 0
            for c in columns:
                text = cells[c][0] if c in cells else []
                if k < len(text) and text[k]:
                    # A text that ran over its column pushes the next one on by a gap.
                    so_far = width(line)
                    line += " " * (max(edge, so_far + 2 if line else 0) - so_far) + text[k]
                edge += widths.get(c, 0) + 2
            lines.append(line.rstrip())
    return lines


def render(html: str) -> str:
    """The visible text of a page."""
    return "\n".join(laid_out(TreeBuilder().read(html)))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, text, n_lines.

    Null and empty pages give an empty text of 0 lines; broken markup gives the text a browser would show or more. Repeated
    rows and ids are independent; an empty table gives an empty result; other columns are not read.
    """
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(h.as_py() or "") for h in batch.column(1)]
            lines = pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), lines], names=["page_id", "text", "n_lines"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(
        run, f"page_id {id_type}, text string, n_lines long")
