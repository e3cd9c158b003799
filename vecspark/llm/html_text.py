"""Visible text of web pages, laid out as a text browser would: tree builder, visibility, blocks, lists and tables."""

from __future__ import annotations

import html
import re
import textwrap
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vecspark.llm.common import lean_batches

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
#: White space and slashes, then an attribute, if any. Possessive, so that no page is scanned again and again.
_ATTR = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+)?+")
_HIDES = re.compile(r"(?:^|;)visibility:(visible|hidden|collapse)")
_RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "legend"}
NEVER_SHOWN = set("head script style template noscript iframe object audio video canvas datalist noembed noframes title".split())
#: Inside svg or math these are never shown either.
FOREIGN_HIDDEN = set("annotation annotation-xml clippath defs desc metadata symbol".split())
#: Elements whose text and whose children other than _PARTS a browser moves in front of the table.
_FOSTERS = {"table", "thead", "tbody", "tfoot", "tr", "colgroup"}
_PARTS = {"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup", "col"}
#: A start tag of the key ends open elements of the values, up to the nearest element of _SCOPE.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
IMPLIED_END |= {t: {"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"} for t in ("thead", "tbody", "tfoot")}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}


class Node:
    """An element: tag, attributes and children, which are nodes or strings."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _tags(page: str) -> Iterator[tuple[int, int, str, dict[str, str] | None]]:
    """Start, end, lower-case name and attributes of every tag (None: an end tag); name "" for comments and declarations.

    Asks for the next tag from wherever the caller has set the end by send(). What is not closed reaches to the end.
    """
    at, n = 0, len(page)
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end, name, attrs = (n if end < 0 else end + 3), "", None
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            end, name, attrs = (n if end < 0 else end + 1), "", None
        elif page.find(">", start) < 0:  # no tag from here on: what is left is text
            return
        elif m := _NAME.match(page, start + 1):
            found, end = [], m.end()
            while (a := _ATTR.match(page, end)) and a[1] is not None:
                found.append(a.groups())
                end = a.end()
            end = min(n, a.end() + 1)
            name, attrs = m[1].lower(), None
            if page[start + 1] != "/":
                attrs = {}
                for k, *v in found:
                    attrs.setdefault(k.lower(), html.unescape(next((x for x in v if x is not None), "")))
        else:
            at = start + 1
            continue
        at = (yield start, end, name, attrs) or end


def parse(page: str) -> Node:
    """Tree of a page; missing end tags and table rows are implied, stray end tags ignored."""
    root = Node("#root", {})
    stack, at = [root], 0
    opened: Counter[str] = Counter()  # of the tags on the stack, so that deep pages are not searched in vain

    def cut(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    def close(tags: set[str], scope: set[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                cut(i)
                return
            if stack[i].tag in scope:
                return

    def add(child: Node | str) -> None:
        """Appends to the innermost element; in a table but in no cell, what can't stand there goes before the table."""
        stray = child.strip() if isinstance(child, str) else child.tag not in _PARTS and child.tag not in ("script", "style", "template")
        if stray and stack[-1].tag in _FOSTERS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "table":  # while it is open, it is the last child of the element below it
                    stack[i - 1].children.insert(-1, child)
                    return
        stack[-1].children.append(child)

    def push(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        if (tag in FOREIGN_HIDDEN or tag == "text") and (opened["svg"] or opened["math"]):
            attrs["hidden" if tag in FOREIGN_HIDDEN else "#line"] = ""
        add(node)
        if tag not in VOID:
            stack.append(node)
            opened[tag] += 1
        return node

    def begin(tag: str, attrs: dict[str, str]) -> None:
        """A start tag, with what it implies."""
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "table", "button"})
        if tag in IMPLIED_END:
            scope = _SCOPE.get(tag, {"table"})
            inner = IMPLIED_END[tag]
            while any(opened[t] for t in inner) and not (stack[-1].tag in scope or stack[-1] is root):
                before = len(stack)
                close(inner, scope)
                if len(stack) == before:
                    break
        if tag in _PARTS and opened["table"]:  # ends what was moved before the table
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _FOSTERS:
                    cut(i + 1)
                    break
                if stack[i].tag in ("td", "th", "caption"):
                    break
        elif tag == "table" and stack[-1].tag in _FOSTERS:
            close({"table"}, set())
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push("tr", {})
        if tag == "body" and opened["head"]:
            close({"head"}, set())
        push(tag, attrs)

    tags = _tags(page)
    found = next(tags, None)
    while found:
        start, end, tag, attrs = found
        if start > at:
            add(html.unescape(page[at:start]))
        at = end
        if tag and attrs is None:
            if tag == "p" and not opened["p"]:
                push("p", {})
            if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "table"):
                close({tag}, set() if tag == "table" else {"table"})
            else:
                close({tag}, {"td", "th", "table"} | ({"button"} if tag == "p" else set()))
        elif tag:
            begin(tag, attrs)
            if tag in _RAW:
                stop = re.compile(rf"</{tag}\s*+/?>", re.I).search(page, at)
                raw = page[at : stop.start() if stop else len(page)]
                opened[tag] -= 1
                stack.pop().children.append(html.unescape(raw).removeprefix("\n") if tag == "textarea" else raw)
                at = stop.end() if stop else len(page)
        try:
            found = tags.send(at)
        except StopIteration:
            break
    if at < len(page):
        add(html.unescape(page[at:]))
    return root


def _hidden(node: Node) -> bool:
    style = node.attrs.get("style", "").lower().replace(" ", "")
    return node.tag in NEVER_SHOWN or "hidden" in node.attrs or "display:none" in style or (node.tag == "dialog" and "open" not in node.attrs)


def _unseen(node: Node, unseen: bool) -> bool:
    """Whether text right in the node is invisible: visibility comes from its parent unless its own style sets it."""
    if "style" in node.attrs:
        for m in _HIDES.finditer(node.attrs["style"].lower().replace(" ", "")):
            unseen = m[1] != "visible"
    return unseen


def _chosen(select: Node) -> list[Node]:
    """The options a reader sees: all of a list box; of a closed list the last selected one, or else the first enabled."""
    options, todo = [], list(reversed(select.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            if x.tag == "option":
                options.append(x)
            else:
                todo += reversed(x.children)
    size = select.attrs.get("size", "1")
    if "multiple" in select.attrs or (size.isdigit() and size.lstrip("0") not in ("", "1")):
        return options
    return [x for x in options if "selected" in x.attrs][-1:] or [x for x in options if "disabled" not in x.attrs][:1]


class _Flow:
    """Lines being written: white space collapses, and the largest break asked for since the last text is made."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.space = 0, False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self._add(first)
            for x in rest:
                self.end()
                self._add(x)
            return
        words = s.split()
        if not words:
            self.space |= bool(s)
            return
        lead = (self.space or s[0].isspace()) and bool(self.parts)
        self._add((" " if lead else "") + " ".join(words))
        self.space = s[-1].isspace()

    def _add(self, s: str) -> None:
        if s:
            if not self.parts and self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.parts.append(s)

    def end(self) -> None:
        self.lines.append("".join(self.parts))
        self.parts, self.space, self.gap = [], False, max(self.gap, 1)

    def brk(self, gap: int) -> None:
        if self.parts:
            self.end()
        self.gap, self.space = max(self.gap, gap), False

    def put(self, lines: list[str], gap: int) -> None:
        self.brk(gap)
        if lines:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.lines += lines
            self.gap = gap

    def done(self) -> list[str]:
        self.brk(1)
        lines = [x.rstrip() for x in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def _table(rows: list[list[tuple[int, list[str]]]], widest: int) -> list[str]:
    """Rows of cells as lines; columns are padded to one width. Lines longer than `widest` are wrapped, save single words."""
    wrap = lambda x: textwrap.wrap(x, widest, break_long_words=False, break_on_hyphens=False, replace_whitespace=False, expand_tabs=False) if len(x) > widest else [x]
    grid = [[x for span, lines in row for x in ([w for line in lines for w in wrap(line)], *[[]] * (span - 1))] for row in rows]
    width = [0] * max((len(r) for r in grid), default=0)
    for row in grid:
        for j, cell in enumerate(row):
            width[j] = max(width[j], *(min(len(x), widest) for x in cell), 0)
    out = []
    for row in grid:
        for i in range(max((len(c) for c in row), default=0)):
            out.append(" | ".join((c[i] if i < len(c) else "").ljust(w) for c, w in zip(row, width, strict=False)).rstrip())
    return out


def render(page: str, widest: int = 60) -> str:
    """All visible text of a page; blocks on lines of their own, list items marked, cells of a table aligned."""
    flow = _Flow()
    flows, tables, lists = [flow], [], []
    todo: list[tuple[object, bool, bool, bool]] = [(parse(page or ""), False, False, False)]
    while todo:
        node, leave, pre, unseen = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not unseen:
                flow.text(node, pre)
            continue
        tag, spaced = node.tag, 2 if node.tag in SPACED else 1
        if leave:
            if tag in ("td", "th") and tables:
                lines = flows.pop().done()
                span = node.attrs.get("colspan", "1")
                tables[-1][-1].append((min(max(int(span), 1), 1000) if span.isdigit() and len(span) < 6 else 1, lines))
            elif tag == "table":
                lines = _table(tables.pop(), widest)
                if stray := flows.pop().done():
                    flows[-1].put(stray, 1)
                flows[-1].put(lines, 2)
            elif tag == "li":
                lines = flows.pop().done() or [""]
                mark = "- "
                if lists and lists[-1] is not None:
                    mark = f"{lists[-1]}. "
                    lists[-1] += 1
                flows[-1].put([mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])], 1)
            elif tag in BLOCK or tag == "textarea" or "#line" in node.attrs:
                if tag in ("ul", "ol", "menu"):
                    lists.pop()
                flow.brk(1 if spaced == 2 and tag in ("ul", "ol") and lists else spaced)
            continue
        if _hidden(node):
            continue
        unseen = _unseen(node, unseen)
        if tag == "br":
            flow.end()
            flow.gap = 0
            continue
        if tag == "hr":
            flow.brk(2)
            continue
        if tag in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append([])
            flows.append(_Flow())
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag == "table":
            flow.brk(2)
            tables.append([])
            flows.append(_Flow())  # of what is in no cell; the parser has put almost all of it before the table
        elif tag == "caption" and tables:
            flows[-2].brk(1)
            tables[-1].append([])
            todo.append((Node("td", {}), True, pre, unseen))
            flows.append(_Flow())
            todo += [(c, False, pre, unseen) for c in reversed(node.children)]
            continue
        elif tag == "li":
            flow.brk(1)
            flows.append(_Flow())
        elif tag == "select":
            options = _chosen(node)
            for x in reversed(options):
                x.attrs.update({"#line": ""} if len(options) > 1 else {})
                todo.append((x, False, pre, unseen))
            continue
        elif tag in BLOCK or tag == "textarea" or "#line" in node.attrs:
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                lists.append(int(start) if start.isdigit() and len(start) < 10 else 1) if tag == "ol" else lists.append(None)
                spaced = 1 if len(lists) > 1 else 2
            flow.brk(spaced)
        todo.append((node, True, pre, unseen))
        todo += [(c, False, pre or tag in ("pre", "textarea"), unseen) for c in reversed(node.children)]
    return "\n".join(flows[0].done())


def _render(columns: list[str], widest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else render(t, widest) for t in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], names=[*columns, "text"])

    return run


def extract_text(pages: DataFrame, widest: int = 60) -> DataFrame:
    """pages with text, what a reader of `html` would see; see render.

    A tree is built first: end tags of p, li, dt, dd, option and table parts and missing tr are implied, stray end tags
    ignored, and an unclosed tag, comment or script ends with the page. Nothing under head, script, style, template,
    noscript, canvas, embedded media and frames, datalist, hidden or display:none is shown, nor text whose nearest visibility is not visible; all else is, menus and footers too,
    formulas (MathML without annotations), labels of svg drawings (each a line), text areas, all options of list boxes
    and the chosen one of closed lists. Text and elements in a table but in no cell stand before it.
    Blocks begin a line, paragraphs, headings, lists and tables leave one empty, nested lists are indented, ordered
    ones counted, pre keeps its spaces. Cells stand in columns; their lines are wrapped at `widest` characters. A very long
    page is one row of one task; the time is in proportion to its length, whatever is in it.

    A null page has a null text, an empty one an empty text. Rows are rendered alone, so repeats agree. A column of
    pages called text is replaced.
    """
    lean_batches(pages.sparkSession)
    pages = pages.drop("text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema]
    return pages.mapInArrow(_render(pages.columns, widest), ", ".join([*fields, "text string"]))
