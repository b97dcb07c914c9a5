"""Visible text of web pages, laid out.

A scanner reads tags, comments and text; a tree builder closes what the next tag implies (a paragraph before a block, an
item before an item, cells, rows, options), opens the row that a cell lacks and opens nothing twice; rendering walks
the tree: hidden elements go, blocks stand on lines of their own, paragraphs and headings have an empty line around
them, list items a bullet or number by depth, and the cells of a table are padded so that columns align.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from unicodedata import east_asian_width

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Element names by how HTML treats them.
VOID = _names("area base br col embed hr img input link meta param source track wbr")
RAW = _names("script style textarea title xmp iframe noembed noframes plaintext")
UNSEEN = _names("head script style template noscript title iframe noembed noframes object audio video canvas datalist area base link meta param source track annotation annotation-xml defs symbol clippath mask marker pattern desc metadata")
#: The parts of a drawing whose text is seen; of an input of these kinds its value (else its placeholder) is.
DRAWN = _names("text foreignobject")
LABELLED = _names("button submit reset")
UNTYPED = _names("hidden password checkbox radio range color file image") | LABELLED
#: Within svg and math a tag may close itself; these elements end both, but not inside the points where HTML goes on.
FOREIGN = _names("svg math")
LEAVES = _names("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var")
WITHIN = _names("foreignobject desc title mi mo mn ms mtext annotation-xml")
SPACED = _names("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure fieldset hr")
BLOCKS = SPACED | _names("html body address article aside center dd details div dt figcaption footer form header hgroup legend li main nav search section summary tr caption option optgroup dialog mtable mtr thead tbody tfoot td th")
#: An opening tag closes these open elements, searching outwards up to the fence.
IMPLIED = {
    **dict.fromkeys(_names("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul"), (_names("p"), _names("td th caption button object table body"))),
    "li": (_names("li p"), _names("ul ol menu td th table body")),
    "dt": (_names("dt dd p"), _names("dl td th table body")),
    "dd": (_names("dt dd p"), _names("dl td th table body")),
    "td": (_names("td th caption"), _names("table")),
    "th": (_names("td th caption"), _names("table")),
    "tr": (_names("tr td th caption colgroup"), _names("table")),
    **dict.fromkeys(_names("tbody thead tfoot"), (_names("tbody thead tfoot tr td th caption colgroup"), _names("table"))),
    "option": (_names("option"), _names("select")),
    "optgroup": (_names("option optgroup"), _names("select")),
    "body": (_names("head"), _names("html")),
}
#: Parts of a table: what stands between them, outside captions and cells, is seen before the table.
PARTS = _names("table thead tbody tfoot colgroup tr")
CELLS = _names("td th")
#: An opening tag in a table stands in the innermost of these; a table that has no cell open ends before another one.
IN_TABLE = {
    **dict.fromkeys(_names("table caption colgroup thead tbody tfoot"), _names("table")),
    "tr": _names("table thead tbody tfoot"),
    **dict.fromkeys(CELLS, _names("table thead tbody tfoot tr")),
}
#: A closing tag looks no further out than these.
CLOSE_FENCE = {**dict.fromkeys(_names("td th tr tbody thead tfoot caption"), _names("table")), "li": _names("ul ol menu"), "table": _names("")}
MAX_DEPTH = 400

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_CLOSED = re.compile(r"(?<![^\s\"'])/\Z|\A(?!.*=\s*[^\s\"'=<>`]+\Z).*/\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?:;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\s*(?:!important\s*)?(?=;|$)", re.I)
#: Where neither stands in a page, nothing but ``hidden`` hides its elements.
_PARTLY = re.compile("visibility|<details", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "depth", "name")

    def __init__(self, name: str, attributes: dict[str, str] | None = None, depth: int = 0):
        self.name, self.attributes, self.depth, self.children = name, attributes or {}, depth, []


#: A number of more digits is out of range, as browsers have it.
MAX_DIGITS = 9
_LONG_REFERENCE = re.compile(r"(?<=&#)[0-9]{8,}")


def number(text: str | None, otherwise: int) -> int:
    """The decimal number of an attribute; ``otherwise`` where there is none or it is out of range."""
    text = (text or "").strip(" \t\n\r\f")
    digits = text.lstrip("0") or text[-1:]
    return int(digits) if digits.isdecimal() and len(digits) <= MAX_DIGITS else otherwise


def plain(text: str) -> str:
    """Character references resolved; a number beyond all characters gives U+FFFD, however long it is."""
    return unescape(_LONG_REFERENCE.sub(lambda found: found[0].lstrip("0")[:8] or "0", text) if "&#" in text else text)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), plain(next(filter(None, values), "")))
    return found


def build(html: str) -> Node:
    """The tree. Unclosed elements end with the page; unmatched closing tags do nothing, but </p> and </br> stand for an
    empty paragraph and a break. Beyond ``MAX_DEPTH`` elements are siblings of the deepest one."""
    root = Node("#root")
    stack, at, any_foreign = [root], 0, False

    def text(data: str) -> None:
        if data:
            stack[-1].children.append(plain(data))

    def close(names: frozenset[str], fence: frozenset[str]) -> bool:
        hit = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                hit = i
            elif stack[i].name in fence:
                break
        if hit:
            del stack[hit:]
        return bool(hit)

    def foreign() -> int:
        """Where the svg or math begins that the next tag stands in; 0 in HTML."""
        last = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in FOREIGN or stack[i].name in WITHIN), 0)
        return last if stack[last].name in FOREIGN else 0

    def into_table(name: str) -> None:
        last = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in IN_TABLE[name] or stack[i].name in ("td", "th", "caption", "template")), 0)
        if not last or stack[last].name not in PARTS:
            return
        if name == "table":
            del stack[last:]
            return
        del stack[last + 1 :]
        if name in CELLS and stack[last].name != "tr":
            row = Node("tr", None, stack[last].depth + 1)
            stack[last].children.append(row)
            if row.depth < MAX_DEPTH:
                stack.append(row)

    while found := _TOKEN.search(html, at):
        text(html[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            last = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name or stack[i].name in CLOSE_FENCE.get(name, ()) or (stack[i].name in ("td", "th") and name not in CLOSE_FENCE)), 0)
            if last and stack[last].name == name:
                del stack[last:]
            elif name in ("p", "br"):
                stack[-1].children.append(Node(name, None, stack[-1].depth + 1))
            continue
        if any_foreign and name in LEAVES and (last := foreign()):
            del stack[last:]
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in IN_TABLE:
            into_table(name)
        node = Node(name, _attributes(found[3]), stack[-1].depth + 1)
        stack[-1].children.append(node)
        any_foreign |= name in FOREIGN
        if any_foreign and _CLOSED.search(found[3]) and (name in FOREIGN or foreign()):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at) if name != "plaintext" else None
            node.children.append(html[at : end.start()] if end else html[at:])
            at = end.start() if end else len(html)
            stack.append(node)
        elif name not in VOID and node.depth < MAX_DEPTH:
            stack.append(node)
    text(html[at:])
    return root


def hidden(node: Node) -> bool:
    a = node.attributes
    return node.name in UNSEEN or "hidden" in a or bool("style" in a and _HIDING.search(a["style"])) or (node.name == "input" and a.get("type", "").lower() == "hidden") or (node.name == "dialog" and "open" not in a)


def _settle(node: Node, seen: bool = True) -> bool:
    """Takes out what an invisible element has of its own, while what is made visible again within it stays, and what a closed
    ``details`` has besides its summary. Whether anything is left to be seen."""
    if node.name == "details" and "open" not in node.attributes:
        node.children = [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]
    kept, left = [], False
    for c in node.children:
        if isinstance(c, str):
            if seen:
                kept.append(c)
                left = True
            continue
        said = _VISIBILITY.findall(c.attributes.get("style", ""))
        own = said[-1].lower() == "visible" if said else seen
        if _settle(c, own) or own:
            if not own and c.name == "li":
                c.name = "div"  # no mark
            kept.append(c)
            left = True
    node.children = kept
    return left


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in text)


class _Lines:
    """Lines of text with collapsed blanks; ``gap`` asks for line ends before the next text."""

    def __init__(self):
        self.lines, self.now, self.space, self.want = [], "", False, 0

    def gap(self, empty_lines: int) -> None:
        if self.now:
            self.lines.append(self.now)
            self.now = ""
        self.space, self.want = False, max(self.want, empty_lines)

    def _begin(self) -> None:
        if not self.now and self.want:
            if self.lines and self.lines[-1]:
                self.lines += [""] * self.want
            self.want = 0

    def text(self, data: str) -> None:
        parts = _BLANK.split(data)
        for i, part in enumerate(parts):
            self.space |= i > 0
            if part:
                self._begin()
                self.now += " " * bool(self.space and self.now) + part
                self.space = False

    def raw(self, lines: list[str]) -> None:
        """Finished lines, as a block."""
        if lines:
            self.gap(0)
            self._begin()
            self.lines += lines

    def end_line(self) -> None:
        self._begin()
        self.lines.append(self.now)
        self.now, self.space = "", False

    def done(self) -> list[str]:
        self.gap(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _plain(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.name == "br" else "" if hidden(c) else _plain(c) for c in node.children)


def _span(cell: Node, name: str, most: int) -> int:
    return min(most, number(cell.attributes.get(name), 1))


def _placed(rows: list[tuple[Node, list[Node]]]) -> list[tuple[int, int, int, int, list[str]]]:
    """(row, column, rows, columns, lines) of the cells of rows (their part of the table, cells): a cell that spans rows keeps
    its columns free in those below, to the end of its part at most."""
    ends, out, taken = {id(part): n + 1 for n, (part, _) in enumerate(rows)}, [], {}
    for n, (part, cells) in enumerate(rows):
        taken = {k: end for k, end in taken.items() if end > n}
        at = 0
        for cell in cells:
            while at in taken:
                at += 1
            wide, tall = max(1, _span(cell, "colspan", 1000)), _span(cell, "rowspan", 65534)
            end = ends[id(part)] if tall == 0 else min(ends[id(part)], n + tall)
            out.append((n, at, end - n, wide, render(cell)))
            if end > n + 1:
                taken |= dict.fromkeys(range(at, at + wide), end)
            at += wide
    return out


def _table(node: Node) -> list[str]:
    captions, rows, loose, parts = [], [], Node("#loose"), [(c, node, None) for c in reversed(node.children)]
    while parts:
        part, group, row = parts.pop()
        if isinstance(part, str):
            loose.children.append(part)
        elif hidden(part):
            continue
        elif part.name == "caption":
            captions.append(part)
        elif part.name in CELLS:
            if row is None:
                rows.append((group, row := []))
            row.append(part)
        elif part.name in PARTS and part.name != "table":
            if part.name == "tr":
                rows.append((group, row := []))
            parts += [(c, group if part.name == "tr" else part, row) for c in reversed(part.children)]
        elif part.name != "col":
            loose.children.append(part)
    before = render(loose)  # what stands in a table outside its cells is seen before it
    for c in captions:
        before += render(c)
    cells = _placed(rows)
    widths: dict[int, int] = {}
    heights = [0] * len(rows)
    for row, at, tall, wide, lines in cells:
        if wide == 1:
            widths[at] = max([widths.get(at, 0), *map(width, lines)])
        heights[row] = max(heights[row], len(lines) if tall == 1 else min(1, len(lines)))
    for row, _, tall, _, lines in sorted(cells, key=lambda c: c[0] + c[2]):
        if tall > 1:  # the last of a cell's rows takes what the others have no room for
            heights[row + tall - 1] += max(0, len(lines) - sum(heights[row : row + tall]))
    tops = [0]
    for h in heights:
        tops.append(tops[-1] + h)
    out: list[list[tuple[int, str]]] = [[] for _ in range(tops[-1])]
    for row, at, _, _, lines in cells:
        for i, line in enumerate(lines):
            out[tops[row] + i].append((at, line))
    left = {0: 0}
    for k in range(max([at for _, at, *_ in cells], default=0)):
        left[k + 1] = left[k] + widths.get(k, 0) + 2
    drawn = []
    for pieces in out:
        line = ""
        for at, piece in sorted(pieces, key=lambda p: p[0]):
            if at:
                line += " " * max(left[at] - width(line), 2 if line else 0)
            line += piece
        drawn.append(line.rstrip())
    return [*before, *drawn]


def _choices(node: Node) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node) and not hidden(c):
            if c.name in ("option", "optgroup"):
                yield c
            if c.name != "option":
                yield from _choices(c)


def _select(node: Node, out: _Lines) -> None:
    """All options of a list, with the labels of their groups; of a drop-down that which is selected, else the first."""
    a, all_ = node.attributes, list(_choices(node))
    shown = lambda c: c.attributes.get("label") or ("" if c.name == "optgroup" else _plain(c))
    if "multiple" in a or number(a.get("size"), 1) > 1:
        for c in all_:
            out.gap(0)
            out.text(shown(c))
        out.gap(0)
        return
    options = [c for c in all_ if c.name == "option"]
    chosen = [c for c in options if "selected" in c.attributes][-1:] or [c for c in options if "disabled" not in c.attributes][:1] or options[:1]
    for c in chosen:
        out.text(f" {shown(c)} ")


def _label(node: Node) -> str:
    """What an input shows: a button's value, the alternative of an image, the value or else the placeholder of a field."""
    a = node.attributes
    kind = a.get("type", "").lower()
    return a.get("alt", "") if kind == "image" else a.get("value", "") if kind in LABELLED else "" if kind in UNTYPED else a.get("value") or a.get("placeholder", "")


def _drawn(node: Node, out: _Lines) -> None:
    """The texts of a drawing, each on a line of its own."""
    for c in node.children:
        if isinstance(c, Node) and not hidden(c):
            if c.name in DRAWN:
                out.gap(0)
                _walk(c, out, [])
                out.gap(0)
            else:
                _drawn(c, out)


def _walk(node: Node, out: _Lines, order: list) -> None:
    for c in node.children:
        if isinstance(c, str):
            out.text(c)
        elif hidden(c):
            continue
        elif c.name == "br":
            out.end_line()
        elif c.name == "hr":
            out.gap(1)
        elif c.name == "img":
            out.text(c.attributes.get("alt", ""))
        elif c.name == "input":
            out.text(_label(c))
        elif c.name == "select":
            _select(c, out)
        elif c.name == "textarea":
            lines = plain("".join(x for x in c.children if isinstance(x, str))).removeprefix("\n").replace("\r", "").split("\n")
            if len(lines) == 1:
                out.text(f" {lines[0]} ")
            else:
                out.raw([line.rstrip() for line in lines])
                out.gap(0)
        elif c.name == "svg":
            _drawn(c, out)
        elif c.name in ("mtd", "mfrac"):  # cells and the parts of a fraction stand apart
            for part in c.children if c.name == "mfrac" else [c]:
                if isinstance(part, str):
                    out.text(part)
                elif not hidden(part):
                    inner = Node("#part", None, part.depth)
                    inner.children = part.children if part is c else [part]
                    out.text(" ")
                    _walk(inner, out, [])
            out.text(" ")
        elif c.name == "pre":
            out.gap(1)
            out.raw([line.rstrip() for line in _plain(c).removeprefix("\n").replace("\r", "").split("\n")])
            out.gap(1)
        elif c.name == "table":
            out.gap(1)
            out.raw(_table(c))
            out.gap(1)
        elif c.name == "li":
            out.gap(0)
            mark = "- "
            if order and order[-1] is not None:
                order[-1] = number(c.attributes.get("value"), order[-1])
                mark = f"{order[-1]}. "
                order[-1] += 1
            lines = render(c)
            out.raw([mark + (lines[0] if lines else "")] + [" " * len(mark) * bool(x) + x for x in lines[1:]])
            out.gap(0)
        elif c.name in ("ul", "ol", "menu"):
            nested = node.name == "li"
            out.gap(0 if nested else 1)
            _walk(c, out, [number(c.attributes.get("start"), 1)] if c.name == "ol" else [None])
            out.gap(0 if nested else 1)
        elif c.name in ("dd", "blockquote"):
            out.gap(c.name == "blockquote")
            out.raw([("  " + x) if x else x for x in render(c)])
            out.gap(c.name == "blockquote")
        elif c.name in BLOCKS:
            out.gap(int(c.name in SPACED))
            _walk(c, out, order if c.name == "li" else [])
            out.gap(int(c.name in SPACED))
        else:
            _walk(c, out, order)


def render(node: Node) -> list[str]:
    out = _Lines()
    _walk(node, out, [])
    return out.done()


def html_text(html: str | None) -> str | None:
    """Null for null; the visible text otherwise, lines joined by line feeds."""
    if html is None:
        return None
    root = build(html)
    if _PARTLY.search(html):
        _settle(root)
    return "\n".join(render(root))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, text, n_chars, n_lines.

    Null html gives a null text, 0 and 0; html without visible text an empty one. Broken markup never fails. Repeated
    rows and null ids give a row each, an empty table none. Other columns are not read.
    """

    @F.pandas_udf("string")
    def laid_out(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield batch.map(html_text)

    rows = only(pages, page_id=id_col, html=html_col).select("page_id", laid_out("html").alias("text"))
    lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return rows.select("page_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), lines.alias("n_lines"))
