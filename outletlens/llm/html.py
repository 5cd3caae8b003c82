"""Layout-aware text of HTML pages.

A tree builder closes elements that a new tag implies to be closed and drops
stray end tags; visibility rules leave out what a browser wouldn't show by its
tag, its attributes and its own style (style sheets aren't read); the renderer
writes all visible text with block spacing, list marks and tables whose columns
are aligned. No step calls itself, and what is open is looked up by tag, so deep
and hostile pages cost no more than others. For their sake layout has bounds, text
has none: lists and quotes are indented by ``DEEPEST`` characters at most, tables
inside ``NESTED`` others are written row by row without columns, and a table whose
padding would exceed ``PADDING`` times its text (and a thousand characters) isn't
padded. Numbers of more than nine digits in attributes count as the greatest allowed.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame

from outletlens.llm import common
from outletlens.llm.pieces import slices

DEEPEST, NESTED, PADDING = 64, 6, 8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object embed audio video canvas datalist link meta base source track param area col colgroup annotation annotation-xml mphantom rp progress meter".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table caption tbody thead tfoot tr ul legend optgroup option mtr plaintext".split())
#: Blocks with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset menu dir".split())
#: Tags that close an open <p>.
CLOSES_P = frozenset("plaintext address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: New tag -> (tags it closes, tags beyond which it doesn't look).
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: End tags don't close anything outside these.
SCOPE = frozenset(["table", "td", "th", "caption", "template", "html"])
HEAD_ONLY = frozenset("base link meta title style script noscript template head html".split())

_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<(?:[!?]|/[^A-Za-z])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)", re.S)
#: The end of a tag, or an attribute: quotes count only where a value begins.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)|(["'])|(?=>)))?+)""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


_ZEROS = re.compile(r"&#0+(?=[0-9])")
_HUGE = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?")


def _unescape(s: str) -> str:
    """Character references as characters; numbers beyond all characters are U+FFFD, however long."""
    return entities.unescape(_ZEROS.sub("&#", _HUGE.sub("\ufffd", s))) if "&" in s else s


def _number(value: str, default: int, most: int) -> int:
    """A whole number of an attribute, between -``most`` and ``most``; anything else is ``default``."""
    found = re.match(r"[ \t\n\f\r]*([+-]?)([0-9]+)", value)
    if not found:
        return default
    size = min(int(found[2]), most) if len(found[2].lstrip("0")) <= 9 else most
    return -size if found[1] == "-" else size


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """(attributes, whether the tag closes itself, where it ends) of a tag whose name ends at ``at``; a tag that never ends takes the rest of the page."""
    out: dict[str, str] = {}
    while found := _ATTRIBUTE.match(page, at):
        if found[1]:
            return out, found.end() - at > 1 and page[found.end() - 2] == "/", found.end()
        if found[6]:
            break
        out.setdefault(found[2].lower(), _unescape(found[3] or found[4] or found[5] or ""))
        at = found.end()
    return out, False, len(page) + 1


class _Open:
    """The open elements, the innermost last, and where each tag is among them."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """Close the element at place ``k`` and all inside it."""
        for node in self.stack[k:]:
            self.at[node.tag].pop()
        del self.stack[k:]

    def last(self, tags) -> int:
        """The place of the innermost open element of ``tags``; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tags: frozenset, fence: frozenset) -> None:
        """Close the outermost open element of ``tags`` that is nearer than ``fence``."""
        wall, places = self.last(fence), []
        for t in tags:
            of = self.at.get(t, [])
            k = bisect_right(of, wall)
            places += of[k : k + 1]
        if places:
            self.cut(min(places))

    def foreign(self) -> bool:
        """Whether they end inside <svg> or <math>, where any tag can close itself."""
        return self.last(("svg", "math")) > self.last(("foreignobject",))


def parse(page: str) -> Node:
    """The tree of a page; the root has tag ''. Any input gives a tree."""
    root = Node("")
    now, at, n = _Open(root), 0, len(page)
    stack = now.stack
    while at < n:
        found = _MARKUP.search(page, at)
        if not found:
            stack[-1].children.append(_unescape(page[at:]))
            break
        if found.start() > at:
            text = _unescape(page[at : found.start()])
            if stack[-1].tag == "head" and text.strip():
                now.cut(len(stack) - 1)
            stack[-1].children.append(text)
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA[") and now.foreign():
                end = page.find("]]>", found.start())
                stack[-1].children.append(page[found.start() + 9 : end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
            continue
        attrs, closed, at = _attributes(page, at)
        if at > n:  # the page ends inside the tag
            break
        if found[1]:
            if tag == "p" and not now.at.get("p"):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif now.at.get(tag):
                free = tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot", "body")
                if free or now.at[tag][-1] > now.last(SCOPE):
                    now.cut(now.at[tag][-1])
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            now.cut(len(stack) - 1)
        if tag in ("html", "body") and now.at.get(tag):
            continue
        if tag in CLOSES_P:
            now.close(frozenset(["p"]), SCOPE)
        if tag in IMPLIED:
            now.close(*IMPLIED[tag])
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if closed and (tag in ("svg", "math") or now.foreign()):
            continue
        if tag == "plaintext":
            node.children.append(page[at:])
            break
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            stop = end.start() if end else n
            node.children.append(page[at:stop] if tag not in ("title", "textarea") else _unescape(page[at:stop]))
            at = n if not end else page.find(">", end.end() - 1) + 1 or n
        elif tag not in VOID and not (closed and tag in ("path", "circle", "rect", "use")):
            now.push(node)
    return root


def visible(node: Node) -> bool:
    """Whether a browser would lay the element out; what is laid out can still be unseen (``unseen``)."""
    a = node.attrs
    return node.tag not in UNSEEN and (node.tag != "dialog" or "open" in a) and not ("hidden" in a and a["hidden"] != "until-found") and not ("style" in a and _HIDDEN.search(a["style"]))


def unseen(node: Node, around: bool) -> bool:
    """Whether text straight in the element isn't shown, where that around it is or isn't."""
    found = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else []
    value = found[-1].lower() if found else node.attrs.get("visibility", "").lower() if node.tag in ("text", "g", "svg", "tspan") else ""
    return True if value in ("hidden", "collapse") else False if value == "visible" else around


def _drawn(svg: Node) -> list:
    """What an <svg> writes: its <text> and <foreignObject> elements, kept apart."""
    out, todo = [], svg.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, str) or not visible(c) or c.attrs.get("display") == "none":
            continue
        if c.tag in ("text", "foreignobject"):
            out += [" ", c, " "]
        elif c.tag == "switch":  # the first that fits is drawn
            todo += [x for x in c.children if isinstance(x, Node)][:1]
        elif c.tag in ("svg", "g", "a"):
            todo += c.children[::-1]
    return out


def _options(select: Node) -> list:
    """What a <select> shows: all of a list box, of a drop-down its chosen option."""
    rows, todo = [], [(c, False) for c in reversed(select.children)]
    while todo:
        c, off = todo.pop()
        if isinstance(c, str):
            continue
        off = off or "disabled" in c.attrs
        if c.tag == "option":
            label = c.attrs.get("label", "")
            rows.append(("option", [label] if label.strip() else c.children, off, c))
        else:
            if c.tag == "optgroup" and visible(c):
                rows.append(("optgroup", [c.attrs.get("label", "")], off, c))
            todo += [(x, off) for x in reversed(c.children)]
    size = select.attrs.get("size", "")
    if "multiple" in select.attrs or (_number(size, 0, 1000) > 1):
        out = []
        for tag, children, _, c in rows:
            if visible(c):
                out.append(Node(tag))
                out[-1].children = children
        return out
    options = [r for r in rows if r[0] == "option"]
    chosen = [r for r in options if "selected" in r[3].attrs][-1:] or [r for r in options if not r[2]][:1]
    return [" ", *chosen[0][1], " "] if chosen else []


class _Writer:
    """Lines of text with pending line breaks; white space collapses outside <pre>."""

    def __init__(self) -> None:
        self.lines, self.line, self.space, self.gap, self.prefix, self.level = [], [], False, 0, "", 0

    def text(self, value: str, keep: bool = False) -> None:
        if keep:
            first, *more = value.split("\n")
            self._put(first)
            for x in more:
                self.newline()
                self._put(x)
            return
        parts = _SPACE.split(value)
        for k, word in enumerate(parts):
            if k:
                self.space = True
            if word:
                self._put(word)

    def _put(self, word: str) -> None:
        if not word:
            return
        self._break()
        if self.space and self.line:
            self.line.append(" ")
        elif not self.line and self.prefix:
            self.line.append(self.prefix)
        self.space = False
        self.line.append(word)

    def newline(self) -> None:
        """A line break that counts even twice in a row."""
        self._break()
        self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def block(self, gap: int) -> None:
        """The next text starts a line, after ``gap`` - 1 empty ones at least."""
        self.gap, self.space = max(self.gap, gap), False

    def _break(self) -> None:
        if self.gap:
            if self.line:
                self.lines.append("".join(self.line).rstrip())
                self.line = []
            if self.lines and self.gap > 1 and self.lines[-1]:
                self.lines.append("")
            self.gap = 0

    def done(self) -> str:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        return "\n".join(self.lines).strip("\n")


def _run(first):
    """The result of a generator that yields others to wait for; they never nest on Python's own stack."""
    stack, value = [first], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def render(root: Node) -> str:
    """All visible text of a tree, in reading order."""
    return _run(_plain([root], False))


def _plain(nodes: list, hid: bool, level: int = 0):
    w = _Writer()
    w.level = level
    for x in nodes:
        yield _walk(x, w, False, 0, hid)
    return w.done()


def _walk(root, w: _Writer, pre: bool, depth: int, hid: bool):
    """Render a node into ``w``."""
    todo: list = [(root, pre, depth, 0, hid)]
    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        node, pre, depth, number, hid = item
        if isinstance(node, str):
            if not hid:
                w.text(node, pre)
            continue
        tag = node.tag
        if tag and not visible(node):
            continue
        hid = unseen(node, hid)
        if tag == "br":
            w.newline()
            continue
        if tag == "input" and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
            if not hid:
                w.text(node.attrs.get("value", ""))
            continue
        if tag == "img":
            if node.attrs.get("alt", "").strip() and not hid:
                w.text(node.attrs["alt"])
            continue
        gap = 2 if tag in SPACED and not (depth and tag in ("ul", "ol", "menu", "dir")) else 1 if tag in BLOCK else 0
        if tag == "hr":
            w.block(2)
            if not hid:
                w.text("---")
            w.block(2)
            continue
        if gap:
            w.block(gap)
        if tag == "table" and w.level < NESTED:
            yield _table(node, w, hid)
            w.block(2)
            continue
        if tag in ("td", "th"):  # of a table inside many others
            w.space = True
        after = [lambda gap=gap: w.block(gap)] if gap else []
        if tag in ("ul", "ol", "menu", "dir"):
            depth += 1
            number = _number(node.attrs.get("start", ""), 1, 10**9) if tag == "ol" else 0
            step = []
            for c in node.children:
                item_tag = isinstance(c, Node) and c.tag == "li" and visible(c)
                step.append((c, pre, depth, number if item_tag and tag == "ol" else 0, hid))
                number += item_tag and tag == "ol"
            todo += after + step[::-1]
            continue
        if tag == "li":
            if not hid:
                w.text(f"{number}." if number else "-", True)
                w.space = True
            old, w.prefix = w.prefix, w.prefix + "  " * (len(w.prefix) < DEEPEST)
            after.append(lambda old=old: setattr(w, "prefix", old))
        elif tag == "dd":
            old, w.prefix = w.prefix, w.prefix + "    " * (len(w.prefix) < DEEPEST)
            after.append(lambda old=old: setattr(w, "prefix", old))
        elif tag == "blockquote":
            old, w.prefix = w.prefix, w.prefix + "> " * (len(w.prefix) < DEEPEST)
            after.append(lambda old=old: setattr(w, "prefix", old))
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        inner = pre or tag in ("pre", "xmp", "listing", "plaintext")
        if tag == "svg":
            children = _drawn(node)
        elif tag == "select":
            children = _options(node)
        elif tag == "mtd":
            children = [" ", *children, " "]
        elif tag == "textarea":
            inner = True
            children = [c.removeprefix("\n") if isinstance(c, str) else c for c in children]
            w.space = True
            after.append(lambda: setattr(w, "space", True))
        if tag == "li" and children and isinstance(children[0], Node) and children[0].tag in ("p", "div"):
            first = children[0]
            children = [*first.children, *children[1:]] if visible(first) and not unseen(first, hid) else children[1:]
        todo += after + [(c, inner, depth, 0, hid) for c in reversed(children)]


def _rows(table: Node):
    """(rows, captions) of a table without those of tables inside it."""
    rows, captions, todo = [], [], [iter(table.children)]
    loose: list = []
    while todo:
        c = next(todo[-1], None)
        if c is None:
            todo.pop()
        elif isinstance(c, str):
            if c.strip():
                loose.append(c)
        elif not visible(c):
            continue
        elif c.tag == "tr":
            rows.append([x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th") and visible(x)])
            loose += [x for x in c.children if not (isinstance(x, Node) and x.tag in ("td", "th")) and not (isinstance(x, str) and not x.strip())]
        elif c.tag in ("tbody", "thead", "tfoot"):
            todo.append(iter(c.children))
        elif c.tag in ("td", "th"):
            rows.append([c])
        elif c.tag == "caption":
            captions.append(c)
        else:
            loose.append(c)
    return rows, captions, loose


def _span(cell: Node, name: str) -> int:
    return max(_number(cell.attrs.get(name, ""), 1, 1000), 1)


def _width(s: str) -> int:
    """Columns that a string takes: two for wide characters, none for combining ones."""
    return len(s) if s.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in s)


def _placed(rows: list[list[Node]]) -> list[list[tuple[int, int, Node]]]:
    """(first column, columns, cell) of the cells of every row; spans from rows above are kept as intervals."""
    out, above = [], []  # above: (first column, end, last row), in order
    for r, cells in enumerate(rows):
        above = [x for x in above if x[2] >= r]
        line, col, k, own = [], 0, 0, []
        for cell in cells:
            while k < len(above) and above[k][0] <= col:
                col = max(col, above[k][1])
                k += 1
            across, last = _span(cell, "colspan"), min(r + _span(cell, "rowspan"), len(rows)) - 1
            line.append((col, across, cell))
            if last > r:
                own.append((col, col + across, last))
            col += across
        if own:
            merged: list[tuple[int, int, int]] = []
            for x in sorted(above + own):
                if merged and merged[-1][2] == x[2] and merged[-1][1] == x[0]:
                    merged[-1] = (merged[-1][0], x[1], x[2])
                else:
                    merged.append(x)
            above = merged
        out.append(line)
    return out


def _table(table: Node, w: _Writer, hid: bool):
    """Cells padded to the width of their columns; a cell's lines stay one below another. Columns in which no cell begins take no place."""
    rows, captions, loose = _rows(table)
    for x in loose:  # what a browser moves before the table
        yield _walk(x, w, False, 0, hid)
        w.block(1)
    for x in captions:
        w.text((yield _plain(x.children, unseen(x, hid), w.level + 1)), True)
        w.block(1)
    grid: list[dict[int, tuple[int, list[str]]]] = []
    widths: dict[int, int] = {}
    for cells in _placed(rows):
        line = {}
        for col, across, cell in cells:
            lines = (yield _plain(cell.children, unseen(cell, hid), w.level + 1)).split("\n")
            line[col] = across, lines
            widths[col] = max(widths.get(col, 0), *(map(_width, lines) if across == 1 else (0,)))
        grid.append(line)
    columns = sorted(widths)
    under = lambda col, across: columns[bisect_left(columns, col) : bisect_left(columns, col + across)]
    spanned = sorted(((across, col, max(map(_width, lines))) for line in grid for col, (across, lines) in line.items() if across > 1))
    for across, col, wide in spanned:  # a cell over several columns widens the last of them if it must
        own = under(col, across)
        widths[own[-1]] += max(0, wide - sum(widths[c] for c in own) - 3 * (len(own) - 1))
    text = sum(len(x) for line in grid for _, lines in line.values() for x in lines)
    full = sum(max(len(x) for _, x in line.values()) for line in grid if line) * sum(widths[c] + 3 for c in columns)
    padded = full <= PADDING * text + 1000
    for line in grid:
        if not any("".join(x) for _, x in line.values()):
            continue
        shown = columns[: bisect_right(columns, max(line))] if padded else sorted(line)
        for k in range(max(len(x) for _, x in line.values())):
            parts, past = [], -1
            for col in shown:
                if col < past:
                    continue
                across, cell = line.get(col, (1, [""]))
                now = cell[k] if k < len(cell) else ""
                if padded:
                    own = under(col, across)
                    past = col + across
                    now += " " * (sum(widths[c] for c in own) + 3 * (len(own) - 1) - _width(now))
                parts.append(now)
            w.block(1)
            w.text(" | ".join(parts).rstrip(), True)


def extract(page: str | None) -> str | None:
    """Visible text of one page; null stays null, an empty page gives ''."""
    return None if page is None else render(parse(page))


def pages_text(pages: DataFrame) -> DataFrame:
    """page_id and text of every page (page_id, html; other columns are ignored).

    Null html gives null text, html without visible text ''; repeated rows give
    repeated results. Pages are handled one by one and whole.
    """
    ddl = "page_id long, text string"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in slices(batch.column("html")):
                out = [extract(x) for x in batch.column("html").slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(a, b - a), pa.array(out, pa.string())], schema=common.arrow_schema(ddl))

    return common.unique_columns(pages, "page_id", "html").mapInArrow(run, ddl)
