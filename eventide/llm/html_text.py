"""Visible text of HTML pages, by a tree and a layout-aware renderer."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never shown; choices of a form count as controls, not as text.
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title meta link base object audio video canvas select option datalist".split())
#: Parts of drawings and formulas that are not shown.
_FOREIGN_HIDDEN = {"svg": frozenset("defs symbol metadata desc clippath mask pattern marker filter".split()), "text": frozenset(["desc"]), "math": frozenset(["annotation", "annotation-xml"])}
#: Inside drawings and formulas: elements that hold HTML again, and start tags that end the drawing or formula.
_HOLDS_HTML = {"svg": frozenset("foreignobject desc title".split()), "text": frozenset(["desc", "title"]), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
_BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Elements of formulas whose children stand apart.
_APART = frozenset(["mtable", "mtr", "mfrac"])
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li listing main menu nav ol optgroup option p pre search section summary ul table caption thead tbody tfoot tr td th hr".split()
)
#: Blocks that have an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
_CLOSES_P = BLOCK - frozenset("body html dd dt li option optgroup legend caption thead tbody tfoot tr td th summary".split()) | frozenset(["li", "dd", "dt"])
#: By a start tag: the open elements that it ends, and those at which the search stops.
_CELL, _ROW, _PART = frozenset(["td", "th"]), frozenset(["tr"]), frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"])
_TABLE, _LISTS = frozenset(["table", "template", "html"]), frozenset(["ul", "ol", "menu", "dir", "table", "template", "html"])
_HEADS = frozenset(["caption", "colgroup"])
#: Where only parts of a table may stand, all that is such a part, and what may stand there besides.
_FRAME = frozenset(["table", "thead", "tbody", "tfoot", "tr"])
_PARTS = _CELL | _ROW | _PART | frozenset(["col"])
_NEUTRAL = frozenset(["script", "style", "template"])
_IMPLIED = {
    "li": (frozenset(["li"]), _LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "html"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "html"])),
    "td": (_CELL | _HEADS, _TABLE | _ROW), "th": (_CELL | _HEADS, _TABLE | _ROW), "tr": (_CELL | _ROW | _HEADS, _TABLE | frozenset(["thead", "tbody", "tfoot"])),
    **{x: (_CELL | _ROW | _PART, _TABLE) for x in ("thead", "tbody", "tfoot", "colgroup", "caption")},
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
#: Attributes as browsers read them: quotes count only where a value begins, and one that is never closed runs to the end of the page.
_WITHIN = r"(?>[\s/]++|(?:[^\s/>=]++|=[^\s/>=]*+)(?:\s*+=\s*+(?>\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])[^\s>]*+))?+)*+"
#: Comments, declarations, end tags, start tags.
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*+){_WITHIN}(?:>|\Z)|<([a-zA-Z][^\s/>]*+)({_WITHIN})(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)", re.S)
_SPACE = re.compile(r"[ \t\r\n\f]+")
_ATTRIBUTE = re.compile(r"([^\s/>=]++|=[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+")
#: Rows that lie further than this from left to right aren't aligned.
MOST_COLUMNS = 1000
MOST_DEPTH = 512


class Node:
    __slots__ = ("tag", "children", "attributes", "hidden", "inside", "unseen")

    def __init__(self, tag: str, attributes: str = "", around: str = "") -> None:
        """``inside`` is what the children are in: '' (HTML), svg, text (of svg) or math; ``around`` the same of the parent."""
        self.tag, self.attributes, self.children, self.unseen = tag, attributes, [], False
        self.hidden = tag in HIDDEN or bool(attributes) and _hides(tag, attributes) or tag == "dialog" and "open" not in _attributes(attributes)
        self.inside = around
        if tag in ("svg", "math"):
            self.inside = tag
        elif around:
            self.hidden = self.hidden or tag in _FOREIGN_HIDDEN[around] or around != "math" and _not_drawn(attributes)
            self.inside = "" if tag in _HOLDS_HTML[around] else "text" if around == "svg" and tag == "text" else around


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


def _declared(style: str) -> dict[str, tuple[bool, str]]:
    """(important, value) of the display and visibility that declarations give; the last one of a name counts, or the last important one."""
    out: dict[str, tuple[bool, str]] = {}
    for one in style.lower().split(";"):
        name, _, value = one.partition(":")
        name = name.strip()
        if name in ("display", "visibility"):
            value, mark, _ = value.partition("!")
            if bool(mark) >= out.get(name, (False, ""))[0]:
                out[name] = (bool(mark), value.strip())
    return out


def _hides(tag: str, raw: str) -> bool:
    """Whether an element's own attributes keep it from being laid out; its visibility is another matter."""
    low = raw.lower()
    if not ("hidden" in low or "style" in low or "type" in low):
        return False
    a = _attributes(raw)
    display = _declared(a["style"]).get("display", (False, ""))[1] if "style" in a else ""
    return (
        display == "none" or "hidden" in a and a["hidden"].lower() != "until-found" and not display
        or a.get("aria-hidden", "").lower() == "true" or tag == "input" and a.get("type", "").lower() == "hidden"
    )


_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")


class Rules:
    """The rules of a page's style elements that set display or visibility, by what the last part of their selector asks for.

    Selectors are made of tags, classes and ids, one inside or a child of the other; those with anything else are passed over, and
    so are rules for media other than the screen.
    """

    def __init__(self, sheets: list[str]) -> None:
        self.by: dict[str, list[tuple]] = {}
        self.n = 0
        for css in sheets:
            self._read(re.sub(r"(?s)/\*.*?(?:\*/|\Z)|<!--|-->", " ", css))

    def _read(self, css: str) -> None:
        at = 0
        while (m := re.compile(r"[{;}]").search(css, at)) is not None:
            head, at = css[at : m.start()].strip(), m.end()
            if m[0] != "{":
                continue
            depth, start = 1, at
            while depth and (m := re.compile(r"[{}]").search(css, at)) is not None:
                depth += 1 if m[0] == "{" else -1
                at = m.end()
            body = css[start : at - 1] if not depth else css[start:]
            at = at if not depth else len(css)
            if head.startswith("@"):
                if re.fullmatch(r"(?i)@media\s+(?:only\s+)?(?:all|screen)", head):
                    self._read(body)
                continue
            found = _declared(body) if "display" in body.lower() or "visibility" in body.lower() else {}
            for selector in head.split(",") if found else ():
                self._add(selector.strip(), found)

    def _add(self, selector: str, found: dict) -> None:
        chain, child = [], False
        for part in re.sub(r"\s*>\s*", " > ", selector).split():
            if part == ">":
                child = True
                continue
            m = _COMPOUND.fullmatch(part)
            if m is None:
                return
            names = re.findall(r"[.#][\w-]+", m[2])
            chain.append((child, None if m[1] in (None, "*") else m[1].lower(), frozenset(names)))
            child = False
        if not chain or child:
            return
        weight = (sum(x[0] == "#" for c in chain for x in c[2]), sum(x[0] == "." for c in chain for x in c[2]), sum(c[1] is not None for c in chain))
        self.n += 1
        last = chain[-1]
        self.by.setdefault(min(last[2], default=last[1] or "*"), []).append((chain, weight, self.n, found))

    @staticmethod
    def _fits(chain: list, node: tuple[str, frozenset], above: list[tuple[str, frozenset]]) -> bool:
        child, tag, names = chain[-1]
        if tag not in (None, node[0]) or not names <= node[1]:
            return False
        if len(chain) == 1:
            return True
        return any(Rules._fits(chain[:-1], above[k], above[:k]) for k in range(len(above) - 1, len(above) - 2 if child else -1, -1) if k >= 0)

    def of(self, node: tuple[str, frozenset], above: list[tuple[str, frozenset]], style: str) -> dict[str, str]:
        """What holds for an element, given its names and those above it: the most important, then inline, then the most specific, then the last."""
        best: dict[str, tuple] = {}
        for key in (*node[1], node[0], "*"):
            for chain, weight, order, found in self.by.get(key, ()):
                if self._fits(chain, node, above):
                    for name, (important, value) in found.items():
                        best[name] = max(best.get(name, ((),)), ((important, False, weight, order), value))
        for name, (important, value) in _declared(style).items() if style else ():
            best[name] = max(best.get(name, ((),)), ((important, True, (0, 0, 0), 0), value))
        return {name: x[1] for name, x in best.items()}


def _settle(root: Node, rules: Rules) -> None:
    """Apply style rules, and let visibility pass to what is inside; the text of what isn't visible goes, but not what is visible inside of it."""
    todo: list[tuple[Node, list, bool]] = [(root, [], False)]
    while todo:
        node, above, unseen = todo.pop()
        a = _attributes(node.attributes) if node.attributes else {}
        name = (node.tag, frozenset([*("." + c for c in a.get("class", "").split()), *(["#" + a["id"]] if a.get("id") else [])]))
        got = rules.of(name, above, a.get("style", ""))
        display, seen = got.get("display", ""), got.get("visibility", "")
        if display == "none":
            node.hidden = True
        elif display and node.hidden and not node.inside and not (node.tag in HIDDEN or node.tag in ("dialog", "input") or a.get("aria-hidden", "").lower() == "true"):
            node.hidden = False
        if seen in ("hidden", "collapse", "visible"):
            unseen = seen != "visible"
            if seen == "collapse" and node.tag in ("tr", "tbody", "thead", "tfoot"):
                node.hidden = True
        node.unseen = unseen
        if unseen:
            node.children = [c if isinstance(c, Node) else " " for c in node.children]
        below = [*above, name] if rules.n else above
        todo += [(c, below, unseen) for c in node.children if isinstance(c, Node) and not (c.hidden and c.tag in HIDDEN)]


def _not_drawn(raw: str) -> bool:
    if "display" not in raw and "visibility" not in raw:
        return False
    a = _attributes(raw)
    return a.get("display", "").strip() == "none" or a.get("visibility", "").strip() in ("hidden", "collapse")


def parse(page: str) -> Node:
    """The element tree of a page, with the tags that HTML lets authors leave out put in their places.

    A start tag ends an open paragraph, list item, term, cell or row as HTML says; a cell outside of a row
    gets one; an end tag ends all that is open inside of its element, and is passed over if there is no
    such element (up to the nearest cell or table). Anything still open ends with the page. Beyond
    ``MOST_DEPTH`` levels, elements become siblings, as in browsers; what is inside of a hidden one there is hidden with it.
    A tag that the page ends in doesn't count. Style rules and visibility are applied to the tree in the end.

    Text and elements that stand between the parts of a table come before the table; a part of a table ends
    whatever else is open there, and a form there holds nothing. In drawings and formulas, tags may end
    themselves, text counts in text elements, and HTML's own elements end the drawing.
    """
    root = Node("html")
    stack = [root]
    at, n = 0, len(page)
    sheets: list[str] = []
    # open elements that lie deeper than the tree goes, and how many of them are hidden
    over: list[Node] = []
    off = 0

    def push(node: Node) -> None:
        nonlocal off
        if len(stack) < MOST_DEPTH:
            stack.append(node)
        else:
            over.append(node)
            off += node.hidden

    def close(tags: frozenset[str], stops: frozenset[str]) -> None:
        # ends up to the outermost element of tags that lies above any of stops
        last = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stops:
                break
            if stack[k].tag in tags:
                last = k
        if last:
            del stack[last:]

    def put(x: Node | str) -> None:
        if off:
            return
        # what isn't part of a table goes before it, in the table's parent
        if stack[-1].tag in _FRAME and not stack[-1].inside:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "table":
                    above = stack[k - 1].children
                    above.insert(len(above) - 1, x)
                    return
                if stack[k].tag not in _FRAME:
                    break
        stack[-1].children.append(x)

    def put_text(text: str) -> None:
        top = stack[-1]
        if top.inside == "svg" or off:
            return
        if text.isspace():
            top.children.append(text)
            return
        if top.tag == "colgroup":
            stack.pop()
        put(html.unescape(text) if "&" in text else text)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            put_text(page[at:])
            break
        if m.start() > at:
            put_text(page[at : m.start()])
        at = m.end()
        if (m[1] or m[2]) and page[at - 1] != ">":
            break
        if over and len(stack) < MOST_DEPTH:
            over, off = [], 0
        if m[2]:
            tag = m[2].lower()
            if stack[-1].inside and (tag in _BREAKS_OUT or tag == "font" and re.search(r"(?i)\b(?:color|face|size)\b", m[3])):
                while stack[-1].inside:
                    stack.pop()
            around = stack[-1].inside
            if around or tag in ("svg", "math"):
                node = Node(tag, m[3], around)
                if not around and stack[-1].tag == "colgroup":
                    stack.pop()
                put(node)
                if m[3].endswith("/") and _ATTRIBUTE.sub("", m[3]).endswith("/"):
                    continue
                if tag in ("script", "style"):
                    end = re.compile(rf"(?i)</{tag}(?=[\s/>]|\Z)").search(page, at)
                    if tag == "style":
                        sheets.append(page[at : end.start() if end else n])
                    at = end.start() if end else n
                push(node)
                continue
            if stack[-1].tag == "colgroup" and tag not in ("col", "template"):
                stack.pop()
            if tag in _CLOSES_P:
                close(frozenset(["p"]), _TABLE | _CELL | frozenset(["caption", "button"]))
            if tag in _IMPLIED:
                close(*_IMPLIED[tag])
            if tag in _PARTS or tag == "table":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in _FRAME:
                        del stack[k + 1 :]
                        break
                    if stack[k].tag in _CELL or stack[k].tag in _HEADS or stack[k].tag == "template":
                        break
            if tag == "table" and stack[-1].tag in _FRAME:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "table":
                        del stack[k:]
                        break
                    if stack[k].tag not in _FRAME:
                        break
            if tag == "form" and stack[-1].tag in _FRAME:
                continue
            if tag in _CELL and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                stack.append(row)
            if tag in ("html", "body") and any(x.tag == tag for x in stack):
                continue
            if tag == "body":
                del stack[1:]
            elif len(stack) > 1 and stack[1].tag == "head" and tag in BLOCK:
                del stack[1:]
            node = Node(tag, m[3])
            if not (tag in _PARTS or tag in _NEUTRAL):
                put(node)
            elif not off:
                stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"(?i)</{tag}(?=[\s/>]|\Z)").search(page, at)
                stop = end.start() if end else n
                body = page[at:stop]
                if tag in ("textarea", "title"):
                    body = html.unescape(body)
                node.children.append(body)
                if tag == "style" and not any(x.tag == "template" for x in stack):
                    sheets.append(body)
                at = page.find(">", stop) + 1 or n if end else n
            elif tag == "plaintext":
                node.children.append(page[at:])
                break
            elif tag not in VOID:
                push(node)
        elif m[1]:
            tag = m[1].lower()
            if over and any(x.tag == tag for x in over):
                while True:
                    x = over.pop()
                    off -= x.hidden
                    if x.tag == tag:
                        break
                continue
            if tag == "br":
                while stack[-1].inside:
                    stack.pop()
                put(Node("br"))
                continue
            fence = _TABLE if tag in ("template", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption") else _TABLE | _CELL
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in fence:
                    break
            else:
                if tag == "p":
                    put(Node("p"))
        elif m[0].startswith("<![CDATA["):
            if stack[-1].inside in ("text", "math"):
                put(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            elif not stack[-1].inside:  # a comment up to the next sign
                at = page.find(">", m.start()) + 1 or n
    rules = Rules(sheets)
    if rules.n or "visibility" in page.lower():
        _settle(root, rules)
    return root


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Canvas:
    """Lines in the making: white space collapses, and blocks ask for line breaks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.blank = False
        self.indent, self.mark = "", ""

    def text(self, s: str) -> None:
        words = _SPACE.split(s) if s else []
        if not words:
            return
        core = " ".join(w for w in words if w)
        if not core:
            self.space = self.space or bool(self.now)
            return
        if self.now and (self.space or not words[0]):
            self.now.append(" ")
        self.now.append(core)
        self.space = not words[-1]

    def line(self, force: bool = False) -> None:
        """End the line; an empty one only with ``force``."""
        if self.now or self.mark or force:
            body = "".join(self.now)
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append((self.indent[: len(self.indent) - len(self.mark)] + self.mark + body).rstrip(" "))
            self.mark = ""
        self.now, self.space = [], False

    def gap(self) -> None:
        self.line() if self.now else None
        self.blank = True

    def raw(self, lines: list[str]) -> None:
        for x in lines:
            self.now = [x] if x else []
            self.line(force=True)

    def done(self) -> list[str]:
        self.line()
        return self.lines


def _render(node: Node, out: Canvas, pre: bool = False) -> None:
    """Depth first, by a stack of its own: pages may nest deeply."""
    todo: list[tuple] = [("in", node, pre, None)]
    while todo:
        what, x, pre, extra = todo.pop()
        if what == "do":
            x()
            continue
        if isinstance(x, str):
            if not pre:
                out.text(x)
            else:
                first, *more = x.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                out.now.append(first)
                for y in more:
                    out.line(force=True)
                    out.now.append(y) if y else None
            continue
        if x.hidden:
            continue
        tag = x.tag
        if x.unseen and (tag in ("img", "input", "hr") or tag == "textarea"):
            continue
        if tag == "br":
            out.line(force=True)
            continue
        if tag == "hr":
            out.gap()
            out.raw(["---"])
            out.gap()
            continue
        if tag == "img":
            alt = _attributes(x.attributes).get("alt", "")
            out.text(alt)
            continue
        if tag == "input":
            a = _attributes(x.attributes)
            if a.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
                out.text(a.get("value", ""))
            continue
        if tag == "table":
            out.gap() if out.now or out.lines else None
            out.line()
            out.raw(_table(x))
            out.gap()
            continue
        children = x.children
        if tag == "details" and "open" not in _attributes(x.attributes):
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        after: list[tuple] = []
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "dl", "menu") and extra == "list"
            begin = out.gap if tag in SPACED and not nested else out.line
            # a list item's first block begins on the line of its mark
            if not (out.mark and not out.now):
                begin()
            after.append(("do", begin, pre, None))
            step = ""
            if tag == "li":
                kind, number = extra if isinstance(extra, tuple) else ("ul", 0)
                out.line()
                step = f"{number}. " if kind == "ol" else "- "
                out.indent += " " * len(step)
                out.mark = "" if x.unseen else step
            elif tag in ("dd", "blockquote"):
                step = "    " if tag == "dd" else "> "
                out.indent += step
            if step:

                def back(n: int = len(step)) -> None:
                    out.line()
                    out.indent = out.indent[:-n]

                after.insert(0, ("do", back, pre, None))
        inner = []
        if tag in ("ol", "ul", "menu", "dir"):
            a = _attributes(x.attributes) if tag == "ol" and x.attributes else {}
            step = -1 if "reversed" in a else 1
            number = 1 if step > 0 else sum(isinstance(c, Node) and c.tag == "li" and not c.hidden for c in children)
            number = _whole(a.get("start", ""), number)
            for c in children:
                if isinstance(c, Node) and c.tag == "li" and not c.hidden:
                    if tag == "ol" and "value" in c.attributes.lower():
                        number = _whole(_attributes(c.attributes).get("value", ""), number)
                    inner.append(("in", c, pre, ("ol" if tag == "ol" else "ul", number)))
                    number += step
                else:
                    inner.append(("in", c, pre, None))
        else:
            within = tag == "pre" or tag == "listing" or tag == "textarea"
            if within and children and isinstance(children[0], str):
                children = [re.sub(r"\A\r?\n", "", children[0]), *children[1:]]
            inner = [("in", c, pre or within, "list" if tag == "li" else None) for c in children]
            if x.inside and tag in _APART:
                inner = [y for one in inner for y in (("in", " ", False, None), one)]
            elif x.inside == "text" and tag == "text":
                inner = [("in", " ", False, None), *inner, ("in", " ", False, None)]
        todo += after[::-1]
        todo += inner[::-1]


def _whole(raw: str, other: int) -> int:
    """A whole number as attributes have it, or ``other``."""
    m = re.match(r"\s*([+-]?\d{1,9})(?!\d)", raw)
    return int(m[1]) if m else other


def _rows(table: Node) -> list[list[Node]]:
    """Rows in the order shown, in groups: of the head, of each body, of the foot."""
    parts: dict[str, list[list[Node]]] = {"thead": [], "tbody": [], "tfoot": []}
    loose = False
    for c in table.children:
        if isinstance(c, Node) and not c.hidden:
            if c.tag == "tr":
                if not loose:
                    parts["tbody"].append([])
                loose = True
                parts["tbody"][-1].append(c)
            elif c.tag in parts:
                loose = False
                # the parser leaves nothing else to be shown there
                parts[c.tag].append([r for r in c.children if isinstance(r, Node) and r.tag == "tr" and not r.hidden])
    return parts["thead"] + parts["tbody"] + parts["tfoot"]


def _span(a: dict[str, str], name: str, most: int) -> int:
    """Columns or rows that a cell takes; more than ``most`` count as that."""
    m = re.match(r"\s*\+?(\d+)", a.get(name, ""))
    n = (most if len(m[1].lstrip("0")) > 6 else min(int(m[1]), most)) if m else 1
    return n or (most if name == "rowspan" else 1)


def _grid(table: Node) -> list[dict[int, list[str]]]:
    """The rows' cells by column.

    Of cells that reach down, only the columns and the last row are kept, as intervals, so that spans of any size take no more room
    than their cells. They end with the group of rows.
    """
    grid: list[dict[int, list[str]]] = []
    for group in _rows(table):
        taken: list[tuple[int, int, int]] = []  # from, to (exclusive), rows to come; in ascending order
        for r, row in enumerate(group):
            cells: dict[int, list[str]] = {}
            k, at, new = 0, 0, []
            for c in row.children:
                if isinstance(c, str) and not c.strip():
                    continue
                if isinstance(c, Node) and c.hidden:
                    continue
                while at < len(taken) and taken[at][0] <= k:
                    k = max(k, taken[at][1])
                    at += 1
                cell = Canvas()
                _render(c, cell) if isinstance(c, Node) else cell.text(c)
                cells[k] = cell.done()
                a = _attributes(c.attributes) if isinstance(c, Node) and c.attributes else {}
                across, down = _span(a, "colspan", 1000), min(_span(a, "rowspan", 65_534), len(group) - r)
                if down > 1:
                    if new and new[-1][1] == k and new[-1][2] == down:
                        new[-1] = (new[-1][0], k + across, down)
                    else:
                        new.append((k, k + across, down))
                k += across
            taken = sorted((x, y, left - 1) for x, y, left in [*taken, *new] if left > 1)
            grid.append(cells)
    return grid


def _table(table: Node) -> list[str]:
    """A table's lines: its caption, then cells in columns as wide as their widest line, two spaces apart.

    Columns in which no cell begins take no room. With more than ``MOST_COLUMNS`` others, cells are two spaces apart and not aligned.
    """
    lines: list[str] = []
    loose = Canvas()
    for c in table.children:
        if isinstance(c, str):
            loose.text(c)
        elif c.tag not in ("thead", "tbody", "tfoot", "tr", "colgroup", "col"):
            _render(c, loose)
            loose.line()
    lines += loose.done()
    grid = _grid(table)
    used = sorted({k for row in grid for k in row})
    if len(used) > MOST_COLUMNS:
        number = {k: i for i, k in enumerate(used)}
        grid = [{i: cell for i, (_, cell) in enumerate(sorted(row.items()))} for row in grid]
        widths = [0] * len(number)
    else:
        number = {k: i for i, k in enumerate(used)}
        grid = [{number[k]: cell for k, cell in row.items()} for row in grid]
        widths = [0] * len(used)
        for row in grid:
            if max(row, default=0) > 0:
                for j, cell in row.items():
                    widths[j] = max([widths[j], *map(width, cell)])
    for row in grid:
        last = max(row, default=-1)
        for i in range(max(map(len, row.values()), default=0)):
            line = ""
            for j in range(last + 1):
                cell = row.get(j, [])
                s = cell[i] if i < len(cell) else ""
                line += s if j == last else s + " " * (max(widths[j] - width(s), 0) + 2)
            lines.append(line.rstrip(" "))
    return lines


def visible_text(page: str) -> str:
    """All visible text of a page, laid out in lines."""
    out = Canvas()
    _render(parse(page), out)
    return "\n".join(out.done())


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """Render pages: (page_id, url, text, n_lines).

    A tree is built with the tags that HTML implies. What is hidden by element (head, script, template
    ...), by attribute (hidden, aria-hidden) or by display:none is left out, with all inside; of what has visibility:hidden, all but what is visible again inside. Both
    may come from style attributes or from the page's own style elements, by selectors of tags, classes and ids. Left out, too, are closed dialogs, choices of forms (select, datalist), fallbacks of media and objects, and what a drawing only defines; the rest
    is all put out, navigation and footers, formulas and the text of drawings too. What stands between the parts of a table comes before it, as browsers show it. White space collapses except in pre; blocks start lines,
    paragraphs, headings, lists and tables have an empty line around them; list items have marks or numbers
    and are indented; cells stand in aligned columns, across spans, with a nested table inside its cell.

    Null markup: null text and lines. Empty markup or one with nothing visible: '' and 0 lines. Broken or plain text is rendered as it
    stands, nesting beyond 512 levels is flattened as browsers do, a tag in which the page ends is no text, and tables of more than 1000 columns aren't aligned. Null ids and urls, and repeated rows, are kept. Empty
    table: empty result. Other columns are ignored. Texts are read whole.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_lines", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [None if x is None else visible_text(x) for x in batch.column("m").to_pylist()]
                lines = [None if x is None else x.count("\n") + 1 if x else 0 for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("u"), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], schema=schema)

    rows = pages.select(F.col(page_id).cast("long").alias("i"), F.col(url).cast("string").alias("u"), F.col(markup).alias("m"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_lines long")
