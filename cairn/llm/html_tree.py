"""The element tree of a web page: tags and attributes as the HTML standard's tokenizer reads them, implied
tags, foster parenting and scope rules of its tree builder. Every step is constant time, so a page takes
time in proportion to its length, whatever stands in it."""

from __future__ import annotations

import html as entities
import re

_words = lambda text: frozenset(text.split())

# Element names of the HTML standard.
VOID = _words("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
RAW = _words("iframe noembed noframes noscript script style xmp")
TEXT_ONLY = _words("textarea title")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
FORMATTING = _words("a b big code em font i nobr s small strike strong tt u")
HEAD_ONLY = _words("base basefont bgsound link meta noframes noscript script style template title")
BLOCKS = _words(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul"
)
CLOSES_P = BLOCKS - {"button"} | HEADINGS | _words("p form li dd dt plaintext table hr xmp")
SPECIAL = CLOSES_P | _words("applet body button caption html marquee object select tbody td template tfoot th thead tr")
MARKED = _words("applet caption marquee object td template th")
PARTS = _words("table tbody tfoot thead tr")
PART_TAGS = _words("caption col colgroup tbody td tfoot th thead tr")
IMPLIED = _words("dd dt li optgroup option p rb rp rt rtc")
#: Elements of svg and math that hold html, and html tags that end svg and math.
INTEGRATION = {"svg": _words("foreignobject desc title"), "math": _words("mi mo mn ms mtext")}
BREAKOUT = _words(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var"
)

_SCOPE = _words("applet caption html marquee object table td template th")
#: What ends the search for an open element, by kind of search.
WALLS = {
    "scope": _SCOPE, "button": _SCOPE | {"button"}, "list": _SCOPE | {"ol", "ul"}, "table": _words("html table template"), "template": _words("html template"), "special": SPECIAL,
    "li": SPECIAL - _words("address div p li"), "dl": SPECIAL - _words("address div p dd dt"),
}
WALLS_OF = {tag: tuple(kind for kind, tags in WALLS.items() if tag in tags) for tag in SPECIAL}
FOREIGN_WALLS = tuple(kind for kind in WALLS if kind not in ("table", "template"))

_TAG = re.compile(r"<(/?)([a-zA-Z][^\t\n\f\r />]*+)")
_ATTRIBUTE = re.compile(r"[\t\n\f\r /]*+(=?[^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\t\n\f\r >]*+)))?")
_NUMBER = re.compile(r"&#(?:([xX])0*+([0-9a-fA-F]*+)|0*+([0-9]*+));?")
SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|;)\s*+(display|visibility)\s*+:\s*+([a-z-]++)([^;]*+)")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW | TEXT_ONLY}
#: Copies of drawn formulas for screen readers: clipped away by an own style, or by the style sheets of KaTeX and MathJax.
_CLIPPED = re.compile(r"clip\s*+:\s*+rect\(\s*+[01](?:px)?[\s,]")
_CLIPPED_CLASSES = _words("katex-mathml mjx-assistive-mml MJX_Assistive_MathML")
#: Elements that are not drawn.
UNDRAWN = _words(
    "head script style template noscript noembed noframes title datalist iframe object applet audio video canvas desc defs metadata annotation annotation-xml rp area base link meta param source track frameset"
)


def _number(m: re.Match) -> str:
    digits = m[2] if m[1] else m[3]
    if digits and len(digits) < 8:
        return f"&#{m[1] or ''}{digits};"
    return "\ufffd" if digits or "0" in m[0] else m[0]


def unescaped(text: str) -> str:
    """The text with character references replaced; a number beyond Unicode is U+FFFD, however long."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _NUMBER.sub(_number, text)
    return entities.unescape(text)


class Node:
    """kind: "none" (not drawn, nor what it holds), "hidden" or "visible" where the element says so, else None."""

    __slots__ = ("tag", "attributes", "children", "kind", "foreign")

    def __init__(self, tag: str, attributes: dict[str, str], kind: str | None = None, foreign: str = ""):
        self.tag, self.attributes, self.children, self.kind, self.foreign = tag, attributes, [], kind, foreign


def kind_of(tag: str, a: dict[str, str], drawn: bool) -> str | None:
    """Whether a browser draws the element or, unless ``drawn``, a screen reader says it."""
    if tag in UNDRAWN or tag == "mjx-assistive-mml" and drawn:
        return "none"
    if not a:
        return "none" if tag == "dialog" else None
    if "hidden" in a or (tag == "dialog" and "open" not in a):
        return "none"
    style = a.get("style", "").lower()
    if drawn:
        if ("class" in a and not _CLIPPED_CLASSES.isdisjoint(a["class"].split())) or (style and _CLIPPED.search(style)):
            return "none"
    elif a.get("aria-hidden", "").lower() == "true":
        return "none"
    said: dict[str, tuple[bool, str]] = {}
    for m in _STYLE.finditer(style) if style else ():
        firm = "!important" in m[3]
        if firm or not said.get(m[1], (False,))[0]:
            said[m[1]] = firm, m[2]
    if said.get("display", (0, ""))[1] == "none":
        return "none"
    seen = said.get("visibility", (0, ""))[1]
    return "hidden" if seen in ("hidden", "collapse") else "visible" if seen == "visible" else None


class _Formats:
    """Open formatting elements (b, i, a and so on). They have no layout and outlive the blocks they stand in,
    so they aren't in the tree; only what they hide is kept. A frame is what a cell, caption or object opens."""

    def __init__(self):
        self.frames: list[dict[str, list[list]]] = [{}]
        self.none, self.seen = 0, []

    def open(self, tag: str, kind: str | None, depth: int) -> None:
        entry = [kind, depth, True]
        self.frames[-1].setdefault(tag, []).append(entry)
        self.none += kind == "none"
        if kind in ("hidden", "visible"):
            self.seen.append(entry)

    def _drop(self, entry: list) -> None:
        entry[2] = False
        self.none -= entry[0] == "none"
        while self.seen and not self.seen[-1][2]:
            self.seen.pop()

    def close(self, tag: str) -> int | None:
        """How many elements were open before the last such element, if one is open."""
        held = self.frames[-1].get(tag)
        if not held:
            return None
        entry = held.pop()
        self._drop(entry)
        return entry[1]

    def end_frame(self) -> None:
        for held in self.frames.pop().values():
            for entry in held:
                self._drop(entry)


class Builder:
    def __init__(self, drawn: bool):
        self.drawn = drawn
        self.stack: list[Node] = []
        self.keys: list[str] = []
        #: Of each open element: the nearest html element, and the nearest that html content can stand in.
        self.html_at: list[int] = []
        self.holds_at: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.walls: dict[str, list[int]] = {kind: [] for kind in WALLS}
        #: Places of open elements that are hidden or visible by their own style.
        self.said: list[int] = []
        self.formats = _Formats()
        self.form: Node | None = None
        self.begun = False
        self.root = Node("html", {})
        self.push(self.root)

    # the stack of open elements

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        key = "/" + node.tag if node.foreign else node.tag
        self.keys.append(key)
        self.places.setdefault(key, []).append(at)
        holds = not node.foreign or holds_html(node)
        self.html_at.append(self.html_at[-1] if node.foreign else at)
        self.holds_at.append(at if holds else self.holds_at[-1])
        for kind in self.walls_of(node):
            self.walls[kind].append(at)
        if node.kind:
            self.said.append(at)
        if not node.foreign and node.tag in MARKED:
            self.formats.frames.append({})

    def walls_of(self, node: Node) -> tuple[str, ...]:
        return WALLS_OF.get(node.tag, ()) if not node.foreign else FOREIGN_WALLS if holds_html(node) else ()

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            node, key = self.stack.pop(), self.keys.pop()
            self.html_at.pop()
            self.holds_at.pop()
            if node.kind:
                self.said.pop()
            if key:
                self.places[key].pop()
            for kind in self.walls_of(node):
                self.walls[kind].pop()
            if not node.foreign and node.tag in MARKED:
                self.formats.end_frame()

    def last(self, *keys: str) -> int:
        """Place of the innermost open element of these names, -1 if none is open."""
        if len(keys) == 1:
            held = self.places.get(keys[0])
            return held[-1] if held else -1
        return max(held[-1] if (held := self.places.get(k)) else -1 for k in keys)

    def close(self, wall: str, *keys: str) -> bool:
        """Close the innermost such element unless a wall stands before it."""
        at = self.last(*keys)
        if at >= self.walls[wall][-1]:
            self.pop_to(at)
            return True
        return False

    # the tree

    def put(self, item: Node | str) -> None:
        """Add to the open element or, where only a table's parts can stand, in front of the table."""
        current = self.stack[-1]
        if current.tag in PARTS and not current.foreign and (at := self.last("table")) > self.last("template"):
            # an open table is the last child of what holds it
            self.stack[at - 1].children.insert(-1, item)
        else:
            current.children.append(item)

    def shown(self, item: Node | str) -> Node | str | None:
        """The item as open formatting elements leave it; None if one of them hides it for good."""
        formats = self.formats
        if formats.none:
            return None
        if formats.seen:
            kind, depth, _ = formats.seen[-1]
            # an element that was opened later and says otherwise stands inside the formatting element
            if not self.said or self.said[-1] < depth:
                wrap = Node("span", {}, kind)
                wrap.children.append(item)
                return wrap
        return item

    def text(self, text: str) -> None:
        current = self.stack[-1]
        if not text:
            return
        blank = not text.strip(" \t\n\r\f")
        if not blank:
            if current.tag == "head" and not current.foreign:
                self.pop_to(len(self.stack) - 1)
            self.begun = True
        if (item := self.shown(text)) is not None:
            if blank:
                self.stack[-1].children.append(item)
            else:
                self.put(item)

    def leaf(self, node: Node) -> None:
        if (item := self.shown(node)) is not None:
            self.put(item)

    def in_table(self) -> bool:
        """Whether a table is open and none of its cells or its caption is."""
        return self.last("table") > max(self.last("td", "th", "caption"), self.walls["template"][-1])

    def start(self, tag: str, a: dict[str, str], closed: bool) -> str:
        """Take a start tag. The name comes back if the text after it is raw."""
        current = self.stack[-1]
        if current.foreign and not (holds_html(current) and not (current.foreign == "math" and tag in ("mglyph", "malignmark"))) and not (current.tag == "annotation-xml" and tag == "svg"):
            if tag not in BREAKOUT and not (tag == "font" and not a.keys().isdisjoint(("color", "face", "size"))):
                self.put(node := Node(tag, a, kind_of(tag, a, self.drawn), current.foreign))
                if not closed:
                    self.push(node)
                return ""
            self.pop_to(self.holds_at[-1] + 1)
            current = self.stack[-1]
        if current.tag in ("select", "option", "optgroup") and self.last("select") > 0:
            if not self.in_select(tag, a):
                return ""
            current = self.stack[-1]
        if tag == "image":
            tag = "img"
        if current.tag == "head" and tag not in HEAD_ONLY:
            self.pop_to(len(self.stack) - 1)
        if tag in ("html", "body", "head", "frameset", "frame"):
            if tag == "head" and not self.begun and len(self.stack) == 1:
                self.put(node := Node(tag, a, "none"))
                self.push(node)
            elif tag == "body" and self.root.kind is None:
                self.root.kind = kind_of(tag, a, self.drawn)
            return ""
        self.begun = self.begun or tag not in HEAD_ONLY
        if tag in PART_TAGS:
            self.part(tag, a)
            return ""
        if tag in FORMATTING:
            if tag in ("a", "nobr"):
                self.end_format(tag)
            self.formats.open(tag, kind_of(tag, a, self.drawn), len(self.stack))
            return ""
        if tag in CLOSES_P:
            self.close("button", "p")
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.pop_to(len(self.stack) - 1)
            elif tag == "li":
                self.close("li", "li")
                self.close("button", "p")
            elif tag in ("dd", "dt"):
                self.close("dl", "dd", "dt")
                self.close("button", "p")
            elif tag == "table" and self.in_table():
                self.pop_to(self.last("table"))
        elif tag == "button":
            self.close("scope", "button")
        elif tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self.pop_to(len(self.stack) - 1)
        elif tag in ("rb", "rt", "rp", "rtc") and self.stack[-1].tag in ("rb", "rt", "rp"):
            self.pop_to(len(self.stack) - 1)
        if tag == "form" and self.form and self.last("template") < 0:
            return ""
        node = Node(tag, a, kind_of(tag, a, self.drawn), tag if tag in ("svg", "math") else "")
        if tag == "form":
            self.form = node
            if self.in_table():
                self.stack[-1].children.append(node)
                return ""
        if tag in VOID:
            self.leaf(node)
        elif tag in RAW or tag in TEXT_ONLY or tag == "plaintext":
            if tag in HEAD_ONLY:
                self.stack[-1].children.append(node)
            else:
                self.leaf(node)
            self.raw = node
            return tag
        else:
            if tag == "template":
                self.stack[-1].children.append(node)
            else:
                self.put(node)
            if not (node.foreign and closed):
                self.push(node)
        return ""

    def in_select(self, tag: str, a: dict[str, str]) -> bool:
        """Whether a start tag in a select goes on by the rules outside of it."""
        if tag in ("option", "optgroup", "hr"):
            for name in ("option", "optgroup") if tag != "option" else ("option",):
                if self.stack[-1].tag == name:
                    self.pop_to(len(self.stack) - 1)
            node = Node(tag, a, kind_of(tag, a, self.drawn))
            self.stack[-1].children.append(node)
            if tag != "hr":
                self.push(node)
            return False
        if tag in ("input", "textarea", "keygen") or (tag in PART_TAGS | {"table"} and self.last("table") > 0):
            self.pop_to(self.last("select"))
            return True
        if tag == "select":
            self.pop_to(self.last("select"))
        return tag in ("script", "template")

    def part(self, tag: str, a: dict[str, str]) -> None:
        """A part of a table: closes what can't hold it and opens the parts it needs."""
        table = self.last("table")
        if table < self.walls["template"][-1]:
            return
        if (cell := self.last("td", "th", "caption")) > table:
            self.pop_to(cell)
        body, row = self.last("tbody", "thead", "tfoot"), self.last("tr")
        if tag in ("td", "th", "tr"):
            self.pop_to(max(table, body, row if tag != "tr" else -1) + 1)
            needed = ["tbody"] * (body < table) + ["tr"] * (tag != "tr" and row < table)
        else:
            self.pop_to(table + 1)
            needed = []
        if tag in ("col", "colgroup"):
            return
        for name in (*needed, tag):
            node = Node(name, a if name is tag else {}, kind_of(tag, a, self.drawn) if name is tag else None)
            self.stack[-1].children.append(node)
            self.push(node)

    def end_format(self, tag: str) -> None:
        depth = self.formats.close(tag)
        if depth is not None and self.walls["special"][-1] < depth:
            self.pop_to(max(depth, self.html_at[-1]))

    def end(self, tag: str) -> None:
        current = self.stack[-1]
        if current.foreign:
            if tag in ("p", "br"):
                self.pop_to(self.holds_at[-1] + 1)
            elif self.last("/" + tag) > self.html_at[-1]:
                self.pop_to(self.last("/" + tag))
                return
        if current.tag in ("select", "option", "optgroup") and (select := self.last("select")) > 0:
            if tag == "select":
                self.pop_to(select)
            elif tag in ("option", "optgroup") and self.last(tag) > select:
                self.pop_to(self.last(tag))
            elif tag in PART_TAGS | {"table"} and self.last(tag) > 0:
                self.pop_to(select)
                self.end(tag)
            return
        if tag in ("html", "body"):
            return
        if tag == "head":
            if current.tag == "head":
                self.pop_to(len(self.stack) - 1)
        elif tag == "p":
            if not self.close("button", "p"):
                self.put(Node("p", {}))
        elif tag == "br":
            self.leaf(Node("br", {}))
        elif tag in FORMATTING:
            self.end_format(tag)
        elif tag == "li":
            self.close("list", "li")
        elif tag in HEADINGS:
            self.close("scope", *HEADINGS)
        elif tag == "form" and self.last("template") < 0:
            self.form, at = None, self.last("form")
            if at > self.walls["scope"][-1]:
                while self.stack[-1].tag in IMPLIED:
                    self.pop_to(len(self.stack) - 1)
                if at == len(self.stack) - 1:
                    self.pop_to(at)
                else:  # what stands open in it goes on
                    self.places["form"].pop()
                    self.keys[at] = ""
        elif tag == "table":
            if (at := self.last("table")) > self.walls["template"][-1]:
                self.pop_to(at)
        elif tag in PART_TAGS:
            self.close("table", tag)
        elif tag == "template":
            if self.last(tag) > 0:
                self.pop_to(self.last(tag))
        else:
            self.close("scope" if tag in BLOCKS or tag in MARKED or tag in ("dd", "dt", "form") else "special", tag)


def holds_html(node: Node) -> bool:
    return node.tag in INTEGRATION.get(node.foreign, ()) or (node.tag == "annotation-xml" and node.attributes.get("encoding", "").lower() in ("text/html", "application/xhtml+xml"))


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes of a tag, whether it ends with a slash, and where it ends (-1 if the page ends first)."""
    if page.startswith(">", at):
        return {}, False, at + 1
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        if not m[1]:
            return found, m[0].endswith("/"), at + 1 if page.startswith(">", at) else -1
        found.setdefault(m[1].lower(), unescaped(m[2] or m[3] or m[4] or ""))


def _script_end(page: str, at: int) -> re.Match | None:
    """End tag of a script; one inside a comment that opens another script belongs to that one."""
    end = _RAW_END["script"].search(page, at)
    inner = page.find("<!--", at, end.start()) if end else -1
    while end and inner >= 0:
        opened = re.compile(r"<script(?=[\t\n\f\r />])", re.I).search(page, inner, end.start())
        if not opened or page.find("-->", inner + 2, end.start()) >= 0:
            break
        inner = end.end()
        end = _RAW_END["script"].search(page, inner)
    return end


def build(page: str, drawn: bool = False) -> Node:
    """The element tree, with what is drawn (or said by a screen reader) marked on each element.

    Tags, attributes, comments and raw texts are read as the standard says: a quote opens a value only after
    an equals sign, and a tag that the page's end cuts off is no text."""
    page = page.replace("\0", "").replace("\r\n", "\n").replace("\r", "\n")
    builder, at, size = Builder(drawn), 0, len(page)
    while at < size:
        sign = page.find("<", at)
        if sign < 0:
            sign = size
        if sign > at:
            builder.text(unescaped(page[at:sign]))
        if sign == size:
            break
        m = _TAG.match(page, sign)
        if m:
            tag = m[2].lower()
            a, closed, at = _attributes(page, m.end())
            if at < 0:
                break
            if m[1]:
                builder.end(tag)
                continue
            raw = builder.start(tag, a, closed)
            if raw:
                end = None if raw == "plaintext" else _script_end(page, at) if raw == "script" else _RAW_END[raw].search(page, at)
                text = page[at : end.start() if end else size]
                text = unescaped(text) if raw in TEXT_ONLY else text
                if raw not in HEAD_ONLY and not SPACE.fullmatch(text):
                    builder.begun = True
                builder.raw.children.append(text)
                at = _attributes(page, end.end())[2] if end else size
                if at < 0:
                    break
        elif page.startswith("<![CDATA[", sign) and builder.stack[-1].foreign:
            end = page.find("]]>", sign)
            builder.text(page[sign + 9 : end if end >= 0 else size])
            at = end + 3 if end >= 0 else size
        elif page.startswith("<!--", sign):
            quick = re.compile(r"<!---?>").match(page, sign)
            if quick:
                at = quick.end()
            else:
                end = re.compile(r"--!?>").search(page, sign + 4)
                at = end.end() if end else size
        elif page.startswith(("<!", "<?", "</"), sign) and sign + 2 < size:
            end = page.find(">", sign + 2)
            at = end + 1 if end >= 0 else size
        else:
            builder.text("<")
            at = sign + 1
    return builder.root
