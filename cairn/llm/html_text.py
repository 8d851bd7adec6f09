"""HTML extraction (operator 10): layout-aware rendering of all visible text of a page's element tree, with
block spacing, lists and aligned table cells."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import read_table, slices, text_or_empty
from .html_tree import HEADINGS, SPACE, Node, build

# Element names of the HTML standard.
SPACED = frozenset("p blockquote pre listing xmp plaintext ul ol dl table figure fieldset".split()) | HEADINGS
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav optgroup search section summary tr hr".split())
KEPT = frozenset("pre listing xmp plaintext textarea".split())
#: Elements of svg and math whose text stands apart from its neighbours.
APART = frozenset("text mfrac mroot mtd mtr".split())
#: Inputs that show no value as text.
TEXTLESS = frozenset("hidden password checkbox radio file color range image".split())
NUMBER = re.compile(r"[ \t\n\f\r]*([+-]?[0-9]{1,9})(?![0-9])")
#: Levels of tables in cells that are aligned, and characters of indentation. What is nested deeper keeps its
#: text but gets no more columns and no more indentation, so the text stays in proportion to the page.
DEEP, INDENT = 16, 40


def number(text: str | None, otherwise: int) -> int:
    m = NUMBER.match(text or "")
    return int(m[1]) if m else otherwise


class Page:
    """Lines of a rendering: inline text joins with collapsed spaces, blocks begin lines, spaced blocks
    leave one empty line between them."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent = ""
        self.bullet = ""
        self.gap = False
        self.space = False

    def text(self, raw: str, keep: bool) -> None:
        if keep:
            for k, part in enumerate(raw.split("\n")):
                if k:
                    self.end(force=True)
                if part:
                    self.line.append(part)
            return
        words = SPACE.sub(" ", raw)
        if words.startswith(" "):
            self.space, words = True, words[1:]
        if words:
            trail = words.endswith(" ")
            if self.space and self.line:
                self.line.append(" ")
            self.line.append(words[:-1] if trail else words)
            self.space = trail

    def end(self, force: bool = False) -> None:
        line = "".join(self.line).rstrip(" ")
        self.line, self.space = [], False
        if line or force:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((self.indent + self.bullet + line).rstrip(" "))
            if self.bullet:
                if len(self.indent) < INDENT:
                    self.indent += " " * len(self.bullet)
                self.bullet = ""

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = self.gap or spaced


def options(select: Node) -> list[Node | str]:
    """What a select shows: all options of a list box, else the last selected or the first that can be chosen."""
    found, waiting = [], select.children[::-1]
    while waiting:
        child = waiting.pop()
        if isinstance(child, Node) and child.kind != "none":
            if child.tag == "option":
                found.append(child)
            else:
                waiting += child.children[::-1]
    a = select.attributes
    if "multiple" not in a and number(a.get("size"), 1) <= 1:
        found = [o for o in found if "selected" in o.attributes][-1:] or [o for o in found if "disabled" not in o.attributes][:1]
    return [part for o in found for part in (" ", o.attributes.get("label") or o, " ")]


class Cell:
    """A table cell: its columns and rows, then its lines."""

    __slots__ = ("node", "hidden", "wide", "high", "lines", "at")

    def __init__(self, node: Node, hidden: bool):
        self.node, self.hidden, self.lines, self.at = node, hidden, [], 0
        self.wide = min(1000, max(1, number(node.attributes.get("colspan"), 1)))
        self.high = max(0, number(node.attributes.get("rowspan"), 1))


def parts_of(table: Node, hidden: bool) -> tuple[list[tuple[Node, bool]], list[list[Cell]]]:
    """Captions and rows of cells that are drawn, with whether they begin hidden."""
    now = lambda n, h: h if n.kind is None else n.kind == "hidden"
    captions, rows = [], []
    waiting = [(c, hidden) for c in reversed(table.children)]
    while waiting:
        child, inherited = waiting.pop()
        if not isinstance(child, Node) or child.kind == "none":
            continue
        own = now(child, inherited)
        if child.tag == "caption":
            captions.append((child, inherited))
        elif child.tag == "tr":
            rows.append([Cell(c, now(c, own)) for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and c.kind != "none"])
            if any(c.high == 0 for c in rows[-1]):  # down to the last row
                for c in rows[-1]:
                    c.high = c.high or 65534
        else:
            waiting += [(c, own) for c in reversed(child.children)]
    return captions, rows


def render(root: Node) -> list[str]:
    """Lines of a tree's visible text. Walks with a stack of its own, so any depth will do."""
    page, counts, keep, hidden = Page(), [], 0, False
    outer: list[tuple] = []
    stack: list = [root]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if not hidden:
                page.text(item, keep > 0)
            continue
        if isinstance(item, tuple):
            step, what = item
            if step == "leave":
                tag, indent, hidden = what
                if tag in KEPT:
                    keep -= 1
                if tag in ("ul", "ol", "menu", "dir"):
                    counts.pop()
                if tag in BLOCK:
                    page.block(tag in SPACED and not (tag in ("ul", "ol") and counts))
                    page.indent, page.bullet = indent, ""
            elif step == "cell":
                outer.append((page, counts, keep, hidden))
                page, counts, keep, hidden = Page(), [], 0, what.hidden
                stack.append(("end", what))
                stack += reversed(what.node.children)
            elif step == "end":
                page.end()
                what.lines = page.lines
                page, counts, keep, hidden = outer.pop()
            else:
                for line in aligned(what):
                    page.line = [line]
                    page.end(force=True)
                page.block(True)
            continue
        tag, a = item.tag, item.attributes
        if item.kind == "none":
            continue
        was = hidden
        if item.kind:
            hidden = item.kind == "hidden"
        if tag == "br":
            page.end(force=True)
        elif tag == "img" or (tag == "input" and a.get("type", "").lower() == "image"):
            if not hidden:
                page.text(a.get("alt", ""), False)
        elif tag == "input":
            if not hidden and a.get("type", "").lower() not in TEXTLESS:
                page.text(a.get("value") or a.get("placeholder", ""), False)
        elif tag == "hr":
            page.block(True)
        elif tag == "table" and len(outer) < DEEP:
            page.block(True)
            captions, rows = parts_of(item, hidden)
            stack += [("leave", ("", "", was)), ("rows", rows)]
            stack += [("cell", c) for r in reversed(rows) for c in reversed(r)]
            stack += [c for c, _ in reversed(captions)]
            continue
        else:
            children = options(item) if tag == "select" else item.children
            if tag in APART and item.foreign or tag in ("td", "th"):
                children = [" ", *([x for c in children for x in (" ", c)] if tag == "mfrac" else children), " "]
            if tag in BLOCK or tag in KEPT or hidden is not was:
                stack.append(("leave", (tag, page.indent, was)))
                was = hidden
            if tag in BLOCK:
                page.block(tag in SPACED and not (tag in ("ul", "ol") and counts))
                if tag in ("ul", "ol", "menu", "dir"):
                    down = tag == "ol" and "reversed" in a
                    first = sum(isinstance(c, Node) and c.tag == "li" for c in children) if down else 1
                    counts.append([tag, number(a.get("start"), first), -1 if down else 1])
                elif tag == "li":
                    kind = counts[-1] if counts else ["ul", 1, 1]
                    kind[1] = number(a.get("value"), kind[1])
                    if not hidden:
                        page.bullet = f"{kind[1]}. " if kind[0] == "ol" else "* "
                    kind[1] += kind[2]
                elif tag in ("dd", "blockquote") and len(page.indent) < INDENT:
                    page.indent += "  "
            if tag in KEPT:
                keep += 1
                if children and isinstance(children[0], str) and children[0].startswith("\n"):
                    children = [children[0][1:], *children[1:]]
            stack += reversed(children)
        hidden = was
    page.end()
    return page.lines


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table. A column is as wide as the widest line of the cells in it alone, and two spaces stand
    between columns; a cell over several columns widens the last of them if it must. A table whose spaces
    would far outweigh its text has its cells two spaces apart instead."""
    columns = 0
    taken, ends = 0, {}  # bits of columns that cells of earlier rows reach down to, and what ends at a row
    down = any(c.high > 1 for r in rows for c in r) and max((sum(c.wide for c in r) for r in rows), default=0) <= 1000
    for n, row in enumerate(rows):
        taken &= ~ends.pop(n, 0)
        at = 0
        for cell in row:
            if taken >> at:
                free = ~(taken >> at)
                at += (free & -free).bit_length() - 1
            cell.at = at
            at += cell.wide
            if down and cell.high > 1:
                bits = ((1 << cell.wide) - 1) << cell.at
                taken |= bits
                ends[n + cell.high] = ends.get(n + cell.high, 0) | bits
        columns = max(columns, at)
    starts = sorted({c.at for r in rows for c in r})
    place = {c: k for k, c in enumerate(starts)}
    width = [0] * len(starts)
    over = []
    for cell in (c for r in rows for c in r):
        widest = max(map(len, cell.lines), default=0)
        k = place[cell.at]
        if k + 1 == len(starts) or starts[k + 1] >= cell.at + cell.wide:
            width[k] = max(width[k], widest)
        elif widest:
            over.append((cell.at + cell.wide, k, widest))
    for end, k, widest in sorted(over):
        last = k
        room = -2
        while last < len(starts) and starts[last] < end:
            room += width[last] + 2
            last += 1
        if room < widest:
            width[last - 1] += widest - room
    offset = [0]
    for w in width:
        offset.append(offset[-1] + w + 2)
    high = [max((len(c.lines) for c in r), default=0) for r in rows]
    natural = sum(len(line) + 2 for r in rows for c in r for line in c.lines)
    padded = sum(h * offset[place[r[-1].at]] for h, r in zip(high, rows) if r)
    loose = padded > 16 * natural + 10_000
    out = []
    for h, row in zip(high, rows):
        for n in range(h):
            parts, size = [], 0
            for cell in row:
                line = cell.lines[n] if n < len(cell.lines) else ""
                if loose:
                    parts.append(line if not parts else "  " + line)
                elif line:
                    gap = offset[place[cell.at]] - size
                    parts.append(" " * gap + line)
                    size += gap + len(line)
            out.append("".join(parts).rstrip(" "))
    return out


def visible_text(page: str, drawn: bool = False) -> str:
    """The text for a screen reader or, if ``drawn``, all text that a browser draws."""
    lines = render(build(page, drawn))
    first, last = 0, len(lines)
    while last and not lines[last - 1]:
        last -= 1
    while first < last and not lines[first]:
        first += 1
    return "\n".join(lines[first:last])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = [visible_text(t, drawn=True).encode("utf-8", "replace").decode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])


def html_text(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, text, n_chars, n_lines.

    All text that is drawn counts, hidden from screen readers or not; scripts count as running, so noscript is
    not drawn, and closed details count as opened. Any text is a page: null and empty html give an empty text
    with no line, markup of any kind is read as a browser reads it (a tag that the page's end cuts off is
    dropped), and time and memory follow a page's length. Tables are aligned down to ``DEEP`` levels in one
    another and lines indented by at most some ``INDENT`` characters; what is deeper keeps its text.
    Rows are independent, so repeated rows and null ids each give their row. Other columns aren't carried; an
    empty table gives an empty one. One pass, no shuffle."""
    rows = pages.select("page_id", text_or_empty(F.col("html")).alias("text")).mapInArrow(_extract, "page_id long, text string")
    lines = F.when(F.length("text") == 0, 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    return rows.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(read_table(spark, sf_dir, "pages"))
