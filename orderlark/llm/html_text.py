"""Layout-aware rendering of HTML to text.

A tree builder reads tags with implied ends (a block ends a paragraph, an item the item before
it, a row or cell the one before it), and elements are laid out as they close: blocks start on
their own lines with blank lines between them, list items have markers and indents, cells of a
table stand in aligned columns, preformatted text keeps its white space. Elements that are not
shown (scripts, styles, head content, hidden ones) leave nothing; all other text is emitted.

One page is one small state machine without recursion, so nesting depth and length are bounded
by memory for the page alone. Rows are independent; there is no shuffle.

Defined results: a null or empty page renders to an empty text; broken markup is read as far
as it goes (an unclosed comment or quote runs to the end); repeated rows are rendered each for
itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlark.llm.common import table

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)"""
    r"|[^<]++|<",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f\v]+")

# Fixed values of the HTML standard: element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp".split())
ESCAPED_RAW = frozenset("textarea title".split())
UNRENDERED = frozenset("area base datalist head iframe link meta noembed noframes param rp script style template title".split())
PARAGRAPHS = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
BLOCKS = PARAGRAPHS | frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav option optgroup search section summary".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption html legend option optgroup".split())
# What a start tag ends, and the elements that shield what stands outside them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
SCOPES = frozenset({"table", "td", "th", "caption", "html"})
INDENT = 2
#: Cells wider than this do not widen their column.
WIDEST = 60


class Lines:
    """Text laid out so far in one block context: the page or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.piece: list[str] = []
        self.space = False  # a collapsed blank waits for the next word
        self.margin = False
        self.indents: list[str] = []
        self.marker = ""

    def text(self, data: str, kept: bool) -> None:
        if kept:
            first, *rest = data.split("\n")
            if first:
                self.piece.append((" " if self.space and self.piece else "") + first)
                self.space = False
            for line in rest:
                self.end_line(force=True)
                if line:
                    self.piece.append(line)
            return
        words = BLANKS.sub(" ", data)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        lead = self.space or words[0] == " "
        if lead and self.piece:
            self.piece.append(" ")
        self.piece.append(words.strip(" "))
        self.space = words[-1] == " "

    def end_line(self, force: bool = False) -> None:
        if self.piece or force:
            self.add("".join(self.piece))
        self.piece, self.space = [], False

    def add(self, line: str) -> None:
        if self.margin and self.lines:
            self.lines.append("")
        self.margin = False
        indent = "".join(self.indents)
        if self.marker:
            indent = indent[: len(indent) - len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append((indent + line).rstrip(" ") if not line.strip() else indent + line)

    def block(self, paragraph: bool) -> None:
        self.end_line()
        self.margin = self.margin or paragraph

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return self.lines


class Element:
    __slots__ = ("cells", "counter", "indented", "kept", "open_cells", "out", "rows", "shown", "span", "tag")

    def __init__(self, tag: str, shown: bool, out: Lines, kept: bool):
        self.tag, self.shown, self.out, self.kept = tag, shown, out, kept
        self.indented, self.counter = 0, 0
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.span = (1, 1)


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def is_shown(tag: str, given: dict[str, str]) -> bool:
    if tag in UNRENDERED or "hidden" in given or UNSHOWN.search(given.get("style", "")):
        return False
    return not (tag == "dialog" and "open" not in given)


def span_of(given: dict[str, str], name: str, most: int) -> int:
    value = given.get(name, "").strip()
    return min(most, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table; a cell is (lines, column span, row span)."""
    grid: list[dict[int, list[str]]] = []
    held: dict[int, int] = {}  # column -> rows it is still covered for
    widths: dict[int, int] = {}
    for row in rows:
        column, line = 0, {}
        covered, held = held, {c: n - 1 for c, n in held.items() if n > 1}
        for lines, across, down in row:
            while column in covered:
                column += 1
            line[column] = lines
            if across == 1:
                fit = [len(x) for x in lines if len(x) <= WIDEST]
                widths[column] = max([widths.get(column, 0), *fit])
            if down > 1:
                held.update(dict.fromkeys(range(column, column + across), down - 1))
            column += across
        grid.append(line)
    out = []
    for line in grid:
        starts, at = {}, 0
        last = max(line, default=-1)
        for column in range(last + 1):
            starts[column] = at
            at += widths.get(column, 0) + INDENT
        for depth in range(max((len(x) for x in line.values()), default=0)):
            text = ""
            for column in sorted(line):
                if depth < len(line[column]):
                    text = text.ljust(starts[column])
                    if text and not text.endswith(" "):
                        text += " " * INDENT
                    text += line[column][depth]
            out.append(text)
    return out


class Page:
    def __init__(self) -> None:
        root = Element("html", True, Lines(), False)
        self.stack = [root]
        self.root = root
        self.counts: Counter[str] = Counter()  # open elements, so that deep nesting is not searched in vain

    def open(self, tag: str, given: dict[str, str]) -> None:
        if tag == "html" or (tag == "body" and self.counts[tag]):
            return
        self._imply(tag)
        top = self.stack[-1]
        out = top.out
        shown = top.shown and is_shown(tag, given)
        if tag in VOID:
            if shown and tag == "br":
                out.end_line(force=True)
            elif shown and tag == "hr":
                out.block(True)
                out.add("---")
                out.block(True)
            return
        element = Element(tag, shown, out, top.kept or tag in ("pre", "textarea"))
        if shown and tag in ("td", "th", "caption") and self.counts["table"]:
            element.out = Lines()
            element.span = (span_of(given, "colspan", 1000), span_of(given, "rowspan", 1000))
        elif shown and tag in BLOCKS:
            out.block(tag in PARAGRAPHS and not (tag in ("ul", "ol") and self._in_list()))
            if tag == "li":
                marker = "- "
                for e in reversed(self.stack):
                    if e.tag in ("ul", "menu", "dir"):
                        break
                    if e.tag == "ol":
                        e.counter += 1
                        marker = f"{e.counter}. "
                        break
                self._indent(element, " " * len(marker), marker)
            elif tag in ("blockquote", "dd"):
                self._indent(element, " " * INDENT, "")
            elif tag == "ol":
                start = given.get("start", "").strip()
                element.counter = int(start) - 1 if re.fullmatch(r"-?[0-9]{1,6}", start) else 0
        self.stack.append(element)
        self.counts[tag] += 1

    def _in_list(self) -> bool:
        for e in reversed(self.stack):
            if e.tag in SCOPES:
                return False
            if e.tag == "li":
                return True
        return False

    @staticmethod
    def _indent(element: Element, indent: str, marker: str) -> None:
        element.indented = 1
        element.out.indents.append(indent)
        element.out.marker = marker

    def _imply(self, tag: str) -> None:
        """End what the start of `tag` ends, and start the row a loose cell needs."""
        if tag in ENDS_PARAGRAPH:
            self._close_to({"p"}, SCOPES | {"button"})
        if tag in ENDS:
            ended, shield = ENDS[tag]
            while self._close_to(ended, shield):
                pass
        if tag in ("td", "th") and self.counts["table"]:
            for e in reversed(self.stack):
                if e.tag == "tr":
                    break
                if e.tag == "table":
                    self.open("tr", {})
                    break

    def _close_to(self, tags, shield) -> bool:
        """Close up to the nearest element of `tags`, unless a shield stands before it."""
        if not any(self.counts[t] for t in tags):
            return False
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                while len(self.stack) > i:
                    self._pop()
                return True
            if tag in shield:
                return False
        return False

    def close(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.open("br", {})
            return
        if not self._close_to({tag}, SCOPES - {tag} if tag not in ("table", "tr", "thead", "tbody", "tfoot") else {"table"} - {tag}) and tag == "p":
            self.open("p", {})
            self._pop()

    def _pop(self) -> None:
        e = self.stack.pop()
        self.counts[e.tag] -= 1
        if not e.shown:
            return
        if e.indented:
            e.out.end_line()
            if e.out.marker:  # an item without text
                e.out.add("")
            e.out.indents.pop()
        table_ = next((x for x in reversed(self.stack) if x.tag == "table"), None) if self.counts["table"] else None
        if e.tag in ("td", "th") and table_ is not None and e.out is not table_.out:
            if not table_.rows:
                table_.rows.append([])
            table_.rows[-1].append((e.out.done(), *e.span))
        elif e.tag == "caption" and table_ is not None and e.out is not table_.out:
            table_.out.block(False)
            for line in e.out.done():
                table_.out.add(line)
        elif e.tag == "tr" and table_ is not None:
            table_.rows.append([])
        elif e.tag == "table":
            e.out.end_line()
            for line in aligned([r for r in e.rows if r]):
                e.out.add(line)
            e.out.block(True)
        elif e.tag in BLOCKS:
            e.out.block(e.tag in PARAGRAPHS and not (e.tag in ("ul", "ol") and self._in_list()))

    def text(self, data: str) -> None:
        top = self.stack[-1]
        if top.shown and (top.kept or data.strip() or data):
            if top.tag in ("table", "thead", "tbody", "tfoot", "tr") and not data.strip():
                return
            top.out.text(unescape(data) if "&" in data else data, top.kept)

    def done(self) -> str:
        while len(self.stack) > 1:
            self._pop()
        return "\n".join(self.root.out.done())


def rendered(html: str) -> str:
    page, at = Page(), 0
    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        if m["start"]:
            tag = m["start"].lower()
            given = attributes(m["attributes"]) if m["attributes"].strip(" \t\n\r\f/") else {}
            page.open(tag, given)
            if tag == "pre" and html.startswith("\n", at):
                at += 1
            if tag in RAW or tag in ESCAPED_RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                stop = end.start() if end else len(html)
                if tag in ESCAPED_RAW:
                    page.text(html[at:stop])
                at = stop
        elif m["end"]:
            page.close(m["end"].lower())
        elif m[0] == "<" or m[0][0] != "<":
            page.text(m[0])
        elif m[0].startswith("<![CDATA["):
            page.text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
    return page.done()


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text and n_lines of every page."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    kind = slim.schema["page_id"].dataType.simpleString()

    def render(batches):
        for batch in batches:
            texts = [rendered(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(texts, pa.string()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())], names=["page_id", "text", "n_lines"]
            )

    return slim.mapInArrow(render, f"page_id {kind}, text string, n_lines long")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLE = {}
