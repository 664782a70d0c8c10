"""Layout-aware text of HTML pages (operator 3).

A tree builder over the standard tokenizer applies implied tags (paragraphs, list items, cells and options that
end where the next one begins), drops stray end tags and closes what is left open.  Cells without a row get one, and whatever else stands between
the parts of a table goes before it; a head ends with the first text or element that it cannot hold.  The renderer then walks the
tree and emits all visible text: invisible elements (head, script, style, template, a closed ``dialog``, ``hidden``, ``display: none``,
...) are skipped with all they hold, ``visibility`` is inherited and a visible child of a hidden element shows, inline white space collapses,
blocks begin on new lines with one blank line around
paragraph-like ones, list items get bullets or numbers indented by depth, ``pre`` keeps its text, and table cells are
padded to the width of their column.  ``colspan`` and ``rowspan`` move cells to their columns; a cell spans the columns' joint width,
rows that its span reaches leave its columns blank, and no span leaves its table section.  Cells longer than ``ALIGNED`` characters
do not set their column's width, so padding stays in proportion to the cells.

Tree building and rendering are iterative, so depth is limited by memory only; columns are aligned within one table.
Scale: a narrow map, one page at a time; nothing is shuffled.

Defined cases: null and empty pages give an empty text; broken markup never raises; text outside any element is visible;
nested tables are rendered as blocks inside their cell's line (their rows joined by "; ").  Repeated rows and further
columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = frozenset("head title script style template noscript iframe object canvas audio video datalist desc metadata defs".split())
FOREIGN = ("svg", "math")  # any element inside may end itself by a slash
BLOCKS = frozenset("""address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption""".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
LISTS = frozenset("ul ol menu dir".split())
#: tag -> (open tags that it ends, tags beyond which it does not look)
ENDS = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: What a head may hold; other elements and text end it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: Blocks that end an open paragraph.
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "li", "dd", "dt", "legend", "summary", "figcaption"}
P_SCOPE = frozenset("td th table button caption html li".split())
#: Table parts; where a table is open, they end what stands in the way and imply the section and row that they need.
PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: Elements that hold parts only: other content goes before their table, except what shows nothing (IN_PLACE).
FRAMES = SECTIONS | {"table", "tr"}
IN_PLACE = frozenset("script style template input".split())
CHILDLESS = frozenset("form colgroup".split())  # between table parts; a form's content stays with the table
_HIDDEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: The largest spans that a page may ask for.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
ALIGNED = 200
_BLANKS = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Builder(HTMLParser):
    """Tokens to a tree of Node and str."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # places in ``open`` of each tag, ascending
        self.tables: list[int] = []  # places in ``open`` of tables, and of templates, whose parts are their own

    def _push(self, node: Node) -> None:
        if node.tag in ("table", "template"):
            self.tables.append(len(self.open))
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _cut(self, k: int) -> None:
        """Ends the open elements from place ``k`` on."""
        while len(self.open) > k:
            self.places[self.open.pop().tag].pop()
        while self.tables and self.tables[-1] >= k:
            self.tables.pop()

    def _table(self) -> int:
        """Place of the table that a part would belong to; 0 if there is none."""
        return self.tables[-1] if self.tables and self.open[self.tables[-1]].tag == "table" else 0

    def _framed(self) -> bool:
        """True where only table parts may stand: straight in a table, section or row."""
        return self._table() > 0 and self.open[-1].tag in FRAMES

    def _before_table(self, kid) -> None:
        """``kid`` goes before the open table, which is the last child of its parent."""
        kids = self.open[self._table() - 1].kids
        kids.insert(len(kids) - 1, kid)

    def _imply(self, tag: str) -> None:
        node = Node(tag, {})
        self.open[-1].kids.append(node)
        self._push(node)

    def _part(self, tag: str) -> None:
        """Back to where a table part belongs, with the section and row that it implies."""
        k = self._table() + 1
        if tag in ("tr", "td", "th"):
            if not (k < len(self.open) and self.open[k].tag in SECTIONS):
                self._cut(k)
                self._imply("tbody")
            k += 1
        if tag in ("td", "th"):
            if not (k < len(self.open) and self.open[k].tag == "tr"):
                self._cut(k)
                self._imply("tr")
            k += 1
        self._cut(k)

    def _close(self, tags, scope) -> None:
        """Ends the innermost open element of ``tags`` and what it holds, if no tag of ``scope`` stands before it."""
        at = max((self._last(t) for t in tags), default=0)
        if at and at >= max((self._last(t) for t in scope), default=0):
            self._cut(at)

    def _last(self, tag: str) -> int:
        """Place of the innermost open element of a tag; 0 if none is open."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _end_head(self) -> None:
        while self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag in ENDS_P:
            self._close({"p"}, P_SCOPE)
        if tag in PARTS and self._table():
            self._part(tag)
        elif tag in ENDS:
            tags, scope = ENDS[tag]
            if tag == "tr":
                self._close({"td", "th"}, {"tr", "table", "template"})
                tags = {"tr"}
            self._close(tags, scope | {"template"} if tag in PARTS else scope)
        if tag == "table" and self._framed():
            self._cut(self._table())
        node, framed = Node(tag, dict(attrs)), self._framed()
        if framed and tag not in PARTS | IN_PLACE | CHILDLESS:
            self._before_table(node)
        else:
            self.open[-1].kids.append(node)
        if tag not in VOID and not (framed and tag in CHILDLESS):
            self._push(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and any(self._last(t) for t in FOREIGN):
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag not in VOID and tag not in ("html", "body"):  # text after them is shown as well
            self._close({tag}, {"table"} if tag not in ("table", "body", "html") else ())

    def handle_data(self, data):
        if data.strip(" \t\n\r\f"):
            self._end_head()
        if self._framed() and _BLANKS.sub("", data):
            self._before_table(data)
        else:
            self.open[-1].kids.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def visible(n: Node) -> bool:
    """Whether the element takes part in the layout; see ``shown`` for what it may still hide."""
    a = n.attrs
    closed = n.tag == "dialog" and "open" not in a
    return not (n.tag in INVISIBLE or closed or "hidden" in a or (n.tag == "input") or (a.get("aria-hidden") or "").lower() == "true" or _HIDDEN.search(a.get("style") or ""))


def shown(n: Node, inherited: bool) -> bool:
    """Whether the element's own text is visible: by its style (the last word counts), else as its parent's."""
    said = _VISIBILITY.findall(n.attrs.get("style") or "")
    return said[-1].lower() == "visible" if said else inherited


class _Lines:
    """Text under layout: the current line, finished lines, and the blank line that the next block wants."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.lead = ""  # indent and mark of the current line
        self.blank = False

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *rest = s.split("\n")
            self.now.append(first)
            for r in rest:
                self.line(keep=True)
                self.now.append(r)
        else:
            self.now.append(_BLANKS.sub(" ", s))

    def line(self, keep: bool = False) -> None:
        s = "".join(self.now)
        s = s.rstrip() if keep else _BLANKS.sub(" ", s).strip()
        self.now = []
        if s or keep:
            if self.blank and self.done:
                self.done.append("")
            self.blank = False
            self.done.append(self.lead + s)
            self.lead = " " * len(self.lead)

    def space(self) -> None:
        self.blank = bool(self.done)


def _span(n: Node, name: str, least: int, most: int) -> int:
    said = re.match(r"\s*(\d{1,9})", n.attrs.get(name) or "")
    value = int(said.group(1)) if said else 1
    return min(max(value, least), most)


def _cells(node: Node, seen: bool) -> list[tuple[int, list[tuple[Node, bool]]]]:
    """(section, cells with whether their text shows) of each row of a table, not of tables inside it."""
    rows: list[tuple[int, list[tuple[Node, bool]]]] = []
    todo, section = [(node, False, seen)], 0
    while todo:
        n, inside, seen = todo.pop()
        if isinstance(n, str) or not visible(n) or (inside and n.tag == "table"):
            continue
        seen = shown(n, seen) if inside else seen
        if n.tag == "tr":
            cells = [c for c in n.kids if not isinstance(c, str) and c.tag in ("td", "th") and visible(c)]
            rows.append((section, [(c, shown(c, seen)) for c in cells]))
        elif n.tag not in ("td", "th", "caption"):
            section += n.tag in SECTIONS
            todo += [(k, True, seen) for k in reversed(n.kids)]
    return rows if any(cells for _, cells in rows) else []


def _placed(rows: list[tuple[int, list[tuple[str, int, int]]]]) -> list[list[tuple[int, int, str]]]:
    """(first column, columns, text) of each row's cells in order; cells of rows above that reach down have an empty text."""
    out: list[list[tuple[int, int, str]]] = []
    above: list[tuple[int, int, int]] = []  # (first column, columns, last row) of cells that reach beyond their row, by column
    before = None
    for k, (section, cells) in enumerate(rows):
        above = [x for x in above if x[2] >= k] if section == before else []
        before, at, taken, down = section, 0, 0, []
        line: list[tuple[int, int, str]] = []
        for text, across, deep in cells:
            while taken < len(above) and above[taken][0] <= at:
                first, wide, _ = above[taken]
                line.append((first, wide, ""))
                at, taken = max(at, first + wide), taken + 1
            if taken < len(above):
                across = min(across, above[taken][0] - at)  # a wide cell ends where one from above stands
            line.append((at, across, text))
            if deep != 1:
                down.append((at, across, k + deep - 1 if deep else len(rows)))
            at += across
        above = sorted([*above, *down]) if down else above
        out.append(line)
    return out


def _aligned(rows: list[tuple[int, list[tuple[str, int, int]]]]) -> list[str]:
    """Lines of a table of (section, [(text, columns, rows)]); rows without text show nothing."""
    placed = _placed(rows)
    widths: dict[int, int] = {}
    for line in placed:
        for first, across, text in line:
            if across == 1 and widths.get(first, 0) < len(text) <= ALIGNED:
                widths[first] = len(text)
    width = lambda first, across: widths.get(first, 0) if across == 1 else sum(widths.get(c, 0) for c in range(first, first + across)) + 3 * (across - 1)
    wide = {span: width(*span) for span in {(first, across) for line in placed for first, across, _ in line}}
    return [" | ".join(text.ljust(min(wide[first, across], ALIGNED)) for first, across, text in line).rstrip()
            for line, (_, cells) in zip(placed, rows, strict=True) if any(text for text, _, _ in cells)]


def render(html: str | None) -> str:
    """All visible text of a page."""
    if not html:
        return ""
    root = parse(html)
    out = _Lines()
    frames: list[_Lines] = []  # outer lines, while a cell is laid out in lines of its own
    lists: list[list] = []  # [tag, next number]
    grids: list[list[str]] = []  # cells so far of each open table
    keep, seen = 0, True
    todo: list[tuple[str, object]] = [("in", root)]
    while todo:
        do, n = todo.pop()
        if do == "text":
            out.text(n, keep > 0)
        elif do == "seen":
            seen = n
        elif do == "in":
            if isinstance(n, str):
                if seen:
                    out.text(n, keep > 0)
                continue
            if not visible(n):
                continue
            before, seen = seen, shown(n, seen)
            if seen != before:
                todo.append(("seen", before))
            if n.tag == "br":
                out.line()
                continue
            if n.tag == "img":
                if n.attrs.get("alt") and seen:
                    out.text(n.attrs["alt"], False)
                continue
            block = n.tag in BLOCKS
            if block:
                out.line()
                out.lead = "  " * len(lists)
                if n.tag in SPACED and not (n.tag in LISTS and lists):
                    out.space()
            if n.tag == "table" and (rows := _cells(n, seen)):
                captions = [k for k in n.kids if not isinstance(k, str) and k.tag == "caption"]
                todo.append(("seen", seen))
                todo.append(("table", [(section, [(_span(c, "colspan", 1, MOST_COLUMNS), _span(c, "rowspan", 0, MOST_ROWS)) for c, _ in cells]) for section, cells in rows]))
                for _, cells in reversed(rows):
                    for c, own in reversed(cells):
                        todo += [("cell", None), *[("in", k) for k in reversed(c.kids)], ("seen", own), ("frame", None)]
                todo.append(("grid", None))
                todo += [("in", c) for c in reversed(captions)]
                continue
            if n.tag in LISTS:
                start = n.attrs.get("start") or "1"
                lists.append([n.tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif n.tag == "li":
                depth = "  " * max(0, len(lists) - 1)
                if lists and lists[-1][0] == "ol":
                    out.lead = f"{depth}{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    out.lead = depth + "- "
            keep += n.tag == "pre"
            todo.append(("out", n))
            todo += [("in", k) for k in reversed(n.kids)]
        elif do == "out":
            if n.tag in BLOCKS:
                out.line(keep=keep > 0 and n.tag == "pre" and bool("".join(out.now)))
                if n.tag in LISTS:
                    lists.pop()
                out.lead = "  " * len(lists)
                if n.tag in SPACED and not (n.tag in LISTS and lists):
                    out.space()
            keep -= n.tag == "pre"
        elif do == "grid":
            grids.append([])
        elif do == "frame":
            frames.append((out, lists, keep))
            out, lists, keep = _Lines(), [], 0
        elif do == "cell":
            out.line()
            cell = _BLANKS.sub(" ", "; ".join(x.strip() for x in out.done if x.strip()))
            out, lists, keep = frames.pop()
            grids[-1].append(cell)
        else:
            cells = iter(grids.pop())
            rows = [(section, [(next(cells), across, deep) for across, deep in spans]) for section, spans in n]
            for r in _aligned(rows):
                out.text(r, True)
                out.line(keep=True)
            out.space()
    out.line()
    return "\n".join(out.done).replace("\xa0", " ")


def extract(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all but the markup by default) and the visible ``text``."""
    carry = [c for c in pages.columns if c != html] if carry is None else carry
    own = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    source = pages.select(own.alias("own"), F.col(f"`{html}`").alias("html"))
    schema = T.StructType([source.schema["own"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([render(h.as_py()) for h in b.column(1)], pa.string())], names=schema.names)

    made = source.mapInArrow(run, schema)
    return made.select(*[F.col("own").getField(c).alias(c) for c in carry], "text")


def q_op3(spark, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.length("text").cast("long").alias("n_chars"), "text")
