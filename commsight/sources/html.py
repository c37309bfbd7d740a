"""HTML pages -> element stream -> tables, cards and heading/body pairs.

S6 is the only Python step: pages are parsed batch by batch in
``mapInPandas`` with the standard-library tolerant parser, emitting one row
per element.  Everything after it (S3, S4, S5, S7) is DataFrame work over
that stream.  Where an element lies follows from interval labels: ``pos`` is
its place in document order and ``last`` that of its last descendant, so an
element contains exactly the positions in (pos, last].  The rows stay of one
size however deep a page is, and so does the work per element.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commsight.functions.text import strip_suffix, strip_text
from commsight.operators.sequence import previous_in_group
from commsight.session import ship_package, spread

ELEMENT_SCHEMA = (
    "page_id long, pos int, last int, parent int, depth int, tag string, classes array<string>, "
    "attrs map<string,string>, text string, link string, in_table int, in_row int, in_section int, "
    "in_anchor int, section string"
)
_ARROW = pa.schema([
    ("page_id", pa.int64()), *((c, pa.int32()) for c in ("pos", "last", "parent", "depth")), ("tag", pa.string()),
    ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
    ("link", pa.string()), *((c, pa.int32()) for c in ("in_table", "in_row", "in_section", "in_anchor")),
    ("section", pa.string())])

# HTML void elements (never have children or an end tag).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Start tags that close an open <p> (HTML5 implied end).
P_CLOSERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Element kinds whose open sibling a new one implicitly closes.
SIBLING_CLOSE = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tbody", "tfoot", "tr", "td", "th"), "tbody": ("thead", "tfoot", "tr", "td", "th"),
    "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
# Element rows per emitted chunk in html_elements.
_CHUNK_ROWS = 20_000
# Text inside these never counts as page text.
NON_TEXT = frozenset(("script", "style", "template"))
# Scopes an implied close does not cross.
_SCOPE = frozenset(("table", "ul", "ol", "dl", "select", "html", "body"))


# Kinds of ancestors that every element knows the nearest of.
_KINDS = {"table": "table", "tr": "row", "thead": "section", "tbody": "section", "tfoot": "section", "a": "anchor"}


#: Tag of the element that tells of a page that could not be parsed.
ERROR_TAG = "#error"


class _Elements(HTMLParser):
    """Builds a flat element list with interval labels and stripped text.

    Text fragments go to one list; each element remembers the [start, end)
    range of fragments inside it, so a fragment costs O(1) however deep it
    is, and an element's text is joined once at the end.  Open elements are
    also kept by tag, so that closing one never searches the whole stack.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # [pos, last, parent, depth, tag, attrs, frag_start, frag_end, near]
        self.out: list[list] = []
        self.stack: list[int] = []              # positions of open elements
        self.open: dict[str, list[int]] = {}    # their places in the stack, by tag
        self.near: dict[str, list[int]] = {k: [] for k in _KINDS.values()}
        self.frags: list[str] = []
        self.hidden = 0                         # depth inside script/style

    def _open(self, tag: str, attrs) -> int:
        a = {k: (v if v is not None else "") for k, v in attrs}
        pos = len(self.out)
        near = [x[-1] if x else None for x in self.near.values()]
        self.out.append([pos, pos, self.stack[-1] if self.stack else -1, len(self.stack), tag, a, len(self.frags),
                         len(self.frags), near])
        return pos

    def _close_to(self, i: int) -> None:
        n, last = len(self.frags), len(self.out) - 1
        while len(self.stack) > i:
            e = self.out[self.stack.pop()]
            tag = e[4]
            self.open[tag].pop()
            if tag in _KINDS:
                self.near[_KINDS[tag]].pop()
            e[1], e[7] = last, n
            if tag in NON_TEXT:
                self.hidden -= 1

    def _innermost(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _implied_close(self, tag: str) -> None:
        targets = ("p",) if tag in P_CLOSERS else ()
        targets = targets + SIBLING_CLOSE.get(tag, ())
        at = self._innermost(targets)
        if at > self._innermost(_SCOPE):
            self._close_to(at)

    def handle_starttag(self, tag, attrs):
        self._implied_close(tag)
        pos = self._open(tag, attrs)
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(pos)
            if tag in _KINDS:
                self.near[_KINDS[tag]].append(pos)
            if tag in NON_TEXT:
                self.hidden += 1

    def handle_startendtag(self, tag, attrs):
        self._implied_close(tag)
        self._open(tag, attrs)

    def handle_endtag(self, tag):
        # An end tag with nothing to close is ignored.
        if self.open.get(tag):
            self._close_to(self.open[tag][-1])

    def handle_data(self, data):
        if self.hidden:
            return
        s = data.strip()
        if s:
            self.frags.append(s)

    def finish(self) -> None:
        self._close_to(0)


def _link(url: str | None, href: str | None) -> str | None:
    """``href`` resolved against the page's address; one that cannot be
    resolved stays as it is."""
    from urllib.parse import urljoin

    if href is None:
        return None
    try:
        return urljoin(url or "", href)
    except ValueError:
        return href


def _parse_page(page_id: int | None, html: str, keep_tags: frozenset | None = None,
                text_tags: frozenset | None = None, url: str | None = None):
    """Elements of a page, one by one; a page that the parser gives up on keeps
    what was parsed and has one more element, ERROR_TAG, whose text says why."""
    p = _Elements()
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError, RecursionError) as e:
        yield (page_id, -1, -1, -1, 0, ERROR_TAG, [], [], f"{type(e).__name__}: {e}", *[None] * 6)
    p.finish()
    for pos, last, parent, depth, tag, a, lo, hi, near in p.out:
        if keep_tags is None or tag in keep_tags:
            yield (page_id, pos, last, parent, depth, tag, a.get("class", "").split(), list(a.items()),
                   "".join(p.frags[lo:hi]) if text_tags is None or tag in text_tags else None,
                   _link(url, a.get("href")), *near, None if near[2] is None else p.out[near[2]][4])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def html_elements(pages: DataFrame, page_id: str = "page_id", html: str = "html",
                  keep_tags: Sequence[str] | None = None, text_tags: Sequence[str] | None = None,
                  url: str | None = None) -> DataFrame:
    """One row per element: (page_id, pos, last, parent, depth, tag,
    classes, attrs, text, link, in_table, in_row, in_section, in_anchor, section).

    ``text`` is the element's visible text as ``get_text(strip=True)`` gives
    it: every text node stripped, empties dropped, joined with ``''``;
    script/style text excluded; entities decoded.  ``pos`` and ``last`` label
    the element's interval (see the module); ``in_table``, ``in_row``,
    ``in_section`` and ``in_anchor`` are the positions of the nearest enclosing
    ones, ``section`` the tag of that table section.  ``link`` is the href, resolved against the page's ``url`` column if named.

    ``keep_tags`` emits only elements with those tags (ancestors are still
    tracked in full): the element-level analogue of pushing a filter into
    the scan, e.g. ``("td", "th")`` for tables or ``("a", "div")`` for cards.
    ``text_tags`` gives a text to those tags only: an outer element's text
    repeats all inner ones.
    """
    ship_package(pages.sparkSession)
    src = spread(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html"),
                              (F.col(url) if url else F.lit(None).cast("string")).alias("url")))
    keep, texts = (frozenset(t.lower() for t in x) if x else None for x in (keep_tags, text_tags))

    def run(batches):
        # Emit in chunks, so that neither a batch of large pages nor one page
        # ever becomes one huge batch of elements.
        rows: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                pid, h, u = (b.column(c)[i].as_py() for c in range(3))
                for row in _parse_page(pid, h, keep, texts, u):
                    rows.append(row)
                    if len(rows) >= _CHUNK_ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    return src.mapInArrow(run, ELEMENT_SCHEMA)


# Tags each extractor reads (pass as ``keep_tags``), and how tables are read
# without the texts of what lies around their cells.
TABLE_TAGS = ("td", "th", "table", "tbody", "div")
TABLES = {"keep_tags": TABLE_TAGS, "text_tags": ("td", "th")}
CARD_TAGS = ("a", "div")


def inside(condition: Column) -> Column:
    """Whether an element lies inside one that satisfies ``condition``.

    Interval containment by a running maximum: some such element that starts
    earlier ends at or after this one.  One window per page, in document
    order; what is asked for must be in the stream.
    """
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(condition, F.col("last"))).over(before) >= F.col("pos"), F.lit(False))


def enclosing(elements: DataFrame, condition: Column, out: str) -> DataFrame:
    """Adds ``out``: position of the nearest element around each that satisfies
    ``condition`` (null if none).

    Intervals nest, so the nearest one is the latest that was opened at the
    number of open ones: starts and ends are counted through the page, then
    the last start at that count is looked up.  Linear in the page, at any
    depth.
    """
    hit = F.coalesce(condition, F.lit(False))
    rows = elements.withColumns({"__at": F.col("pos").cast("double"), "__step": hit.cast("int"), "__end": F.lit(False)})
    ends = rows.where(hit).withColumns({"__at": F.col("last") + 0.5, "__step": F.lit(-1), "__end": F.lit(True)})
    page = Window.partitionBy("page_id")
    # Elements that end together leave the innermost first.
    rows = rows.unionByName(ends).withColumn("__open", F.sum("__step").over(
        page.orderBy("__at", F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)))
    # An element does not contain itself: its own start does not count.
    own = (F.col("__step") > 0).cast("int")
    rows = rows.where(~F.col("__end")).withColumns({
        "__level": F.col("__open") - own, "__start": F.when(own > 0, F.col("pos"))})
    starts = rows.where("__start IS NOT NULL").select(
        "page_id", F.col("__open").alias("__level"), "pos", F.col("__start"), F.lit(True).alias("__mark"))
    asked = rows.drop("__start").withColumns({"__mark": F.lit(False), "__start": F.lit(None).cast("int")})
    # (Equal positions: an element and its own start, which is one level up.)
    both = asked.unionByName(starts, allowMissingColumns=True).withColumn("__near", F.last(
        "__start", ignorenulls=True).over(Window.partitionBy("page_id", "__level").orderBy("pos").rowsBetween(
            Window.unboundedPreceding, 0)))
    return both.where(~F.col("__mark")).withColumn(out, F.when(F.col("__level") > 0, F.col("__near"))).drop(
        "__at", "__step", "__end", "__open", "__level", "__start", "__mark", "__near")


def has_classes(required: Sequence[str]) -> Column:
    """True when the element carries every class in ``required``."""
    return F.size(F.array_except(F.array(*[F.lit(c) for c in required]), F.col("classes"))) == 0


def class_attr_is(value: str) -> Column:
    """Exact match of the whole ``class`` attribute text (a multi-class string)."""
    return F.coalesce(F.col("attrs")["class"] == F.lit(value), F.lit(False))


def html_table_rows(elements: DataFrame, columns: Sequence[str], table_id: str | None = None,
                    container_class: str | None = None, header: str = "thead") -> DataFrame:
    """The rows of the located table(s), one output column per cell.

    * ``table_id``: the table with that ``id``; ``container_class``: tables
      inside a ``div`` of that class; neither: every table.
    * ``header='thead'``: header cells come from ``thead``; data rows are the
      ``tbody`` rows' ``td`` cells.
    * ``header='first_row'``: the first ``tbody`` row (td or th) is the
      header and is not emitted; data rows use ``td`` cells.

    With ``table_id`` or ``container_class`` only the first such table of a
    page, and of that only the first ``tbody``, is read.  Rows without any
    data cell are skipped; rows with more cells than ``columns`` are left to
    ``html_table_rejects``; missing cells are null.  Output: (page_id,
    table_pos, row_pos, row_idx, *columns) with ``row_idx`` 0-based among
    emitted rows.  Columns are taken by position; ``html_table_by_header``
    takes them by the page's own header.

    All windows are per page: a page is one input row, so these groups are
    bounded by what one task already parsed.
    """
    data = _cells(elements, table_id, container_class, header).where(~F.col("head"))
    w = Window.partitionBy("page_id", "row_pos")
    data = data.withColumn("__n", F.count("*").over(w)).where(F.col("__n") <= len(columns))
    wide = data.groupBy("page_id", "table_pos", "row_pos").agg(
        *[F.max(F.when(F.col("col_idx") == i, F.col("text"))).alias(name) for i, name in enumerate(columns)])
    return _numbered(wide, columns)


def html_table_rejects(elements: DataFrame, columns: Sequence[str], table_id: str | None = None,
                       container_class: str | None = None, header: str = "thead") -> DataFrame:
    """Rows that ``html_table_rows`` leaves out, with the reason: (page_id,
    table_pos, row_pos, cells array, reason)."""
    data = _cells(elements, table_id, container_class, header).where(~F.col("head"))
    rows = data.groupBy("page_id", "table_pos", "row_pos").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda c: c["text"]).alias("cells"))
    n = F.size("cells")
    return rows.where(n > len(columns)).withColumn(
        "reason", F.concat(n.cast("string"), F.lit(f" cells for {len(columns)} columns")))


def html_table_by_header(elements: DataFrame, names: Mapping[str, str], table_id: str | None = None,
                         container_class: str | None = None, header: str = "thead") -> DataFrame:
    """S3 / S4 with P1: rows of the located table(s), each cell in the column
    that its page's header gives it.

    ``names`` maps header texts to output columns, in any order on the page.
    Tables, rows and output as in ``html_table_rows``; a column that the page
    lacks is null; of two columns with one header the first counts.  Cells
    that have no place are left to ``html_cell_rejects``; a row of such cells
    only gives no row.
    """
    known = _named(elements, table_id, container_class, header).where(
        ~F.col("head") & F.col("name").isin(list(names)) & F.col("first"))
    wide = known.groupBy("page_id", "table_pos", "row_pos").agg(
        *[F.max(F.when(F.col("name") == h, F.col("text"))).alias(c) for h, c in names.items()])
    return _numbered(wide, list(names.values()))


def html_cell_rejects(elements: DataFrame, names: Mapping[str, str], table_id: str | None = None,
                      container_class: str | None = None, header: str = "thead") -> DataFrame:
    """What ``html_table_by_header`` has no column for: (page_id, table_pos,
    row_pos, col_idx, name, text, reason), one row per cell that stands beyond
    the header, under one that ``names`` lacks or under one that repeats; and
    one row, without cell, per page that could not be parsed."""
    cells = _named(elements, table_id, container_class, header).where(~F.col("head"))
    reason = F.when(F.col("headed") == 0, "no header").when(F.col("name").isNull(), "beyond the header").when(
        ~F.col("name").isin(list(names)), "unknown header").when(~F.col("first"), "repeated header")
    columns = ["page_id", "table_pos", "row_pos", "col_idx", "name", "text", "reason"]
    failed = elements.where(F.col("tag") == ERROR_TAG).select("page_id", F.col("text").alias("reason"))
    return cells.withColumn("reason", reason).where("reason IS NOT NULL").select(columns).unionByName(
        failed, allowMissingColumns=True).select(columns)


def _numbered(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in page order with their 0-based ``row_idx`` in the table."""
    rw = Window.partitionBy("page_id", "table_pos").orderBy("row_pos")
    return wide.select("page_id", "table_pos", "row_pos", (F.row_number().over(rw) - 1).cast("long").alias("row_idx"),
                       *columns)


def _cells(elements: DataFrame, table_id: str | None, container_class: str | None, header: str) -> DataFrame:
    """Header and data cells (page_id, pos, text, table_pos, row_pos, col_idx,
    head) of the located tables."""
    tag = F.col("tag")
    el = elements.where(tag != ERROR_TAG)
    page = Window.partitionBy("page_id")
    if table_id is not None or container_class is not None:
        wanted = tag == "table"
        if table_id is not None:
            wanted &= F.coalesce(F.col("attrs")["id"] == table_id, F.lit(False))
        if container_class is not None:
            el = el.withColumn("__in", inside((tag == "div") & F.array_contains("classes", container_class)))
            wanted &= F.col("__in")
        # (Past the containers only these count; the rest, most of a deep
        # page's elements, is not shuffled or sorted.)
        el = el.where(tag.isin("table", "tbody", "td", "th"))
        # The first such table, and its first body (cells outside any body
        # count where it has none).
        el = el.withColumn("__t", F.min(F.when(wanted, F.col("pos"))).over(page)).where(F.col("in_table") == F.col("__t"))
        el = el.withColumn("__s", F.min(F.when(tag == "tbody", F.col("pos"))).over(page)).where(
            tag.isin("td", "th") & (F.col("__s").eqNullSafe(F.col("in_section")) | (F.col("section") == "thead")))
    else:
        el = el.where(tag.isin("td", "th")).repartition("page_id")
    cells = el.where(F.col("in_row").isNotNull() & F.col("in_table").isNotNull()).select(
        "page_id", "pos", "tag", "text", F.col("in_table").alias("table_pos"), F.col("in_row").alias("row_pos"),
        F.coalesce("section", F.lit("tbody")).alias("section"))
    table = Window.partitionBy("page_id", "table_pos")
    where = "tbody" if header == "first_row" else "thead"
    first = F.min(F.when(F.col("section") == where, F.col("row_pos"))).over(table)
    cells = cells.withColumn("head", F.coalesce(F.col("row_pos") == first, F.lit(False)))
    if header == "first_row":
        kept = (F.col("section") == "tbody") & (F.col("head") | (F.col("tag") == "td"))
    else:
        kept = (F.col("head") & (F.col("tag") == "th")) | ((F.col("section") == "tbody") & (F.col("tag") == "td"))
    at = Window.partitionBy("page_id", "row_pos").orderBy("pos")
    return cells.where(kept).withColumn("col_idx", F.row_number().over(at) - 1)


def _named(elements: DataFrame, table_id: str | None, container_class: str | None, header: str) -> DataFrame:
    """``_cells`` with the header's ``name`` of each cell's column, whether it
    is the first of that name, and how many cells are headed."""
    cells = _cells(elements, table_id, container_class, header)
    table = Window.partitionBy("page_id", "table_pos")
    own = F.when(F.col("head"), F.col("text"))
    cells = cells.withColumns({"headed": F.count(own).over(table),
                               "name": F.max(own).over(Window.partitionBy("page_id", "table_pos", "col_idx"))})
    return cells.withColumn("first", F.col("col_idx") == F.min(F.when(F.col("head"), F.col("col_idx"))).over(
        Window.partitionBy("page_id", "table_pos", "name")))


def html_table_header(elements: DataFrame, table_id: str | None = None, container_class: str | None = None,
                      header: str = "thead") -> DataFrame:
    """Header texts of the located tables (page_id, table_pos, col_idx, name)."""
    return _cells(elements, table_id, container_class, header).where("head").select(
        "page_id", "table_pos", "col_idx", F.col("text").alias("name"))


# The data-centre listing's card markup.
CARD_CLASSES = ("flex", "flex-col", "gap-2", "rounded", "border", "border-gray-100", "p-2",
                "hover:border-teal-300", "hover:shadow-lg", "hover:shadow-teal-600/40")
CARD_NAME_CLASS = "text font-medium hover:text-purple"
CARD_DETAIL_CLASS = "text-xs text-gray-500"


def html_cards(elements: DataFrame, card_tag: str = "a", card_classes: Sequence[str] = CARD_CLASSES,
               name_class: str = CARD_NAME_CLASS, detail_class: str = CARD_DETAIL_CLASS) -> DataFrame:
    """One row per card: (page_id, card_pos, Name, Type, Address, Link).

    Name is the first inner div whose class text is ``name_class``; Type and
    Address are the first and second divs with ``detail_class``; ``''`` when
    absent.  Link is the card's href as S6 resolved it (name the pages' ``url``
    column there).

    One aggregation over the element stream: every element is keyed by its
    card (the anchor itself, or the nearest enclosing one), so the anchor and
    its inner divs meet in the same group without a join.
    """
    is_card = (F.col("tag") == card_tag) & has_classes(card_classes)
    if card_tag == "a":
        around = F.col("in_anchor")
    else:
        elements, around = enclosing(elements, F.col("tag") == card_tag, "__around"), F.col("__around")
    card_pos = F.coalesce(F.when(F.col("tag") == card_tag, F.col("pos")), around)
    el = elements.where(is_card | (F.col("tag") == "div")).select(
        "page_id", "pos", "text", card_pos.alias("card_pos"), is_card.alias("__card"),
        F.when(is_card, F.coalesce(F.col("link"), F.lit(""))).alias("Link"),
        ((F.col("tag") == "div") & class_attr_is(name_class)).alias("__is_name"),
        ((F.col("tag") == "div") & class_attr_is(detail_class)).alias("__is_detail"),
    ).where(F.col("card_pos").isNotNull())
    per_card = el.groupBy("page_id", "card_pos").agg(
        F.max("__card").alias("__card"), F.max("Link").alias("Link"),
        F.min_by(F.col("text"), F.when(F.col("__is_name"), F.col("pos"))).alias("__name"),
        F.sort_array(F.collect_list(F.when(F.col("__is_detail"), F.struct("pos", "text")))).alias("__det"),
    ).where(F.col("__card"))
    det = F.coalesce(F.col("__det"), F.array())
    return per_card.select(
        "page_id", "card_pos",
        F.coalesce(F.col("__name"), F.lit("")).alias("Name"),
        F.coalesce(F.element_at(det, 1)["text"], F.lit("")).alias("Type"),
        F.coalesce(F.when(F.size(det) >= 2, F.element_at(det, 2)["text"]), F.lit("")).alias("Address"),
        "Link",
    )


def pair_heading_body(stream: DataFrame, is_heading: Column, is_body: Column,
                      keys: Sequence[str], order: Sequence[str], text: str = "text",
                      heading_out: str = "Country", body_out: str = "Providers",
                      width=None) -> DataFrame:
    """Each heading is attached to the *next* qualifying body only.

    Elements that are neither (wrong tag or class) are ignored, as the
    reference's loop ignores them.  A body pairs when the previous qualifying
    element of its group is a heading whose cleaned text (stripped, cut at
    `` - ``) is non-empty; later bodies and unpaired headings are dropped.
    Exact equivalent of the state machine, with no per-row Python.
    """
    q = stream.where(is_heading | is_body).withColumn("__h", is_heading)
    q = q.withColumn("__t", F.when(F.col("__h"), strip_suffix(strip_text(text))).otherwise(F.col(text)))
    prev = previous_in_group(q, ["__h", "__t"], order, keys, width=width, prefix="__p")
    paired = prev.where(~F.col("__h") & F.coalesce(F.col("__p__h"), F.lit(False)) & (F.col("__p__t") != ""))
    return paired.select(*keys, *[o for o in order if o not in keys],
                         F.col("__p__t").alias(heading_out), strip_text(text).alias(body_out))
