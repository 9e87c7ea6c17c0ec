"""Pages to one row per element.

The only Python in the extraction path. Each page is tokenised with the standard
library's HTML parser and written as rows; nothing is selected or extracted
here. Supported: void elements and implied end tags for p, li, dt, dd, option,
tr, td, th and table sections. Not supported: the adoption of misnested
formatting elements. Text and markup are not copied into the rows: each row holds
byte ranges into the page's text and source, so a page's text is stored once
however deep its elements nest.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.session import spread

# --- fixed values (HTML syntax) -----------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
# start tag -> (open elements it ends, elements the search stops at)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
P_LIMIT = frozenset("button caption html object table td template th".split())
# ------------------------------------------------------------------------------

NODE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("last_desc", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("sib_ix", T.IntegerType()),
    T.StructField("type_ix", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("src_from", T.LongType()),
    T.StructField("src_to", T.LongType()),
    T.StructField("in_from", T.LongType()),
    T.StructField("in_to", T.LongType()),
    T.StructField("t_from", T.LongType()),
    T.StructField("t_to", T.LongType()),
    T.StructField("doc_text", T.BinaryType()),
])


class _Shredder(HTMLParser):
    """Turns one page into element records; offsets are in characters."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.lines = [0]
        at = html.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = html.find("\n", at + 1)
        self.text: list[str] = []
        self.bytes_out = 0
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.places: dict[str, list[int]] = {}  # where in ``open`` the elements of each name are
        self._push("html", {}, 0, 0)
        self.body = None
        self.feed(html)
        self.close()
        self._pop_to(0, len(html), len(html))

    def _at(self) -> int:
        line, col = self.getpos()
        return self.lines[line - 1] + col

    def _push(self, tag: str, attrs: dict, start: int, end: int, empty: bool = False) -> None:
        up = self.open[-1] if self.open else None
        node = {
            "id": len(self.nodes), "parent": up["id"] if up else None, "tag": tag, "attrs": attrs,
            "depth": len(self.open), "sib": up["kids"] if up else 0,
            "src": [start, end], "inner": [end, end], "t": [self.bytes_out, self.bytes_out], "kids": 0, "types": {},
        }
        if up:
            up["kids"] += 1
            up["types"][tag] = node["type"] = up["types"].get(tag, 0) + 1
        else:
            node["type"] = 1
        node["last"] = node["id"]
        self.nodes.append(node)
        if not empty:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def _pop_to(self, size: int, inner_end: int, end: int) -> None:
        """Close elements until ``size`` stay open; the lowest one owns the end tag."""
        while len(self.open) > size:
            node = self.open.pop()
            self.places[node["tag"]].pop()
            lowest = len(self.open) == size
            node["inner"][1] = inner_end
            node["src"][1] = end if lowest else inner_end
            node["t"][1] = self.bytes_out
            node["last"] = len(self.nodes) - 1

    def _innermost(self, tags) -> int:
        """The place of the innermost open element of these names; 0, the root's, where there is none."""
        return max((places[-1] for tag in tags if (places := self.places.get(tag))), default=0)

    def _end_open(self, targets, limits, at: int) -> None:
        while (i := self._innermost(targets)) > self._innermost(limits):
            self._pop_to(i, at, at)
            if len(targets) == 1:
                return

    def _need_body(self, at: int) -> None:
        if self.body is None:
            self._pop_to(1, at, at)
            self._push("body", {}, at, at)
            self.body = self.open[-1]

    def handle_starttag(self, tag, attrs):
        at = self._at()
        end = at + len(self.get_starttag_text() or "")
        named = {}
        for k, v in attrs:
            named.setdefault(k, v if v is not None else "")
        if tag == "html":
            root = self.nodes[0]
            for k, v in named.items():
                root["attrs"].setdefault(k, v)
            if root["kids"] == 0:
                root["src"][0], root["inner"][0] = at, end
            return
        if tag == "body":
            if self.body is None:
                self._pop_to(1, at, at)
                self._push("body", named, at, end)
                self.body = self.open[-1]
            return
        if tag == "head":
            if len(self.open) == 1 and self.body is None:
                self._push("head", named, at, end)
            return
        if tag not in HEAD_ONLY:
            self._need_body(at)
        if tag in CLOSES_P:
            self._end_open({"p"}, P_LIMIT, at)
        if tag in ENDS:
            self._end_open(*ENDS[tag], at)
        self._push(tag, named, at, end, empty=tag in VOID)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        at = self._at()
        close = self.html.find(">", at)
        end = close + 1 if close >= 0 else len(self.html)
        if tag in ("html", "body") or tag in VOID:
            return
        if i := self._innermost([tag]):
            self._pop_to(i, at, end)

    def handle_data(self, data):
        if self.body is None and len(self.open) <= 2 and self.open[-1]["tag"] in ("html", "head"):
            if not data.strip():
                return
            self._need_body(self._at())
        self.text.append(data)
        self.bytes_out += len(data.encode("utf-8", "replace"))


def _byte_offsets(html: str):
    """Character offset to UTF-8 byte offset."""
    if html.isascii():
        return lambda i: i
    import numpy as np

    points = np.frombuffer(html.encode("utf-32-le", "replace"), dtype="<u4")
    width = 1 + (points > 0x7F).astype("i8") + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(width)])
    return lambda i: int(offsets[i])


def page_rows(page_id: int, html: str) -> Iterator[tuple]:
    page = _Shredder(html or "")
    to_byte = _byte_offsets(page.html)
    whole = "".join(page.text).encode("utf-8", "replace")
    for n in page.nodes:
        yield (
            page_id, n["id"], n["parent"], n["last"], n["depth"], n["sib"], n["type"], n["tag"],
            list(n["attrs"].items()),
            to_byte(n["src"][0]), to_byte(n["src"][1]), to_byte(n["inner"][0]), to_byte(n["inner"][1]),
            n["t"][0], n["t"][1], whole if n["id"] == 0 else None,
        )


BATCH_ROWS = 20_000
SHRED_PART_BYTES = 16 << 10  # stored pages are small beside what shredding makes of them

# The shredder travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _shred_batches(batches):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(NODE_SCHEMA)

    def flush(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        rows: list[tuple] = []
        for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows.extend(page_rows(page_id, html))
            if len(rows) >= BATCH_ROWS:
                yield flush(rows)
                rows = []
        if rows:
            yield flush(rows)


def shred_pages(pages: DataFrame) -> DataFrame:
    """One row per element. Pages are shredded where they are read, unless the
    input is too small to occupy the cores."""
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("html"))
    if not pages.isStreaming:
        rows = spread(rows, "page_id", SHRED_PART_BYTES)
    return rows.mapInArrow(_shred_batches, NODE_SCHEMA)


def page_texts(nodes: DataFrame) -> DataFrame:
    """The text of each page, once per page: ``page_id, doc_text`` (bytes)."""
    return nodes.filter(F.col("node_id") == 0).select("page_id", "doc_text")
