"""Page → node table.

The only per-row Python in the document pipeline.  Each page's HTML is
tokenised with the standard-library ``html.parser`` and folded into a
pre-order node array: ``pos`` is the node's index and ``end`` the index of
its last descendant, so "inside element e" is ``e.pos < n.pos <= e.end`` and
an element's text is a slice of the array.  ``closes`` lists the elements
that end just before a node (innermost first), and ``ctx`` / ``lists`` /
``quotes`` carry what a node inherits, so nothing grows with depth.  Every
later step (chrome removal, title, content root, Markdown) is a Spark
expression over this array.

The parse runs in ``mapInArrow``: Arrow batches in, Arrow batches out, cut to
a bounded number of HTML bytes; the HTML column is dropped right after
parsing.  A page the parser gives up on keeps the nodes built so far and says
so in ``parse_error``.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Executors need not have this package installed: functions defined here
# (run inside Python workers) are shipped by value with the task.
import sys as _sys  # noqa: E402
from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

NODE_TYPE = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("ptag", T.StringType()),
    T.StructField("closes", T.ArrayType(T.IntegerType())),
    T.StructField("ctx", T.IntegerType()),
    T.StructField("lists", T.IntegerType()),
    T.StructField("quotes", T.IntegerType()),
    T.StructField("cells", T.IntegerType()),
    T.StructField("raw", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("idx", T.IntegerType()),
    T.StructField("id", T.StringType()),
    T.StructField("cls", T.ArrayType(T.StringType())),
    T.StructField("role", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("src", T.StringType()),
    T.StructField("alt", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("text", T.StringType()),
])
NODES_TYPE = T.ArrayType(NODE_TYPE)

TEXT = "#text"
# Bits of ``ctx``: the node is inside (an element is also inside itself) …
PRE, BOLD, ITALIC, CODE, CELL = 1, 2, 4, 8, 16
_BITS = {"pre": PRE, "b": BOLD, "strong": BOLD, "i": ITALIC, "em": ITALIC, "code": CODE, "td": CELL, "th": CELL}
BATCH_HTML_CHARS = 2_000_000     # HTML parsed before a batch is sent on

# HTML void elements (never have children or an end tag).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Start tags that implicitly close an open <p>.
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Elements that bound the search for an implied end tag.
SCOPE = frozenset("html body table td th applet object marquee template caption".split())
_ATTRS = ("id", "role", "href", "src", "alt", "name", "content")


def _arrow_node_type() -> pa.DataType:
    return pa.list_(pa.struct([
        ("pos", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("parent", pa.int32()),
        ("ptag", pa.string()), ("closes", pa.list_(pa.int32())), ("ctx", pa.int32()), ("lists", pa.int32()),
        ("quotes", pa.int32()), ("cells", pa.int32()), ("raw", pa.int32()), ("tag", pa.string()), ("idx", pa.int32()), ("id", pa.string()),
        ("cls", pa.list_(pa.string())), ("role", pa.string()), ("href", pa.string()), ("src", pa.string()),
        ("alt", pa.string()), ("name", pa.string()), ("content", pa.string()), ("text", pa.string()),
    ]))


class _TreeBuilder(HTMLParser):
    """Builds the pre-order node list with the usual implied end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.stack: list[int] = []
        self.open: dict[str, int] = {}             # how many elements of a tag are open
        self.counts: dict[tuple[int, str], int] = {}
        self.closing: list[int] = []

    # -- helpers -----------------------------------------------------------
    def _pop_to(self, i: int) -> None:
        """Close stack entries down to and including stack index ``i``."""
        last = len(self.nodes) - 1
        for pos in reversed(self.stack[i:]):
            node = self.nodes[pos]
            node["end"] = last
            self.open[node["tag"]] -= 1
            self.closing.append(pos)
        del self.stack[i:]

    def _find_open(self, tags, stop=SCOPE) -> int:
        if not any(self.open.get(t) for t in tags):
            return -1
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.nodes[self.stack[i]]["tag"]
            if t in tags:
                return i
            if t in stop:
                return -1
        return -1

    def _add(self, tag: str, attrs=None, text=None, raw=0) -> int:
        pos = len(self.nodes)
        parent = self.stack[-1] if self.stack else -1
        up = self.nodes[parent] if self.stack else None
        key = (parent, tag)
        idx = self.counts.get(key, 0) + 1
        self.counts[key] = idx
        node = {"pos": pos, "end": pos, "depth": len(self.stack), "parent": parent, "ptag": up and up["tag"],
                "closes": self.closing or None, "tag": tag, "idx": idx, "text": text, "cls": None,
                "ctx": (up["ctx"] if up else 0) | _BITS.get(tag, 0),
                "lists": (up["lists"] if up else 0) + (up is not None and up["tag"] in ("ul", "ol")),
                "quotes": (up["quotes"] if up else 0) + (tag == "blockquote"), "cells": None, "raw": raw}
        self.closing = []
        if tag in ("td", "th") and up is not None and up["tag"] == "tr":
            up["cells"] = (up["cells"] or 0) + 1
        for a in _ATTRS:
            node[a] = None
        if attrs:
            for k, v in attrs:
                if k in _ATTRS and node[k] is None:
                    node[k] = v if v is not None else ""
                elif k == "class" and node["cls"] is None:
                    node["cls"] = (v or "").split()
        self.nodes.append(node)
        return pos

    # -- parser callbacks ----------------------------------------------------
    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            i = self._find_open(("p",), SCOPE | {"button"})
            if i >= 0:
                self._pop_to(i)
        if tag == "li":
            i = self._find_open(("li",), SCOPE | {"ul", "ol"})
            if i >= 0:
                self._pop_to(i)
        elif tag in ("dt", "dd"):
            i = self._find_open(("dt", "dd"), SCOPE | {"dl"})
            if i >= 0:
                self._pop_to(i)
        elif tag in ("td", "th", "tr"):
            i = self._find_open(("td", "th") if tag != "tr" else ("tr", "td", "th"), {"table"})
            if i >= 0:
                self._pop_to(i)
        elif tag == "option":
            i = self._find_open(("option",), {"select"})
            if i >= 0:
                self._pop_to(i)
        pos = self._add(tag, attrs, raw=len((self.get_starttag_text() or "").encode()))
        if tag not in VOID:
            self.stack.append(pos)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1] == len(self.nodes) - 1:
            self._pop_to(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if tag in VOID or not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[i]]["tag"] == tag:
                self._pop_to(i)
                return

    def handle_data(self, data):
        if not data:
            return
        parent = self.stack[-1] if self.stack else -1
        last = self.nodes[-1] if self.nodes else None
        if last is not None and last["tag"] == TEXT and last["parent"] == parent and not self.closing:
            last["text"] += data
            return
        self._add(TEXT, text=data)

    def finish(self) -> list[dict]:
        self.close()
        self._pop_to(0)
        return self.nodes


def parse_nodes(html: str | None) -> tuple[list[dict] | None, str | None]:
    """One document's pre-order node list, and the error that ended the parse early."""
    if html is None:
        return None, None
    b = _TreeBuilder()
    try:
        b.feed(html)
        return b.finish(), None
    except Exception as e:  # malformed beyond repair: keep what was built, and say so
        b._pop_to(0)
        return b.nodes, f"{type(e).__name__}: {e}"


def html_nodes(df: DataFrame, html_col: str = "html", out_col: str = "nodes") -> DataFrame:
    """Replace ``html_col`` by its node array ``out_col`` and ``parse_error`` (one pass, mapInArrow).

    All other columns pass through unchanged, so no join back is needed.
    """
    keep = [f for f in df.schema.fields if f.name not in (html_col, "parse_error")]
    out_schema = T.StructType(keep + [T.StructField(out_col, NODES_TYPE), T.StructField("parse_error", T.StringType())])
    keep_names = [f.name for f in keep]
    arrow_type = _arrow_node_type()

    def run(batches):
        for batch in batches:
            htmls = batch.column(html_col).to_pylist()
            first, chars = 0, 0
            for i, html in enumerate(htmls):
                chars += len(html or "")
                if chars >= BATCH_HTML_CHARS or i == len(htmls) - 1:
                    parsed = [parse_nodes(h) for h in htmls[first:i + 1]]
                    cols = [batch.column(n).slice(first, i + 1 - first) for n in keep_names]
                    cols += [pa.array([p[0] for p in parsed], type=arrow_type), pa.array([p[1] for p in parsed], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=keep_names + [out_col, "parse_error"])
                    first, chars = i + 1, 0

    return df.mapInArrow(run, out_schema)
