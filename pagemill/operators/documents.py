"""Document operators H02–H18 over the node array of :mod:`html_nodes`.

Pipeline per page (one row per page throughout — no shuffle, no join):

    html ─H01 parse─▶ nodes ─H02 chrome removal─▶ kept flags
         ─H04 title, H05 content root─▶ render range
         ─H09 render─▶ raw Markdown ─cleanup, H10/H11─▶ markdown + H12/H14 stats

Every step after H01 is a Spark expression (higher-order functions over the
array), so the work is vectorised JVM code and scales with pages × nodes.
The service's size limits are flags (``too_large``, ``error``): title and
Markdown are made for every page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.operators.html_nodes import BOLD, CELL, CODE, ITALIC, PRE, TEXT, VOID, html_nodes
from pagemill.operators.staging import stage

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference service's behaviour.
# ---------------------------------------------------------------------------
MAX_SOURCE_BYTES = 5 * 1024 * 1024      # larger pages are refused
MAX_SLIM_BYTES = 900 * 1024             # slimmed document limit
MIN_ROOT_CHARS = 80                     # a content root needs more text than this
# Page chrome removed before conversion (tags, ids, classes, roles).
REMOVE_SELECTORS = [
    "script", "style", "noscript", "template", "iframe", "svg", "nav", "footer",
    "header", "aside", "form",
    "#mw-navigation", "#mw-panel", "#mw-head", "#mw-page-base", "#mw-head-base",
    ".vector-header-container", ".vector-main-menu", ".vector-toc", ".vector-column-start",
    ".vector-column-end", ".vector-sticky-pinned-container", "#p-lang-btn", ".mw-editsection",
    ".navbox", ".vertical-navbox", ".sistersitebox", ".metadata", ".noprint", "#catlinks",
    ".catlinks", "#footer", ".mw-footer", "#siteNotice", "#centralNotice", ".mw-indicators",
    ".sidebar", "#sidebar", ".site-header", ".site-footer", ".cookie-banner",
    "[role='navigation']", "[role='banner']", "[role='contentinfo']",
]
# Main-content candidates, best first.
CONTENT_SELECTORS = [
    "#mw-content-text .mw-parser-output", ".mw-parser-output", "#mw-content-text", "article",
    "main", "[role='main']", "#content", "#main-content", ".post-content", ".entry-content",
    ".article-content", ".article-body", ".post-body", ".readable-content",
]
# Bulk removed from encyclopedia article fragments.
WIKI_STRIP_SELECTORS = [
    "style", "script", "link", "meta", "svg", "table", ".reference", "sup.reference",
    ".reflist", ".mw-references-wrap", ".navbox", ".vertical-navbox", ".sistersitebox",
    ".metadata", ".noprint", ".mw-empty-elt", ".mw-editsection", ".hatnote",
    ".shortdescription", ".thumb", ".gallery", ".infobox", "#toc", ".toc",
]
# Appendix section headings dropped from encyclopedia articles.
ERROR_SOURCE_SIZE = "The page is larger than the 5 MB service limit."
ERROR_SLIM_SIZE = "The page content is too large to convert after cleanup."
ERROR_NOTHING = "Readable content could not be identified."
ERROR_CHROME = "Readable content could not be isolated from page chrome."
ERROR_EMPTY_MARKDOWN = "Empty Markdown."
ERROR_MARKDOWN_CHROME = "Extraction returned page chrome instead of article content."
# Frame of the slimmed document around title and root.
SLIM_FRAME = '<!doctype html><html><head><meta charset="utf-8"><title></title></head><body></body></html>'
APPENDIX_HEADINGS = ["References", "External links", "Further reading", "See also", "Notes",
                     "Bibliography", "Sources", "Citations"]
# ---------------------------------------------------------------------------

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCKS = ["p", "div", "section", "article", "main", "header", "footer", "aside", "nav", "figure",
          "figcaption", "table", "form", "dl", "dd", "dt", "address", "details", "summary",
          "fieldset", "center", "body", "ul", "ol", "blockquote"]
# Noncharacters that stand for marks while lines are cleaned up: indentation,
# and in code blocks space, tab and line end; bold mark; quote mark at a line's start.
INDENT, SPACE, TAB, LINE, STRONG, QUOTE = "\ufdd0\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4", "\ufdd5"

_SIMPLE = re.compile(r"^([a-z0-9]*)((?:[#.][A-Za-z0-9_-]+)*)(?:\[(\w+)='([^']*)'\])?$")


def _compound(sel: str) -> dict:
    m = _SIMPLE.match(sel)
    if not m:
        raise ValueError(f"unsupported selector {sel!r}")
    tag, rest, attr, val = m.groups()
    ids = re.findall(r"#([A-Za-z0-9_-]+)", rest)
    classes = re.findall(r"\.([A-Za-z0-9_-]+)", rest)
    return {"tag": tag or None, "id": ids[0] if ids else None, "classes": classes,
            "role": val if attr == "role" else None}


def selector_parts(sel: str) -> list[dict]:
    """A selector of the fixed lists: compounds joined by descendant spaces."""
    return [_compound(s) for s in sel.split()]


def _match_compound(n: Column, c: dict) -> Column:
    cond = n["tag"] != F.lit(TEXT)
    if c["tag"]:
        cond = cond & (n["tag"] == c["tag"])
    if c["id"]:
        cond = cond & (n["id"] == c["id"])
    for cl in c["classes"]:
        cond = cond & F.coalesce(F.array_contains(n["cls"], cl), F.lit(False))
    if c["role"]:
        cond = cond & (n["role"] == c["role"])
    return cond


def all_matches(nodes: Column, sel: str) -> Column:
    """The nodes that match selector ``sel``.

    Descendant parts are tested by interval containment, for the few nodes
    that match the last part.
    """
    parts = selector_parts(sel)
    found = _compound_matches(nodes, parts[-1])
    for part in parts[:-1]:
        found = F.filter(found, _inside_any(_compound_matches(nodes, part)))
    return found


def _compound_matches(nodes: Column, part: dict) -> Column:
    return F.filter(nodes, lambda n: _match_compound(n, part))


def _inside_any(outer: Column):
    return lambda n: F.exists(outer, lambda a: (a["pos"] < n["pos"]) & (n["pos"] <= a["end"]))


def matches_any(n: Column, selectors: list[str]) -> Column:
    """Does ``n`` match one of a list of selectors without descendant parts?  Set membership per kind."""
    simple = [selector_parts(s) for s in selectors]
    if any(len(p) > 1 for p in simple):
        raise ValueError("selectors with descendant parts need all_matches")
    tags = [p[0]["tag"] for p in simple if p[0]["tag"] and not p[0]["id"] and not p[0]["classes"] and not p[0]["role"]]
    ids = [p[0]["id"] for p in simple if p[0]["id"] and not p[0]["tag"]]
    classes = [p[0]["classes"][0] for p in simple if p[0]["classes"] and not p[0]["tag"] and not p[0]["id"]]
    roles = [p[0]["role"] for p in simple if p[0]["role"]]
    compound = [p[0] for p in simple if p[0]["tag"] and (p[0]["classes"] or p[0]["id"])]
    cond = n["tag"].isin(*tags) if tags else F.lit(False)
    if ids:
        cond = cond | F.coalesce(n["id"].isin(*ids), F.lit(False))
    if classes:
        cond = cond | F.coalesce(F.arrays_overlap(n["cls"], F.array(*[F.lit(c) for c in classes])), F.lit(False))
    if roles:
        cond = cond | F.coalesce(n["role"].isin(*roles), F.lit(False))
    for c in compound:
        cond = cond | _match_compound(n, c)
    return (n["tag"] != F.lit(TEXT)) & cond


# --------------------------------------------------------------------- steps
def _at(arr: Column, i) -> Column:
    """1-based element access that yields NULL out of range (ANSI-safe)."""
    return F.try_element_at(arr, i if isinstance(i, Column) else F.lit(i))


def _node(nodes: Column, a: Column) -> Column:
    return _at(nodes, a + 1)


def text_of(nodes: Column, e: Column, kept_only: bool = True) -> Column:
    """textContent of element ``e``: its descendant text nodes, concatenated."""
    desc = F.slice(nodes, e["pos"] + 2, F.greatest(e["end"] - e["pos"], F.lit(0)))
    keep = (lambda t: (t["tag"] == TEXT) & t["k"]) if kept_only else (lambda t: t["tag"] == TEXT)
    return F.array_join(F.transform(F.filter(desc, keep), lambda t: t["text"]), "")


def remove_chrome(df: DataFrame, selectors: list[str] = REMOVE_SELECTORS, nodes_col: str = "nodes") -> DataFrame:
    """Mark every node inside an element matching a chrome selector.

    Adds field ``k`` (kept) to every node: it lies in none of the outermost
    removed intervals.
    """
    nodes = F.col(nodes_col)
    df = stage(df, _hits=F.transform(F.filter(nodes, lambda n: matches_any(n, selectors)),
                                     lambda n: F.struct(n["pos"].alias("pos"), n["end"].alias("end"))))
    hits = F.col("_hits")
    df = stage(df, _removed=F.filter(hits, lambda r: ~F.exists(hits, lambda o: (o["pos"] < r["pos"]) & (r["pos"] <= o["end"]))))
    removed = F.col("_removed")
    kept = F.transform(nodes, lambda n: n.withField(
        "k", ~F.exists(removed, lambda r: (r["pos"] <= n["pos"]) & (n["pos"] <= r["end"]))))
    return stage(df, **{nodes_col: kept}).drop("_hits", "_removed")


def _first(nodes: Column, pred) -> Column:
    return _at(F.filter(nodes, lambda n: n["k"] & pred(n)), 1)


def locate(df: DataFrame, nodes_col: str = "nodes", min_chars: int = MIN_ROOT_CHARS) -> DataFrame:
    """H04 + H05 + H16: slim title, content root / render range, author."""
    nodes = F.col(nodes_col)
    cands = [_at(F.filter(all_matches(nodes, s), lambda n: n["k"]), 1) for s in CONTENT_SELECTORS]
    df = stage(
        df,
        _h1=_first(nodes, lambda n: n["tag"] == "h1"),
        _title=_first(nodes, lambda n: n["tag"] == "title"),
        _body=_first(nodes, lambda n: n["tag"] == "body"),
        _cands=F.array(*cands),
        author=F.nullif(U.js_trim(_first(nodes, lambda n: (n["tag"] == "meta")
                                          & (F.lower(n["name"]) == "author"))["content"]), F.lit("")),
    )
    h1_text = U.js_trim(text_of(nodes, F.col("_h1")))
    title_text = U.js_trim(text_of(nodes, F.col("_title")))
    root = _at(F.filter(F.col("_cands"), lambda c: c.isNotNull()
                                 & (X.utf16_length(U.js_trim(text_of(nodes, c))) > min_chars)), 1)
    df = stage(df, slim_title=F.coalesce(F.nullif(h1_text, F.lit("")), F.nullif(title_text, F.lit("")), F.lit("")),
               _root=root)
    df = stage(df, root_chars=X.utf16_length(U.js_trim(text_of(nodes, F.col("_root")))))
    body = F.col("_body")
    r = F.col("_root")
    lo = F.when(r.isNotNull(), r["pos"]).when(body.isNotNull(), body["pos"] + 1).otherwise(F.lit(0))
    hi = F.when(r.isNotNull(), r["end"]).when(body.isNotNull(), body["end"]).otherwise(F.size(nodes) - 1)
    tag = F.when(r.isNotNull(), r["tag"]).when(body.isNotNull(), F.lit("body")).otherwise(F.lit("document"))
    return stage(df, lo=lo, hi=hi, root_tag=tag).drop("_h1", "_title", "_body", "_cands", "_root")


def _break(n: Column, lines: int) -> Column:
    """Line ends with the quote marks of node ``n``; inside a table cell a space."""
    return F.when(n["ctx"].bitwiseAND(CELL) != 0, F.lit(" ")).otherwise(
        F.repeat(F.concat(F.lit("\n"), F.repeat(F.lit(QUOTE), n["quotes"])), F.lit(lines)))


def _open_token(n: Column, base: Column) -> Column:
    t = n["tag"]
    level = F.when(t.isin(*HEADINGS), F.substring(t, 2, 1).try_cast("int"))
    li = F.concat(_break(n, 1), F.repeat(F.lit(INDENT), F.greatest(n["lists"] - 1, F.lit(0))),
                  F.when(n["ptag"] == "ol", F.concat(n["idx"].cast("string"), F.lit(". "))).otherwise(F.lit("- ")))
    img = F.when(F.coalesce(n["src"], F.lit("")) != "",
                 F.concat(F.lit("!["), F.coalesce(n["alt"], F.lit("")), F.lit("]("),
                          U.resolve_location_p(base, n["src"]), F.lit(")"))).otherwise(F.lit(""))
    return (F.when(level.isNotNull(), F.concat(_break(n, 2), F.repeat(F.lit("#"), level), F.lit(" ")))
            .when(t == "li", li)
            .when(t == "pre", F.concat(_break(n, 2), F.lit("```" + LINE)))
            .when(t == "br", _break(n, 1))
            .when(t == "hr", F.concat(_break(n, 2), F.lit("---"), _break(n, 2)))
            .when(t == "img", img)
            .when(t == "a", F.when(n["href"].isNotNull(), F.lit("[")).otherwise(F.lit("")))
            .when(t == "tr", F.concat(_break(n, 1), F.lit("|")))
            .when(t.isin("td", "th"), F.lit(" "))
            .when(t.isin(*BLOCKS), _break(n, 2))
            .otherwise(F.lit("")))


def _close_token(e: Column, base: Column) -> Column:
    t = e["tag"]
    rule = F.concat(_break(e, 1), F.lit("|"), F.repeat(F.lit(" --- |"), F.coalesce(e["cells"], F.lit(0))))
    first_row = (e["idx"] == 1) & e["ptag"].isin("table", "thead")
    return (F.when(t == "a", F.when(e["href"].isNotNull(),
                                    F.concat(F.lit("]("), U.resolve_location_p(base, e["href"]), F.lit(")")))
                   .otherwise(F.lit("")))
            .when(t == "pre", F.concat(F.lit(LINE + "```"), _break(e, 2)))
            .when(t.isin("td", "th"), F.lit(" |"))
            .when(t == "tr", F.when(first_row, rule).otherwise(F.lit("")))
            .when(t == "blockquote", F.repeat(F.concat(F.lit("\n"), F.repeat(F.lit(QUOTE), e["quotes"] - 1)), F.lit(2)))
            .when(t.isin(*HEADINGS, *BLOCKS), _break(e, 2))
            .otherwise(F.lit("")))


def _text_token(n: Column) -> Column:
    def inside(bit):
        return n["ctx"].bitwiseAND(bit) != 0

    code = F.translate(F.replace(n["text"], F.lit("\r\n"), F.lit("\n")), " \t\n\r", SPACE + TAB + LINE + LINE)
    t = F.regexp_replace(n["text"], r"[\t\n\f\r ]+", " ")
    core = F.trim(t)
    lead = F.when(t.startswith(" "), F.lit(" ")).otherwise(F.lit(""))
    trail = F.when(t.endswith(" ") & (core != ""), F.lit(" ")).otherwise(F.lit(""))
    b = F.when(inside(BOLD), F.lit(STRONG)).otherwise(F.lit(""))
    i = F.when(inside(ITALIC), F.lit("_")).otherwise(F.lit(""))
    c = F.when(inside(CODE), F.lit("`")).otherwise(F.lit(""))
    return F.when(inside(PRE), code).when(core == "", t).otherwise(F.concat(lead, b, i, c, core, c, i, b, trail))


def render(df: DataFrame, nodes_col: str = "nodes", base_col: str = "base_parts") -> DataFrame:
    """Markdown from the kept nodes of the render range, in one pass.

    Each node emits the closing tokens of the kept elements that end before
    it, then, if kept, its own opening token or text.
    """
    nodes = F.col(nodes_col)
    base = F.col(base_col)
    lo, hi = F.col("lo"), F.col("hi")
    df = stage(df, _sub=F.slice(nodes, lo + 1, F.greatest(hi - lo + 1, F.lit(0))))
    sub = F.col("_sub")

    def closed(c: Column) -> Column:
        e = _node(nodes, c)
        return F.when((c >= lo) & e["k"], _close_token(e, base)).otherwise(F.lit(""))

    tokens = F.transform(sub, lambda n: F.concat(
        F.coalesce(F.array_join(F.transform(n["closes"], closed), ""), F.lit("")),
        F.when(~n["k"], F.lit("")).when(n["tag"] == TEXT, _text_token(n)).otherwise(_open_token(n, base))))
    open_at_end = F.reverse(F.filter(sub, lambda e: e["k"] & (e["tag"] != TEXT) & (e["end"] >= hi)))
    tail = F.array_join(F.transform(open_at_end, lambda e: _close_token(e, base)), "")
    raw = F.concat(F.array_join(tokens, ""), tail)
    # Slimmed-document size (P16 / H06): frame, escaped title, and the kept nodes as written.
    slim = F.aggregate(F.filter(sub, lambda n: n["k"]), F.lit(0).cast("bigint"), lambda acc, n: acc + F.when(
        n["tag"] == TEXT, F.octet_length(X.escape_text(n["text"]))).otherwise(
        n["raw"] + F.when(n["tag"].isin(*VOID), F.lit(0)).otherwise(F.octet_length(n["tag"]) + 3)).cast("bigint"))
    frame = len(SLIM_FRAME) + F.octet_length(X.escape_html(F.col("slim_title")))
    return stage(df, _raw_md=raw, slim_bytes=(slim + frame).cast("bigint")).drop("_sub")


def split_lines(raw: Column) -> Column:
    """Lines of the raw rendering with their quote level, without spare spaces."""
    def line(x):
        level = F.length(F.regexp_extract(x, f"^({QUOTE}*)", 1))
        text = F.regexp_replace(F.regexp_replace(x, f"^{QUOTE}*[ \\t]+|^{QUOTE}+", ""), r"[ \t]+$", "")
        return F.struct(level.alias("level"), F.regexp_replace(text, "[ \\t]{2,}", " ").alias("text"))

    return F.transform(F.split(raw, "\n"), line)


def kept_lines(lines: Column) -> Column:
    """Lines with text, marked if a blank line stands before them.

    ``lines`` must be a staged column (:func:`split_lines`): it is read again
    at every line.
    """
    marked = F.transform(lines, lambda x, i: F.struct(
        x["level"].alias("level"), x["text"].alias("text"),
        F.coalesce((i > 0) & (_at(lines, F.greatest(i, F.lit(1)))["text"] == ""), F.lit(False)).alias("blank")))
    return F.filter(marked, lambda x: x["text"] != "")


def _joined(lines: Column) -> Column:
    def prefix(level):
        return F.repeat(F.lit("> "), level)

    def one(x, i):
        before = _at(lines, F.greatest(i, F.lit(1)))["level"]
        gap = F.when(i == 0, F.lit("")).when(
            x["blank"], F.concat(F.lit("\n"), F.rtrim(prefix(F.least(x["level"], before))), F.lit("\n"))).otherwise(F.lit("\n"))
        return F.concat(gap, prefix(x["level"]), F.replace(x["text"], F.lit(LINE), F.concat(F.lit("\n"), prefix(x["level"]))))

    md = F.array_join(F.transform(lines, one), "")
    md = F.replace(md, F.lit(STRONG + STRONG), F.lit(""))
    md = F.replace(md, F.lit(STRONG), F.lit("**"))
    return U.js_trim(F.translate(md, INDENT[0] + SPACE + TAB, "  \t"))


def finish(df: DataFrame, host: Column) -> DataFrame:
    """Final Markdown, title, stats, and the
    service's refusal as a flag (``error``); nothing is withheld."""
    df = stage(df, _split=split_lines(F.col("_raw_md")))
    df = stage(df, _lines=kept_lines(F.col("_split")))
    df = stage(df, _md=_joined(F.col("_lines")))
    md = F.col("_md")
    error = (F.when(F.col("source_bytes") > MAX_SOURCE_BYTES, F.lit(ERROR_SOURCE_SIZE))
             .when(F.col("slim_bytes") > MAX_SLIM_BYTES, F.lit(ERROR_SLIM_SIZE))
             .when(md == "", F.lit(ERROR_NOTHING))
             .when(X.is_chrome_dump(md), F.lit(ERROR_CHROME)))
    title = F.coalesce(F.nullif(F.col("slim_title"), F.lit("")), X.title_from_markdown(md, host))
    df = stage(df, error=error, title=title)
    markdown = F.concat(U.js_trim(X.ensure_heading(md, F.col("title"))), F.lit("\n"))
    df = stage(df, markdown=markdown)
    return df.select(
        *[c for c in df.columns if c not in ("_raw_md", "_md", "_split", "_lines")],
        X.word_count(F.col("markdown")).alias("words"),
        X.byte_length(F.col("markdown")).alias("markdown_bytes"),
    )


def parse_pages(pages: DataFrame, html_col: str = "html", declared_col: str | None = None) -> DataFrame:
    """S03 + H01: parse with the size flag.  ``too_large``: the declared or
    the actual size is over the service's limit; every page is parsed."""
    sized = pages.withColumn("source_bytes", F.octet_length(F.col(html_col)).cast("bigint"))
    size = F.greatest(F.col("source_bytes"), F.col(declared_col)) if declared_col else F.col("source_bytes")
    sized = sized.withColumn("too_large", F.coalesce(size > MAX_SOURCE_BYTES, F.lit(False)))
    return html_nodes(sized, html_col, "nodes")


def extract_html(pages: DataFrame, url_col: str = "final_url", html_col: str = "html") -> DataFrame:
    """H17 for HTML captures: the full page → Markdown pipeline.

    ``pages`` needs ``url_col`` (the final URL, base for relative links) and
    ``html_col``; every other column passes through.
    """
    df = U.with_url_parts(parse_pages(pages, html_col), url_col, "base_parts")
    df = remove_chrome(df)
    df = locate(df)
    df = render(df).drop("nodes")
    return finish(df, F.col("base_parts.host"))


def extract_markdown(docs: DataFrame, md_col: str, url_col: str) -> DataFrame:
    """Native-Markdown normaliser — trim, title, heading guarantee, stats
    (bytes exclude the final newline); empty or chrome is flagged in ``error``."""
    df = U.with_url_parts(docs, url_col, "base_parts")
    df = stage(df, _md=U.js_trim(F.col(md_col)))
    md = F.col("_md")
    error = (F.when(md == "", F.lit(ERROR_EMPTY_MARKDOWN))
             .when(X.is_chrome_dump(md), F.lit(ERROR_MARKDOWN_CHROME)))
    df = stage(df, error=error, _title=X.title_from_markdown(md, F.col("base_parts.host")))
    df = stage(df, _with_heading=X.ensure_heading(md, F.col("_title")))
    wh = F.col("_with_heading")
    return df.select(
        *[c for c in df.columns if c not in ("_md", "_title", "_with_heading", "base_parts")],
        F.col("_title").alias("title"),
        F.concat(U.js_trim(wh), F.lit("\n")).alias("markdown"),
        X.word_count(wh).alias("words"),
        X.byte_length(wh).alias("markdown_bytes"),
    )


def selector_table(spark, selectors: list[str]):
    """The fixed selector list as a table (rank, selector, kind, value)."""
    rows = []
    for rank, s in enumerate(selectors, start=1):
        c = selector_parts(s)[-1]
        kind, value = (("tag", c["tag"]) if c["tag"] and not (c["id"] or c["classes"] or c["role"]) else
                       ("id", c["id"]) if c["id"] else ("class", c["classes"][0]) if c["classes"] else
                       ("role", c["role"]))
        rows.append((rank, s, kind, value))
    return spark.createDataFrame(rows, "rank int, selector string, kind string, value string")


def selector_hits(spark, node_rows: DataFrame, selectors: list[str]) -> DataFrame:
    """How many element nodes and pages each selector matches.

    The theta join "node matches selector" is split into one equi-join per
    selector kind (tag, id, class, role) against the fixed selector table,
    which has a constant size (tens of rows) and is broadcast.  The node
    side is never shuffled for the join; only the (selector, page) partial
    aggregates are.
    """
    sel = F.broadcast(selector_table(spark, selectors))
    n = node_rows.select("page_id", F.col("n.tag").alias("tag"), F.col("n.id").alias("id"),
                         F.col("n.role").alias("role"), F.col("n.cls").alias("cls"))
    by_tag = n.select("page_id", F.lit("tag").alias("kind"), F.col("tag").alias("value"))
    by_id = n.where(F.col("id").isNotNull()).select("page_id", F.lit("id").alias("kind"), F.col("id").alias("value"))
    by_role = n.where(F.col("role").isNotNull()).select("page_id", F.lit("role").alias("kind"), F.col("role").alias("value"))
    by_cls = n.where(F.col("cls").isNotNull()).select(
        "page_id", F.lit("class").alias("kind"), F.explode(F.array_distinct("cls")).alias("value"))
    keys = by_tag.unionByName(by_id).unionByName(by_role).unionByName(by_cls)
    hits = keys.join(sel, ["kind", "value"])
    return (hits.groupBy("rank", "selector")
            .agg(F.count("*").alias("nodes"), F.countDistinct("page_id").alias("pages")))
