"""Operator 5: main text of web pages, with a suffix array over each host's pages.

A page is read into blocks of text without menus, headers, footers, sidebars,
adverts, forms, comments and hidden parts, as tags, roles and class names tell
them; of pages with an article (else a main part) only that is taken.  Then
the token streams of a host's pages are concatenated and their suffixes sorted
(to the depth of the shortest substring asked for).  Substrings that start on
many distinct pages are boilerplate: outside an article the tokens go that are
covered by substrings on MIN_PAGES pages, and the unique runs stay; inside an
article only blocks go that are covered as a whole by substrings on half of the
host's pages (MIN_PAGES at least), since articles quote and are copied.

A host's pages are dealt over as many groups as its size asks for, and each
group has a suffix array of its own.  Of hosts with several groups the groups'
counts of distinct pages are summed by host and substring (64-bit hash), so
the rule and the result are those of one array over the whole host.

Null, empty and text-less pages have the empty text.  Pages without a host are
handled like one host.  Repeated rows are pages of their own but count as one
page where distinct pages are counted.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, staged
from pagemill.sources.tables import read_pages

GROUP_PAGES = 400
BROADCAST_HOSTS = 100_000     # hosts with more than one group that are sent to all tasks; beyond, a join
DEPTH = 8                     # tokens of the shortest substring looked for; a power of two
MIN_PAGES = 3
INSIDE_SHARE = 0.5            # of the host's pages

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu noscript template svg object canvas "
                    "video audio datalist script style".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var".split())
CLOSES = {"li": "ul ol", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar "
                   "navigation menu breadcrumb breadcrumbs pagination pager comment comments disqus respond share sharing "
                   "social related recommended newsletter subscribe signup login cookie cookies consent popup modal "
                   "masthead copyright legal toolbar widget skip search".split())
WEAK = frozenset("header footer notice notices banner alert".split())
CONTENT = frozenset("article post entry content story body main text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


def _patterns():
    import re

    tag = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>"""
                     r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
    attribute = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
    return tag, attribute, re.compile(r"[^a-z]+")


def _is_chrome(tag: str, attributes: str, in_article: bool, attribute, parts) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if tag in ("html", "body") or not attributes.strip():
        return False
    for name, value in attribute.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id"):
            for one in value.split():
                found = set(parts.split(one))
                if found & STRONG or found & WEAK and not found & CONTENT:
                    return True
    return False


def page_blocks(html: str, patterns) -> tuple[list[str], bool]:
    """Blocks of a page's main part in order, and whether they are an article's (or a main part's)."""
    from html import unescape

    tag_re, attribute, parts = patterns
    out: dict[str, list[str]] = {"article": [], "main": [], "": []}
    stack: list[tuple[str, bool, str]] = []      # tag, whether chrome, container
    chrome, article, main = 0, 0, 0
    current: list[str] = []

    def flush():
        text = " ".join("".join(current).split())
        current.clear()
        if text:
            out["article" if article else "main" if main else ""].append(text)

    def pop(to: int):
        nonlocal chrome, article, main
        for _, dropped, container in stack[to:]:
            chrome -= dropped
            article -= container == "article"
            main -= container == "main"
        del stack[to:]

    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        if start > at and not chrome:
            text = html[at:start]
            current.append(unescape(text) if "&" in text else text)
        if start == n:
            break
        m = tag_re.match(html, start)
        if m is None:
            if not chrome:
                current.append("<")
            at = start + 1
            continue
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            current.append(" ")
            continue
        inline = tag in INLINE
        if not inline and tag not in RAW:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if inline and stack[i][0] not in INLINE:
                    break
            continue
        if tag in VOID or rest.endswith("/") and tag not in RAW and not inline and tag not in ("p", "div", "article"):
            continue
        if tag in RAW:
            end = _find_close(html, tag, at)
            at = n if end < 0 else end
            stack.append((tag, True, ""))
            chrome += 1
            continue
        if not inline:
            scope = CLOSES.get(tag, "").split()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or scope and stack[i][0] == tag or tag == "body" and stack[i][0] == "head":
                    pop(i)
                    break
                if stack[i][0] in scope or stack[i][0] not in INLINE and not scope and tag != "body":
                    break
        dropped = _is_chrome(tag, rest, article > 0, attribute, parts)
        container = "article" if tag == "article" else "main" if tag == "main" or "role" in rest and "main" in rest else ""
        stack.append((tag, dropped, container))
        chrome += dropped
        article += container == "article"
        main += container == "main"
    flush()
    for kind in ("article", "main"):
        if out[kind]:
            return out[kind], True
    return out[""], False


def _find_close(html: str, tag: str, at: int) -> int:
    import re

    m = re.compile("</" + re.escape(tag), re.I).search(html, at)
    return m.start() if m else -1


def _read(batches):
    import pyarrow as pa

    patterns = _patterns()
    for batch in batches:
        blocks, inside = [], []
        for html in batch.column("html").to_pylist():
            b, i = page_blocks(html or "", patterns)
            blocks.append(b)
            inside.append(i)
        yield pa.RecordBatch.from_arrays(
            [batch.column(x) for x in ("page_id", "url", "host", "part", "n_pages")]
            + [pa.array(blocks, pa.list_(pa.string())), pa.array(inside, pa.bool_())],
            names=["page_id", "url", "host", "part", "n_pages", "blocks", "inside"])


def suffix_ranks(tokens, depth: int):
    """Rank of each suffix by its first ``depth`` tokens (a power of two), by prefix doubling."""
    import numpy as np

    rank, k = tokens, 1
    while k < depth:
        after = np.full(len(rank), -1, np.int64)
        after[:-k] = rank[k:]
        rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1]
        k *= 2
    return rank


def pages_with(rank, page):
    """Number of distinct pages on which the suffixes of each rank start."""
    import numpy as np

    order = np.lexsort((page, rank))                      # the suffix array, pages in order within equal prefixes
    r, p = rank[order], page[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    return np.bincount(r, weights=new).astype(np.int64)


def covered(starts, n: int, depth: int):
    """Which of n tokens lie in a substring of ``depth`` tokens that begins at one of ``starts``."""
    import numpy as np

    change = np.zeros(n + depth + 1, np.int64)
    change[starts] += 1
    change[starts + depth] -= 1
    return np.cumsum(change)[:n] > 0


def repeated_cover(rank, page, depth: int, at_least: int):
    """Which tokens lie in a substring of ``depth`` tokens that starts on ``at_least`` distinct pages."""
    import numpy as np

    return covered(np.flatnonzero(pages_with(rank, page)[rank] >= at_least), len(rank), depth)


def _group(pdf):
    """Token stream of a group's pages: words, places of each page's blocks, page of each token, end of each token's page."""
    import numpy as np
    import pandas as pd

    words, page_of, block_at = [], [], []
    for i, blocks in enumerate(pdf["blocks"]):
        places = []
        for block in blocks:
            own = block.split(" ")
            places.append((len(words), len(words) + len(own)))
            words += own
            words.append("\n")                            # between blocks, the same everywhere
        words.append(f"\n{i}")                            # ends a page, unique
        page_of.append(len(words))
        block_at.append(places)
    size = np.diff([0, *page_of])
    distinct = pd.factorize(pdf["page_id"])[0]            # a page without an id is -1
    return words, block_at, np.repeat(distinct, size), np.repeat(np.array(page_of) - 1, size)


def _ranks(words, end):
    """Rank of each suffix, a place of each rank, and the hash of its substring; 0 if that goes over a page's end."""
    import numpy as np
    import pandas as pd

    tokens, names = pd.factorize(np.array(words, object))
    rank = suffix_ranks(tokens.astype(np.int64), DEPTH)
    at = np.unique(rank, return_index=True)[1]
    of = np.append(pd.util.hash_array(names, categorize=False)[tokens], np.zeros(DEPTH, np.uint64))
    h = np.zeros(len(at), np.uint64)
    for j in range(DEPTH):
        h = h * np.uint64(0x9E3779B97F4A7C15) + of[at + j]
    return rank, at, np.where(at + DEPTH <= end[at], h, 0).view(np.int64)


def _counts(pdf):
    """Distinct pages of each substring of a group, of a host with several."""
    import pandas as pd

    words, _, page, end = _group(pdf)
    rank, _, h = _ranks(words, end)
    pages = pages_with(rank, page)
    return pd.DataFrame({"host": pdf["host"].iloc[0], "part": pdf["part"].iloc[0], "h": h[h != 0], "n": pages[h != 0]})


def _least(inside: bool, n_pages: int) -> int:
    """Pages of a host on which a substring is boilerplate."""
    import math

    return max(MIN_PAGES, math.ceil(INSIDE_SHARE * n_pages)) if inside else MIN_PAGES


def _text(pdf, counts=None):
    """Texts of a group; ``counts`` (h, n) has the host's repeated substrings if the host has several groups."""
    import numpy as np
    import pandas as pd

    words, block_at, page, end = _group(pdf)
    n_pages = page.max() + 1 if counts is None else int(pdf["n_pages"].iloc[0])
    covers = {}
    if n_pages >= MIN_PAGES:
        rank, _, h = _ranks(words, end)
        if counts is None:
            pages = pages_with(rank, page)
        else:
            known = counts.drop_duplicates("h").set_index("h")["n"]
            pages = known.reindex(h, fill_value=0).to_numpy()
        for inside in (False, True):
            if (pdf["inside"] == inside).any():
                covers[inside] = covered(np.flatnonzero(pages[rank] >= _least(inside, n_pages)), len(rank), DEPTH)
    texts = []
    for blocks, places, inside in zip(pdf["blocks"], block_at, pdf["inside"]):
        cover = covers.get(inside)
        if cover is None:
            texts.append(" ".join(blocks))
        elif inside:
            kept = [b for b, (s, e) in zip(blocks, places) if not cover[s:e].all()]
            texts.append(" ".join(kept or blocks))
        else:
            kept = []
            for b, (s, e) in zip(blocks, places):
                own = cover[s:e]
                kept.append(b if not own.any() else " ".join(w for w, gone in zip(words[s:e], own) if not gone))
            texts.append(" ".join(x for x in kept if x))
    return pd.DataFrame({"page_id": pdf["page_id"].to_numpy(), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def _host_text(pdf):
    return _text(pdf)


def _part_text(pdf, counts):
    return _text(pdf, counts)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    large = (pages.groupBy("host").agg(F.ceil(F.count("*") / GROUP_PAGES).cast("int").alias("parts"),
                                       F.count_distinct("page_id").alias("n_pages")).where("parts > 1"))
    n_large = large.count()
    if n_large <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    part = F.pmod(F.xxhash64("page_id"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pages.join(large, "host", "left").withColumn("part", part).drop("parts")
    columns = "page_id long, url string, host string, part int, n_pages long, blocks array<string>, inside boolean"
    result = "page_id long, url string, text string, n_chars long"
    read = dealt.select("page_id", "url", "html", "host", "part", "n_pages").mapInArrow(_read, columns)
    if not n_large:
        return read.groupBy("host", "part").applyInPandas(_host_text, result)
    read = staged(read, "op5")
    whole = read.where("n_pages is null").groupBy("host", "part").applyInPandas(_host_text, result)
    read = read.where("n_pages is not null")
    counts = staged(read.groupBy("host", "part").applyInPandas(_counts, "host string, part int, h long, n long"), "op5")
    repeated = counts.groupBy("host", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_PAGES)
    marks = counts.drop("n").join(repeated, ["host", "h"])
    return whole.unionByName(read.groupBy("host", "part").cogroup(marks.groupBy("host", "part")).applyInPandas(_part_text, result))


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_pages(spark, sf_dir))
