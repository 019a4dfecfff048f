"""Markdown / text scalar operators as Column expressions.

H10 heading guarantee, H11 title fallback, H12/H13 word counts, H14 byte
size, P17 chrome-dump detector, P19/P20 error classes, F01 file names,
F02 HTML escaping, F04–F06 line handling.  All JVM-side except the NFKD
step of F01, which is an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.urls import JS_WS, js_trim

# Executors need not have this package installed: functions defined here
# (run inside Python workers) are shipped by value with the task.
import sys as _sys  # noqa: E402
from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference service's behaviour.
# ---------------------------------------------------------------------------
# Phrases that mark navigation chrome near the top of a Markdown document
# (case-insensitive); two or more = chrome.  The service looks at the first
# 2000 characters; here ``first`` is a parameter, by default the whole text.
CHROME_SIGNALS = [
    r"jump to content",
    r"main menu",
    r"move to sidebar",
    r"personal tools",
    r"skip to (?:main )?content",
    r"toggle (?:the )?table of contents",
]
CHROME_HEAD_CHARS = 2000
# Error messages that no fallback can fix (case-insensitive patterns).
POLICY_ERRORS = [
    r"private and reserved",
    r"credentials are not supported",
    r"only http and https",
    r"only standard web ports",
    r"did not resolve to a public address",
    r"enter a complete url",
]
# Markdown marker characters dropped before counting words.
MARKER_CLASS = r"[#>*_`|~-]"
# ---------------------------------------------------------------------------

_NOT_WS = f"[^{JS_WS}]+"


def utf16_length(c: Column) -> Column:
    """JavaScript ``String.length`` (UTF-16 code units)."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def byte_length(c: Column) -> Column:
    """UTF-8 byte length."""
    return F.octet_length(c).cast("bigint")


def count_tokens(c: Column) -> Column:
    """Number of whitespace-separated tokens (JS ``\\s`` semantics)."""
    return F.regexp_count(c, F.lit(_NOT_WS)).cast("bigint")


def word_count(md: Column) -> Column:
    """H12 (documents): drop fenced code and images, keep link text, drop
    marker characters, count whitespace-separated tokens."""
    x = F.regexp_replace(md, r"(?s)```.*?```", " ")
    x = F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", " ")
    x = F.regexp_replace(x, r"\[([^\]]+)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, MARKER_CLASS, " ")
    return count_tokens(x)


def word_count_post(md: Column) -> Column:
    """H13 (posts): a whole link (text included) becomes a space; markers dropped."""
    x = F.regexp_replace(md, r"\[[^\]]+\]\([^)]*\)", " ")
    x = F.regexp_replace(x, MARKER_CLASS, " ")
    return count_tokens(x)


def chrome_hits(md: Column, first: int | None = None) -> Column:
    """A10: how many chrome phrases occur (in the ``first`` characters, if given)."""
    head = md if first is None else F.substring(md, 1, first)
    hits = [F.when(head.rlike("(?i)" + p), 1).otherwise(0) for p in CHROME_SIGNALS]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def is_chrome_dump(md: Column, first: int | None = None) -> Column:
    """Two or more chrome phrases (in the ``first`` characters, if given)."""
    return chrome_hits(md, first) >= 2


def has_heading(md: Column) -> Column:
    return md.rlike(r"(?m)^#[" + JS_WS + r"]+[^" + JS_WS + "]")


def title_from_markdown(md: Column, host: Column) -> Column:
    """First ``# `` line, else the hostname."""
    first = js_trim(F.regexp_extract(md, r"(?m)^#[" + JS_WS + r"]+(.+)$", 1))
    return F.coalesce(F.nullif(first, F.lit("")), host)


def ensure_heading(md: Column, title: Column) -> Column:
    """Prepend ``# title`` when the document has no level-1 heading line."""
    return F.when(has_heading(md), md).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), md))


def escape_html(c: Column) -> Column:
    """escape & < > " (ampersand first)."""
    x = F.replace(c, F.lit("&"), F.lit("&amp;"))
    x = F.replace(x, F.lit("<"), F.lit("&lt;"))
    x = F.replace(x, F.lit(">"), F.lit("&gt;"))
    return F.replace(x, F.lit('"'), F.lit("&quot;"))


def escape_text(c: Column) -> Column:
    """Text as a serialised document holds it: & < > escaped."""
    x = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(x, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def is_policy_error(msg: Column) -> Column:
    """Errors no fallback can fix."""
    return msg.rlike("(?i)(" + "|".join(POLICY_ERRORS) + ")")


def merge_errors(direct: Column, browser: Column) -> Column:
    """P20: combine the direct and the rendered-fallback error messages."""
    return (F.when(is_policy_error(direct), direct)
            .when(browser.rlike("(?i)browser fallback is unavailable"), direct)
            .when(direct == browser, direct)
            .otherwise(F.concat(direct, F.lit(" Browser fallback: "), browser)))


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Unicode NFKD (the one string normalisation Spark lacks)."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


def safe_filename(title: Column, strip_edges: bool = True, max_chars: int | None = None) -> Column:
    """NFKD, keep word characters / whitespace / '-', collapse runs of
    space, '_' and '-' into '-', strip edge dashes, default ``document``.
    The service cuts at 80 characters: pass ``max_chars=80`` for its label.
    ``strip_edges=False`` is the browser-download variant."""
    x = F.regexp_replace(nfkd(title), r"[^A-Za-z0-9_\s-]", "")
    x = js_trim(x)
    x = F.regexp_replace(x, r"[\s_-]+", "-")
    if strip_edges:
        x = F.regexp_replace(x, r"^-+|-+$", "")
    if max_chars is not None:
        x = F.substring(x, 1, max_chars)
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("document"))


def collapse_blank_lines(c: Column) -> Column:
    """three or more newlines → one blank line."""
    return F.regexp_replace(c, r"\n{3,}", "\n\n")

