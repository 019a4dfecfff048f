"""Encyclopedia articles: payload scan (S04), fragment clean-up (H07) and
appendix sections (H08 / W06), as expressions over the node array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.operators import documents as Dm
from pagemill.operators.staging import stage

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference service's behaviour.
# ---------------------------------------------------------------------------
ERROR_NO_ARTICLE = "Wikipedia API did not return article HTML."
FRAGMENT_OPEN = '<!doctype html><html><head><meta charset="utf-8"><title>{}</title></head><body><article><h1>{}</h1>'
FRAGMENT_CLOSE = "</article></body></html>"
# ---------------------------------------------------------------------------

PAYLOAD = "struct<error:struct<info:string>,parse:struct<title:string,text:string>>"


def spaced_title(title: Column) -> Column:
    """underscores of a page title as spaces."""
    return F.replace(title, F.lit("_"), F.lit(" "))


def parse_payload(df: DataFrame, body_col: str = "body", title_col: str = "page_title") -> DataFrame:
    """``fragment``, ``display_title``, ``error`` and ``source_bytes`` of a parse payload.

    A payload with an error, without text, or that is no JSON has no fragment
    and the service's message.
    """
    df = stage(df, _p=F.from_json(F.col(body_col), PAYLOAD, {"mode": "PERMISSIVE"}))
    p = F.col("_p")
    text = F.nullif(p["parse"]["text"], F.lit(""))
    ok = p["error"].isNull() & text.isNotNull()
    title = F.coalesce(F.nullif(U.js_trim(p["parse"]["title"]), F.lit("")), spaced_title(F.col(title_col)))
    return df.select(
        "*", F.when(ok, text).alias("fragment"), F.when(ok, title).alias("display_title"),
        F.when(~F.coalesce(ok, F.lit(False)), F.coalesce(F.nullif(p["error"]["info"], F.lit("")), F.lit(ERROR_NO_ARTICLE))).alias("error"),
        F.when(ok, F.octet_length(text).cast("bigint")).alias("source_bytes")).drop("_p")


def wrap_fragment(fragment: Column, title: Column) -> Column:
    """A fragment as a document of one article headed by its title."""
    t = X.escape_html(title)
    a, b, c = FRAGMENT_OPEN.split("{}")
    return F.concat(F.lit(a), t, F.lit(b), t, F.lit(c), fragment, F.lit(FRAGMENT_CLOSE))


def drop_appendix(df: DataFrame, nodes_col: str = "nodes") -> DataFrame:
    """Appendix sections lose their kept flag.

    An h2 or h3 whose label (without "[edit]") starts with an appendix name
    goes, with its following siblings up to the next h2 or h3 that is not one.
    Nodes need the flag ``k`` of :func:`documents.remove_chrome`.
    """
    nodes = F.col(nodes_col)
    names = "|".join(Dm.APPENDIX_HEADINGS)
    # pos, parent and whether it is an appendix, of each kept heading
    df = stage(df, _heads=F.transform(
        F.filter(nodes, lambda n: n["k"] & n["tag"].isin("h2", "h3")),
        lambda n: F.struct(n["pos"].alias("pos"), n["parent"].alias("parent"), U.js_trim(F.regexp_replace(
            Dm.text_of(nodes, n), r"(?i)\[edit\]", "")).rlike(rf"(?i)^({names})\b").alias("appendix"))))
    heads = F.col("_heads")

    def section(h):
        stops = F.filter(heads, lambda x: (x["parent"] == h["parent"]) & (x["pos"] > h["pos"]) & ~x["appendix"])
        last = F.when(h["parent"] >= 0, Dm._node(nodes, h["parent"])["end"]).otherwise(F.size(nodes) - 1)
        return F.struct(h["pos"].alias("pos"), F.coalesce(Dm._at(stops, 1)["pos"] - 1, last).alias("end"))

    df = stage(df, _gone=F.transform(F.filter(heads, lambda h: h["appendix"]), section))
    gone = F.col("_gone")
    kept = F.transform(nodes, lambda n: n.withField(
        "k", n["k"] & ~F.exists(gone, lambda g: (g["pos"] <= n["pos"]) & (n["pos"] <= g["end"]))))
    return stage(df, **{nodes_col: kept}).drop("_heads", "_gone")


def clean_fragments(df: DataFrame, fragment_col: str = "fragment", title_col: str = "display_title") -> DataFrame:
    """H07 + H08: fragments to node arrays with bulk and appendix sections flagged out."""
    df = df.withColumn("html", wrap_fragment(F.col(fragment_col), F.col(title_col)))
    return drop_appendix(Dm.remove_chrome(Dm.parse_pages(df), Dm.WIKI_STRIP_SELECTORS))
