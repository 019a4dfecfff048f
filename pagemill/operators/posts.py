"""Rich-post operators.

Block documents are rows ``(doc, pos, type, text, depth)``.  List numbering
is gaps-and-islands over the block order, separators depend on the previous
block (``lag``), and the document is assembled by sorting its lines by
position.  A document (one article / post) is a bounded unit, so grouping a
document's blocks into one row is bounded by the document, not the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import js_trim, js_trim_end

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference service's behaviour.
# ---------------------------------------------------------------------------
# Block heading types and the Markdown prefix each renders to (shifted down one level).
HEADING_PREFIX = {
    "header-one": "##",
    "header-two": "###",
    "header-three": "####",
    "header-four": "#####",
    "header-five": "######",
    "header-six": "######",
}
ORDERED, UNORDERED, ATOMIC = "ordered-list-item", "unordered-list-item", "atomic"
UNTITLED_ARTICLE = "Untitled X Article"
# ---------------------------------------------------------------------------


def number_lists(blocks: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """1..n within each run of consecutive ordered-list items;
    any other block type ends the run (depth does not fork numbering)."""
    w = Window.partitionBy(doc).orderBy(pos)
    prev = F.lag("type").over(w)
    b = blocks.withColumn("_new_run", F.when(prev.isNull() | (prev != F.col("type")), 1).otherwise(0))
    b = b.withColumn("_run", F.sum("_new_run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(doc, "_run").orderBy(pos))
    return b.withColumn("list_number", F.when(F.col("type") == ORDERED, n)).drop("_new_run", "_run")


def block_line(type_: Column, text: Column, depth: Column, number: Column, code: Column | None = None,
               atomic: Column | None = None) -> Column:
    """One block → its Markdown text (before right-trim).

    ``text`` is the text with inline marks, ``code`` (default: the same) that
    without, and ``atomic`` the lines of an atomic block.
    """
    code = F.coalesce(text if code is None else code, F.lit(""))
    indent = F.repeat(F.lit("  "), F.greatest(F.coalesce(depth, F.lit(0)), F.lit(0)).cast("int"))
    t = F.coalesce(text, F.lit(""))
    heading = None
    for k, v in HEADING_PREFIX.items():
        heading = (F.when(type_ == k, F.concat(F.lit(v + " "), t)) if heading is None
                   else heading.when(type_ == k, F.concat(F.lit(v + " "), t)))
    if atomic is not None:
        lines = F.filter(F.transform(atomic, js_trim_end), lambda x: x != "")
        heading = heading.when(type_ == ATOMIC, F.array_join(lines, "\n\n"))
    return (heading
            .when(type_ == UNORDERED, F.concat(indent, F.lit("- "), t))
            .when(type_ == ORDERED, F.concat(indent, number.cast("string"), F.lit(". "), t))
            .when(type_ == "blockquote", F.concat(F.lit("> "), F.replace(t, F.lit("\n"), F.lit("\n> "))))
            .when(type_ == "code-block", F.concat(F.lit("```\n"), code, F.lit("\n```")))
            .otherwise(t))


def render_blocks(blocks: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """X16 + X18 + W02: per block its line and whether a blank line precedes it.

    Columns ``inline`` (text with inline marks) and ``atomic`` (lines of
    atomic blocks) are used if they are there.  List items keep their line even when empty and are separated only from
    a different previous type; other blocks are right-trimmed and skipped
    when empty.
    """
    b = number_lists(blocks, doc, pos)
    has = lambda c: F.col(c) if c in blocks.columns else None
    line = block_line(F.col("type"), F.col("inline" if "inline" in blocks.columns else "text"), F.col("depth"), F.col("list_number"),
                      F.col("text"), has("atomic"))
    is_list = F.col("type").isin(ORDERED, UNORDERED)
    b = b.withColumn("line", F.when(is_list, line).otherwise(js_trim_end(line)))
    b = b.withColumn("keep", is_list | (F.col("line") != ""))
    w = Window.partitionBy(doc).orderBy(pos)
    prev_type = F.lag("type").over(w)
    # Separator: any non-list line after earlier output, or a list item whose
    # previous block had a different type.  (Blank lines never double: the
    # assembly collapses 3+ newlines.)
    b = b.withColumn("_prev_type", prev_type)
    b = b.withColumn("_emitted_before", F.sum(F.col("keep").cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, -1)))
    has_out = F.coalesce(F.col("_emitted_before"), F.lit(0)) > 0
    sep = F.when(is_list, has_out & (F.coalesce(F.col("_prev_type"), F.lit("")) != F.col("type"))).otherwise(has_out)
    return b.withColumn("blank_before", sep).drop("_prev_type", "_emitted_before")


def joined_lines(lines: Column) -> Column:
    """Lines (an array) as one text: at most one blank line between two, trimmed."""
    return js_trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def assemble(lines: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Join a document's kept lines in order, collapse 3+ newlines, trim."""
    kept = lines.where("keep")
    piece = F.concat(F.when(F.col("blank_before"), F.lit("\n")).otherwise(F.lit("")), F.col("line"))
    g = kept.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(pos), piece.alias("p")))).alias("ps"),
                              F.count("*").alias("lines"))
    return g.select(doc, "lines", joined_lines(F.transform("ps", lambda s: s["p"])).alias("markdown"))


def best_variant(variants: DataFrame) -> DataFrame:
    """Highest-bit-rate video variant per media (NULL rate = 0;
    ties keep the earlier variant) — a partial aggregate, skew-safe."""
    v = variants.where(F.col("content_type").contains("video"))
    key = F.struct(F.coalesce(F.col("bit_rate"), F.lit(0)), -F.col("variant_id"))
    return v.groupBy("media_id").agg(F.max_by("url", key).alias("url"))


def author_label(name: Column, screen_name: Column) -> Column:
    """``Name (@user)`` / ``Name`` / ``@user`` / NULL."""
    has_name = F.coalesce(name, F.lit("")) != ""
    has_user = F.coalesce(screen_name, F.lit("")) != ""
    return (F.when(has_name, F.concat(name, F.when(has_user, F.concat(F.lit(" (@"), screen_name, F.lit(")")))
                                      .otherwise(F.lit(""))))
            .when(has_user, F.concat(F.lit("@"), screen_name)))


def media_line(kind: Column, url: Column, alt: Column) -> Column:
    """Video → ``[Video](url)``, else ``![alt](url)``; no URL → NULL."""
    return F.when(F.coalesce(url, F.lit("")) != "",
                  F.when(kind == "video", F.concat(F.lit("[Video]("), url, F.lit(")")))
                  .otherwise(F.concat(F.lit("!["), F.coalesce(alt, F.lit("")), F.lit("]("), url, F.lit(")"))))


def render_post(posts: DataFrame) -> DataFrame:
    """Plain post → title, bold author, text, media lines."""
    user = F.col("screen_name")
    has_user = F.coalesce(user, F.lit("")) != ""
    title = F.when(has_user, F.concat(F.lit("Post by @"), user)).otherwise(F.lit("X Post"))
    author = author_label(F.col("name"), user)
    text = js_trim(F.coalesce(F.col("text"), F.lit("")))
    media = F.filter(F.transform(F.coalesce(F.col("media"), F.array().cast("array<struct<type:string,url:string,alt:string>>")),
                                 lambda m: media_line(m["type"], m["url"], m["alt"])), lambda x: x.isNotNull())
    parts = F.concat(F.array(F.concat(F.lit("# "), title)),
                     F.filter(F.array(F.when(author.isNotNull(), F.concat(F.lit("**"), author, F.lit("**"))),
                                      F.when(text != "", text)), lambda x: x.isNotNull()),
                     media)
    md = F.concat(js_trim(F.array_join(parts, "\n\n")), F.lit("\n"))
    return posts.withColumn("title", title).withColumn("author", author).withColumn("markdown", md)
