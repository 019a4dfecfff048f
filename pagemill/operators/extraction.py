"""Whole extraction of a captured source.

A source has up to four captures: an encyclopedia payload, the fetched page,
the rendered page as HTML and the same as Markdown; a post has its payload
alone.  Each capture that could be converted is a candidate with a rank.  All
HTML candidates go through one conversion, all Markdown ones through another,
and a map-side aggregate keeps each source's first success and the errors of
the others.  A policy error of the fetched page ends the search before the
rendered captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.operators import articles, documents as Dm, encyclopedia as E
from pagemill.operators.staging import stage

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference service's behaviour.
# ---------------------------------------------------------------------------
MARKDOWN_TYPE = r"(?i)(?:text|application)/(?:x-)?markdown"
HTML_TYPE = r"(?i)text/html|application/xhtml\+xml"
DIRECT, NATIVE, RENDERED, POST = "direct-html", "native-markdown", "browser-run", "x-fxtwitter"
ERROR_REDIRECTS = "The URL redirected too many times."
ERROR_RENDERED = "Browser Run could not extract Markdown from this page."
ERROR_RENDERED_CHROME = "Browser extraction returned page chrome instead of article content."
ERROR_NO_RENDERER = "Browser fallback is unavailable."
ERROR_POST_JSON = "The X provider returned invalid JSON (HTTP {})."
ERROR_POST_STATUS = "The X provider returned HTTP {}."
ERROR_NO_POST = "FxTwitter did not return a tweet."
VERSION = 1
# ---------------------------------------------------------------------------

ENCYCLOPEDIA, FETCHED, RENDERED_HTML, RENDERED_MARKDOWN = range(4)     # ranks of the candidates
ANSWER = "struct<status:int,success:boolean,result:string>"
DOCUMENT = ["provider", "final_url", "title", "author", "markdown", "words", "markdown_bytes", "source_bytes"]


def fetch_outcome(status: Column, location: Column) -> Column:
    """3xx needs a location; any other non-2xx is an error message."""
    return (F.when((status >= 300) & (status < 400),
                   F.when(location.isNull(), F.concat(F.lit("Redirect "), status.cast("string"), F.lit(" had no destination.")))
                   .otherwise(F.lit("redirect")))
            .when((status < 200) | (status >= 300), F.concat(F.lit("The website returned HTTP "), status.cast("string"), F.lit(".")))
            .otherwise(F.lit("ok")))


def content_kind(ctype: Column) -> Column:
    """Native Markdown, HTML, or unsupported."""
    return (F.when(ctype.rlike(MARKDOWN_TYPE), F.lit("native-markdown"))
            .when(ctype.rlike(HTML_TYPE), F.lit("html")).otherwise(F.lit("unsupported")))


def rendered_result(answer: Column) -> Column:
    """The trimmed result of a rendering that was answered, not marked as failed and not blank; else null."""
    r = U.js_trim(answer["result"])
    return F.when(answer["status"].between(200, 299) & F.coalesce(answer["success"], F.lit(True)) & (r != ""), r)


def fetched_error(c: DataFrame) -> Column:
    """What kept the fetched page from conversion: a refusal, the HTTP outcome or the type of content; else null."""
    outcome = fetch_outcome(c["status"], c["location"])
    ctype = F.coalesce(c["content_type"], F.lit(""))
    unsupported = F.concat(F.lit("Unsupported content type: "), F.coalesce(F.nullif(ctype, F.lit("")), F.lit("unknown")), F.lit("."))
    return F.coalesce(c["fetch_error"], F.when(outcome == "redirect", F.lit(ERROR_REDIRECTS)).when(outcome != "ok", outcome)
                      .when(content_kind(ctype) == "unsupported", unsupported))


def _html_candidates(c: DataFrame) -> DataFrame:
    fetched = F.when(c["fetched_error"].isNull() & (content_kind(c["content_type"]) == "html"), c["body"])
    rendered = rendered_result(c["rendered_html"])
    pair = lambda rank, provider, url, html: F.when(html.isNotNull(), F.struct(
        F.lit(rank).alias("rank"), F.lit(provider).alias("provider"), url.alias("final_url"), html.alias("html")))
    both = F.filter(F.array(pair(FETCHED, DIRECT, c["final_url"], fetched), pair(RENDERED_HTML, RENDERED, c["source_url"], rendered)),
                    lambda x: x.isNotNull())
    return Dm.extract_html(c.select("id", F.inline(both)))


def _markdown_candidates(c: DataFrame) -> DataFrame:
    fetched = F.when(c["fetched_error"].isNull() & (content_kind(c["content_type"]) == "native-markdown"), c["body"])
    rendered = rendered_result(c["rendered_md"])
    pair = lambda rank, provider, url, md, size: F.when(md.isNotNull(), F.struct(
        F.lit(rank).alias("rank"), F.lit(provider).alias("provider"), url.alias("final_url"), md.alias("md"), size.alias("source_bytes")))
    both = F.filter(F.array(pair(FETCHED, NATIVE, c["final_url"], fetched, F.octet_length(c["body"]).cast("bigint")),
                            pair(RENDERED_MARKDOWN, RENDERED, c["source_url"], rendered, F.lit(None).cast("bigint"))), lambda x: x.isNotNull())
    out = Dm.extract_markdown(c.select("id", F.inline(both)).withColumn("author", F.lit(None).cast("string")), "md", "final_url")
    chrome = (F.col("rank") == RENDERED_MARKDOWN) & (F.col("error") == Dm.ERROR_MARKDOWN_CHROME)
    return out.withColumn("error", F.when(chrome, F.lit(ERROR_RENDERED_CHROME)).otherwise(F.col("error")))


def _encyclopedia_candidates(c: DataFrame) -> DataFrame:
    c = U.with_url_parts(c.where(c["wiki_body"].isNotNull()), "source_url", "_w")
    c = stage(c, page_title=U.wiki_title_p(F.col("_w"))).where(F.col("page_title").isNotNull())
    c = E.parse_payload(c.select("id", F.col("source_url").alias("final_url"), "page_title", F.col("wiki_body").alias("body")))
    c = c.where(F.col("error").isNull()).drop("error", "body", "page_title").withColumnRenamed("source_bytes", "_text_bytes")
    c = U.with_url_parts(c, "final_url", "base_parts")
    c = Dm.render(Dm.locate(E.clean_fragments(c))).drop("nodes")
    out = Dm.finish(c, F.col("base_parts.host"))
    return (out.withColumn("rank", F.lit(ENCYCLOPEDIA)).withColumn("provider", F.lit(DIRECT))
            .withColumn("source_bytes", F.col("_text_bytes")))


def extract(captures: DataFrame, ttl_seconds: int) -> DataFrame:
    """One row a capture: the ten fields of an extraction, or ``error``.

    ``captures``: id (unique), source_url, fetched_at, fetch_error (a refusal
    before or during the fetch), final_url, status, location, content_type,
    body, wiki_body, rendered_html and rendered_md (``ANSWER``; both null if
    nothing renders).  A null body is an empty one.  ``rank`` tells the candidate that was taken.
    """
    c = captures.withColumn("body", F.coalesce("body", F.lit("")))
    c = stage(c, fetched_error=fetched_error(c))
    parts = [x.select("id", "rank", "error", *DOCUMENT) for x in (_encyclopedia_candidates(c), _html_candidates(c), _markdown_candidates(c))]
    tried = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ok = F.col("error").isNull()
    document = F.struct("rank", *DOCUMENT)
    early = F.col("rank") <= FETCHED
    found = tried.groupBy("id").agg(
        F.min(F.when(ok & early, F.col("rank"))).alias("first"), F.min(F.when(ok & ~early, F.col("rank"))).alias("second"),
        F.min_by(document, F.when(ok & early, F.col("rank"))).alias("_early"), F.min_by(document, F.when(ok & ~early, F.col("rank"))).alias("_late"),
        F.max(F.when(F.col("rank") == FETCHED, F.col("error"))).alias("fetch_failed"),
        F.max(F.when(F.col("rank") == RENDERED_MARKDOWN, F.col("error"))).alias("render_failed"))
    base = c.select("id", "source_url", "fetched_at", "fetched_error", (c["rendered_html"].isNull() & c["rendered_md"].isNull()).alias("_none"))
    j = base.join(found, "id", "left")
    direct = F.coalesce("fetched_error", "fetch_failed")
    rendered = F.when(F.col("_none"), F.lit(ERROR_NO_RENDERER)).otherwise(F.coalesce("render_failed", F.lit(ERROR_RENDERED)))
    policy = F.coalesce(X.is_policy_error(direct), F.lit(False))
    doc = F.when(F.col("first").isNotNull(), F.col("_early")).when(~policy & F.col("second").isNotNull(), F.col("_late"))
    j = stage(j, _doc=doc, _error=F.when(policy, direct).otherwise(X.merge_errors(direct, rendered)))
    return _row(j, ttl_seconds)


def _row(j: DataFrame, ttl_seconds: int) -> DataFrame:
    ok = F.col("_doc").isNotNull()
    return j.select("id", "source_url", "_doc.rank", *[F.col(f"_doc.{x}").alias(x) for x in DOCUMENT],
                    F.when(ok, F.col("fetched_at")).alias("fetched_at"),
                    F.when(ok, F.timestamp_add("SECOND", F.lit(ttl_seconds), F.col("fetched_at"))).alias("expires_at"),
                    F.when(ok, F.lit(VERSION)).alias("version"), F.when(~ok, F.col("_error")).alias("error"))


def extract_posts(answers: DataFrame, ttl_seconds: int) -> DataFrame:
    """S05 / H17 for posts: ``answers`` has id (unique), source_url, fetched_at, status and payload.

    A payload that is no JSON is told first, then a refused request, then one without a post.
    """
    made = articles.convert_posts(answers, "id").withColumnRenamed("error", "_fault")
    j = answers.select("id", "source_url", "fetched_at", "status", F.octet_length("payload").cast("bigint").alias("source_bytes")).join(made, "id")
    told = lambda text: F.concat(F.lit(text.split("{}")[0]), F.col("status").cast("string"), F.lit(text.split("{}")[1]))
    error = (F.when(F.col("_fault") == articles.ERROR_JSON, told(ERROR_POST_JSON))
             .when(~F.col("status").between(200, 299), told(ERROR_POST_STATUS))
             .when(F.col("_fault").isNotNull(), F.lit(ERROR_NO_POST)))
    j = stage(j, _error=error)
    md = F.col("markdown")
    doc = F.struct(F.lit(FETCHED).alias("rank"), F.lit(POST).alias("provider"), F.col("source_url").alias("final_url"), "title", "author", md.alias("markdown"),
                   X.word_count_post(md).alias("words"), X.byte_length(md).alias("markdown_bytes"), "source_bytes")
    return _row(j.select("id", "source_url", "fetched_at", "_error", F.when(F.col("_error").isNull(), doc).alias("_doc")), ttl_seconds)
