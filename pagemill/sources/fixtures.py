"""Frames derived from the base tables (FIXTURES.md F1–F10).

The reference works on HTTP requests, captured responses, payloads and
counters; the test tables carry pages, events and conversations.  Each frame
here is a projection / join of the base tables, so its volume grows with
them, and the same derivation is written in SQL for the DuckDB oracle
(``pagemill.plans.oracle_fixtures``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.sources.tables import read_events, read_pages, read_table

# Host of the service whose request log is classified (P13) and whose
# beacons are validated.
SITE_HOST = "site.example"
SITE_ORIGIN = f"https://{SITE_HOST}"


def _k(c="event_id"):
    return F.floor(F.col(c) / 20).cast("bigint")


def url_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one submitted URL per event, mixing good, hostile and broken URLs."""
    ev = read_events(spark, sf_dir).select("event_id", "ts", "user_id")
    pages = read_pages(spark, sf_dir, "page_id", "url")
    n_pages = pages.select(F.count("*")).scalar()
    k = F.floor(F.col("event_id") / 20).cast("bigint")
    m = F.col("event_id") % 20
    s = lambda c: c.cast("string")
    # The URL template is fixed on the event side (before the join) so the
    # post-join expression is just "template or the page URL".
    fixed = (
        F.when(m == 1, F.concat(F.lit("HTTPS://WWW.EXAMPLE.COM/Article?q="), s(k), F.lit("#c")))
        .when(m == 2, F.lit(""))
        .when(m == 3, F.lit("http://localhost/x"))
        .when(m == 4, F.concat(F.lit("http://10."), s(k % 256), F.lit(".0.4/test")))
        .when(m == 5, F.concat(F.lit("http://172."), s(k % 40), F.lit(".1.1/")))
        .when(m == 6, F.lit("https://user:pw@example.com/"))
        .when(m == 7, F.concat(F.lit("http://example.com:"), s(8000 + k % 3), F.lit("/")))
        .when(m == 8, F.lit("file:///srv/pages/index"))
        .when(m == 9, F.concat(F.lit("https://x.com/user"), s(k % 50), F.lit("/status/"), s(F.col("event_id"))))
        .when(m == 10, F.lit("https://en.wikipedia.org/wiki/Rust_(programming_language)"))
        .when(m == 11, F.lit("https://en.wikipedia.org/wiki/Special:Random"))
        .when(m == 12, F.concat(F.lit("http://printer"), s(k % 9), F.lit(".local/")))
        .when(m == 13, F.concat(F.lit("http://100."), s(60 + k % 10), F.lit(".0.1/")))
        .when(m == 14, F.lit("http://169.254.169.254/latest/meta-data"))
        .when(m == 15, F.lit("https://example.com:443/\u00e9/\u6771 a?q=\u00f1&b=1"))
        .when(m == 16, F.lit("not a url"))
        .when(m == 17, F.concat(F.lit("https://twitter.com/i/status/"), s(F.col("event_id"))))
    )
    pad = F.when(m == 18, F.lit("  ")).otherwise(F.lit(""))
    e = ev.select("event_id", "ts", "user_id", (F.col("event_id") % n_pages).alias("slot"),
                  fixed.alias("fixed"), pad.alias("pad"))
    j = e.join(pages, e["slot"] == pages["page_id"])
    raw = F.coalesce(F.col("fixed"), F.concat(F.col("pad"), F.col("url"), F.col("pad")))
    method = F.when(F.col("event_id") % 3 == 0, F.lit("GET")).otherwise(F.lit("POST"))
    return j.select("event_id", "ts", F.col("user_id").alias("actor"), "page_id",
                    method.alias("method"), raw.alias("raw_url"))


def _between(ev: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Events of the days from ``start`` up to ``end``."""
    if start is not None:
        ev = ev.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return ev if end is None else ev.where(F.col("ts") < F.lit(end).cast("timestamp"))


def usage_events(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """F2 (full 7-key grain): one usage event per base event."""
    return usage_events_from(_between(read_events(spark, sf_dir), start, end))


def usage_events_from(ev: DataFrame) -> DataFrame:
    """F2 projection over an events frame (batch or streaming)."""
    eid, et = F.col("event_id"), F.col("event_type")
    event_name = (F.when(et == "view", F.lit("browser_page_view"))
                  .when(et == "click", F.lit("conversion_submit"))
                  .when(et == "signup", F.when(eid % 3 == 0, F.lit("copy_markdown"))
                        .when(eid % 3 == 1, F.lit("download_markdown")).otherwise(F.lit("input_engaged")))
                  .otherwise(F.lit("conversion")))
    outcome = (F.when(et == "view", F.lit("loaded")).when(et == "purchase", F.lit("success"))
               .when(et == "error", F.when(eid % 4 == 0, F.lit("missing_url")).when(eid % 4 == 1, F.lit("invalid_url"))
                     .when(eid % 4 == 2, F.lit("rate_limited")).otherwise(F.lit("extraction_failed")))
               .otherwise(F.lit("recorded")))
    cache_status = F.when(et == "purchase", F.when(eid % 3 == 0, F.lit("HIT")).when(eid % 3 == 1, F.lit("MISS"))
                          .otherwise(F.lit("STALE"))).otherwise(F.lit(""))
    pages = F.array(*[F.lit(p) for p in U.BROWSER_PAGES])
    source = (F.when(et == "view", F.when(eid % 2 == 0, F.lit("home")).otherwise(F.lit("x-guide")))
              .when(et.isin("click", "signup"), F.element_at(pages, (eid % 5 + 1).cast("int")))
              .when(et == "purchase", F.when(eid % 3 == 1, F.lit("origin"))
                    .when((eid % 3 == 0) & (eid % 2 == 0), F.lit("edge")).otherwise(F.lit("r2")))
              .otherwise(F.lit("")))
    provider = F.when(et == "purchase", F.when(eid % 3 == 0, F.lit("direct-html"))
                      .when(eid % 3 == 1, F.lit("native-markdown")).otherwise(F.lit("x-fxtwitter"))).otherwise(F.lit(""))
    status = (F.when(outcome == "success", F.lit(200)).when(outcome.isin("missing_url", "invalid_url"), F.lit(400))
              .when(outcome == "rate_limited", F.lit(429)).when(outcome == "extraction_failed", F.lit(502))
              .otherwise(F.lit(204)))
    is_conv = et.isin("purchase", "error")
    words = F.when(et == "purchase", eid % 500).otherwise(F.lit(0)).cast("bigint")
    return ev.select(
        "event_id", "ts", "user_id", event_name.alias("event_name"), outcome.alias("outcome"),
        cache_status.alias("cache_status"), source.alias("source"), provider.alias("provider"),
        status.cast("bigint").alias("status_code"),
        F.when(is_conv, F.col("value")).otherwise(F.lit(0.0)).alias("duration_ms"),
        words.alias("words"), (words * 6).alias("markdown_bytes"),
    )


def http_groups(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """edge HTTP log grouped by (day, path, status) with count and visits."""
    ev = _between(read_events(spark, sf_dir), start, end)
    eid, et = F.col("event_id"), F.col("event_type")
    path = (F.when(eid % 4 == 0, F.lit("/")).when(eid % 4 == 1, F.lit("/api/extract"))
            .when(eid % 4 == 2, F.lit("/api/markdown")).otherwise(F.lit("/md")))
    status = (F.when(et == "error", F.when(eid % 2 == 0, F.lit(502)).otherwise(F.lit(400)))
              .when(et == "signup", F.lit(308)).otherwise(F.lit(200)))
    return (ev.select(F.to_date("ts").alias("day"), path.alias("path"), status.alias("status"),
                      F.when(et == "view", 1).otherwise(0).alias("v"))
            .groupBy("day", "path", "status")
            .agg(F.count("*").alias("n"), F.sum("v").cast("bigint").alias("visits")))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the captured HTTP response for each page."""
    p = read_pages(spark, sf_dir)
    pid = F.col("page_id")
    status = (F.when(pid % 10 == 0, F.lit(404)).when(pid % 10 == 1, F.lit(301))
              .when(pid % 10 == 2, F.lit(500)).otherwise(F.lit(200)))
    location = F.when(pid % 10 == 1, F.concat(F.lit("https://moved.example.org/p/"), pid.cast("string")))
    ctype = (F.when(pid % 7 == 0, F.lit("text/markdown; charset=utf-8"))
             .when(pid % 7 == 1, F.lit("application/pdf")).otherwise(F.lit("text/html; charset=utf-8")))
    return p.select("page_id", "url", status.alias("status"), location.alias("location"),
                    ctype.alias("content_type"), F.col("html").alias("body"))


def redirect_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page → next page redirect edges (every 8th page is terminal)."""
    p = read_pages(spark, sf_dir, "page_id")
    return p.where(F.col("page_id") % 8 != 0).select(F.col("page_id").alias("src"),
                                                      (F.col("page_id") + 1).alias("dst"))


def post_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rich-text blocks of an article, one per conversation turn."""
    c = read_table(spark, sf_dir, "conversations")
    t = F.col("turn")
    btype = (F.when(F.col("role") == "system", F.lit("header-one"))
             .when(F.col("role") == "user", F.when(t % 4 < 2, F.lit("ordered-list-item")).otherwise(F.lit("blockquote")))
             .otherwise(F.when(t % 3 == 0, F.lit("unstyled")).when(t % 3 == 1, F.lit("ordered-list-item"))
                        .otherwise(F.lit("code-block"))))
    return c.select("conv_id", "turn", btype.alias("type"), "text", (t % 3).alias("depth"))


def media_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video variants per media item."""
    ev = read_events(spark, sf_dir)
    eid = F.col("event_id")
    return ev.select(
        F.col("user_id").alias("media_id"), eid.alias("variant_id"),
        F.when(eid % 5 == 0, F.lit("application/x-mpegURL")).otherwise(F.lit("video/mp4")).alias("content_type"),
        F.when(eid % 11 == 0, F.lit(None)).otherwise(F.round(F.col("value") * 1000).cast("bigint")).alias("bit_rate"),
        F.concat(F.lit("https://video.example.org/"), eid.cast("string"), F.lit(".mp4")).alias("url"),
    )


def result_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stored extraction results — one per page, a second (older) row for
    every 9th page, and an unsupported ``version = 2`` for every 25th."""
    from pagemill.operators.admission import admit
    p = admit(read_pages(spark, sf_dir, "page_id", "url"), "url")
    pid = F.col("page_id")
    canon = F.col("canonical_url")
    base = p.select(
        "page_id", U.cache_key(canon).alias("cache_key"), canon.alias("source_url"),
        F.concat(F.lit("Page "), pid.cast("string")).alias("title"),
        F.when(pid % 3 == 0, F.lit("direct-html")).when(pid % 3 == 1, F.lit("native-markdown"))
        .otherwise(F.lit("browser-run")).alias("provider"),
        (pid % 50).cast("bigint").alias("words"),
        F.when(pid % 25 == 0, F.lit(2)).otherwise(F.lit(1)).alias("version"),
    )
    version = lambda days, mark: F.struct(F.lit(days).alias("days"), F.lit(mark).alias("mark"))
    rows = base.withColumn("_v", F.explode(F.when(pid % 9 == 0, F.array(version(0, ""), version(-3, " (old)")))
                                           .otherwise(F.array(version(0, "")))))
    rows = (rows.withColumn("fetched_at", F.timestamp_add("DAY", pid % 20 + F.col("_v.days"), F.lit("2024-01-01 00:00:00").cast("timestamp")))
            .withColumn("title", F.concat("title", F.col("_v.mark"))))
    return rows.select(
        "page_id", "cache_key", "source_url", F.col("source_url").alias("final_url"), "title",
        F.concat(F.lit("# "), F.col("title"), F.lit("\n")).alias("markdown"), "provider", "words",
        (F.col("words") * 6).alias("markdown_bytes"), "fetched_at",
        F.timestamp_add("DAY", F.lit(7), F.col("fetched_at")).alias("expires_at"), "version",
    )


def dns_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 dns: captured A / AAAA answers per page host.

    Hosts are keyed by their lowest page id; the answer shape cycles through
    public only, public + private, CNAME text mixed in, unresolved, and a
    mapped private IPv6 answer with a trailing-dot A record.
    """
    p = read_pages(spark, sf_dir, "page_id", "url")
    hosts = (U.with_url_parts(p, "url").select(F.col("_u.host").alias("host"), "page_id")
             .groupBy("host").agg(F.min("page_id").alias("hid")))
    h = F.col("hid")
    sh = (h % 200).cast("string")
    a = (F.when(h % 5 == 0, F.array(F.concat(F.lit("93.184.216."), sh)))
         .when(h % 5 == 1, F.array(F.lit("93.184.216.34"), F.concat(F.lit("10.0.0."), sh)))
         .when(h % 5 == 2, F.array(F.lit("dyna.wikimedia.org."), F.lit("208.80.154.224")))
         .when(h % 5 == 4, F.array(F.concat(F.lit("203.0.114."), sh, F.lit(".")))))
    aaaa = (F.when(h % 5 == 0, F.array(F.lit("2606:4700:4700::1111")))
            .when(h % 5 == 4, F.array(F.lit("::ffff:10.0.0.1"))))
    return hosts.select("host", a.alias("a"), aaaa.alias("aaaa"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access log of the service itself (P13): host, path and method per event."""
    ev = read_events(spark, sf_dir)
    eid, et = F.col("event_id"), F.col("event_type")
    paths = ["/", "/api/extract", "/api/markdown", "/md", "/md/", "/api/event", "/health",
             "/api/unknown", "/wp-login.php", "/.env", "/.git/config", "/url-to-markdown/",
             "/styles.css", "/ngsw.json", "/WordPress/x", "/x-to-markdown/"]
    path = F.element_at(F.array(*[F.lit(x) for x in paths]), (eid % len(paths) + 1).cast("int"))
    host = F.when(eid % 50 == 7, F.lit(f"www.{SITE_HOST}")).otherwise(F.lit(SITE_HOST))
    method = (F.when(et == "view", F.lit("GET")).when(et == "click", F.lit("POST"))
              .when(et == "signup", F.lit("OPTIONS")).when(et == "purchase", F.lit("GET")).otherwise(F.lit("PUT")))
    return ev.select("event_id", "ts", host.alias("host"), path.alias("path"), method.alias("method"))


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser beacons posted to the event endpoint."""
    return beacons_from(read_events(spark, sf_dir))


def beacons_from(ev: DataFrame) -> DataFrame:
    """Beacons of an events frame (batch or streaming)."""
    eid, et = F.col("event_id"), F.col("event_type")
    names = U.BROWSER_EVENTS + ["page_view"]
    pages = U.BROWSER_PAGES + ["admin"]
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (eid % len(names) + 1).cast("int"))
    page = F.element_at(F.array(*[F.lit(x) for x in pages]), (F.floor(eid / 7) % len(pages) + 1).cast("int"))
    body = (F.when(eid % 23 == 0, F.lit("{not json"))
            .when(eid % 41 == 0, F.concat(F.lit('{"event":"'), name, F.lit('","page":"'), page, F.lit('"} junk')))
            .when(eid % 43 == 0, F.lit(""))
            .when(eid % 29 == 0, F.concat(F.lit('{"event":"'), name, F.lit('","page":"'), page,
                                          F.lit('","pad":"'), F.repeat(F.lit("x"), 120), F.lit('"}')))
            .when(eid % 31 == 0, F.lit('{"event":1,"page":"home"}'))
            .otherwise(F.concat(F.lit('{"event":"'), name, F.lit('","page":"'), page, F.lit('"}'))))
    method = F.when(et == "error", F.lit("GET")).otherwise(F.lit("POST"))
    origin = F.when(eid % 17 == 0, F.lit("https://evil.example")).when(eid % 19 == 0, F.lit(None)).otherwise(F.lit(SITE_ORIGIN))
    fetch_site = (F.when(eid % 13 == 0, F.lit("cross-site")).when(eid % 3 == 0, F.lit(""))
                  .when(eid % 2 == 0, F.lit("same-origin")))
    declared = F.when(eid % 37 == 0, F.lit(4096)).otherwise(F.length(body)).cast("bigint")
    return ev.select("event_id", "ts", method.alias("method"), origin.alias("origin"),
                     fetch_site.alias("sec_fetch_site"), declared.alias("content_length"), body.alias("body"))


def post_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a provider payload (JSON) per conversation: an article, or a plain post for every fifth.

    A turn is a block with style and entity ranges (some overlapping, out of
    range or of unknown kind) and brings four entities; the entity map is an
    array, an object of wrappers or an object of entities.
    """
    c = read_table(spark, sf_dir, "conversations")
    conv, t = F.col("conv_id"), F.col("turn")
    name = F.concat(conv.cast("string"), F.lit("-"), t.cast("string"))
    fixed = lambda x: F.lit(x)
    btype = (F.when(t % 3 == 2, "atomic").when(F.col("role") == "system", "header-one")
             .when(F.col("role") == "user", F.when(t % 4 < 2, "ordered-list-item").otherwise("blockquote"))
             .otherwise(F.when(t % 3 == 0, "unstyled").otherwise("code-block")))
    text = F.when((conv + t) % 4 == 0, F.concat(F.lit("\U0001F600 "), F.col("text"))).otherwise(F.col("text"))
    styles = fixed('[{"offset":0,"length":4,"style":"Bold"},{"offset":0,"length":8,"style":"Italic"},{"offset":2,"length":3,"style":"Code"},'
                   '{"offset":4,"length":5,"style":"Strikethrough"},{"offset":3,"length":100000,"style":"Underline"},'
                   '{"offset":3,"length":2,"style":"Blink"},{"offset":5,"length":0,"style":"Bold"}]')
    key = lambda k: (t * 10 + k).cast("string")
    ranges = F.concat(F.lit('[{"key":'), key(0), F.lit(',"offset":5,"length":8},{"key":'), key(1), F.lit(',"offset":0,"length":1},{"key":'), key(2),
                      F.lit(',"offset":0,"length":1},'), F.when((conv + t) % 6 == 5, F.concat(F.lit('{"key":'), key(3), F.lit(',"offset":0,"length":1},'))).otherwise(""),
                      F.lit('{"key":99999,"offset":0,"length":1},{"key":"7","offset":0,"length":1}]'))
    block = F.concat(F.lit('{"type":"'), btype, F.lit('","text":'), F.to_json(F.struct(text.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("x")))) - 6),
                     F.lit(',"data":{"depth":'), (t % 3).cast("string"), F.lit('},"inlineStyleRanges":'), styles, F.lit(',"entityRanges":'), ranges, F.lit("}"))
    url = F.when(t % 4 == 3, "").otherwise(F.concat(F.lit("https://link.example/"), name))
    link = lambda u: F.concat(F.lit('{"type":"LINK","data":{"url":"'), u, F.lit('"}}'))
    media = F.concat(F.lit('{"type":"MEDIA","data":{"caption":" Cap [c] ","url":"https://own.example/'), name, F.lit('","mediaItems":[{"mediaId":"m'), name,
                     F.lit('"},{"media_id":"cover'), conv.cast("string"), F.lit('"}]}}'))
    emoji = F.concat(F.lit('{"type":"TWEMOJI","data":{"url":"https://emoji.example/'),
                     F.when(t % 2 == 0, "72x72/1f468-200d-1f469.svg?x=1").otherwise("72x72/smile.svg"), F.lit('"}}'))
    table = F.lit('{"type":"MARKDOWN","data":{"markdown":" | a |\\r\\n| b | "}}')
    values = [(0, link(url)), (1, media), (2, emoji), (3, table)]
    listed = F.concat_ws(",", F.concat(F.lit('{"key":"'), key(0), F.lit('","value":'), link(F.lit("https://old.example/")), F.lit("}")),
                         *[F.concat(F.lit('{"key":'), key(k), F.lit(',"value":'), v, F.lit("}")) for k, v in values])
    wrapped = F.concat_ws(",", *[F.concat(F.lit('"w'), key(k), F.lit('":{"key":"'), key(k), F.lit('","value":'), v, F.lit("}")) for k, v in values])
    bare = F.concat_ws(",", *[F.concat(F.lit('"'), key(k), F.lit('":'), v) for k, v in values])
    variants = F.concat(F.lit('[{"bit_rate":1,"content_type":"video/mp4","url":"https://v.example/low"},{"bit_rate":5,"content_type":"video/mp4","url":"https://v.example/'),
                        name, F.lit('"},{"bit_rate":9,"content_type":"application/x-mpegURL","url":"https://v.example/list"}]'))
    medium = F.when(t % 2 == 0, F.concat(
        F.lit('{"media_id":"m'), name, F.lit('","media_info":{'),
        F.when(t % 4 == 2, F.concat(F.lit('"variants":'), variants)).otherwise(F.concat(F.lit('"original_img_url":"https://img.example/'), name, F.lit('.jpg"'))), F.lit("}}")))
    rows = c.select("conv_id", "turn", block.alias("block"), medium.alias("medium"),
                    F.when(conv % 3 == 0, listed).when(conv % 3 == 1, wrapped).otherwise(bare).alias("entities"), F.col("text").alias("first"))
    docs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "block", "medium", "entities", "first"))).alias("p"))
    joined = lambda f: F.array_join(F.transform("p", lambda x: x[f]), ",")
    cid = conv.cast("string")
    entity_map = (F.when(conv % 3 == 0, F.concat(F.lit("["), joined("entities"), F.lit(',{"key":"x","value":{"type":"LINK"}}]')))
                  .otherwise(F.concat(F.lit("{"), joined("entities"), F.lit(',"x":{"type":"LINK"}}'))))
    cover = F.when(conv % 3 != 1, F.concat(F.lit(',"cover_media":{"media_id":"cover'), cid, F.lit('","media_info":{"preview_image":{"original_img_url":"https://cover.example/'),
                                           cid, F.lit('.jpg"}}}'))).otherwise("")
    title = F.when(conv % 7 == 0, " ").otherwise(F.concat(F.lit(" Title "), cid))
    article = F.concat(F.lit('"article":{"title":"'), title, F.lit('","preview_text":" Preview "'), cover, F.lit(',"media_entities":['), joined("medium"),
                       F.lit('],"content":{"entityMap":'), entity_map, F.lit(',"blocks":['), joined("block"), F.lit("]}}"))
    plain = F.concat(F.lit('"text":'), F.to_json(F.struct(F.col("p")[0]["first"].alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("p")[0]["first"].alias("x")))) - 6),
                     F.lit(',"media":[{"type":"photo","url":"https://img.example/'), cid, F.lit('.jpg","altText":"Alt"}]'))
    author = F.concat(F.lit('"author":{'), F.when(conv % 4 == 0, "").otherwise(F.concat(F.lit('"name":"Person '), cid, F.lit('",'))),
                      F.lit('"screen_name":"user'), cid, F.lit('"},'))
    payload = (F.when(conv % 11 == 10, F.lit("<html>busy</html>"))
               .otherwise(F.concat(F.lit('{"code":200,"tweet":{'), author, F.when(conv % 5 == 4, plain).otherwise(article), F.lit("}}"))))
    return docs.select("conv_id", payload.alias("payload"))


def fallback_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all captures of a page: fetched (F3), refused, rendered as HTML and as Markdown, encyclopedia payload."""
    from pagemill.operators.admission import admit
    p = admit(captures(spark, sf_dir), "url").drop("canon_parts", "verdict", "route", "cache_key")
    pid = F.col("page_id")
    sid = pid.cast("string")
    wiki = pid % 9 == 4
    source = F.when(wiki, F.concat(F.lit("https://en.wikipedia.org/wiki/Page_"), sid)).otherwise(F.col("canonical_url"))
    article = F.regexp_extract("body", r"(?s)<article[^>]*>(.*?)</article>", 1)
    payload = F.when(pid % 2 == 0, F.to_json(F.struct(F.struct(F.concat(F.lit("Page "), sid).alias("title"), article.alias("text")).alias("parse")))) \
        .otherwise(F.lit('{"error":{"info":"The page is missing."}}'))
    answer = lambda status, ok, result: F.struct(F.lit(status).alias("status"), F.lit(ok).alias("success"), result.alias("result"))
    none = F.lit(None).cast("string")
    html = (F.when(pid % 4 == 3, F.lit(None)).when(pid % 3 == 0, answer(200, True, F.concat(F.lit(" "), F.col("body"), F.lit("\n"))))
            .when(pid % 3 == 1, answer(200, False, F.col("body"))).otherwise(answer(503, True, none)))
    text = (F.when(pid % 5 < 2, F.concat(F.lit("  # Rendered "), sid, F.lit("\n\nSome *text* [here](https://a.example/)  "))).when(pid % 5 == 2, F.lit("Plain rendered text"))
            .when(pid % 5 == 3, F.lit("Main menu\nand Toggle the table of contents")).otherwise(F.lit("  \n")))
    md = F.when(pid % 4 == 3, F.lit(None)).otherwise(answer(200, True, text))
    refused = F.when(pid % 13 == 5, F.lit("Private and reserved network URLs are not supported."))
    return p.select(
        pid.alias("id"), source.alias("source_url"), F.timestamp_add("DAY", pid % 20, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("fetched_at"),
        refused.alias("fetch_error"), F.col("canonical_url").alias("final_url"), "status", "location", "content_type", "body",
        F.when(wiki, payload).alias("wiki_body"), html.alias("rendered_html"), md.alias("rendered_md"))


def extraction_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what extraction gave for each cache key (one row a key): the captures answered 200 with a known type succeed."""
    from pagemill.operators.admission import admit
    p = admit(captures(spark, sf_dir).drop("body"), "url")
    ok = (F.col("status") == 200) & ~F.col("content_type").contains("pdf")
    row = F.struct("page_id", ok.alias("ok"), F.when(F.col("content_type").contains("markdown"), "native-markdown").otherwise("direct-html").alias("provider"),
                   (F.col("page_id") % 70).cast("bigint").alias("words"))
    p = p.groupBy("cache_key").agg(F.max(row).alias("r"))
    return p.select("cache_key", "r.ok", "r.provider", "r.words", (F.col("r.words") * 6).alias("markdown_bytes"))


SITE_KEY = "0f0f-site-key"          # ownership key of the submissions


def site_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what a crawl of each host's site brought: root, robots, sitemaps, image, guides, the www redirect.

    Sitemaps list the host's pages, 1,000 ids a file; every tenth page is not listed.
    """
    from pagemill.operators.admission import admit
    p = admit(read_pages(spark, sf_dir, "page_id", "url"), "url")
    p = p.where(F.col("verdict") == "ok").select("page_id", F.col("canonical_url").alias("url"), F.col("canon_parts.host").alias("host"))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    entry = F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url>"))
    file = F.floor(F.col("page_id") / 1000)
    maps = p.groupBy("host", file.alias("file")).agg(F.concat_ws("", F.collect_list(F.when(F.col("page_id") % 10 != 7, entry))).alias("x"), F.min("page_id").alias("least"))
    origin = F.concat(F.lit("https://"), F.col("host"))
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')
    # the file with the site's own paths is sitemap.xml
    own = lambda path: F.concat(F.lit("<url><loc>"), origin, F.lit(path), F.lit("</loc></url>"))
    maps = maps.select("host", F.concat(F.lit("/sitemap-"), F.col("file").cast("string"), F.lit(".xml")).alias("path"), F.lit(200).alias("status"),
                       F.lit("application/xml").alias("content_type"), F.lit(None).cast("string").alias("location"), F.concat(head, F.col("x"), F.lit("</urlset>")).alias("body"))
    h = p.groupBy("host").agg(F.min("page_id").alias("hid"))
    hid = F.col("hid")
    guide = lambda path, title: F.concat(F.lit('<html><head><link rel="canonical" href="'), origin, F.lit(path), F.lit('"></head><h1>'), F.lit(title), F.lit("</h1></html>"))
    doc = lambda path, status, kind, body, location=F.lit(None).cast("string"): F.struct(
        F.lit(path).alias("path"), status.alias("status"), F.lit(kind).alias("content_type"), location.alias("location"), body.alias("body"))
    root = F.concat(F.lit('<html><head><link rel="canonical" href="'), origin, F.lit('/" />'), F.when(hid % 3 == 0, '<meta name="description" content="d">').otherwise(""),
                    F.when(hid % 4 == 0, '<script type="application/ld+json">{}</script>').otherwise(""), F.lit("</head></html>"))
    site_map = F.concat(head, own("/"), own("/url-to-markdown/"), own("/webpage-to-markdown/"), F.when(hid % 2 == 0, own("/x-to-markdown/")).otherwise(""), F.lit("</urlset>"))
    ok = F.lit(200)
    docs = F.array(
        doc("/", F.when(hid % 5 == 4, 500).otherwise(200), "text/html", root),
        doc("/robots.txt", ok, "text/plain", F.concat(F.lit("User-agent: *\n"), F.when(hid % 3 != 1, F.concat(F.lit("Sitemap: "), origin, F.lit("/sitemap.xml"))).otherwise(""))),
        doc("/sitemap.xml", ok, "application/xml", site_map), doc("/og.png", F.when(hid % 7 == 0, 404).otherwise(200), "image/png", F.lit("")),
        doc("/url-to-markdown/", ok, "text/html", guide("/url-to-markdown/", "URL to Markdown")),
        doc("/webpage-to-markdown/", F.when(hid % 6 == 0, 404).otherwise(200), "text/html", guide("/webpage-to-markdown/", "Webpage to Markdown")),
        doc("/x-to-markdown/", ok, "text/html", guide("/x-to-markdown/", "Another title")),
        doc("www", F.when(hid % 2 == 0, 308).otherwise(301), "text/html", F.lit(""), F.concat(origin, F.lit("/"))))
    return h.select("host", F.inline(docs)).unionByName(maps)


def located_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """captures of the pages of which most redirect: to the next page, relatively, to a private host, nowhere, to themselves."""
    p = read_pages(spark, sf_dir, "page_id", "url")
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("after"))
    p = p.join(after, "page_id", "left")
    m = F.col("page_id") % 16
    status = F.when(F.col("page_id") % 8 == 0, F.when(m == 0, 200).otherwise(404)).otherwise(F.when(m % 2 == 0, 301).otherwise(302))
    location = (F.when(m == 3, F.lit("./a/../next?x=1")).when(m == 5, F.lit("http://10.0.0.1/")).when(m == 6, F.lit(None)).when(m == 9, F.col("url"))
                .when(m == 12, F.lit("/rooted#f")).otherwise(F.col("after")))
    return p.select("page_id", "url", status.alias("status"), location.alias("location"))
