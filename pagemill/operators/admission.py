"""Request-side operators: submitted URL, admission verdicts, DNS, redirects,
access-log routing and beacon validation (S01, P10–P13, J04, J06, J07, K08, U08).

All of these are projections or equi-joins; none collects anything to the
driver.  The only joins are against tables keyed by host / page id, which
Catalyst (with AQE) plans as broadcast when a side is small at run time and
as a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.operators.staging import stage
from pagemill.sources.fixtures import SITE_HOST, SITE_ORIGIN

MAX_REDIRECTS = 5          # fixed value: redirects followed per request
MAX_BEACON_BYTES = 128     # fixed value: beacon payload limit


def _decoded(c):
    """Form-decoded; a value with a malformed escape stays as it is."""
    return F.coalesce(F.try_url_decode(c), c)


def json_string(body, field: str):
    """The top-level string ``field`` of a JSON object; null if the text is
    not one JSON value, or the field is absent or not a string."""
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))        # no text may follow the value
    value = F.try_variant_get(whole, f"$[0].{field}", "variant")
    one = F.try_variant_get(whole, "$[1]", "variant").isNull()
    return F.when(one & (F.schema_of_variant(value) == "STRING"), F.try_variant_get(whole, f"$[0].{field}", "string"))


def request_url(method, request_url, content_type, body):
    """The URL a request submitted — GET query param ``url``, POST JSON
    string field ``url``, other POST form field ``url``; anything else ''."""
    q = F.regexp_extract(request_url, r"[?&]url=([^&#]*)", 1)
    get_val = F.when(request_url.rlike(r"[?&]url="), _decoded(q)).otherwise(F.lit(""))
    json_val = F.coalesce(json_string(body, "url"), F.lit(""))
    form_raw = F.regexp_extract(body, r"(?:^|&)url=([^&]*)", 1)
    form_val = F.when(body.rlike(r"(?:^|&)url="), _decoded(form_raw)).otherwise(F.lit(""))
    return (F.when(method == "GET", get_val)
            .when(method == "POST", F.when(content_type.contains("application/json"), json_val)
                  .otherwise(form_val))
            .otherwise(F.lit("")))


def admit(requests: DataFrame, raw_col: str = "raw_url") -> DataFrame:
    """P10 + U01 + U02 + U06: verdict, canonical URL, cache key and route.

    Adds ``verdict``, ``canonical_url``, ``cache_key``, ``route`` and the
    staged anatomy of the canonical URL as ``canon_parts``.
    """
    cols = requests.columns
    df = U.with_url_parts(requests, raw_col, "_u")
    u, bits = F.col("_u"), U.canonical_bits(F.col("_u"))
    reason = U.reason_p(u, F.col(raw_col))
    df = stage(df, _reason=reason, **{f"_{k}": F.when(reason.isNull(), c) for k, c in bits.items()})
    ok = F.col("_reason").isNull()
    url = F.concat(u["scheme"], F.lit("://"), u["host"], "_port", "_path", "_query")
    df = stage(df, canonical_url=F.when(ok, url))
    # the canonical form's parts are known: nothing is parsed again
    canon = F.struct(
        F.col("canonical_url").alias("input"), u["scheme"].alias("scheme"), F.lit("").alias("userinfo"), u["host"].alias("host"),
        F.substring("_port", 2, 5).alias("port"), F.col("_path").alias("path"), F.nullif(F.col("_query"), F.lit("")).alias("query"),
        ok.alias("valid"), u["blocked"].alias("blocked"))
    df = df.withColumn("canon_parts", F.when(ok, canon))
    c = F.col("canon_parts")
    return df.select(
        *cols,
        F.coalesce(F.col("_reason"), F.lit("ok")).alias("verdict"),
        "canonical_url",
        F.when(ok, U.cache_key(F.col("canonical_url"))).alias("cache_key"),
        F.when(ok, U.route_p(c)).alias("route"),
        "canon_parts",
    )


def dns_verdict(urls: DataFrame, dns: DataFrame, url_col: str = "canonical_url") -> DataFrame:
    """A ∪ AAAA answers, IP literals only (trailing dot stripped); none →
    unresolved; any private → private; IP-literal hosts skip the lookup."""
    if "canon_parts" not in urls.columns:
        urls = U.with_url_parts(urls, url_col, "canon_parts")
    host = F.col("canon_parts.host")
    inner = F.regexp_replace(host, r"^\[|\]$", "")
    u = urls.withColumn("host", host).withColumn("ip_literal", U.is_ipv4(inner) | U.is_ipv6(inner))
    j = u.join(dns, "host", "left")
    answers = F.concat(F.coalesce("a", F.array().cast("array<string>")),
                       F.coalesce("aaaa", F.array().cast("array<string>")))
    ips = F.filter(F.transform(answers, lambda x: F.regexp_replace(x, r"\.$", "")),
                   lambda x: U.is_ipv4(x) | U.is_ipv6(x))
    verdict = (F.when(F.col("ip_literal"), F.lit("ip_literal"))
               .when(F.size(ips) == 0, F.lit("unresolved"))
               .when(F.exists(ips, U.private_address), F.lit("private"))
               .otherwise(F.lit("public")))
    return j.withColumn("n_addresses", F.size(ips)).withColumn("dns_verdict", verdict).drop("a", "aaaa")


def resolve_redirects(starts: DataFrame, edges: DataFrame, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """Follow redirect edges from every start node.

    A redirect is a function (one location per response), so the chain is a
    linear sequence of ``max_hops + 1`` left equi-joins ``n(i+1) = edge(n(i))``
    — bounded by the fixed redirect limit, no recursion and no union of
    re-computed branches.  At scale each hop is one shuffle join keyed on the
    current node.  The request at hop ``max_hops`` that still redirects is the
    one that fails with "too many redirects"; ``final`` is the last node reached.
    """
    cur = starts.select(F.col("start"), F.col("start").alias("n0"))
    for i in range(max_hops + 1):
        # ended chains get keys of their own that no edge has, so they spread over all partitions
        e = edges.select(F.col("src").cast("string").alias(f"_s{i}"), F.col("dst").alias(f"n{i + 1}"))
        key = F.coalesce(F.col(f"n{i}").cast("string"), F.concat(F.lit("~"), F.col("start").cast("string")))
        cur = cur.withColumn("_key", key)
        cur = cur.join(e, cur["_key"] == e[f"_s{i}"], "left").drop(f"_s{i}", "_key")
    last = max_hops + 1
    hops = sum((F.col(f"n{i}").isNotNull().cast("int") for i in range(1, last + 1)), F.lit(0))
    too_many = F.col(f"n{last}").isNotNull()
    final = F.element_at(F.array(*[F.col(f"n{i}") for i in range(last + 1)]), (hops + 1))
    return cur.select(
        "start", final.alias("final"), hops.cast("bigint").alias("hops"),
        F.when(too_many, F.lit("TOO_MANY")).otherwise(F.lit("OK")).alias("status"),
    )


def classify_log(log: DataFrame) -> DataFrame:
    """Route and status for every access-log row."""
    path, method, host = F.col("path"), F.col("method"), F.col("host")
    is_api = path.startswith("/api/")
    rw = [
        (host == f"www.{SITE_HOST}", "redirect", F.lit(308)),
        (U.is_scanner_path(path), "scanner", F.lit(404)),
        ((method == "OPTIONS") & is_api, "preflight", F.lit(204)),
        (path == "/api/event", "event", F.when(method == "POST", F.lit(204)).otherwise(F.lit(404))),
        (path == "/health", "health", F.lit(200)),
        (path.isin("/md", "/md/"), "md", F.when(method == "GET", F.lit(200)).otherwise(F.lit(405))),
        (path == "/api/extract", "extract", F.when(method.isin("GET", "POST"), F.lit(200)).otherwise(F.lit(405))),
        (path == "/api/markdown", "markdown", F.when(method.isin("GET", "POST"), F.lit(200)).otherwise(F.lit(405))),
        (is_api, "api_unknown", F.lit(404)),
    ]
    route = F.lit("asset")
    status = F.lit(200)
    for cond, r, s in reversed(rw):
        route = F.when(cond, F.lit(r)).otherwise(route)
        status = F.when(cond, s).otherwise(status)
    return log.withColumn("route", route).withColumn("status", status)


def beacon_status(b: DataFrame) -> DataFrame:
    """404 (wrong method/origin/fetch site) → 413 (declared, then actual
    size > 128) → 400 (not JSON / event or page not allowed) → 204."""
    ev, pg = json_string(F.col("body"), "event"), json_string(F.col("body"), "page")
    length16 = (F.octet_length(F.encode(F.col("body"), "UTF-16LE")) / 2).cast("bigint")
    site = F.coalesce(F.col("sec_fetch_site"), F.lit(""))
    status = (F.when((F.col("method") != "POST") | ~F.col("origin").eqNullSafe(SITE_ORIGIN)
                     | ~site.isin("", "same-origin"), F.lit(404))
              .when(F.col("content_length") > MAX_BEACON_BYTES, F.lit(413))
              .when(length16 > MAX_BEACON_BYTES, F.lit(413))
              .when(F.coalesce(ev.isin(*U.BROWSER_EVENTS) & pg.isin(*U.BROWSER_PAGES), F.lit(False)), F.lit(204))
              .otherwise(F.lit(400)))
    return b.withColumn("event", ev).withColumn("page", pg).withColumn("status", status)


def allow_lists(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The fixed allow-lists as (tiny, constant-size) tables."""
    events = spark.createDataFrame([(e,) for e in U.BROWSER_EVENTS], "event string")
    pages = spark.createDataFrame([(p,) for p in U.BROWSER_PAGES], "page string")
    return events, pages


def links(urls: DataFrame, url_col: str = "canonical_url", origin: str = SITE_ORIGIN) -> DataFrame:
    """Interactive, share and alternate links for a canonical URL."""
    enc = U.encode_uri_component(F.col(url_col))
    return urls.select(
        "*",
        F.concat(F.lit(origin + "/?url="), enc).alias("interactive_link"),
        F.concat(F.lit(origin + "/md?url="), enc).alias("share_link"),
        F.concat(F.lit("/api/markdown?url="), enc).alias("alternate_link"),
    )


def fetch_list(urls: DataFrame, url_col: str = "canonical_url") -> DataFrame:
    """The upstream API URL each routed request would call."""
    if "canon_parts" not in urls.columns:
        urls = U.with_url_parts(urls, url_col, "canon_parts")
    p = F.col("canon_parts")
    # Stage the struct-valued helpers so their regexes run once per row.
    staged = (urls.withColumn("_ref", U.post_ref_p(p)).withColumn("_title", U.wiki_title_p(p))
              .withColumn("_is_post", U.is_post_p(p)))
    ref, title = F.col("_ref"), F.col("_title")
    origin = F.concat(p["scheme"], F.lit("://"), p["host"])
    wiki = F.concat(origin, F.lit("/w/api.php?action=parse&page="), F.url_encode(title),
                    F.lit("&prop=text%7Cdisplaytitle&format=json&formatversion=2&redirects=1"
                          "&disableeditsection=1&disablestylededuplication=1"))
    post = F.concat(F.lit("https://api.fxtwitter.com/"), U.encode_uri_component(ref["username"]),
                    F.lit("/status/"), ref["id"])
    api = F.when(F.col("_is_post"), F.when(ref["error"].isNull(), post)).when(title.isNotNull(), wiki)
    return staged.withColumn("api_url", api).drop("_ref", "_title", "_is_post")


# Outcomes of a followed chain; a refused hop is ``REFUSED:`` and the verdict.
CHAIN_OK, CHAIN_TOO_MANY, CHAIN_NO_LOCATION, CHAIN_UNKNOWN, CHAIN_REFUSED = "OK", "TOO_MANY", "NO_LOCATION", "NOT_CAPTURED", "REFUSED"


def redirect_targets(captures: DataFrame) -> DataFrame:
    """One row a captured URL: ``src`` (canonical), ``step`` and, for a redirect, ``next``.

    ``captures`` has url, status and location.  A location is resolved against
    its URL (U11) and admitted again (P10): ``step`` is OK for an answer that
    is no redirect, MOVED for one that may be followed, NO_LOCATION, or the
    refusal.  Of the captures of one URL the one with the greatest
    (status, location) counts.
    """
    c = admit(captures.select("url", "status", "location"), "url").where(F.col("verdict") == "ok")
    moved = (F.col("status") >= 300) & (F.col("status") < 400)
    c = c.groupBy(F.col("canonical_url").alias("src")).agg(F.max(F.struct("status", "location")).alias("_a"), F.any_value("canon_parts").alias("_p"))
    c = c.select("src", "_a.*", "_p")
    c = stage(c, target=F.when(moved & F.col("location").isNotNull(), U.resolve_location_p(F.col("_p"), F.col("location")))).drop("_p")
    c = admit(c, "target")
    step = (F.when(~moved, F.lit(CHAIN_OK)).when(F.col("location").isNull(), F.lit(CHAIN_NO_LOCATION))
            .when(F.col("verdict") != "ok", F.concat(F.lit(CHAIN_REFUSED + ":"), F.col("verdict"))).otherwise(F.lit("MOVED")))
    return c.select("src", F.coalesce(step, F.lit(CHAIN_UNKNOWN)).alias("step"), F.when(step == "MOVED", F.col("canonical_url")).alias("next"))


def follow_locations(starts: DataFrame, captures: DataFrame, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """J04 by location: ``start``, ``final``, ``hops`` and ``status`` of the chain from each start URL.

    ``starts`` has start (an id, unique) and url.  Every capture's target is
    resolved and judged once; the chain is then ``max_hops + 1`` equi-joins on
    URLs over that table, whose exchange is reused.  Ended chains have join
    keys of their own, so they spread.  A loop ends, like any long chain, at
    the hop beyond ``max_hops``.
    """
    targets = redirect_targets(captures)
    first = admit(starts.select("start", "url"), "url")
    refused = F.when(F.col("verdict") != "ok", F.concat(F.lit(CHAIN_REFUSED + ":"), F.col("verdict")))
    cur = first.select("start", F.coalesce("canonical_url", "url").alias("final"), F.lit(0).cast("bigint").alias("hops"), refused.alias("status"))
    alone = F.concat(F.lit("~"), F.col("start").cast("string"))
    for hop in range(max_hops + 1):
        cur = cur.withColumn("_k", F.when(F.col("status").isNull(), F.col("final")).otherwise(alone)).join(targets, F.col("_k") == F.col("src"), "left")
        moved = F.col("step") == "MOVED"
        ended = F.when(F.col("src").isNull(), F.lit(CHAIN_UNKNOWN)).when(~moved, F.col("step"))
        if hop == max_hops:
            ended = F.coalesce(ended, F.lit(CHAIN_TOO_MANY))
        open_ = F.col("status").isNull()
        on = open_ & moved & F.lit(hop < max_hops)
        # one row a chain: its state after this hop
        cur = stage(cur.select("start", "final", "hops", "status", "src", "step", "next"), _s=F.struct(
            F.when(on, F.col("next")).otherwise(F.col("final")).alias("final"), (F.col("hops") + F.coalesce(on, F.lit(False)).cast("bigint")).alias("hops"),
            F.coalesce("status", ended).alias("status"))).select("start", "_s.*")
    return cur
