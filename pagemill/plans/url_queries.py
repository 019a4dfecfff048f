"""URL-layer queries: admission, canonical form, keys, routes, DNS, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.operators import admission as A
from pagemill.operators.staging import stage
from pagemill.plans import duck as D
from pagemill.plans import oracle_fixtures as OF
from pagemill.plans.registry import register
from pagemill.sources import fixtures as FX

# ---------------------------------------------------------------- DuckDB bits
_REQ = f"with r as ({OF.URL_REQUESTS}), p as ({D.parts_cte('r', 'raw_url')})"
_ADMITTED = f"{_REQ}, a as (select *, {D.canonical_url('raw_url')} as canonical_url from p where {D.rejection_reason('raw_url')} is null)"


def _admitted(spark, d):
    return A.admit(FX.url_requests(spark, d)).where(F.col("verdict") == "ok")


# ------------------------------------------------------------------- queries
@register("q_url_reject", "P01 P02 P03 P04 P05 P06 P07 P10",
          f"{_REQ} select event_id, coalesce({D.rejection_reason('raw_url')}, 'ok') as verdict from p")
def q_url_reject(spark, d):
    return A.admit(FX.url_requests(spark, d)).select("event_id", "verdict")


@register("q_url_normalize", "U01",
          f"{_REQ} select event_id, {D.canonical_url('raw_url')} as canonical_url from p")
def q_url_normalize(spark, d):
    return A.admit(FX.url_requests(spark, d)).select("event_id", "canonical_url")


@register("q_cache_key", "U02 F09",
          f"{_ADMITTED} select event_id, {D.cache_key('canonical_url')} as cache_key from a")
def q_cache_key(spark, d):
    return _admitted(spark, d).select("event_id", "cache_key")


@register("q_route", "U03 U06",
          f"{_ADMITTED} select event_id, {D.is_post_url()} as is_post, {D.route()} as route from a")
def q_route(spark, d):
    a = _admitted(spark, d)
    return a.select("event_id", U.is_post_p(F.col("canon_parts")).alias("is_post"), "route")


def _post_ref_sql():
    host = "regexp_replace(u_host, '^www\\.', '')"
    rx = "(?i)^/([^/]+)/(?:status|article)/([0-9]+)"
    user = f"regexp_extract({D.url_path()}, {D.q(rx)}, 1)"
    pid = f"regexp_extract({D.url_path()}, {D.q(rx)}, 2)"
    err = f"""(case when not u_valid then 'Enter a complete X or Twitter URL.'
      when {host} not in ('x.com', 'twitter.com') then 'Only x.com and twitter.com URLs are supported.'
      when {pid} = '' or lower({user}) = 'i' then 'Use the post URL (x.com/user/status/…) or author article URL (x.com/user/article/…).' end)"""
    return (f"{_ADMITTED} select event_id, case when {err} is null then {pid} end as post_id, "
            f"case when {err} is null then {user} end as username, {err} as error "
            f"from a where {host} in ('x.com', 'twitter.com')")


@register("q_post_ref", "U04", _post_ref_sql)
def q_post_ref(spark, d):
    a = _admitted(spark, d)
    host = F.regexp_replace(F.col("canon_parts.host"), r"^www\.", "")
    a = a.where(host.isin("x.com", "twitter.com")).withColumn("ref", U.post_ref_p(F.col("canon_parts")))
    return a.select("event_id", F.col("ref.id").alias("post_id"), F.col("ref.username").alias("username"),
                    F.col("ref.error").alias("error"))


@register("q_wiki_title", "U05 F07",
          f"{_ADMITTED} select event_id, {D.wiki_title()} as wiki_title from a")
def q_wiki_title(spark, d):
    return _admitted(spark, d).select("event_id", U.wiki_title_p(F.col("canon_parts")).alias("wiki_title"))


def _addresses(spark, d):
    dns = FX.dns_answers(spark, d)
    ans = dns.select(F.explode(F.concat(F.coalesce("a", F.array().cast("array<string>")),
                                        F.coalesce("aaaa", F.array().cast("array<string>")))).alias("address"))
    hosts = U.with_url_parts(FX.url_requests(spark, d), "raw_url").select(
        F.regexp_replace(F.col("_u.host"), r"^\[|\]$", "").alias("address"))
    return ans.unionByName(hosts.where(U.is_ipv4(F.col("address")) | U.is_ipv6(F.col("address"))))


_ADDR_SQL = f"""
with d as ({OF.dns_answers()}), r as ({OF.URL_REQUESTS}), p as ({D.parts_cte('r', 'raw_url')}),
addr as (
  select unnest(list_concat(coalesce(a, []::varchar[]), coalesce(aaaa, []::varchar[]))) as address from d
  union all
  select address from (select regexp_replace(u_host, '^\\[|\\]$', '', 'g') as address from p)
  where {D.is_ipv4('address')} or {D.is_ipv6('address')}
)"""


@register("q_address_class", "P09 F17",
          f"{_ADDR_SQL} select address, (case when {D.is_ipv4('address')} then 4 when {D.is_ipv6('address')} then 6 else 0 end) as kind, "
          f"{D.private_address('address')} as is_private from addr")
def q_address_class(spark, d):
    a = _addresses(spark, d)
    return a.select("address", U.address_kind(F.col("address")).alias("kind"),
                    U.private_address(F.col("address")).alias("is_private"))


@register("q_private_ipv4", "P07",
          f"{_ADDR_SQL} select address, {D.private_ipv4('address')} as is_private from addr where {D.is_ipv4('address')}")
def q_private_ipv4(spark, d):
    a = _addresses(spark, d).where(U.is_ipv4(F.col("address")))
    return a.select("address", U.private_ipv4(F.col("address")).alias("is_private"))


@register("q_private_ipv6", "P08",
          f"{_ADDR_SQL} select address, {D.private_ipv6('address')} as is_private from addr where {D.is_ipv6('address')}")
def q_private_ipv6(spark, d):
    a = _addresses(spark, d).where(U.is_ipv6(F.col("address")))
    return a.select("address", U.private_ipv6(F.col("address")).alias("is_private"))


def _dns_sql():
    ips = ("list_filter(list_transform(list_concat(coalesce(dn.a, []::varchar[]), coalesce(dn.aaaa, []::varchar[])), "
           f"lambda x: regexp_replace(x, '\\.$', '')), lambda x: {D.is_ipv4('x')} or {D.is_ipv6('x')})")
    inner = "regexp_replace(a.u_host, '^\\[|\\]$', '', 'g')"
    return f"""{_ADMITTED}, dn as ({OF.dns_answers()})
select event_id, cast(len({ips}) as integer) as n_addresses,
  case when {D.is_ipv4(inner)} or {D.is_ipv6(inner)} then 'ip_literal'
       when len({ips}) = 0 then 'unresolved'
       when list_bool_or(list_transform({ips}, lambda x: {D.private_address('x')})) then 'private'
       else 'public' end as dns_verdict
from a left join dn on dn.host = a.u_host"""


@register("q_dns_verdict", "J06 E03 A11", _dns_sql)
def q_dns_verdict(spark, d):
    a = _admitted(spark, d)
    v = A.dns_verdict(a, FX.dns_answers(spark, d))
    return v.select("event_id", "n_addresses", "dns_verdict")


@register("q_scanner_paths", "P11",
          f"select event_id, path, {D.is_scanner_path('path')} as is_scanner from ({OF.REQUEST_LOG})")
def q_scanner_paths(spark, d):
    log = FX.request_log(spark, d)
    return log.select("event_id", "path", U.is_scanner_path(F.col("path")).alias("is_scanner"))


def _log_routes_sql():
    from pagemill.sources.fixtures import SITE_HOST
    return f"""
select route, status, count(*) as n from (
  select case when host = 'www.{SITE_HOST}' then 'redirect'
    when {D.is_scanner_path('path')} then 'scanner'
    when method = 'OPTIONS' and starts_with(path, '/api/') then 'preflight'
    when path = '/api/event' then 'event' when path = '/health' then 'health'
    when path in ('/md', '/md/') then 'md' when path = '/api/extract' then 'extract'
    when path = '/api/markdown' then 'markdown' when starts_with(path, '/api/') then 'api_unknown'
    else 'asset' end as route,
  case when host = 'www.{SITE_HOST}' then 308
    when {D.is_scanner_path('path')} then 404
    when method = 'OPTIONS' and starts_with(path, '/api/') then 204
    when path = '/api/event' then case when method = 'POST' then 204 else 404 end
    when path = '/health' then 200
    when path in ('/md', '/md/') then case when method = 'GET' then 200 else 405 end
    when path in ('/api/extract', '/api/markdown') then case when method in ('GET', 'POST') then 200 else 405 end
    when starts_with(path, '/api/') then 404 else 200 end as status
  from ({OF.REQUEST_LOG})
) group by route, status"""


@register("q_log_routes", "P13 P11", _log_routes_sql)
def q_log_routes(spark, d):
    c = A.classify_log(FX.request_log(spark, d))
    return c.groupBy("route", "status").agg(F.count("*").alias("n"))


def _beacon_sql():
    ev = "try(json_extract_string(body, '$.event'))"
    pg = "try(json_extract_string(body, '$.page'))"
    evs = ", ".join(D.q(x) for x in U.BROWSER_EVENTS)
    pgs = ", ".join(D.q(x) for x in U.BROWSER_PAGES)
    return f"""
select event_id, case
  when method <> 'POST' or origin is distinct from '{FX.SITE_ORIGIN}' or coalesce(sec_fetch_site, '') not in ('', 'same-origin') then 404
  when content_length > 128 then 413
  when length(body) > 128 then 413
  when json_valid(body) and try(json_type(body, '$.event')) = 'VARCHAR' and {ev} in ({evs})
       and try(json_type(body, '$.page')) = 'VARCHAR' and {pg} in ({pgs}) then 204
  else 400 end as status
from ({OF.beacons()})"""


@register("q_beacon_status", "P12 F19", _beacon_sql)
def q_beacon_status(spark, d):
    return A.beacon_status(FX.beacons(spark, d)).select("event_id", "status")


def _beacon_allow_sql():
    evs = ", ".join(D.q(x) for x in U.BROWSER_EVENTS)
    pgs = ", ".join(D.q(x) for x in U.BROWSER_PAGES)
    return f"""
select event, page, count(*) as n from (
  select try(json_extract_string(body, '$.event')) as event, try(json_extract_string(body, '$.page')) as page
  from ({OF.beacons()})
) where event in ({evs}) and page in ({pgs}) group by event, page"""


@register("q_beacon_allow", "J07", _beacon_allow_sql)
def q_beacon_allow(spark, d):
    body = F.col("body")
    b = FX.beacons(spark, d).select(A.json_string(body, "event").alias("event"), A.json_string(body, "page").alias("page"))
    events, pages = A.allow_lists(spark)
    # The allow-lists are fixed 8 / 5 row tables: broadcasting them is bounded.
    ok = b.join(F.broadcast(events), "event", "left_semi").join(F.broadcast(pages), "page", "left_semi")
    return ok.groupBy("event", "page").agg(F.count("*").alias("n"))


@register("q_links", "K08 F07",
          f"{_ADMITTED} select event_id, "
          f"'{FX.SITE_ORIGIN}/?url=' || {D.encode_uri_component('canonical_url')} as interactive_link, "
          f"'{FX.SITE_ORIGIN}/md?url=' || {D.encode_uri_component('canonical_url')} as share_link, "
          f"'/api/markdown?url=' || {D.encode_uri_component('canonical_url')} as alternate_link from a")
def q_links(spark, d):
    return A.links(_admitted(spark, d)).select("event_id", "interactive_link", "share_link", "alternate_link")


def _fetch_list_sql():
    host = "regexp_replace(u_host, '^www\\.', '')"
    rx = "(?i)^/([^/]+)/(?:status|article)/([0-9]+)"
    user = f"regexp_extract({D.url_path()}, {D.q(rx)}, 1)"
    pid = f"regexp_extract({D.url_path()}, {D.q(rx)}, 2)"
    ok = f"({host} in ('x.com','twitter.com') and {pid} <> '' and lower({user}) <> 'i')"
    wiki = (f"u_scheme || '://' || u_host || '/w/api.php?action=parse&page=' || {D.form_encode(D.wiki_title())} || "
            "'&prop=text%7Cdisplaytitle&format=json&formatversion=2&redirects=1&disableeditsection=1&disablestylededuplication=1'")
    post = f"'https://api.fxtwitter.com/' || {D.encode_uri_component(user)} || '/status/' || {pid}"
    return (f"{_ADMITTED} select event_id, case when {D.is_post_url()} then case when {ok} then {post} end "
            f"when {D.wiki_title()} is not null then {wiki} end as api_url from a "
            f"where {D.route()} <> 'direct'")


@register("q_fetch_list", "U08", _fetch_list_sql)
def q_fetch_list(spark, d):
    a = A.fetch_list(_admitted(spark, d))
    return a.where(F.col("route") != "direct").select("event_id", "api_url")


def _loc_variant(pid):
    s = pid.cast("string")
    m = pid % 8
    return (F.when(m == 6, F.concat(F.lit("../p/"), s)).when(m == 7, F.concat(F.lit("./a/../p/"), s)).when(m == 0, F.concat(F.lit("https://moved.example.org/p/"), s))
            .when(m == 1, F.concat(F.lit("/p/"), s))
            .when(m == 2, F.concat(F.lit("//cdn.example.org/p/"), s))
            .when(m == 3, F.concat(F.lit("p/"), s, F.lit("?x=1")))
            .when(m == 4, F.concat(F.lit("?page="), s))
            .otherwise(F.concat(F.lit("#frag"), s)))


def _redirect_resolve_sql():
    loc = """(case page_id % 8 when 6 then '../p/' || cast(page_id as varchar) when 7 then './a/../p/' || cast(page_id as varchar) when 0 then 'https://moved.example.org/p/' || cast(page_id as varchar)
      when 1 then '/p/' || cast(page_id as varchar) when 2 then '//cdn.example.org/p/' || cast(page_id as varchar)
      when 3 then 'p/' || cast(page_id as varchar) || '?x=1' when 4 then '?page=' || cast(page_id as varchar)
      else '#frag' || cast(page_id as varchar) end)"""
    origin = "u_scheme || '://' || regexp_extract(u_input, '(?s)^[A-Za-z][A-Za-z0-9+.\\-]*:[/\\\\]*([^/\\\\?#]*)', 1)"
    bpath = D.url_path()
    bdir = f"regexp_replace({bpath}, '[^/]*$', '')"
    return f"""
with c as (select page_id, canon, {loc} as location from (
  select page_id, {D.canonical_url('url')} as canon from ({D.parts_cte('pages', 'url', 'page_id, url')}))),
p as ({D.parts_cte('c', 'canon')})
select page_id, location, case
  when regexp_matches(location, '^[A-Za-z][A-Za-z0-9+.\\-]*:') then location
  when starts_with(location, '//') then u_scheme || ':' || location
  when starts_with(location, '/') then {origin} || location
  when starts_with(location, '?') then {origin} || {bpath} || location
  when starts_with(location, '#') then {origin} || {bpath} || coalesce(u_query, '') || location
  when starts_with(location, '../') then {origin} || regexp_replace({bdir}, '[^/]+/$', '') || substr(location, 4)
  when starts_with(location, './') then {origin} || {bdir} || replace(substr(location, 3), 'a/../', '')
  else {origin} || {bdir} || location end as resolved
from p"""


@register("q_redirect_resolve", "U11", _redirect_resolve_sql)
def q_redirect_resolve(spark, d):
    from pagemill.sources.tables import read_pages
    p = read_pages(spark, d, "page_id", "url")
    c = stage(A.admit(p, "url").select("page_id", "canon_parts"), location=_loc_variant(F.col("page_id")))
    return c.select("page_id", "location", U.resolve_location_p(F.col("canon_parts"), F.col("location")).alias("resolved"))


def _redirects_sql():
    e = OF.REDIRECT_EDGES
    joins = "\n".join(
        f"left join ({e}) e{i} on e{i}.src = n{i}" if i == 0 else f"left join ({e}) e{i} on e{i}.src = e{i - 1}.dst"
        for i in range(A.MAX_REDIRECTS + 1))
    nodes = ["n0"] + [f"e{i}.dst" for i in range(A.MAX_REDIRECTS + 1)]
    hops = " + ".join(f"(case when {n} is not null then 1 else 0 end)" for n in nodes[1:])
    last = nodes[-1]
    final = "case " + " ".join(f"when ({hops}) = {i} then {nodes[i]}" for i in range(len(nodes) - 1)) + " end"
    return f"""
select start, case when {last} is not null then {last} else {final} end as final,
  cast(case when {last} is not null then {A.MAX_REDIRECTS + 1} else {hops} end as bigint) as hops,
  case when {last} is not null then 'TOO_MANY' else 'OK' end as status
from (select page_id as start, page_id as n0 from pages) s
{joins}"""


@register("q_redirects", "J04", _redirects_sql)
def q_redirects(spark, d):
    from pagemill.sources.tables import read_pages
    starts = read_pages(spark, d, "page_id").select(F.col("page_id").alias("start"))
    return A.resolve_redirects(starts, FX.redirect_edges(spark, d))


def _request_url_frame(spark, d):
    r = FX.url_requests(spark, d)
    m = F.col("event_id") % 3
    raw = F.col("raw_url")
    return r.select(
        "event_id",
        F.when(m == 0, F.lit("GET")).otherwise(F.lit("POST")).alias("method"),
        F.when(m == 0, F.concat(F.lit(FX.SITE_ORIGIN + "/api/extract?url="), F.url_encode(raw)))
        .otherwise(F.lit(FX.SITE_ORIGIN + "/api/extract")).alias("request_url"),
        F.when(m == 1, F.lit("application/json")).when(m == 2, F.lit("application/x-www-form-urlencoded"))
        .alias("content_type"),
        F.when(m == 1, F.to_json(F.struct(raw.alias("url")))).when(m == 2, F.concat(F.lit("url="), F.url_encode(raw)))
        .alias("body"),
    )


@register("q_request_url", "S01",
          f"select event_id, coalesce(raw_url, '') as submitted from ({OF.URL_REQUESTS})")
def q_request_url(spark, d):
    q = _request_url_frame(spark, d)
    return q.select("event_id", A.request_url(F.col("method"), F.col("request_url"), F.col("content_type"),
                                              F.col("body")).alias("submitted"))


def _chains_sql():
    key = "page_id, url, status, location"
    return f"""with recursive cap as (
  select p.page_id, p.url, case when p.page_id % 16 = 0 then 200 when p.page_id % 8 = 0 then 404 when p.page_id % 2 = 0 then 301 else 302 end as status,
    case p.page_id % 16 when 3 then './a/../next?x=1' when 5 then 'http://10.0.0.1/' when 6 then null when 9 then p.url when 12 then '/rooted#f' else n.url end as location
  from pages p left join pages n on n.page_id = p.page_id + 1
), c as (
  select {D.canonical_url('url')} as src, u_host, u_scheme, u_path, max({{'s': status, 'l': location}}) as v from ({D.parts_cte('cap', 'url', key)}) where {D.rejection_reason('url')} is null group by all
), one as (
  select src, v.s as status, v.l as location, case when v.s < 300 or v.s >= 400 or v.l is null then null when v.l like './%' then u_scheme || '://' || u_host || regexp_replace(case when u_path = '' then '/' else u_path end, '[^/]*$', '') || 'next?x=1'
    when v.l like '/%' then u_scheme || '://' || u_host || v.l else v.l end as target from c
  qualify row_number() over (partition by src order by v.s desc, v.l desc nulls last) = 1
), e as (
  select src, case when status < 300 or status >= 400 then 'OK' when location is null then 'NO_LOCATION' when {D.rejection_reason('target')} is not null
    then 'REFUSED:' || {D.rejection_reason('target')} else 'MOVED' end as step, {D.canonical_url('target')} as nxt
  from ({D.parts_cte('one', 'target', 'src, status, location, target')})
), f as (
  select page_id as start, url, {D.canonical_url('url')} as canon, {D.rejection_reason('url')} as reason from ({D.parts_cte('pages', 'url', 'page_id, url')})
), g(start, final, hops, n, status) as (
  select start, coalesce(canon, url), cast(0 as bigint), 0, 'REFUSED:' || reason from f
  union all
  select start, case when step = 'MOVED' and n < 5 then nxt else final end, hops + case when step = 'MOVED' and n < 5 then 1 else 0 end, n + 1,
    case when src is null then 'NOT_CAPTURED' when step <> 'MOVED' then step when n = 5 then 'TOO_MANY' end
  from g left join e on e.src = g.final where status is null
)
select start, final, hops, status from g where status is not null"""


@register("q_redirect_chains", "J04 U11 P10", _chains_sql)
def q_redirect_chains(spark, d):
    c = FX.located_captures(spark, d)
    return A.follow_locations(c.select(F.col("page_id").alias("start"), "url"), c)
