"""DuckDB SQL for the derived frames (mirrors ``pagemill.sources.fixtures``)."""

from __future__ import annotations

from pagemill.functions import urls as U
from pagemill.plans import duck as D
from pagemill.sources.fixtures import SITE_HOST, SITE_ORIGIN


def _arr(xs):
    return "[" + ", ".join(D.q(x) for x in xs) + "]"


URL_REQUESTS = """
select e.event_id, e.ts, e.user_id as actor, p.page_id,
  case e.event_id % 3 when 0 then 'GET' else 'POST' end as method,
  case e.event_id % 20
    when 1 then concat('HTTPS://WWW.EXAMPLE.COM/Article?q=', cast(e.k as varchar), '#c')
    when 2 then ''
    when 3 then 'http://localhost/x'
    when 4 then concat('http://10.', cast(e.k % 256 as varchar), '.0.4/test')
    when 5 then concat('http://172.', cast(e.k % 40 as varchar), '.1.1/')
    when 6 then 'https://user:pw@example.com/'
    when 7 then concat('http://example.com:', cast(8000 + e.k % 3 as varchar), '/')
    when 8 then 'file:///srv/pages/index'
    when 9 then concat('https://x.com/user', cast(e.k % 50 as varchar), '/status/', cast(e.event_id as varchar))
    when 10 then 'https://en.wikipedia.org/wiki/Rust_(programming_language)'
    when 11 then 'https://en.wikipedia.org/wiki/Special:Random'
    when 12 then concat('http://printer', cast(e.k % 9 as varchar), '.local/')
    when 13 then concat('http://100.', cast(60 + e.k % 10 as varchar), '.0.1/')
    when 14 then 'http://169.254.169.254/latest/meta-data'
    when 15 then 'https://example.com:443/é/東 a?q=ñ&b=1'
    when 16 then 'not a url'
    when 17 then concat('https://twitter.com/i/status/', cast(e.event_id as varchar))
    when 18 then concat('  ', p.url, '  ')
    else p.url end as raw_url
from (select *, cast(floor(event_id / 20) as bigint) as k from events) e
cross join (select count(*) as n_pages from pages) c
join pages p on p.page_id = e.event_id % c.n_pages
"""

USAGE_EVENTS = f"""
select event_id, ts, user_id, event_name, outcome, cache_status, source, provider,
  cast(case when outcome = 'success' then 200 when outcome in ('missing_url','invalid_url') then 400
       when outcome = 'rate_limited' then 429 when outcome = 'extraction_failed' then 502 else 204 end as bigint) as status_code,
  duration_ms, words, words * 6 as markdown_bytes
from (
  select event_id, ts, user_id,
    case event_type when 'view' then 'browser_page_view' when 'click' then 'conversion_submit'
      when 'signup' then case when event_id % 3 = 0 then 'copy_markdown' when event_id % 3 = 1 then 'download_markdown' else 'input_engaged' end
      else 'conversion' end as event_name,
    case event_type when 'view' then 'loaded' when 'purchase' then 'success'
      when 'error' then case when event_id % 4 = 0 then 'missing_url' when event_id % 4 = 1 then 'invalid_url'
                             when event_id % 4 = 2 then 'rate_limited' else 'extraction_failed' end
      else 'recorded' end as outcome,
    case when event_type = 'purchase' then case when event_id % 3 = 0 then 'HIT' when event_id % 3 = 1 then 'MISS' else 'STALE' end else '' end as cache_status,
    case when event_type = 'view' then case when event_id % 2 = 0 then 'home' else 'x-guide' end
         when event_type in ('click', 'signup') then {_arr(U.BROWSER_PAGES)}[event_id % 5 + 1]
         when event_type = 'purchase' then case when event_id % 3 = 1 then 'origin'
              when event_id % 3 = 0 and event_id % 2 = 0 then 'edge' else 'r2' end
         else '' end as source,
    case when event_type = 'purchase' then case when event_id % 3 = 0 then 'direct-html'
         when event_id % 3 = 1 then 'native-markdown' else 'x-fxtwitter' end else '' end as provider,
    case when event_type in ('purchase', 'error') then value else 0.0 end as duration_ms,
    cast(case when event_type = 'purchase' then event_id % 500 else 0 end as bigint) as words
  from events
)
"""

HTTP_GROUPS = """
select cast(ts as date) as day,
  case event_id % 4 when 0 then '/' when 1 then '/api/extract' when 2 then '/api/markdown' else '/md' end as path,
  case event_type when 'error' then case when event_id % 2 = 0 then 502 else 400 end when 'signup' then 308 else 200 end as status,
  count(*) as n, cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as visits
from events group by 1, 2, 3
"""

CAPTURES = """
select page_id, url,
  case when page_id % 10 = 0 then 404 when page_id % 10 = 1 then 301 when page_id % 10 = 2 then 500 else 200 end as status,
  case when page_id % 10 = 1 then concat('https://moved.example.org/p/', cast(page_id as varchar)) end as location,
  case page_id % 7 when 0 then 'text/markdown; charset=utf-8' when 1 then 'application/pdf' else 'text/html; charset=utf-8' end as content_type,
  html as body
from pages
"""

REDIRECT_EDGES = "select page_id as src, page_id + 1 as dst from pages where page_id % 8 <> 0"

POST_BLOCKS = """
select conv_id, turn,
  case role when 'system' then 'header-one'
    when 'user' then case when turn % 4 < 2 then 'ordered-list-item' else 'blockquote' end
    else case turn % 3 when 0 then 'unstyled' when 1 then 'ordered-list-item' else 'code-block' end end as type,
  text, turn % 3 as depth
from conversations
"""

MEDIA_VARIANTS = """
select user_id as media_id, event_id as variant_id,
  case when event_id % 5 = 0 then 'application/x-mpegURL' else 'video/mp4' end as content_type,
  case when event_id % 11 = 0 then null else cast(round(value * 1000) as bigint) end as bit_rate,
  concat('https://video.example.org/', cast(event_id as varchar), '.mp4') as url
from events
"""


def result_store() -> str:
    canon = D.canonical_url("url")
    return f"""
with p as ({D.parts_cte('pages', 'url', 'page_id, url')}),
base as (
  select page_id, {D.cache_key(canon)} as cache_key, {canon} as source_url,
    'Page ' || cast(page_id as varchar) as title,
    case when page_id % 3 = 0 then 'direct-html' when page_id % 3 = 1 then 'native-markdown' else 'browser-run' end as provider,
    cast(page_id % 50 as bigint) as words,
    case when page_id % 25 = 0 then 2 else 1 end as version
  from p
),
rows as (
  select *, timestamp '2024-01-01 00:00:00' + to_days(cast(page_id % 20 as integer)) as fetched_at from base
  union all
  select page_id, cache_key, source_url, title || ' (old)' as title, provider, words, version,
    timestamp '2024-01-01 00:00:00' + to_days(cast(page_id % 20 - 3 as integer)) as fetched_at
  from base where page_id % 9 = 0
)
select page_id, cache_key, source_url, source_url as final_url, title, '# ' || title || chr(10) as markdown,
  provider, words, words * 6 as markdown_bytes, fetched_at, fetched_at + to_days(7) as expires_at, version
from rows
"""


def dns_answers() -> str:
    return f"""
with h as (
  select u_host as host, min(page_id) as hid from ({D.parts_cte('pages', 'url', 'page_id')}) group by u_host
)
select host,
  case when hid % 5 = 0 then ['93.184.216.' || cast(hid % 200 as varchar)]
       when hid % 5 = 1 then ['93.184.216.34', '10.0.0.' || cast(hid % 200 as varchar)]
       when hid % 5 = 2 then ['dyna.wikimedia.org.', '208.80.154.224']
       when hid % 5 = 4 then ['203.0.114.' || cast(hid % 200 as varchar) || '.'] end as a,
  case when hid % 5 = 0 then ['2606:4700:4700::1111'] when hid % 5 = 4 then ['::ffff:10.0.0.1'] end as aaaa
from h
"""


_LOG_PATHS = ["/", "/api/extract", "/api/markdown", "/md", "/md/", "/api/event", "/health",
              "/api/unknown", "/wp-login.php", "/.env", "/.git/config", "/url-to-markdown/",
              "/styles.css", "/ngsw.json", "/WordPress/x", "/x-to-markdown/"]

REQUEST_LOG = f"""
select event_id, ts,
  case when event_id % 50 = 7 then 'www.{SITE_HOST}' else '{SITE_HOST}' end as host,
  {_arr(_LOG_PATHS)}[event_id % {len(_LOG_PATHS)} + 1] as path,
  case event_type when 'view' then 'GET' when 'click' then 'POST' when 'signup' then 'OPTIONS'
    when 'purchase' then 'GET' else 'PUT' end as method
from events
"""


def beacons() -> str:
    names = U.BROWSER_EVENTS + ["page_view"]
    pages = U.BROWSER_PAGES + ["admin"]
    name = f"{_arr(names)}[event_id % {len(names)} + 1]"
    page = f"{_arr(pages)}[cast(floor(event_id / 7) as bigint) % {len(pages)} + 1]"
    body = f"""(case when event_id % 23 = 0 then '{{not json'
      when event_id % 41 = 0 then '{{"event":"' || {name} || '","page":"' || {page} || '"}} junk'
      when event_id % 43 = 0 then ''
      when event_id % 29 = 0 then '{{"event":"' || {name} || '","page":"' || {page} || '","pad":"' || repeat('x', 120) || '"}}'
      when event_id % 31 = 0 then '{{"event":1,"page":"home"}}'
      else '{{"event":"' || {name} || '","page":"' || {page} || '"}}' end)"""
    return f"""
select event_id, ts, method, origin, sec_fetch_site,
  cast(case when event_id % 37 = 0 then 4096 else length(body) end as bigint) as content_length, body
from (
  select event_id, ts,
    case when event_type = 'error' then 'GET' else 'POST' end as method,
    case when event_id % 17 = 0 then 'https://evil.example' when event_id % 19 = 0 then null else '{SITE_ORIGIN}' end as origin,
    case when event_id % 13 = 0 then 'cross-site' when event_id % 3 = 0 then '' when event_id % 2 = 0 then 'same-origin' end as sec_fetch_site,
    {body} as body
  from events
)
"""
