"""Fallback-chain queries: rendered captures and the whole extraction row."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import documents as Dm
from pagemill.operators import extraction as Ex
from pagemill.plans import duck as D
from pagemill.plans import oracle_fixtures as OF
from pagemill.plans.capture_queries import d_fetch_outcome
from pagemill.plans.doc_queries import _PAGE_FACTS, WS, d_md_text, d_word_count
from pagemill.plans.registry import register
from pagemill.sources import fixtures as FX

TS_FMT_SPARK, TS_FMT_DUCK = "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"
TTL = 604_800


def _d_chrome(md: str) -> str:
    hits = " + ".join(f"(case when regexp_matches({md}, {D.q('(?i)' + p)}) then 1 else 0 end)" for p in X.CHROME_SIGNALS)
    return f"({hits}) >= 2"


def _d_markdown(name: str, md: str, host: str, src: str) -> str:
    """CTE of a Markdown candidate: id, error, title, words, size of ``src``."""
    first = D.js_trim(f"regexp_extract(md, {D.q('(?m)^#[' + WS + ']+(.+)$')}, 1)")
    has = f"regexp_matches(md, {D.q('(?m)^#[' + WS + ']+[^' + WS + ']')})"
    wh = f"(case when {has} then md else '# ' || title || chr(10) || chr(10) || md end)"
    return f"""{name} as (
  select id, case when md = '' then {D.q(Dm.ERROR_EMPTY_MARKDOWN)} when {_d_chrome('md')} then {D.q(Dm.ERROR_MARKDOWN_CHROME)} end as error, title,
    {d_word_count(wh)} as words, cast(octet_length(encode(raw)) as bigint) as source_bytes
  from (select *, coalesce(nullif({first}, ''), {host}) as title from (select id, {D.js_trim(md)} as md, {md} as raw, final_host from {src}))
)"""


def _chain_sql() -> str:
    pol = D.q("(?i)(" + "|".join(X.POLICY_ERRORS) + ")")
    canon = D.canonical_url("url")
    return f"""
with {_PAGE_FACTS.strip()},
pp as (select *, {canon} as canonical, u_host as final_host from ({D.parts_cte('pr', 'url')})),
c as (
  select pp.*, pp.page_id as id, k.status, k.location, k.content_type, pp.page_id % 9 = 4 as wiki,
    case when pp.page_id % 13 = 5 then 'Private and reserved network URLs are not supported.' end as fetch_error,
    {d_fetch_outcome()} as outcome,
    coalesce(nullif(h1_text, ''), nullif(title_text, '')) as htitle, {d_word_count(d_md_text("case when use_art then art else body_clean end"))} as hwords,
    case when pp.page_id % 5 < 2 then '  # Rendered ' || pp.page_id || chr(10) || chr(10) || 'Some *text* [here](https://a.example/)  '
      when pp.page_id % 5 = 2 then 'Plain rendered text' when pp.page_id % 5 = 3 then 'Main menu' || chr(10) || 'and Toggle the table of contents' else ' ' end as rmd
  from pp join ({OF.CAPTURES}) k on k.page_id = pp.page_id
), s as (
  select *, case when wiki then 'https://en.wikipedia.org/wiki/Page_' || id else canonical end as source_url,
    case when regexp_matches(content_type, {D.q(Ex.MARKDOWN_TYPE)}) then 'md' when regexp_matches(content_type, {D.q(Ex.HTML_TYPE)}) then 'html' else '' end as kind,
    coalesce(fetch_error, case when outcome = 'redirect' then {D.q(Ex.ERROR_REDIRECTS)} when outcome <> 'ok' then outcome end) as refused
  from c
), {_d_markdown('nat', 'html', 'final_host', 's')}, sr as (
  select * replace (case when wiki then 'en.wikipedia.org' else final_host end as final_host) from s
), {_d_markdown('ren', 'rmd', 'final_host', 'sr')},
t as (
  select s.*, coalesce(refused, case when kind = '' then 'Unsupported content type: ' || content_type || '.' when kind = 'md' then nat.error end) as direct,
    id % 4 <> 3 as has_render, nat.title as ntitle, nat.words as nwords, ren.title as rtitle, ren.words as rwords, case when id % 5 = 4 then {D.q(Ex.ERROR_RENDERED)}
      when ren.error = {D.q(Dm.ERROR_MARKDOWN_CHROME)} then {D.q(Ex.ERROR_RENDERED_CHROME)} else ren.error end as rerror
  from s join nat using (id) join ren using (id)
), r as (
  select *, case when wiki and id % 2 = 0 then 0 when direct is null then 1 when regexp_matches(direct, {pol}) then null
    when has_render and id % 3 = 0 then 2 when has_render and rerror is null then 3 end as rank from t
)
select id, rank, source_url, case when rank in (0, 2, 3) then source_url when rank = 1 then canonical end as final_url,
  case rank when 0 then 'direct-html' when 1 then case kind when 'md' then 'native-markdown' else 'direct-html' end when 2 then 'browser-run' when 3 then 'browser-run' end as provider,
  case rank when 0 then 'Page ' || id when 1 then case kind when 'md' then ntitle else coalesce(htitle, final_host) end
    when 2 then coalesce(htitle, case when wiki then 'en.wikipedia.org' else final_host end) when 3 then rtitle end as title,
  cast(null as varchar) as author,
  case rank when 0 then {d_word_count("('Page ' || id || ' ' || " + d_md_text('art') + ")")} when 1 then case kind when 'md' then nwords else hwords end when 2 then hwords when 3 then rwords end as words,
  case rank when 0 then cast(octet_length(encode(art)) as bigint) when 1 then cast(octet_length(encode(html)) as bigint)
    when 2 then cast(octet_length(encode({D.js_trim('html')})) as bigint) end as source_bytes,
  case when rank is not null then strftime(timestamp '2024-01-01' + to_days(cast(id % 20 as integer)), '{TS_FMT_DUCK}') end as fetched_at,
  case when rank is not null then strftime(timestamp '2024-01-01' + to_days(cast(id % 20 as integer)) + to_seconds({TTL}), '{TS_FMT_DUCK}') end as expires_at,
  case when rank is not null then {Ex.VERSION} end as version,
  case when rank is null then case when regexp_matches(direct, {pol}) or not has_render or direct = rerror then direct
    else direct || ' Browser fallback: ' || rerror end end as error
from r"""


@register("q_rendered_ok", "S06",
          f"""select page_id as id, page_id % 4 <> 3 and page_id % 3 = 0 as html_ok, page_id % 4 <> 3 and page_id % 5 <> 4 as markdown_ok,
  case when page_id % 4 <> 3 and page_id % 3 = 0 then cast(length({D.js_trim('html')}) as integer) end as html_chars from pages""")
def q_rendered_ok(spark, d):
    c = FX.fallback_captures(spark, d)
    html, md = Ex.rendered_result(F.col("rendered_html")), Ex.rendered_result(F.col("rendered_md"))
    return c.select("id", html.isNotNull().alias("html_ok"), md.isNotNull().alias("markdown_ok"), F.length(html).alias("html_chars"))


@register("q_fallback_chain", "H15 H16 H17 H18 S04 S06 P14 P15 P19 P20", _chain_sql)
def q_fallback_chain(spark, d):
    x = Ex.extract(FX.fallback_captures(spark, d), TTL)
    ts = lambda c: F.date_format(c, TS_FMT_SPARK).alias(c)
    return x.select("id", "rank", "source_url", "final_url", "provider", "title", "author", "words", "source_bytes", ts("fetched_at"), ts("expires_at"),
                    "version", "error")
