"""Outcome queries: what each request got from store, admission and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import admission as A
from pagemill.operators import freshness as R
from pagemill.operators import outcomes as O
from pagemill.operators import usage as G
from pagemill.plans import duck as D
from pagemill.plans import oracle_fixtures as OF
from pagemill.plans.capture_queries import REASON_MESSAGES
from pagemill.plans.freshness_queries import _STORE
from pagemill.plans.registry import register
from pagemill.sources import fixtures as FX

_DECIDED = f"""with r as ({OF.URL_REQUESTS}), p as ({D.parts_cte('r', 'raw_url')}),
a as (
  select event_id, ts, actor, event_id % 1000 as duration_ms, coalesce({D.rejection_reason('raw_url')}, 'ok') as verdict,
    case when {D.rejection_reason('raw_url')} is null then {D.cache_key(D.canonical_url('raw_url'))} end as cache_key from p
), s as ({_STORE}),
met as (
  select event_id, s.fetched_at, expires_at, provider, words, markdown_bytes, version = 1 and markdown is not null as readable
  from a join s on s.cache_key = a.cache_key and s.fetched_at <= a.ts
  qualify row_number() over (partition by event_id order by s.fetched_at desc, page_id desc) = 1
), res as (
  select {D.cache_key(D.canonical_url('url'))} as cache_key, max({{'id': page_id, 'ok': status = 200 and content_type not like '%pdf%',
    'provider': case when content_type like '%markdown%' then 'native-markdown' else 'direct-html' end, 'words': page_id % 70}}) as v
  from ({D.parts_cte(f'({OF.CAPTURES})', 'url')}) group by 1
), b as (
  select a.*, m.fetched_at, m.expires_at, m.provider as sprovider, m.words as swords, m.markdown_bytes as sbytes, m.event_id is not null as kept,
    coalesce(m.expires_at > a.ts, false) as fresh
  from a left join (select * from met where readable) m using (event_id)
), lim as (
  select event_id, row_number() over (partition by actor % 3, cast(ts as date) order by ts, event_id) <= {R.ADMISSION_LIMIT} as admitted from b where verdict = 'ok' and not fresh
), x as (
  select b.*, coalesce(admitted, false) as adm, coalesce(admitted and v.ok, false) as made, v
  from b left join lim using (event_id) left join res using (cache_key)
), d as (
  select *, case when verdict <> 'ok' then null when fresh then 'HIT' when made then 'MISS' when kept then 'STALE' end as cache_status,
    case when verdict = 'missing_url' then 'missing_url' when verdict <> 'ok' then 'invalid_url' when fresh or made or kept then 'success'
      when not adm then 'rate_limited' else 'extraction_failed' end as outcome from x
), o as (
  select event_id, ts, duration_ms, outcome, cast(case outcome when 'success' then 200 when 'rate_limited' then 429 when 'extraction_failed' then 502 else 400 end as bigint) as status_code,
    cache_status, case cache_status when 'MISS' then 'origin' when 'STALE' then 'r2'
      when 'HIT' then case when ts < fetched_at + interval {R.EDGE_TTL_SECONDS} second then 'edge' else 'r2' end end as source,
    case when cache_status = 'MISS' then v.provider when cache_status is not null then sprovider end as provider,
    cast(case when cache_status = 'MISS' then v.words when cache_status is not null then swords end as bigint) as words
  from d
)"""

_ROLLED = f"""{_DECIDED}, u as (
  select strftime(ts, '%Y-%m-%d') as day, 'conversion' as event_name, outcome, coalesce(cache_status, '') as cache_status, coalesce(source, '') as source,
    coalesce(provider, '') as provider, status_code, count(*) as event_count, cast(sum(duration_ms) as bigint) as duration_ms,
    cast(sum(coalesce(words, 0)) as bigint) as words, cast(sum(coalesce(words, 0) * 6) as bigint) as markdown_bytes
  from o group by all
)"""


def _decided(spark, d):
    r = A.admit(FX.url_requests(spark, d)).select("event_id", "ts", "actor", "verdict", "cache_key", (F.col("event_id") % 1000).alias("duration_ms"))
    return O.decide(r, FX.result_store(spark, d), FX.extraction_results(spark, d), F.col("actor") % 3, window="1 day")


@register("q_serve_stale", "O02 O01 W03", f"{_DECIDED} select event_id, cache_status, source from o where cache_status = 'STALE'")
def q_serve_stale(spark, d):
    return _decided(spark, d).where("stale").select("event_id", "cache_status", "source")


@register("q_outcomes", "O01 O03 J02 W03", f"{_DECIDED} select event_id, outcome, status_code, cache_status, source, provider, words from o")
def q_outcomes(spark, d):
    return _decided(spark, d).select("event_id", "outcome", "status_code", "cache_status", "source", "provider", "words")


@register("q_usage_from_requests", "O04 A01", f"{_ROLLED} select * from u")
def q_usage_from_requests(spark, d):
    return G.rollup_usage(O.usage_events(_decided(spark, d)))


@register("q_cache_efficiency", "O05", f"""{_ROLLED}, e as (
  select provider, source, cast(coalesce(sum(event_count) filter (cache_status = 'HIT'), 0) as bigint) as hits, cast(coalesce(sum(event_count) filter (cache_status = 'MISS'), 0) as bigint) as misses,
    cast(coalesce(sum(event_count) filter (cache_status = 'STALE'), 0) as bigint) as stale from u where outcome = 'success' group by provider, source
) select *, (hits + stale) / (hits + stale + misses) as hit_rate from e""")
def q_cache_efficiency(spark, d):
    return O.cache_efficiency(G.rollup_usage(O.usage_events(_decided(spark, d))))


_MESSAGES = "case verdict " + " ".join(f"when {D.q(k)} then {D.q(v)}" for k, v in REASON_MESSAGES.items()) + " end"
_CODES = " ".join(f"when {D.q(k)} then {D.q(v[0])}" for k, v in O.FAILURES.items())
_TOLD = " ".join(f"when {D.q(k)} then {D.q(v[1])}" for k, v in O.FAILURES.items())


@register("q_result_json", "K04", f"""{_DECIDED}
select o.event_id, case when o.outcome = 'success' then '{{"provider":"' || o.provider || '","stats":{{"markdownBytes":' || (o.words * 6) || ',"words":' || o.words || '}},"cache":{{"key":"'
    || cache_key || '","status":"' || o.cache_status || '"}}}}'
  else '{{"error":{{"code":"' || case o.outcome {_CODES} end || '","message":"' || coalesce({_MESSAGES}, case o.outcome {_TOLD} end) || '"}}}}' end as line
from o join d using (event_id)""")
def q_result_json(spark, d):
    decided = _decided(spark, d)
    message = F.coalesce(*[F.when(F.col("verdict") == k, F.lit(v)) for k, v in REASON_MESSAGES.items()])
    return O.answer_lines(decided, message)
