"""Capture-side queries: capture scan, size limit, HTTP outcome, content-type
dispatch, policy-error class and fallback error merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import admission as A
from pagemill.operators import documents as Dm
from pagemill.operators.extraction import HTML_TYPE, MARKDOWN_TYPE, content_kind, fetch_outcome
from pagemill.plans import duck as D
from pagemill.plans import oracle_fixtures as OF
from pagemill.plans.registry import register
from pagemill.sources import fixtures as FX

# User-facing messages of the admission checks.
REASON_MESSAGES = {
    "missing_url": "A url parameter is required.",
    "unparseable": "Enter a complete URL, including https:// or http://.",
    "scheme": "Only HTTP and HTTPS URLs are supported.",
    "credentials": "URLs containing credentials are not supported.",
    "port": "Only standard web ports are supported.",
    "private": "Private and reserved network URLs are not supported.",
}
def d_fetch_outcome():
    return ("(case when status >= 300 and status < 400 then case when location is null then 'Redirect ' || cast(status as varchar) "
            "|| ' had no destination.' else 'redirect' end when status < 200 or status >= 300 then 'The website returned HTTP ' "
            "|| cast(status as varchar) || '.' else 'ok' end)")


@register("q_captures", "S02 D14",
          f"select page_id, {D.canonical_url('url')} as final_url, content_type, cast(octet_length(encode(body)) as bigint) as source_bytes "
          f"from ({D.parts_cte(f'({OF.CAPTURES})', 'url')})")
def q_captures(spark, d):
    c = A.admit(FX.captures(spark, d), "url")
    return c.select("page_id", F.col("canonical_url").alias("final_url"), "content_type",
                    F.octet_length("body").cast("bigint").alias("source_bytes"))


@register("q_body_limit", "S03",
          f"select page_id, octet_length(encode(body)) > {Dm.MAX_SOURCE_BYTES} as too_large from ({OF.CAPTURES})")
def q_body_limit(spark, d):
    c = FX.captures(spark, d)
    return c.select("page_id", (F.octet_length("body") > Dm.MAX_SOURCE_BYTES).alias("too_large"))


@register("q_fetch_outcome", "P15", f"select page_id, {d_fetch_outcome()} as outcome from ({OF.CAPTURES})")
def q_fetch_outcome(spark, d):
    c = FX.captures(spark, d)
    return c.select("page_id", fetch_outcome(F.col("status"), F.col("location")).alias("outcome"))


@register("q_content_dispatch", "P14",
          f"select page_id, case when regexp_matches(content_type, {D.q(MARKDOWN_TYPE)}) then 'native-markdown' "
          f"when regexp_matches(content_type, {D.q(HTML_TYPE)}) then 'html' else 'unsupported' end as kind from ({OF.CAPTURES})")
def q_content_dispatch(spark, d):
    c = FX.captures(spark, d)
    return c.select("page_id", content_kind(F.col("content_type")).alias("kind"))


def _messages(spark, d):
    r = A.admit(FX.url_requests(spark, d)).where(F.col("verdict") != "ok")
    m = F.col("verdict")
    msg = None
    for k, v in REASON_MESSAGES.items():
        msg = F.when(m == k, F.lit(v)) if msg is None else msg.when(m == k, F.lit(v))
    req = r.select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), msg.alias("message"))
    cap = FX.captures(spark, d).select(F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("id"),
                                       fetch_outcome(F.col("status"), F.col("location")).alias("message"))
    return req.unionByName(cap.where(~F.col("message").isin("ok", "redirect")))


def _messages_sql():
    cases = " ".join(f"when {D.q(k)} then {D.q(v)}" for k, v in REASON_MESSAGES.items())
    return f"""
with r as ({OF.URL_REQUESTS}), p as ({D.parts_cte('r', 'raw_url')}),
m as (
  select 'r' || cast(event_id as varchar) as id, case {D.rejection_reason('raw_url')} {cases} end as message
  from p where {D.rejection_reason('raw_url')} is not null
  union all
  select 'c' || cast(page_id as varchar) as id, {d_fetch_outcome()} as message from ({OF.CAPTURES})
  where {d_fetch_outcome()} not in ('ok', 'redirect')
)"""


@register("q_policy_error", "P19",
          lambda: f"{_messages_sql()} select id, message, regexp_matches(message, {D.q('(?i)(' + '|'.join(X.POLICY_ERRORS) + ')')}) as is_policy from m")
def q_policy_error(spark, d):
    m = _messages(spark, d)
    return m.select("id", "message", X.is_policy_error(F.col("message")).alias("is_policy"))


BROWSER_ERRORS = ["Browser fallback is unavailable.", "Browser Run could not extract Markdown from this page."]


def _merge_sql():
    pol = D.q("(?i)(" + "|".join(X.POLICY_ERRORS) + ")")
    b = (f"(case when cast(substr(id, 2) as bigint) % 3 = 0 then {D.q(BROWSER_ERRORS[0])} "
         f"when cast(substr(id, 2) as bigint) % 3 = 1 then message else {D.q(BROWSER_ERRORS[1])} end)")
    return f"""{_messages_sql()}
select id, case when regexp_matches(message, {pol}) then message
  when regexp_matches({b}, '(?i)browser fallback is unavailable') then message
  when message = {b} then message else message || ' Browser fallback: ' || {b} end as merged from m"""


@register("q_error_merge", "P20", _merge_sql)
def q_error_merge(spark, d):
    m = _messages(spark, d)
    n = F.substring("id", 2, 20).cast("bigint") % 3
    browser = F.when(n == 0, F.lit(BROWSER_ERRORS[0])).when(n == 1, F.col("message")).otherwise(F.lit(BROWSER_ERRORS[1]))
    return m.select("id", X.merge_errors(F.col("message"), browser).alias("merged"))
