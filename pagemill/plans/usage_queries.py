"""Usage-layer queries: daily rollup, merges, ranges, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.operators import usage as G
from pagemill.plans import oracle_fixtures as OF
from pagemill.plans.registry import register
from pagemill.sources import fixtures as FX
from pagemill.sources.tables import read_events

P = G.periods()


def d_fi(x: str) -> str:
    return f"(case when {x} is null or isnan({x}) or isinf({x}) then 0 else greatest(0, floor({x} + 0.5)) end)"


def d_rollup(where: str = "true") -> str:
    return f"""
select strftime(ts, '%Y-%m-%d') as day, event_name, outcome, cache_status, source, provider,
  cast({d_fi('cast(status_code as double)')} as bigint) as status_code,
  count(*) as event_count,
  cast(sum({d_fi('cast(duration_ms as double)')}) as bigint) as duration_ms,
  cast(sum({d_fi('cast(words as double)')}) as bigint) as words,
  cast(sum({d_fi('cast(markdown_bytes as double)')}) as bigint) as markdown_bytes
from ({OF.USAGE_EVENTS}) where {where}
group by 1, 2, 3, 4, 5, 6, 7"""


def d_period(day: str) -> str:
    return ("case " + " ".join(f"when {day} >= '{lo}' and {day} < '{hi}' then '{n}'" for n, (lo, hi) in P.items())
            + " end")


def _rollup(spark, d, start: str | None = None, end: str | None = None):
    """Daily rollup; with bounds only the days from start up to end are read (the bounds reach the scan)."""
    return G.rollup_usage(FX.usage_events(spark, d, start, end))


FIRST, LAST = min(lo for lo, _ in P.values()), max(hi for _, hi in P.values())


@register("q_usage_daily", "A01 K02 F10 F14 D8", d_rollup())
def q_usage_daily(spark, d):
    return _rollup(spark, d)


@register("q_usage_merge", "A02", d_rollup())
def q_usage_merge(spark, d):
    ev = FX.usage_events(spark, d)
    old = G.rollup_usage(ev.where(F.col("event_id") % 2 == 0))
    new = G.rollup_usage(ev.where(F.col("event_id") % 2 == 1))
    return G.merge_usage(old, new)


@register("q_usage_range", "S08 T01",
          f"select * from ({d_rollup()}) where day >= '2024-01-10' and day < '2024-01-20'")
def q_usage_range(spark, d):
    return G.usage_range(_rollup(spark, d, "2024-01-10", "2024-01-20"), "2024-01-10", "2024-01-20")


def _http_log(spark, d):
    """Raw edge requests (one per event) behind the F7 groups."""
    ev = read_events(spark, d)
    eid, et = F.col("event_id"), F.col("event_type")
    path = (F.when(eid % 4 == 0, F.lit("/")).when(eid % 4 == 1, F.lit("/api/extract"))
            .when(eid % 4 == 2, F.lit("/api/markdown")).otherwise(F.lit("/md")))
    status = (F.when(et == "error", F.when(eid % 2 == 0, F.lit(502)).otherwise(F.lit(400)))
              .when(et == "signup", F.lit(308)).otherwise(F.lit(200)))
    return ev.select("ts", path.alias("path"), status.alias("status"),
                     F.when(et == "view", 1).otherwise(0).alias("visit"),
                     F.lit("eyeball").alias("request_source"))


_CUR = P["current"]


@register("q_http_groups", "S09 A08 P21",
          f"""select path, status, count(*) as n, cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as visits
from (select *, case event_id % 4 when 0 then '/' when 1 then '/api/extract' when 2 then '/api/markdown' else '/md' end as path,
        case event_type when 'error' then case when event_id % 2 = 0 then 502 else 400 end when 'signup' then 308 else 200 end as status
      from events)
where ts >= timestamp '{_CUR[0]}' and ts < timestamp '{_CUR[1]}' and path in ('/', '/api/extract', '/api/markdown')
group by path, status""")
def q_http_groups(spark, d):
    log = _http_log(spark, d)
    lo, hi = _CUR
    f = log.where((F.col("ts") >= F.lit(lo).cast("timestamp")) & (F.col("ts") < F.lit(hi).cast("timestamp"))
                  & (F.col("request_source") == "eyeball") & F.col("path").isin(*G.REPORT_PATHS))
    return f.groupBy("path", "status").agg(F.count("*").alias("n"), F.sum("visit").cast("bigint").alias("visits"))


def _http_summary_sql():
    api = "path in ('/api/extract', '/api/markdown')"
    return f"""
select period,
  cast(sum(case when {api} then n else 0 end) as bigint) as api_attempts,
  cast(sum(case when {api} and status >= 400 and status < 500 then n else 0 end) as bigint) as api_client_errors,
  cast(sum(case when {api} and status >= 500 then n else 0 end) as bigint) as api_server_errors,
  cast(sum(case when {api} and status >= 200 and status < 300 then n else 0 end) as bigint) as api_successes,
  cast(sum(case when path = '/' then n else 0 end) as bigint) as homepage_requests,
  cast(sum(case when path = '/' then visits else 0 end) as bigint) as visits
from (select *, {d_period("strftime(day, '%Y-%m-%d')")} as period from ({OF.HTTP_GROUPS}))
where period in ('previous', 'current') and path in ('/', '/api/extract', '/api/markdown')
group by period"""


@register("q_http_summary", "A03 E01 F16 W07", _http_summary_sql)
def q_http_summary(spark, d):
    return G.http_summary(FX.http_groups(spark, d, FIRST, LAST))


def _first_party_sql():
    conv = "event_name = 'conversion' and outcome not in ('missing_url', 'invalid_url')"
    ok = f"{conv} and outcome = 'success'"

    def t(cond, m="event_count"):
        return f"cast(sum(case when {cond} then {m} else 0 end) as bigint)"

    return f"""
select period,
  {t("event_name = 'browser_page_view'")} as browser_page_loads,
  {t("event_name = 'input_engaged'")} as input_engagements,
  {t("event_name = 'conversion_submit'")} as client_submits,
  {t(conv)} as conversion_attempts, {t(ok)} as conversion_successes,
  {t(conv + " and outcome <> 'success'")} as conversion_errors,
  {t("event_name = 'conversion' and outcome in ('missing_url', 'invalid_url')")} as validation_errors,
  {t(ok + " and cache_status in ('HIT', 'STALE')")} as cache_hits,
  {t(ok + " and cache_status = 'MISS'")} as cache_misses,
  {t("event_name = 'copy_markdown'")} as copies, {t("event_name = 'download_markdown'")} as downloads,
  {t(conv, 'duration_ms')} as duration_ms, {t(ok, 'markdown_bytes')} as markdown_bytes, {t(ok, 'words')} as words
from (select *, {d_period('day')} as period from ({d_rollup()})) where period is not null
group by period"""


@register("q_first_party", "A04", _first_party_sql)
def q_first_party(spark, d):
    return G.first_party(_rollup(spark, d, FIRST, LAST))


@register("q_loads_by_source", "A05",
          f"""select period, case when source = '' then 'unknown' else source end as source,
  cast(sum(event_count) as bigint) as page_loads
from (select *, {d_period('day')} as period from ({d_rollup()}))
where period is not null and event_name = 'browser_page_view' group by 1, 2""")
def q_loads_by_source(spark, d):
    return G.loads_by_source(_rollup(spark, d, FIRST, LAST))


def _tenths(num: str, den: str) -> str:
    """Percentage num/den with one decimal (tenths by exact integer arithmetic)."""
    t = f"(({num}) * 2000 + ({den})) // (2 * ({den}))"
    return f"cast({t} // 10 as varchar) || '.' || cast({t} % 10 as varchar)"


def _rates_sql():
    return f"""
with h as ({_http_summary_sql()}), f as ({_first_party_sql()})
select h.period,
  case when api_attempts > 0 then {_tenths('api_successes', 'api_attempts')} end as endpoint_2xx_rate,
  case when conversion_attempts > 0 then {_tenths('conversion_successes', 'conversion_attempts')} end as success_rate,
  case when conversion_attempts > 0 then cast((2 * duration_ms + conversion_attempts) // (2 * conversion_attempts) as bigint) end as avg_latency_ms
from h join f on h.period = f.period"""


def tenths_text(num, den):
    """Percentage num/den with one decimal, ties away from zero (toFixed(1))."""
    t = G.int_div(num * 2000 + den, 2 * den)
    return F.concat(G.int_div(t, F.lit(10)).cast("string"), F.lit("."), (t % 10).cast("string"))


@register("q_rates", "A06", _rates_sql)
def q_rates(spark, d):
    h = G.http_summary(FX.http_groups(spark, d, FIRST, LAST))
    f = G.first_party(_rollup(spark, d, FIRST, LAST))
    j = h.join(f, "period")
    a, c = F.col("api_attempts"), F.col("conversion_attempts")
    return j.select(
        "period",
        F.when(a > 0, tenths_text(F.col("api_successes"), a)).alias("endpoint_2xx_rate"),
        F.when(c > 0, tenths_text(F.col("conversion_successes"), c)).alias("success_rate"),
        F.when(c > 0, G.int_div(2 * F.col("duration_ms") + c, 2 * c)).alias("avg_latency_ms"),
    )


def d_change(cur: str, prev: str) -> str:
    d = f"({cur} - {prev})"
    t = f"((abs({d}) * 2000 + {prev}) // (2 * {prev}))"
    txt = (f"(case when {d} < 0 then '-' else '' end) || cast({t} // 10 as varchar) || '.' || "
           f"cast({t} % 10 as varchar) || '%'")
    return f"(case when {prev} = 0 then case when {cur} = 0 then '0%' else 'new' end else {txt} end)"


def _report_sql(summary_sql: str, metrics) -> str:
    parts = " union all ".join(
        f"select {i} as ord, '{label}' as metric, "
        f"cast(coalesce(sum(case when period = 'current' then {key} end), 0) as bigint) as current, "
        f"cast(coalesce(sum(case when period = 'previous' then {key} end), 0) as bigint) as previous from s"
        for i, (label, key) in enumerate(metrics))
    return f"with s as ({summary_sql}), r as ({parts}) select ord, metric, current, previous, {d_change('current', 'previous')} as change from r"


@register("q_report_http", "K06 J09 F15", lambda: _report_sql(_http_summary_sql(), G.HTTP_METRICS))
def q_report_http(spark, d):
    return G.report_table(G.http_summary(FX.http_groups(spark, d, FIRST, LAST)), G.HTTP_METRICS)


@register("q_report_first_party", "K06 J09 F15", lambda: _report_sql(_first_party_sql(), G.FIRST_PARTY_METRICS))
def q_report_first_party(spark, d):
    return G.report_table(G.first_party(_rollup(spark, d, FIRST, LAST)), G.FIRST_PARTY_METRICS)


@register("q_period_change", "F15 W05",
          f"""select day, event_name, events, prev_events, {d_change('events', 'prev_events')} as change from (
  select day, event_name, events,
    cast(coalesce(lag(events) over (partition by event_name order by day), 0) as bigint) as prev_events
  from (select day, event_name, cast(sum(event_count) as bigint) as events from ({d_rollup()}) group by 1, 2))""")
def q_period_change(spark, d):
    daily = _rollup(spark, d).groupBy("day", "event_name").agg(F.sum("event_count").cast("bigint").alias("events"))
    w = Window.partitionBy("event_name").orderBy("day")
    daily = daily.withColumn("prev_events", F.coalesce(F.lag("events").over(w), F.lit(0)).cast("bigint"))
    return daily.withColumn("change", G.percentage_change(F.col("events"), F.col("prev_events")))


SPINE = ("2023-12-29", "2024-02-03")


@register("q_day_spine", "E04",
          f"""select strftime(d, '%Y-%m-%d') as day, cast(coalesce(sum(event_count), 0) as bigint) as events
from (select unnest(generate_series(date '{SPINE[0]}', date '{SPINE[1]}' - interval 1 day, interval 1 day)) as d) s
left join ({d_rollup()}) r on r.day = strftime(s.d, '%Y-%m-%d') group by 1""")
def q_day_spine(spark, d):
    spine = G.day_spine(spark, *SPINE)
    totals = _rollup(spark, d, *SPINE).groupBy("day").agg(F.sum("event_count").alias("events"))
    return spine.join(totals, "day", "left").select(
        "day", F.coalesce(F.col("events"), F.lit(0)).cast("bigint").alias("events"))


def _answers(spark, d):
    """An answer per day: batches of counted rows, one of them without results."""
    daily = FX.usage_events(spark, d).groupBy(G.usage_day(F.col("ts")).alias("day"), "event_name").agg(F.count("*").alias("event_count"))
    row = F.to_json(F.struct("day", "event_name", "event_count"))
    half = lambda odd: F.concat_ws(",", F.array_sort(F.collect_list(F.when((F.length("event_name") % 2 == 1) == F.lit(odd), row))))
    payload = F.concat(F.lit('[{"results":['), half(False), F.lit(']},{"success":true},{"results":['), half(True), F.lit(']},{"results":null}]'))
    return daily.groupBy(F.col("day").alias("asked")).agg(payload.alias("payload"))


@register("q_flatten_batches", "S10", f"select day as asked, day, event_name, cast(sum(event_count) as bigint) as event_count from ({d_rollup()}) group by day, event_name")
def q_flatten_batches(spark, d):
    return G.flatten_batches(_answers(spark, d))
