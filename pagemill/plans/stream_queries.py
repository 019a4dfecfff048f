"""Streaming queries: each runs its stream to completion (availableNow) and
returns the sink's content; the oracle is the batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.plans import oracle_fixtures as OF
from pagemill.plans.registry import register
from pagemill.plans.url_queries import _beacon_sql
from pagemill.plans.usage_queries import d_rollup
from pagemill.streaming import streams as S


@register("q_stream_usage", "R01 A02", d_rollup)
def q_stream_usage(spark, d):
    return S.stream_usage(spark, d)


@register("q_stream_daily", "R05",
          """select strftime(cast(ts as date), '%Y-%m-%d') as day, event_type, cast(count(*) as bigint) as n from events
group by 1, 2""")
def q_stream_daily(spark, d):
    return S.stream_daily(spark, d)


def _beacons_sql():
    return f"""with st as ({_beacon_sql()}), b as (
  select strftime(ts, '%Y-%m-%d') as day, status, case when status = 204 then json_extract_string(body, '$.event') end as event,
    case when status = 204 then json_extract_string(body, '$.page') end as page
  from ({OF.beacons()}) join st using (event_id))
select case when status = 204 then 'accepted' else 'rejected' end as sink, day, cast(status as bigint) as status, event, page, count(*) as n from b group by all"""


@register("q_stream_beacons", "R02 R06 O04 P12", _beacons_sql)
def q_stream_beacons(spark, d):
    usage, rejected = S.stream_beacons(spark, d)
    none = F.lit(None).cast("string")
    taken = usage.select(F.lit("accepted").alias("sink"), "day", F.col("status_code").alias("status"), F.col("event_name").alias("event"), F.col("source").alias("page"),
                         F.col("event_count").alias("n"))
    turned = rejected.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("status").cast("bigint").alias("status")).agg(F.count("*").alias("n"))
    return taken.unionByName(turned.select(F.lit("rejected").alias("sink"), "day", "status", none.alias("event"), none.alias("page"), "n"))
