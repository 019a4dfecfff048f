"""Freshness-layer queries: store reads/writes, replay, admission, tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import admission as A
from pagemill.operators import freshness as R
from pagemill.plans import duck as D
from pagemill.plans import oracle_fixtures as OF
from pagemill.plans.registry import register
from pagemill.sources import fixtures as FX
from pagemill.sources.tables import read_pages

STORE_AS_OF = "2024-01-15 00:00:00"
RETAIN_AS_OF = "2024-02-10 00:00:00"
TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss"
TS_FMT_DUCK = "%Y-%m-%d %H:%M:%S"
TTL_SETTINGS = ["604800", "0", "", "abc", "99999999", "7200.9"]


def _ts(c):
    return F.date_format(c, TS_FMT_SPARK)


def d_latest(src: str) -> str:
    return (f"select * exclude (rn) from (select *, row_number() over (partition by cache_key "
            f"order by fetched_at desc, page_id desc) as rn from ({src})) where rn = 1")


_STORE = OF.result_store()
_READ = f"select * from ({d_latest(_STORE)}) where version = 1 and markdown is not null"


@register("q_store_read", "S07 D5 D6 W04",
          f"select cache_key, title, strftime(fetched_at, '{TS_FMT_DUCK}') as fetched_at, "
          f"expires_at <= timestamp '{STORE_AS_OF}' as stale from ({_READ})")
def q_store_read(spark, d):
    s = R.read_store(FX.result_store(spark, d), F.lit(STORE_AS_OF).cast("timestamp"))
    return s.select("cache_key", "title", _ts("fetched_at").alias("fetched_at"), "stale")


def _new_results(spark, d):
    s = FX.result_store(spark, d)
    return (s.where(F.col("page_id") % 4 == 0)
            .withColumn("fetched_at", F.timestamp_add("DAY", F.lit(10), F.col("fetched_at")))
            .withColumn("expires_at", F.timestamp_add("DAY", F.lit(7), F.col("fetched_at")))
            .withColumn("title", F.concat(F.col("title"), F.lit(" (refresh)"))))


_NEW = (f"select * replace (fetched_at + to_days(10) as fetched_at, fetched_at + to_days(17) as expires_at, "
        f"title || ' (refresh)' as title) from ({_STORE}) where page_id % 4 = 0")


@register("q_store_upsert", "K01 W04",
          f"select cache_key, title, strftime(fetched_at, '{TS_FMT_DUCK}') as fetched_at, "
          f"source_url as meta_source_url, substr(source_url, 1, 1024) as meta_source_label, cast(version as varchar) as meta_version "
          f"from ({d_latest(f'select * from ({_STORE}) union all select * from ({_NEW})')})")
def q_store_upsert(spark, d):
    u = R.upsert_store(FX.result_store(spark, d), _new_results(spark, d))
    return u.select("cache_key", "title", _ts("fetched_at").alias("fetched_at"), "meta_source_url", "meta_source_label", "meta_version")


@register("q_retention", "R07",
          f"select page_id, cache_key, strftime(fetched_at, '{TS_FMT_DUCK}') as fetched_at from ({_STORE}) "
          f"where fetched_at > timestamp '{RETAIN_AS_OF}' - interval 30 day")
def q_retention(spark, d):
    r = R.retain(FX.result_store(spark, d), F.lit(RETAIN_AS_OF).cast("timestamp"))
    return r.select("page_id", "cache_key", _ts("fetched_at").alias("fetched_at"))


def _dedup_sql():
    canon = D.canonical_url("url")
    return (f"select {D.cache_key(canon)} as cache_key, min(page_id) as page_id, count(*) as pages "
            f"from ({D.parts_cte('pages', 'url', 'page_id, url')}) group by 1")


@register("q_dedup_by_key", "A09", _dedup_sql)
def q_dedup_by_key(spark, d):
    p = A.admit(read_pages(spark, d, "page_id", "url"), "url")
    return p.groupBy("cache_key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages"))


def _ttl_sql():
    arr = "[" + ", ".join(D.q(x) for x in TTL_SETTINGS) + "]"
    s = f"{arr}[page_id % {len(TTL_SETTINGS)} + 1]"
    v = f"try_cast(trim(case when {s} = '' then '{R.DEFAULT_TTL_SECONDS}' else {s} end) as double)"
    ttl = (f"cast(case when {v} is null or isnan({v}) or isinf({v}) then {R.DEFAULT_TTL_SECONDS} "
           f"else least({R.MAX_TTL_SECONDS}, greatest({R.MIN_TTL_SECONDS}, floor({v}))) end as bigint)")
    return f"""
select page_id, ttl, strftime(fetched_at + to_seconds(ttl), '{TS_FMT_DUCK}') as expires_at,
  cast(greatest(0, floor((epoch_us(timestamp '{STORE_AS_OF}') - epoch_us(fetched_at)) / 1000000)) as bigint) as age_seconds
from (select *, {ttl} as ttl from ({_STORE}))"""


@register("q_freshness", "F11 F13 D20", _ttl_sql)
def q_freshness(spark, d):
    s = FX.result_store(spark, d)
    setting = F.element_at(F.array(*[F.lit(x) for x in TTL_SETTINGS]), (F.col("page_id") % len(TTL_SETTINGS) + 1).cast("int"))
    s = s.withColumn("ttl", R.ttl_seconds(setting))
    return s.select("page_id", "ttl",
                    _ts(F.timestamp_add("SECOND", F.col("ttl"), F.col("fetched_at"))).alias("expires_at"),
                    R.age_seconds(F.col("fetched_at"), F.lit(STORE_AS_OF).cast("timestamp")).alias("age_seconds"))


def _admitted(spark, d):
    return A.admit(FX.url_requests(spark, d)).where(F.col("verdict") == "ok").drop("canon_parts")


_REQ = f"with r as ({OF.URL_REQUESTS}), p as ({D.parts_cte('r', 'raw_url')})"
_ADM = (f"{_REQ}, a as (select event_id, ts, actor, {D.cache_key(D.canonical_url('raw_url'))} as cache_key "
        f"from p where {D.rejection_reason('raw_url')} is null)")


@register("q_cache_replay", "J03 W05",
          f"""{_ADM}, s as ({_STORE})
select a.event_id, case when m.fetched_at is null then 'MISS' when m.expires_at > a.ts then 'HIT' else 'STALE' end as cache_status
from a left join (
  select event_id, max(s.fetched_at) as fetched_at, max(s.expires_at) as expires_at
  from a join s on s.cache_key = a.cache_key and s.fetched_at <= a.ts group by event_id) m on m.event_id = a.event_id""")
def q_cache_replay(spark, d):
    r = R.replay_cache(_admitted(spark, d), FX.result_store(spark, d))
    return r.select("event_id", "cache_status")


@register("q_admission", "W03",
          f"""with r as ({OF.URL_REQUESTS})
select event_id, row_number() over (partition by actor % 3, cast(ts as date) order by ts, event_id) <= {R.ADMISSION_LIMIT} as admitted
from r""")
def q_admission(spark, d):
    r = FX.url_requests(spark, d)
    a = R.admit_misses(r, F.col("actor") % 3, window="1 day")
    return a.select("event_id", "admitted")


@register("q_cache_lookup", "J01 D6",
          f"""{_ADM}, s as ({_READ})
select a.event_id, s.cache_key is not null as found, s.expires_at <= a.ts as stale
from a left join s on s.cache_key = a.cache_key""")
def q_cache_lookup(spark, d):
    store = R.latest_per_key(FX.result_store(spark, d)).where((F.col("version") == 1) & F.col("markdown").isNotNull())
    a = _admitted(spark, d).select("event_id", "ts", "cache_key")
    j = a.join(store.select("cache_key", "expires_at"), "cache_key", "left")
    return j.select("event_id", F.col("expires_at").isNotNull().alias("found"),
                    (F.col("expires_at") <= F.col("ts")).alias("stale"))


@register("q_cache_source", "J02 O01",
          f"""{_ADM}, s as ({_READ})
select a.event_id,
  case when s.cache_key is not null and s.expires_at > a.ts then 'HIT' else 'MISS' end as cache_status,
  case when s.cache_key is not null and s.expires_at > a.ts and a.ts < s.fetched_at + interval {R.EDGE_TTL_SECONDS} second then 'edge'
       when s.cache_key is not null and s.expires_at > a.ts then 'r2' else 'origin' end as source
from a left join s on s.cache_key = a.cache_key""")
def q_cache_source(spark, d):
    store = R.latest_per_key(FX.result_store(spark, d)).where((F.col("version") == 1) & F.col("markdown").isNotNull())
    a = _admitted(spark, d).select("event_id", "ts", "cache_key")
    j = a.join(store.select("cache_key", "fetched_at", "expires_at"), "cache_key", "left")
    fresh = F.col("expires_at").isNotNull() & (F.col("expires_at") > F.col("ts"))
    edge = fresh & (F.col("ts") < F.timestamp_add("SECOND", F.lit(R.EDGE_TTL_SECONDS), F.col("fetched_at")))
    return j.select("event_id", F.when(fresh, F.lit("HIT")).otherwise(F.lit("MISS")).alias("cache_status"),
                    F.when(edge, F.lit("edge")).when(fresh, F.lit("r2")).otherwise(F.lit("origin")).alias("source"))
