"""Result-store and cache-freshness operators (S07, K01, J01–J03, W03–W05,
F11, F13, R07, A09, O01–O05).

Skew: a single URL (cache key) or actor may carry a third of all requests.
None of these operators gathers a whole key into one task:

* latest-row-per-key is a partial aggregate on narrow columns, so each task
  forwards one row per key before the shuffle;
* the as-of lookup joins requests with the key's few stored versions;
* the admission cap (first N per actor and window) is an exact two-stage
  top-N: rank inside salted sub-groups, keep N per sub-group, rank again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference service's behaviour.
# ---------------------------------------------------------------------------
DEFAULT_TTL_SECONDS = 604_800          # stored result TTL
MIN_TTL_SECONDS = 3_600
MAX_TTL_SECONDS = 30 * 24 * 60 * 60
EDGE_TTL_SECONDS = 86_400              # edge cache s-maxage
RETENTION_DAYS = 30                    # store lifecycle rule
ADMISSION_LIMIT = 10                   # uncached conversions per actor and window
ADMISSION_WINDOW = "60 seconds"
SOURCE_URL_META_CHARS = 1024           # object metadata cut
# ---------------------------------------------------------------------------
SALT_BUCKETS = 16


def ttl_seconds(setting: Column) -> Column:
    """configured TTL → clamp to [1 h, 30 d], floor; empty → default;
    non-numeric → default (``'0'`` is numeric and clamps to one hour)."""
    s = F.when(setting.isNull() | (setting == ""), F.lit(str(DEFAULT_TTL_SECONDS))).otherwise(setting)
    v = F.trim(s).try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    clamped = F.least(F.lit(MAX_TTL_SECONDS), F.greatest(F.lit(MIN_TTL_SECONDS), F.floor(v)))
    return F.when(ok, clamped).otherwise(F.lit(DEFAULT_TTL_SECONDS)).cast("bigint")


def age_seconds(fetched_at: Column, now: Column) -> Column:
    """whole seconds since the fetch, never negative."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(fetched_at)) / 1_000_000)).cast("bigint")


def latest_per_key(rows: DataFrame, key: str = "cache_key", order: str = "fetched_at") -> DataFrame:
    """The last-written row per key (ties: larger page_id, which
    must then tell the rows apart).

    The winner is found on narrow columns (hash aggregates with map-side
    partials); the documents are only filtered by it.
    """
    tie = [c for c in ("page_id",) if c in rows.columns]
    winner = rows.groupBy(key).agg(F.max(F.struct(order, *tie)).alias("_last")).select(key, "_last.*")
    return rows.join(winner, [key, order, *tie], "left_semi").select(rows.columns)


def read_store(store: DataFrame, as_of: Column) -> DataFrame:
    """Readable results only (version 1 with Markdown), latest per key,
    with the stale flag ``expires_at <= as_of``."""
    latest = latest_per_key(store)
    # The reader sees one object per key: if the latest write is unreadable
    # (other version, no Markdown) the key is absent.
    readable = latest.where((F.col("version") == 1) & F.col("markdown").isNotNull())
    return readable.withColumn("stale", F.col("expires_at") <= as_of)


def upsert_store(store: DataFrame, new: DataFrame) -> DataFrame:
    """Last write per key wins; object metadata carries the source URL
    (whole, and as the service's label of 1024 characters) and the version as text."""
    merged = latest_per_key(store.unionByName(new))
    return merged.select(
        "*",
        F.col("source_url").alias("meta_source_url"),
        F.substring("source_url", 1, SOURCE_URL_META_CHARS).alias("meta_source_label"),
        F.col("version").cast("string").alias("meta_version"),
        F.date_format("expires_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("meta_expires_at"),
    )


def retain(store: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Drop results fetched more than ``days`` before ``as_of``."""
    return store.where(F.col("fetched_at") > as_of - F.make_dt_interval(F.lit(days)))


def replay_cache(requests: DataFrame, store: DataFrame, key: str = "cache_key", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """As-of lookup of a request log in the stored results.

    A request meets the latest result of its key that was fetched by then:
    none → MISS, not yet expired → HIT, expired → STALE.  A key has one stored
    version per extraction, so the equi-join yields a few rows a request and
    hot request keys are split by the adaptive skew join.
    """
    r = requests.select(key, ts, tie)
    s = store.select(F.col(key).alias("_key"), "fetched_at", "expires_at")
    met = r.join(s, (F.col(key) == F.col("_key")) & (F.col("fetched_at") <= F.col(ts)))
    last = met.groupBy(tie).agg(F.max("fetched_at").alias("fetched_at"), F.max_by("expires_at", "fetched_at").alias("expires_at"))
    out = requests.join(last, tie, "left")
    status = (F.when(F.col("fetched_at").isNull(), F.lit("MISS"))
              .when(F.col("expires_at") > F.col(ts), F.lit("HIT")).otherwise(F.lit("STALE")))
    return out.withColumn("cache_status", status)


def admit_misses(requests: DataFrame, actor: Column, window: str = ADMISSION_WINDOW,
                 limit: int = ADMISSION_LIMIT, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Fixed-window admission — the first ``limit`` requests per actor
    and window (ordered by ts, tie) pass, the rest are refused.

    Exact two-stage top-N: rank within (actor, window, salt) sub-groups and
    keep the first ``limit`` of each (the global first ``limit`` are among
    them), then rank the survivors per (actor, window).  No task ever holds
    more than one sub-group or ``limit × SALT_BUCKETS`` survivors of a group.
    """
    r = requests.withColumn("_actor", actor).withColumn("_win", F.window(F.col(ts), window)["start"])
    r = r.withColumn("_salt", F.pmod(F.xxhash64(F.col(tie)), F.lit(SALT_BUCKETS)))
    w1 = Window.partitionBy("_actor", "_win", "_salt").orderBy(ts, tie)
    cand = r.withColumn("_rn1", F.row_number().over(w1)).where(F.col("_rn1") <= limit)
    w2 = Window.partitionBy("_actor", "_win").orderBy(ts, tie)
    top = cand.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= limit).select(tie, "_rn")
    out = r.join(top, tie, "left")
    return out.withColumn("admitted", F.col("_rn").isNotNull()).withColumnRenamed("_rn", "admit_rank") \
        .drop("_actor", "_win", "_salt")


def flag_admitted(requests: DataFrame, miss: Column, actor: Column, window: str = ADMISSION_WINDOW, limit: int = ADMISSION_LIMIT,
                  ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """W03 on some of the rows: ``admitted`` of the rows where ``miss`` holds, null for the others.

    The same exact top-N in two stages as :func:`admit_misses`, but in one pass
    over the requests: rows that take no part stand in groups of their own.
    """
    alone = F.concat(F.lit("~"), F.col(tie).cast("string"))
    r = (requests.withColumn("_miss", F.coalesce(miss, F.lit(False)))
         .withColumn("_who", F.when(F.col("_miss"), F.concat(F.lit("="), F.coalesce(actor.cast("string"), F.lit("")))).otherwise(alone))
         .withColumn("_win", F.when(F.col("_miss"), F.window(F.col(ts), window)["start"]))
         .withColumn("_salt", F.when(F.col("_miss"), F.pmod(F.xxhash64(F.col(tie)), F.lit(SALT_BUCKETS)))))
    first = F.row_number().over(Window.partitionBy("_who", "_win", "_salt").orderBy(ts, tie))
    r = r.withColumn("_near", F.col("_miss") & (first <= limit)).withColumn("_who", F.when(F.col("_near"), F.col("_who")).otherwise(alone))
    rank = F.row_number().over(Window.partitionBy("_who", "_win").orderBy(ts, tie))
    return r.withColumn("admitted", F.when(F.col("_miss"), F.col("_near") & (rank <= limit))).drop("_miss", "_who", "_win", "_salt", "_near")
