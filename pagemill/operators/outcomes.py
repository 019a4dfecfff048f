"""What each request got (O01–O05): fresh, stale, extracted, refused or failed.

One decision over the request, the stored row it met, its admission among the
misses, and the extraction's result.  Requests without a cache key get join
keys of their own, so they spread over all tasks; a hot key is split by the
adaptive skew join, and the admission cap ranks salted groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import freshness as R
from pagemill.operators.staging import stage

# Fixed values that must equal the reference service's behaviour: HTTP status of each outcome.
STATUS = {"success": 200, "missing_url": 400, "invalid_url": 400, "rate_limited": 429, "extraction_failed": 502}

# code and message of the answers that are no result (an invalid URL has the message of its check)
FAILURES = {
    "missing_url": ("BAD_REQUEST", "A url parameter is required."),
    "invalid_url": ("BAD_REQUEST", "Invalid URL."),
    "rate_limited": ("RATE_LIMITED", "Too many uncached conversions. Try again in about a minute."),
    "extraction_failed": ("EXTRACTION_FAILED", "Extraction failed."),
}

STORED = ["fetched_at", "expires_at", "provider", "words", "markdown_bytes"]


def meet_store(requests: DataFrame, store: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``requests`` (cache_key may be null) with ``stored``, the row of the key last written by then.

    Null if there is none or the last one is not readable (another version, no
    Markdown).
    """
    own = F.concat(F.lit("~"), F.col(tie).cast("string"))
    r = requests.select(F.coalesce("cache_key", own).alias("_k"), F.struct(*requests.columns).alias("_r"))
    ok = (F.col("version") == 1) & F.col("markdown").isNotNull()
    s = store.select(F.col("cache_key").alias("_s"), F.struct("fetched_at", "page_id").alias("_at"), F.when(ok, F.struct(*STORED)).alias("_row"))
    met = r.join(s, (F.col("_k") == F.col("_s")) & (F.col("_at.fetched_at") <= F.col(f"_r.{ts}")), "left")
    last = met.groupBy(F.col(f"_r.{tie}").alias("_tie")).agg(F.any_value("_r").alias("_r"), F.max_by("_row", "_at").alias("stored"))
    return last.select("_r.*", "stored")


def decide(requests: DataFrame, store: DataFrame, results: DataFrame, actor: Column, window: str = R.ADMISSION_WINDOW,
           limit: int = R.ADMISSION_LIMIT) -> DataFrame:
    """``requests`` with outcome, status_code, cache_status, source, stale, provider, words, markdown_bytes.

    ``requests`` has event_id (unique), ts, verdict and cache_key
    (:func:`admission.admit`); ``results`` has one row a cache_key: ok,
    provider, words, markdown_bytes.  A key without a result failed.
    Only requests that no fresh row answers count against the limit.
    """
    cols = requests.columns
    df = meet_store(requests, store)
    df = stage(df, fresh=F.coalesce(F.col("stored.expires_at") > F.col("ts"), F.lit(False)), valid=F.col("verdict") == "ok")
    miss = F.col("valid") & ~F.col("fresh")
    df = R.flag_admitted(df, miss, actor, window, limit)
    df = df.withColumn("_k", F.when(F.col("admitted"), F.col("cache_key")).otherwise(F.concat(F.lit("~"), F.col("event_id").cast("string"))))
    got = results.select(F.col("cache_key").alias("_s"), F.when(F.col("ok"), F.struct("provider", "words", "markdown_bytes")).alias("result"))
    df = df.join(got, F.col("_k") == F.col("_s"), "left")
    kept, made = F.col("stored").isNotNull(), F.col("result").isNotNull()
    status = (F.when(~F.col("valid"), F.lit(None)).when(F.col("fresh"), F.lit("HIT")).when(made, F.lit("MISS")).when(kept, F.lit("STALE")))
    outcome = (F.when(F.col("verdict") == "missing_url", F.lit("missing_url")).when(~F.col("valid"), F.lit("invalid_url"))
               .when(F.col("fresh") | made | kept, F.lit("success")).when(~F.col("admitted"), F.lit("rate_limited")).otherwise(F.lit("extraction_failed")))
    df = stage(df, cache_status=status, outcome=outcome)
    st = F.col("cache_status")
    edge = F.col("ts") < F.timestamp_add("SECOND", F.lit(R.EDGE_TTL_SECONDS), F.col("stored.fetched_at"))
    source = F.when(st == "MISS", F.lit("origin")).when(st == "STALE", F.lit("r2")).when(st == "HIT", F.when(edge, F.lit("edge")).otherwise(F.lit("r2")))
    of = lambda c: F.when(st == "MISS", F.col(f"result.{c}")).when(st.isNotNull(), F.col(f"stored.{c}")).alias(c)
    code = F.coalesce(*[F.when(F.col("outcome") == k, F.lit(v)) for k, v in STATUS.items()])
    return df.select(*cols, "outcome", code.cast("bigint").alias("status_code"), "cache_status", source.alias("source"),
                     F.coalesce(st == "STALE", F.lit(False)).alias("stale"), "admitted", of("provider"), of("words"), of("markdown_bytes"))


def usage_events(decided: DataFrame) -> DataFrame:
    """The usage event of each request, as the rollup takes it."""
    return decided.select("ts", F.lit("conversion").alias("event_name"), "outcome", "cache_status", "source", "provider", "status_code",
                          "duration_ms", "words", "markdown_bytes")


def cache_efficiency(usage: DataFrame) -> DataFrame:
    """Hits, misses, stale answers and their share served from cache, by provider and source, from rolled-up usage."""
    u = usage.where((F.col("event_name") == "conversion") & (F.col("outcome") == "success"))
    n = lambda s: F.sum(F.when(F.col("cache_status") == s, F.col("event_count")).otherwise(0)).cast("bigint")
    g = u.groupBy("provider", "source").agg(n("HIT").alias("hits"), n("MISS").alias("misses"), n("STALE").alias("stale"))
    served = F.col("hits") + F.col("stale")
    return g.withColumn("hit_rate", F.try_divide(served, served + F.col("misses")))


def answer_lines(decided: DataFrame, message: Column | None = None) -> DataFrame:
    """event_id and ``line``, the JSON line of each answer: a result with its cache block, or an error.

    ``message`` (may be null) is told in place of the outcome's own.
    """
    failed = F.col("outcome")
    pick = lambda i: F.coalesce(*[F.when(failed == k, F.lit(v[i])) for k, v in FAILURES.items()])
    told = pick(1) if message is None else F.coalesce(message, pick(1))
    result = F.to_json(F.struct("provider", F.struct(F.col("markdown_bytes").alias("markdownBytes"), "words").alias("stats"),
                                F.struct(F.col("cache_key").alias("key"), F.col("cache_status").alias("status")).alias("cache")))
    error = F.to_json(F.struct(F.struct(pick(0).alias("code"), told.alias("message")).alias("error")))
    return decided.select("event_id", F.when(failed == "success", result).otherwise(error).alias("line"))
