"""Usage counters and reports.

The daily rollup is a two-phase hash aggregate (partial per task, final per
key after one shuffle of the partials), so the shuffle carries at most one
row per (task, 7-key group) no matter how many events there are.  Merging
partial rollups is exact because every measure is additive.  Reports read
the rollup once and split periods with conditional aggregation instead of
one scan per day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["day", "event_name", "outcome", "cache_status", "source", "provider", "status_code"]
MEASURES = ["duration_ms", "words", "markdown_bytes"]
WINDOW_DAYS = 3               # fixed value: report period length in days
REPORT_AS_OF = "2024-01-30"   # report parameter used by the registered queries
REPORT_PATHS = ["/", "/api/extract", "/api/markdown"]   # fixed value: edge-log paths reported


def finite_integer(x: Column) -> Column:
    """non-negative rounded integer; NaN / ±∞ / NULL → 0 (JS Math.round)."""
    d = x.cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(bad, F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(d + 0.5))).cast("bigint")


def usage_day(ts: Column) -> Column:
    """the UTC day of an event, as the ``YYYY-MM-DD`` key."""
    return F.date_format(ts, "yyyy-MM-dd")


def rollup_usage(events: DataFrame) -> DataFrame:
    """One row per (day, 7 keys) with count and additive measures."""
    e = events.select(
        usage_day(F.col("ts")).alias("day"),
        *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in KEYS[1:6]],
        finite_integer(F.col("status_code")).alias("status_code"),
        *[finite_integer(F.col(m)).alias(m) for m in MEASURES],
    )
    return e.groupBy(*KEYS).agg(F.count("*").alias("event_count"), *[F.sum(m).alias(m) for m in MEASURES])


def merge_usage(base: DataFrame, partials: DataFrame | None = None) -> DataFrame:
    """Union old and new counters and re-sum (exact: all measures add)."""
    cols = KEYS + ["event_count"] + MEASURES
    u = base.select(*cols)
    if partials is not None:
        u = u.unionByName(partials.select(*cols))
    return u.groupBy(*KEYS).agg(*[F.sum(m).cast("bigint").alias(m) for m in ["event_count"] + MEASURES])


def usage_range(usage: DataFrame, start: str, end: str) -> DataFrame:
    """``start <= day < end`` ordered by day, event, outcome."""
    return usage.where((F.col("day") >= start) & (F.col("day") < end)).orderBy("day", "event_name", "outcome")


def periods(as_of: str = REPORT_AS_OF, days: int = WINDOW_DAYS) -> dict[str, tuple[str, str]]:
    """Previous / current complete-day windows and the partial day."""
    a = dt.date.fromisoformat(as_of)
    f = lambda d: d.isoformat()
    return {
        "previous": (f(a - dt.timedelta(days=2 * days)), f(a - dt.timedelta(days=days))),
        "current": (f(a - dt.timedelta(days=days)), f(a)),
        "today": (f(a), f(a + dt.timedelta(days=1))),
    }


def period_of(day: Column, as_of: str = REPORT_AS_OF, days: int = WINDOW_DAYS) -> Column:
    out = None
    for name, (lo, hi) in periods(as_of, days).items():
        cond = (day >= lo) & (day < hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def http_summary(groups: DataFrame, as_of: str = REPORT_AS_OF) -> DataFrame:
    """A03 (+ S09 filters, E01 day union): six edge counters per period."""
    g = groups.select(period_of(F.date_format("day", "yyyy-MM-dd"), as_of).alias("period"), "path", "status",
                      "n", "visits")
    g = g.where(F.col("period").isin("previous", "current") & F.col("path").isin(*REPORT_PATHS))
    api = F.col("path").isin("/api/extract", "/api/markdown")
    s = F.col("status")

    def total(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("bigint")

    return g.groupBy("period").agg(
        total(api).alias("api_attempts"),
        total(api & (s >= 400) & (s < 500)).alias("api_client_errors"),
        total(api & (s >= 500)).alias("api_server_errors"),
        total(api & (s >= 200) & (s < 300)).alias("api_successes"),
        total(F.col("path") == "/").alias("homepage_requests"),
        F.sum(F.when(F.col("path") == "/", F.col("visits")).otherwise(0)).cast("bigint").alias("visits"),
    )


FIRST_PARTY = ["browser_page_loads", "input_engagements", "client_submits", "conversion_attempts",
               "conversion_successes", "conversion_errors", "validation_errors", "cache_hits",
               "cache_misses", "copies", "downloads", "duration_ms", "markdown_bytes", "words"]


def first_party(usage: DataFrame, as_of: str = REPORT_AS_OF) -> DataFrame:
    """The 14 first-party counters per period (validation errors are not
    attempts; STALE counts as a cache hit; any non-success conversion is an
    error)."""
    u = usage.withColumn("period", period_of(F.col("day"), as_of)).where(F.col("period").isNotNull())
    ev, oc, cs, c = F.col("event_name"), F.col("outcome"), F.col("cache_status"), F.col("event_count")
    conv = (ev == "conversion") & ~oc.isin("missing_url", "invalid_url")
    ok = conv & (oc == "success")

    def total(cond, m=c):
        return F.sum(F.when(cond, m).otherwise(0)).cast("bigint")

    return u.groupBy("period").agg(
        total(ev == "browser_page_view").alias("browser_page_loads"),
        total(ev == "input_engaged").alias("input_engagements"),
        total(ev == "conversion_submit").alias("client_submits"),
        total(conv).alias("conversion_attempts"),
        total(ok).alias("conversion_successes"),
        total(conv & (oc != "success")).alias("conversion_errors"),
        total((ev == "conversion") & oc.isin("missing_url", "invalid_url")).alias("validation_errors"),
        total(ok & cs.isin("HIT", "STALE")).alias("cache_hits"),
        total(ok & (cs == "MISS")).alias("cache_misses"),
        total(ev == "copy_markdown").alias("copies"),
        total(ev == "download_markdown").alias("downloads"),
        total(conv, F.col("duration_ms")).alias("duration_ms"),
        total(ok, F.col("markdown_bytes")).alias("markdown_bytes"),
        total(ok, F.col("words")).alias("words"),
    )


def loads_by_source(usage: DataFrame, as_of: str = REPORT_AS_OF) -> DataFrame:
    """Browser page loads per source ('' → 'unknown') per period."""
    u = usage.withColumn("period", period_of(F.col("day"), as_of))
    u = u.where(F.col("period").isNotNull() & (F.col("event_name") == "browser_page_view"))
    src = F.when(F.col("source") == "", F.lit("unknown")).otherwise(F.col("source"))
    return u.groupBy("period", src.alias("source")).agg(F.sum("event_count").cast("bigint").alias("page_loads"))


def percentage_change(cur: Column, prev: Column) -> Column:
    """'0%' / 'new' when previous is 0, else the change with one decimal
    (exact integer arithmetic, ties away from zero as JS toFixed does)."""
    d = cur - prev
    tenths = int_div(F.abs(d) * 2000 + prev, 2 * prev)
    sign = F.when(d < 0, F.lit("-")).otherwise(F.lit(""))
    txt = F.concat(sign, int_div(tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
    return F.when(prev == 0, F.when(cur == 0, F.lit("0%")).otherwise(F.lit("new"))).otherwise(txt)


def int_div(a: Column, b: Column) -> Column:
    """Integer division of BIGINTs (null by zero), without a detour over doubles."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def report_table(summary: DataFrame, metrics: list[tuple[str, str]]) -> DataFrame:
    """Unpivot a per-period summary into (metric, current,
    previous, change) rows — one pass, conditional aggregation, no cross join."""
    stacked = summary.select(
        "period",
        F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(label).alias("metric"),
                                     F.col(key).cast("bigint").alias("value"))
                            for i, (label, key) in enumerate(metrics)])).alias("m"))
    agg = stacked.groupBy(F.col("m.ord").alias("ord"), F.col("m.metric").alias("metric")).agg(
        F.coalesce(F.sum(F.when(F.col("period") == "current", F.col("m.value"))), F.lit(0)).cast("bigint").alias("current"),
        F.coalesce(F.sum(F.when(F.col("period") == "previous", F.col("m.value"))), F.lit(0)).cast("bigint").alias("previous"),
    )
    return agg.select("ord", "metric", "current", "previous",
                      percentage_change(F.col("current"), F.col("previous")).alias("change"))


HTTP_METRICS = [("Visits", "visits"), ("Homepage requests", "homepage_requests"),
                ("Conversion endpoint requests", "api_attempts"),
                ("Successful endpoint responses", "api_successes"),
                ("Endpoint client errors", "api_client_errors"), ("Endpoint server errors", "api_server_errors")]
FIRST_PARTY_METRICS = [("Browser page loads", "browser_page_loads"), ("Input engagements", "input_engagements"),
                       ("Browser submits", "client_submits"), ("Completed conversion attempts", "conversion_attempts"),
                       ("Successful conversions", "conversion_successes"),
                       ("Completed conversion errors", "conversion_errors"),
                       ("Validation rejections", "validation_errors"), ("Cache hits", "cache_hits"),
                       ("Cache misses", "cache_misses"), ("Copies", "copies"), ("Downloads", "downloads")]


def day_spine(spark, start: str, end: str) -> DataFrame:
    """One row per day in [start, end)."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)),
                                                      F.date_sub(F.to_date(F.lit(end)), 1))).alias("d")) \
        .select(F.date_format("d", "yyyy-MM-dd").alias("day"))


def flatten_batches(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows of an answer's result batches, one each; a batch without results has none.

    ``payload`` is a JSON array of batches, each with an array ``results`` of objects.
    """
    rows = "array<struct<results:array<struct<day:string,event_name:string,event_count:bigint>>>>"
    batches = F.from_json(F.col(payload), rows)
    results = F.flatten(F.transform(batches, lambda b: F.coalesce(b["results"], F.array().cast("array<struct<day:string,event_name:string,event_count:bigint>>"))))
    return answers.select(*[c for c in answers.columns if c != payload], F.inline(results))
