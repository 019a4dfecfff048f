"""Request outcomes against a plain replay of the decision."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import outcomes as O
from pagemill.operators import usage as G

T0 = dt.datetime(2024, 1, 10)
STORE = "cache_key string, page_id int, fetched_at timestamp, expires_at timestamp, version int, markdown string, provider string, words long, markdown_bytes long"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    requests = [(i, T0 + dt.timedelta(seconds=rng.randrange(600)), rng.choice(["hot"] * 3 + ["a", "b", None]), v, None if v != "ok" else rng.choice(["k0"] * 4 + [f"k{j}" for j in range(9)]), 7)
                for i in range(900) for v in [rng.choice(["ok"] * 8 + ["missing_url", "private", "scheme"])]]
    store = []
    for j in range(8):
        for n in range(rng.randrange(3)):
            at = T0 + dt.timedelta(seconds=rng.randrange(-90_000, 500))
            store.append((f"k{j}", len(store), at, at + dt.timedelta(seconds=rng.choice([50, 90_300, 200_000])), rng.choice([1, 1, 1, 2]), rng.choice(["md", "md", None]), f"p{n}", 10 * j, j))
    store.append(("k0", 99, T0 - dt.timedelta(days=3), T0 - dt.timedelta(days=1), 1, "old", "px", 5, 6))
    results = [(f"k{j}", j % 3 != 1, "made", 100 + j, j) for j in range(7)]
    return requests, store, results


def plain(requests, store, results, limit=10):
    got, used, made = {}, {}, {k: (ok, p, w, b) for k, ok, p, w, b in results}
    for i, ts, actor, verdict, key, _ in sorted(requests, key=lambda r: (r[1], r[0])):
        if verdict != "ok":
            got[i] = ("missing_url" if verdict == "missing_url" else "invalid_url", 400, None, None, None, None)
            continue
        rows = sorted((r for r in store if r[0] == key and r[2] <= ts), key=lambda r: (r[2], r[1]))
        row = rows[-1] if rows and rows[-1][4] == 1 and rows[-1][5] is not None else None
        if row and row[3] > ts:
            got[i] = ("success", 200, "HIT", "edge" if ts < row[2] + dt.timedelta(days=1) else "r2", row[6], row[7])
            continue
        slot = (actor, ts.replace(second=0))
        used[slot] = used.get(slot, 0) + 1
        ok, p, w, _ = made.get(key, (False, None, None, None))
        if used[slot] <= limit and ok:
            got[i] = ("success", 200, "MISS", "origin", p, w)
        elif row:
            got[i] = ("success", 200, "STALE", "r2", row[6], row[7])
        else:
            got[i] = ("rate_limited", 429, None, None, None, None) if used[slot] > limit else ("extraction_failed", 502, None, None, None, None)
    return got


def frames(spark, tables):
    requests, store, results = tables
    return (spark.createDataFrame(requests, "event_id int, ts timestamp, actor string, verdict string, cache_key string, duration_ms int"), spark.createDataFrame(store, STORE),
            spark.createDataFrame(results, "cache_key string, ok boolean, provider string, words long, markdown_bytes long"))


def test_outcomes(spark, tables):
    rows = O.decide(*frames(spark, tables), F.col("actor")).collect()
    got = {r.event_id: (r.outcome, r.status_code, r.cache_status, r.source, r.provider, r.words) for r in rows}
    want = plain(*tables)
    assert len(rows) == len(want) and got == want
    assert {x[0] for x in want.values()} == set(O.STATUS) and {x[2] for x in want.values()} == {None, "HIT", "STALE", "MISS"}
    assert all(r.stale == (r.cache_status == "STALE") for r in rows)


def test_usage_and_efficiency(spark, tables):
    usage = G.rollup_usage(O.usage_events(O.decide(*frames(spark, tables), F.col("actor"))))
    want = plain(*tables)
    assert usage.agg(F.sum("event_count")).first()[0] == len(want)
    for r in O.cache_efficiency(usage).collect():
        mine = [x[2] for x in want.values() if (x[4], x[3]) == (r.provider, r.source)]
        assert (r.hits, r.misses, r.stale) == tuple(mine.count(s) for s in ("HIT", "MISS", "STALE"))
        assert r.hit_rate == (r.hits + r.stale) / len(mine)


def test_empty_tables(spark, tables):
    requests, store, results = frames(spark, tables)
    assert O.decide(requests.limit(0), store, results, F.col("actor")).collect() == []
    rows = O.decide(requests, store.limit(0), results.limit(0), F.col("actor")).collect()
    assert {r.outcome for r in rows} == {"missing_url", "invalid_url", "rate_limited", "extraction_failed"}


def test_one_pass_over_the_requests(spark, tables):
    plan = O.decide(*frames(spark, tables), F.col("actor"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("duration_ms#") and plan.count("LogicalRDD") == 3
