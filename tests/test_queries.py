"""Every registered query runs; a sample is compared with its DuckDB oracle
at sf0.001 (the driver compares all of them at sf0.01)."""

import duckdb
import pytest

from pagemill.plans import ORACLES, QUERIES
from pagemill.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ["q_url_reject", "q_extract", "q_usage_daily", "q_cache_replay", "q_admission", "q_article_markdown",
          "q_report_first_party", "q_selector_hits", "q_redirects", "q_stream_daily", "q_markdown_text", "q_slim_size",
          "q_beacon_status", "q_post_markdown", "q_store_upsert", "q_redirect_resolve", "q_article", "q_outcomes"]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(res.fetchall(), dcols)


def test_every_query_has_stable_schema(spark):
    for name, fn in QUERIES.items():
        assert fn(spark, SF).schema is not None, name


def test_entry(spark):
    import __spark_entry__ as E
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
