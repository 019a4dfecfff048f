"""Sinks: a version counts as a whole or not at all."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pagemill.sources import sinks as S


def docs(spark, rows):
    return spark.createDataFrame(rows, "filename string, markdown string")


def held(spark, path):
    return sorted(map(tuple, S.read_documents(spark, str(path)).collect()))


def test_each_document_is_one_file(spark, tmp_path):
    rows = [(f"Page-{i}.md", f"# Page {i}\n\ntext\r\n") for i in range(40)] + [("empty.md", None), ("a+b é%20.md", "x")]
    assert held(spark, tmp_path) == []
    S.write_documents(docs(spark, rows).withColumn("more", F.lit(1)), str(tmp_path))
    assert held(spark, tmp_path) == sorted((n, t) for n, t in rows if t)
    assert sorted(f for _, _, files in os.walk(tmp_path) for f in files if f.endswith(".md")) == sorted(n for n, _ in rows)
    S.write_documents(docs(spark, rows[:3]), str(tmp_path))                 # the next version replaces the last
    assert held(spark, tmp_path) == rows[:3]
    assert len(S.drop_old_versions(spark, str(tmp_path))) == 1 and held(spark, tmp_path) == rows[:3]
    S.write_documents(docs(spark, []), str(tmp_path))
    assert held(spark, tmp_path) == []


@pytest.mark.parametrize("bad", [("a.md", "again"), ("../x.md", "out"), ("", "none"), (None, "none")])
def test_a_failed_write_leaves_the_last_version(spark, tmp_path, bad):
    good = [("a.md", "1"), ("b.md", "2")]
    S.write_documents(docs(spark, good), str(tmp_path))
    with pytest.raises(Exception):
        S.write_documents(docs(spark, [*((f"{i}.md", "n") for i in range(9)), ("a.md", "new"), bad]), str(tmp_path))
    assert held(spark, tmp_path) == good and not os.path.exists(tmp_path.parent / "x.md")


STORE = "cache_key string, page_id int, fetched_at timestamp, markdown string"


def test_store_versions(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    path = f"file:{tmp_path}/store"
    assert S.read_versioned(spark, path) is None
    first = S.upsert_versioned(spark.createDataFrame([("a", 1, at(1), "a1"), ("b", 2, at(1), "b1"), ("b", 3, at(1), "b2")], STORE), path)
    second = S.upsert_versioned(spark.createDataFrame([("a", 4, at(3), "a3"), ("b", 5, dt.datetime(2023, 1, 1), "old"), ("c", 6, at(2), None)], STORE), path)
    rows = {r.cache_key: r.markdown for r in S.read_versioned(spark, path).collect()}
    assert rows == {"a": "a3", "b": "b2", "c": None} and S.current_version(spark, path) == second != first
    broken = spark.createDataFrame([("a", 9, at(9), "x")], STORE).withColumn("markdown", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        S.upsert_versioned(broken, path)
    assert S.current_version(spark, path) == second
    gone = S.drop_old_versions(spark, path)
    assert first in gone and second not in gone and S.read_versioned(spark, path).count() == 3
