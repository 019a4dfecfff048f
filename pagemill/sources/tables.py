"""Readers for the base tables (parquet) with explicit column pruning.

Every reader returns a lazy DataFrame: Catalyst pushes filters and the
projection into the parquet scan (``PushedFilters`` / ``ReadSchema``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def read_pages(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages", *(cols or ("page_id", "url", "html")))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as a UTC TIMESTAMP (the file stores TIMESTAMP_NTZ,
    which watermarks and unix_* functions reject)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.withColumn("ts", F.col("ts").cast("timestamp"))
