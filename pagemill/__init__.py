"""pagemill — a Spark-native web-page → Markdown corpus engine.

Captured pages, posts and request logs are DataFrames; URL hygiene,
content extraction, cache-freshness replay, admission control and usage
reporting are DataFrame / SQL / Structured Streaming operators.

Subpackages
-----------
functions  Column-level scalar operators (URLs, text, time).
sources    Table readers and the frames derived from the base tables.
operators  DataFrame → DataFrame operators (documents, posts, usage, ...).
plans      The query catalogue (Spark plans + their SQL oracles).
streaming  Structured Streaming twins of the batch operators.
"""

from pagemill.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
