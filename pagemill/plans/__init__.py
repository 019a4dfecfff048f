"""The query catalogue.  Importing this package registers every query."""

from pagemill.plans import (  # noqa: F401
    article_queries, capture_queries, doc_queries, extraction_queries, freshness_queries, outcome_queries, post_queries, site_queries, stream_queries, url_queries,
    usage_queries, wiki_queries,
)
from pagemill.plans.registry import OPERATORS, ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "OPERATORS"]
