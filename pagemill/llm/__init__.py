"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; ``QUERIES`` and
``ORACLES`` hold its registered queries and their DuckDB SQL.
"""

from . import bpe, decontamination, html_text, language_id, lexical, line_dedup, manifest, near_dedup, pieces, sharding, suffix_dedup, token_counts, topk  # noqa: F401
from .common import LLM_ORACLES as ORACLES
from .common import LLM_QUERIES as QUERIES

__all__ = ["ORACLES", "QUERIES"]
