"""Per-row staging barrier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, **cols: Column) -> DataFrame:
    """Add ``cols`` to ``df`` through a one-row generator.

    Catalyst re-inlines a projected expression into every consumer that
    references it once (CollapseProject) and into pushed-down predicates.
    For per-page array work that is wrong: an expression such as "positions
    of removed elements" would be re-evaluated inside a per-node lambda,
    turning O(n) into O(n²).  Columns produced by a generator are attributes
    that no rule can inline, so each staged value is computed exactly once
    per row.  The generator emits exactly one row per input row.
    """
    names = list(cols)
    packed = F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, packed)
