"""Connected components and near-duplicate links over DataFrames (no Python workers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import discard, is_empty, staged


def _staged_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number with a sum of hashes."""
    seen = Observation()
    table = staged(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s")), "edges")
    return table, (seen.get["n"], seen.get["s"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of each end of ``edges`` (u, v); component is the smallest id reachable.

    Distributed union-find by alternating large-star and small-star steps: each
    step links a node's neighbours to the smallest of them.  Minima are
    aggregated before the shuffle, so a hub costs one row a task; each round
    is a written table.  The number of rounds is logarithmic in a component's
    size.
    """
    ends = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, state = _staged_edges(ends.distinct())
    before = None
    for _ in range(max_rounds):
        if state[0] == 0 or state == before:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.join(least, "u").where("v > u and v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, last = state, now
        now, state = _staged_edges(small)
        discard(last)
    return (now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))))


def hub_pairs(rows: DataFrame, name: str) -> DataFrame:
    """(list, id, size, hub) of each member of ``rows`` (list, id, size, n) but the hubs.

    A list's hub is the member whose lists are the largest: of a group of near
    copies that is the text they come from.  ``n`` is the list's length.
    """
    # an id is in as many lists as its sketch has runs
    rows = rows.withColumn("weight", F.sum("n").over(Window.partitionBy("id"))).select("list", "id", "size", "weight")
    hubs = rows.groupBy("list").agg(F.max(F.struct("weight", (-F.col("id")).alias("m"))).alias("top"))
    hubs = hubs.select("list", (-F.col("top.m")).alias("hub"))
    return staged(rows.join(hubs, "list").where("id <> hub").select("list", "id", "size", "hub"), name)


def linked(members: DataFrame, prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], reach: float, name: str,
           max_rounds: int = 4, pairs_a_row: int = 64) -> DataFrame:
    """Links (u, v) that connect all ids which are similar and share a list.

    ``members`` has (list, id, size): the size of the id's set, or null; with a
    column n, the length of the list, lists of one are left out already.  Ids are
    similar up to the Jaccard distance ``reach``.  ``prepare`` gets the ids
    that share a list and returns ``verify``, which takes pairs (a, b) and
    returns them with ``distance``, null only where it is surely over twice
    ``reach``.  The ids are a table that goes after the first round: ``prepare``
    must have read them when it returns.  What ``verify`` returns is written
    before it is called again.  Its attribute ``close``, if there is one, need not return pairs
    over ``reach``.  With ``marked`` (members to members with a ``mark``) and
    ``marks_fit`` (two marks to a condition) pairs that ``close`` would not
    return need not be made at the end, where there are several a row.

    Not all pairs of a list are compared.  Each list's members are compared
    with its hub (``hub_pairs``).  The distance is a metric, so two
    members are not similar if their distances from the hub differ by more
    than ``reach``: members near the hub but not linked to it are compared with
    those linked members that this leaves.  Members that are not linked form
    the list of the next round.  So a large group of near copies costs one
    comparison a copy, and no link that would join two components is lost.
    Once at most ``pairs_a_row`` pairs a row are left, those of fitting sizes
    are compared.
    """
    found, verify, star = [], None, None

    def links(pairs: DataFrame) -> None:
        near = getattr(verify, "close", verify)(pairs).where(F.col("distance") <= reach)
        found.append(staged(near.select(F.col("a").alias("u"), F.col("b").alias("v")), name))

    for at in range(max_rounds):
        if "n" not in members.columns:
            lists = members.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
            members = members.join(lists, "list")
        rows = staged(members, name)
        if star is not None:
            discard(star)
        size = rows.agg(F.count("*"), F.sum((F.col("n") - 1) / 2)).first()
        if not size[0]:
            break
        if verify is None:
            verify = prepare(rows.select("id").distinct())
        if size[1] <= size[0] or at and size[1] <= pairs_a_row * size[0] or at == max_rounds - 1:
            marked = getattr(verify, "marked", lambda members: members.withColumn("mark", F.lit(None).cast("int")))(rows)
            left = marked.select("list", F.col("id").alias("a"), F.col("size").alias("sa"), F.col("mark").alias("ma"))
            right = marked.select("list", F.col("id").alias("b"), F.col("size").alias("sb"), F.col("mark").alias("mb"))
            sizes = F.coalesce(F.least("sa", "sb") >= (1 - reach) * F.greatest("sa", "sb"), F.lit(True))
            fit = (F.col("a") < F.col("b")) & sizes
            if hasattr(verify, "marks_fit"):
                fit = fit & verify.marks_fit(F.col("ma"), F.col("mb"))
            links(left.join(right, (left["list"] == right["list"]) & fit).select("a", "b").distinct())
            discard(rows)
            break
        star = hub_pairs(rows, name)
        discard(rows)
        judged = verify(star.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
        judged = staged(judged.select(F.col("a").alias("hub"), F.col("b").alias("id"), "distance"), name)
        link = judged.where(F.col("distance") <= reach)
        found.append(link.select(F.col("hub").alias("u"), F.col("id").alias("v")))
        middle = judged.where((F.col("distance") > reach) & (F.col("distance") <= 2 * reach + 1e-9))
        if not is_empty(middle):
            between = (middle.select("hub", F.col("id").alias("x"), F.col("distance").alias("dx"))
                       .join(link.select("hub", F.col("id").alias("y"), F.col("distance").alias("dy")), "hub")
                       .where(F.col("dx") - F.col("dy") <= reach + 1e-9))
            links(between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        members = star.join(link.select("hub", "id"), ["hub", "id"], "left_anti").select("list", "id", "size")
    if not found:
        return members.select(F.col("id").alias("u"), F.col("id").alias("v")).where("false")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
