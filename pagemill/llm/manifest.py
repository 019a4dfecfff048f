"""Operator 12: Merkle manifest of a dataset, with inclusion proofs by checkpoint and recompute.

Every row is a leaf.  The leaves of a group (a language) stand in order of
their ids; every eight consecutive nodes become one node of the next level
until one is left, the group's subroot.  The subroots, in order of the groups,
are the leaves of one more such tree, which ends in the root.

Only each third level is stored.  A block of 512 nodes of a stored level is an
aligned subtree; one task raises it to its top, and the interior is thrown
away.  Proofs go down the same blocks: a block joins the path above its top,
regenerates its interior from the stored nodes, and hands each node its
siblings.  A leaf's place comes from a range exchange on (group, id) with
counts by partition, so no group is ever sorted in one task.

Nulls: a null field counts as ``-``; a null group is a group of its own and
comes first; rows without id come first in their group.  Rows that share an id
are ordered by their leaf; equal rows are leaves each.  Long texts are hashed
whole.  An empty table has no leaves and gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import documents, query, sha256_text, staged

ARITY = 8
STEP = 3                          # levels from one stored level to the next
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of a row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    told = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
            for c in fields]
    return sha256_text(F.concat(*told))


def _height(n: int, arity: int) -> int:
    h = 0
    while n > arity ** h:
        h += 1
    return h


def _levels(nodes: list[str], arity: int, height: int) -> list[list[str]]:
    """Hashes of a subtree, level by level from ``nodes`` upwards."""
    import hashlib

    levels = [nodes]
    for _ in range(height):
        low = levels[-1]
        levels.append([hashlib.sha256("".join(low[i:i + arity]).encode()).hexdigest() for i in range(0, len(low), arity)])
    return levels


def _siblings(levels: list[list[str]], at: int, arity: int) -> list[tuple[str, str]]:
    """For node ``at`` of the lowest level: hashes before and after it in its run, level by level."""
    path = []
    for low in levels[:-1]:
        first = at // arity * arity
        path.append(("".join(low[first:at]), "".join(low[at + 1:first + arity])))
        at //= arity
    return path


def fold(leaf: str, path) -> str:
    """Root that a leaf and the hashes beside its way up give."""
    import hashlib

    for before, after in path:
        leaf = hashlib.sha256((before + leaf + after).encode()).hexdigest()
    return leaf


def _positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with pos, a row's place in its group ``g`` in the given order, and m, the group's size."""
    def numbered(batches):
        import numpy as np
        import pyarrow as pa

        last, count = None, 0
        for batch in batches:
            groups = batch.column("g").to_pylist()
            seq = np.empty(len(groups), np.int64)
            for i, g in enumerate(groups):
                last, count = g, count + 1 if g == last else 0
                seq[i] = count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq)], names=[*batch.schema.names, "seq"])

    keys = [F.col("g"), *(F.col(c).asc_nulls_first() for c in order)]
    cols = df.columns
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", seq long"
    dealt = staged(dealt.mapInArrow(numbered, schema), name)
    # one row a partition and group: as many as partitions and groups together
    counts = dealt.groupBy("part", "g").agg(F.count("*").alias("n"))
    every = Window.partitionBy("g")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"), F.sum("n").over(every).alias("m"))
    return dealt.join(counts, ["part", "g"]).select(*cols, (F.col("skipped") + F.col("seq")).alias("pos"), "m")


def _blocks(nodes: DataFrame, width: int, *more: str) -> DataFrame:
    """One row a block: g, block, m and its nodes in order."""
    return (nodes.withColumn("block", F.expr(f"pos div {width}"))
            .groupBy("g", "block").agg(F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("pos", "h", *more))).alias("nodes")))


def _raise_blocks(arity: int, step: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            tops = [_levels([n["h"] for n in nodes], arity, min(step, _height(m, arity)))[-1][0]
                    for nodes, m in zip(batch.column("nodes").to_pylist(), batch.column("m").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("block"), batch.column("m"), pa.array(tops, pa.string())],
                                             names=["g", "pos", "m", "h"])

    return run


class Tree:
    """Stored levels of the trees of all groups, and each group's top (g, h)."""

    def __init__(self, leaves: DataFrame, name: str, arity: int = ARITY, step: int = STEP):
        """``leaves``: g, pos, m, h and what else a proof is to carry."""
        self.arity, self.step, self.name, self.width = arity, step, name, arity ** step
        self.stored = [leaves]
        tops = []
        widest = leaves.agg(F.max("m")).first()[0] or 0
        while widest:
            raised = staged(_blocks(self.stored[-1], self.width).select("g", "block", "m", F.col("nodes"))
                            .mapInArrow(_raise_blocks(arity, step), "g string, pos long, m long, h string"), f"{name}-level{len(self.stored)}")
            tops.append(raised.where(F.col("m") <= self.width).select("g", "h"))
            widest = -(-widest // self.width) if widest > self.width else 0
            if widest:
                self.stored.append(raised.where(F.col("m") > self.width)
                                   .select("g", "pos", F.expr(f"(m + {self.width - 1}) div {self.width}").alias("m"), "h"))
        self.tops = tops[0] if tops else leaves.select("g", "h").limit(0)
        for t in tops[1:]:
            self.tops = self.tops.unionAll(t)

    def _parents(self, r: int, above: DataFrame, tops: DataFrame) -> DataFrame:
        """g, block and the path above the top of each block of stored level ``r``."""
        ended = self.stored[r].where((F.col("m") <= self.width) & (F.col("pos") == 0)).select("g").distinct()
        told = tops.columns[1:]
        whole = tops.join(ended, "g", "left_semi").select("g", F.lit(0).cast("long").alias("block"), *told)
        return whole if above is None else whole.unionAll(above.select("g", F.col("pos").alias("block"), *told))

    def descend(self, tops: DataFrame, finish, schema: str, *more: str) -> DataFrame:
        """Rows that ``finish`` makes of each leaf and its path.

        ``tops``: g, path (from the group's top upwards) and columns that are
        handed down.  ``more`` names columns of the leaves.
        """
        told = [c for c in tops.columns if c not in ("g", "path")]
        handed = "".join(f", `{c}` string" for c in told)
        above = None
        for r in range(len(self.stored) - 1, 0, -1):
            work = _blocks(self.stored[r], self.width).join(self._parents(r, above, tops), ["g", "block"])
            above = staged(work.mapInArrow(self._paths(told), f"g string, pos long, path {PATH}{handed}"), f"{self.name}-paths{r}")
            above = above.select("g", "pos", *tops.columns[1:])
        work = _blocks(self.stored[0], self.width, *more).join(self._parents(0, above, tops), ["g", "block"])
        return work.mapInArrow(self._finished(finish, told, to_arrow_schema(StructType.fromDDL(schema))), schema)

    def _regenerated(self):
        arity, step = self.arity, self.step

        def run(row):
            return _levels([n["h"] for n in row["nodes"]], arity, min(step, _height(row["m"], arity)))

        return run

    def _paths(self, told: list[str]):
        levels, arity = self._regenerated(), self.arity

        def run(batches):
            import pyarrow as pa

            kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
            for batch in batches:
                out: dict = {c: [] for c in ("g", "pos", "path", *told)}
                for row in batch.to_pylist():
                    tree = levels(row)
                    up = [(p["before"], p["after"]) for p in row["path"]]
                    for i, n in enumerate(row["nodes"]):
                        out["g"].append(row["g"])
                        out["pos"].append(n["pos"])
                        out["path"].append([{"before": b, "after": a} for b, a in _siblings(tree, i, arity) + up])
                        for c in told:
                            out[c].append(row[c])
                yield pa.RecordBatch.from_arrays([pa.array(out["g"], pa.string()), pa.array(out["pos"], pa.int64()), pa.array(out["path"], kind),
                                                  *(pa.array(out[c], pa.string()) for c in told)], names=list(out))

        return run

    def _finished(self, finish, told: list[str], schema):
        levels, arity = self._regenerated(), self.arity

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for row in batch.to_pylist():
                    tree = levels(row)
                    up = [(p["before"], p["after"]) for p in row["path"]]
                    made = [finish(n, _siblings(tree, i, arity) + up, {c: row[c] for c in told}) for i, n in enumerate(row["nodes"])]
                    yield pa.RecordBatch.from_pylist(made, schema)

        return run


class Manifest:
    """Trees of a dataset: ``groups`` (one a value of ``group``) and ``whole`` (over their subroots).

    ``observed`` gives, by field, the values found when the rows are checked
    against the manifest; by default they are those the leaves are made of.
    """

    def __init__(self, docs: DataFrame, fields=FIELDS, group: str = "lang", key: str = "doc_id", observed: dict | None = None,
                 arity: int = ARITY, step: int = STEP):
        now = [(observed or {}).get(f, F.col(f)) for f in fields]
        changed = F.lit(False)
        for f in observed or {}:
            changed = changed | ~F.col(f).eqNullSafe(observed[f])
        own = leaf_hash([F.col(f) for f in fields])
        leaves = docs.select(
            F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("g"),
            F.col(key).cast("long").alias("id"), own.alias("h"), F.when(changed, leaf_hash(now)).alias("found"),
            F.monotonically_increasing_id().alias("salt"))       # tells equal rows apart, so that they spread
        leaves = _positions(staged(leaves, "op12-leaves"), ["id", "h", "salt"], "op12-places").drop("salt")
        self.groups = Tree(leaves, "op12-groups", arity, step)
        tops = self.groups.tops.select(F.lit("all").alias("g"), F.col("g").alias("group_key"), "h")
        self.whole = Tree(_positions(tops, ["group_key"], "op12-subroots"), "op12-whole", arity, step)

    def root(self) -> DataFrame:
        return self.whole.tops.select(F.col("h").alias("root"))

    def _above(self) -> DataFrame:
        """g, path, subroot and root of each group: the proofs of the upper tree."""
        start = self.whole.tops.select("g", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("h").alias("root"))

        def finish(node, path, told):
            return {"g": node["group_key"], "path": [{"before": b, "after": a} for b, a in path], "subroot": node["h"], "root": told["root"]}

        return staged(self.whole.descend(start, finish, f"g string, path {PATH}, subroot string, root string", "group_key"), "op12-above")

    def proofs(self) -> DataFrame:
        """id, leaf, subroot, root and path: for each level, hashes before and after the node in its run."""
        def finish(node, path, told):
            return {"id": node["id"], "leaf": node["h"], "subroot": told["subroot"], "root": told["root"],
                    "path": [{"before": b, "after": a} for b, a in path]}

        return self.groups.descend(self._above(), finish, f"id long, leaf string, subroot string, root string, path {PATH}", "id")

    def checked(self) -> DataFrame:
        """id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

        folded_root is what the row as it was found gives with its proof.
        """
        def finish(node, path, told):
            import hashlib

            folded = fold(node["h"] if node["found"] is None else node["found"], path)
            proof = hashlib.sha256("".join(b + a for b, a in path).encode()).hexdigest()
            return {"id": node["id"], "leaf": node["h"], "subroot": told["subroot"], "root": told["root"], "proof_sha256": proof,
                    "folded_root": folded, "verified": folded == told["root"]}

        return self.groups.descend(self._above(), finish, "id long, leaf string, subroot string, root string, proof_sha256 string, "
                                   "folded_root string, verified boolean", "id", "found")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(docs: DataFrame) -> dict[str, Column]:
    """Lower-cased texts where 3 divides the CRC-32 of the decimal doc_id."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return {"text": F.when(chosen, lower_ascii(F.col("text"))).otherwise(F.col("text"))}


# CRC-32 by half bytes: c is shifted four bits, the table holds what the four bits add.
ORACLE = """
WITH RECURSIVE t AS (
  SELECT list_transform(range(0, 16), lambda n: list_reduce([n, 0, 0, 0, 0], lambda c, z:
           CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), d AS (
  SELECT *, row_number() OVER () AS rid, list_reduce(list_concat([4294967295::BIGINT], list_transform(
              string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b:
              xor(xor(xor(c, b) >> 4, CAST(tab[1 + CAST(xor(c, b) & 15 AS INTEGER)] AS BIGINT)) >> 4,
                  CAST(tab[1 + CAST(xor(xor(c, b) >> 4, CAST(tab[1 + CAST(xor(c, b) & 15 AS INTEGER)] AS BIGINT)) & 15 AS INTEGER)] AS BIGINT))) AS c
  FROM documents, t
), f AS (
  SELECT rid, doc_id, lang, text, concat_ws('',
      coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head,
    CASE WHEN xor(c, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS found
  FROM d
), leaf AS (
  SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
         sha256(head || coalesce(strlen(found) || ':' || found, '-')) AS found FROM f
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h, rid) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS m FROM leaf
), node(lang, lev, pos, m, h) AS (
  SELECT lang, 0, pos, m, h FROM placed
  UNION ALL
  SELECT lang, any_value(lev) + 1, pos // 8, any_value((m + 7) // 8), sha256(string_agg(h, '' ORDER BY pos))
  FROM node WHERE m > 1 GROUP BY lang, pos // 8
), sub AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM node WHERE m = 1
), top(lev, pos, m, h) AS (
  SELECT 0, pos, m, h FROM sub
  UNION ALL
  SELECT any_value(lev) + 1, pos // 8, any_value((m + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE m > 1 GROUP BY pos // 8
), up AS (
  SELECT p.rid, n.lev, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < n.pos), '') AS bef,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > n.pos), '') AS aft
  FROM placed p JOIN node n ON n.lang IS NOT DISTINCT FROM p.lang AND n.pos = p.pos // CAST(pow(8, n.lev) AS BIGINT) AND n.m > 1
  JOIN node s ON s.lang IS NOT DISTINCT FROM n.lang AND s.lev = n.lev AND s.pos // 8 = n.pos // 8
  GROUP BY p.rid, n.lev
  UNION ALL
  SELECT p.rid, 1000 + n.lev, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < n.pos), ''),
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > n.pos), '')
  FROM placed p JOIN sub b ON b.lang IS NOT DISTINCT FROM p.lang JOIN top n ON n.pos = b.pos // CAST(pow(8, n.lev) AS BIGINT) AND n.m > 1
  JOIN top s ON s.lev = n.lev AND s.pos // 8 = n.pos // 8
  GROUP BY p.rid, n.lev
), proof AS (
  SELECT p.rid, list([bef, aft] ORDER BY lev) FILTER (lev IS NOT NULL) AS path, coalesce(string_agg(bef || aft, '' ORDER BY lev), '') AS joined
  FROM placed p LEFT JOIN up USING (rid) GROUP BY p.rid
), result AS (
  SELECT p.doc_id, p.h AS leaf, b.h AS subroot, r.h AS root, sha256(joined) AS proof_sha256,
         list_reduce(list_concat([[p.found, '']], coalesce(path, [])), lambda a, x: [sha256(x[1] || a[1] || x[2]), ''])[1] AS folded_root
  FROM placed p JOIN proof USING (rid) JOIN sub b ON b.lang IS NOT DISTINCT FROM p.lang, (SELECT h FROM top WHERE m = 1) r
)
SELECT *, folded_root = root AS verified FROM result
"""


@query("op12_manifest", ORACLE)
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, *FIELDS)
    return Manifest(docs, observed=tampered(docs)).checked().withColumnRenamed("id", "doc_id")
