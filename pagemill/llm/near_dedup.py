"""Operator 3: near-duplicate documents by bottom-k MinHash sketches.

A document's set holds the hashes of its distinct word shingles; its sketch
the k least of them, from one hash function.  Documents with equal sets are
one class from the start.  Inverted lists: the key of a list is a run of four
consecutive sketch values, so that documents in one list share them; a pair
with similarity 0.85 misses all lists with a probability of about 1e-8 (6e-7
at 0.8).  Small sets, whose whole order is in the sketch, share one for
certain: the d shingles that two sets do not share cut the others into at most
d + 1 runs, so up to 15 shingles runs of three count too, up to 5 runs of two.  Pairs of a list pass when
their union's sketch puts the similarity near the threshold or above, and are
verified on the full sets (64-bit hashes).

A list of many is not turned into pairs.  Its members are compared with its
hub; pairs that the triangle inequality of the Jaccard distance cannot settle
from there are compared in blocks of a hub's members inside the tasks, which
return links only.

Null, empty and blank texts have no set and are linked with nothing.  With
fewer words than a shingle the whole sequence is the one shingle.  Rows that
share a doc_id are one document node with a row each.  A row without doc_id
is never kept; its component is that of the documents with its set, or null.
Other columns are
ignored by ``near_duplicates``.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, query, staged
from .graph import components, hub_pairs

SKETCH = 64
BLOCK = 128                   # members of a hub that a task holds twice of
BROADCAST_IDS = 500_000      # documents whose ids (8 bytes each) go to all tasks; beyond, a join
RUN = 4
SPACES = [0x20, *range(0x09, 0x0E)]


def _sets(column, words_a_shingle: int):
    """For each value of a text column: its row and the sorted hashes of its set."""
    import numpy as np

    from .textbytes import chunks, grams, mix, table_without, words

    table = table_without(SPACES)
    for first, offsets, data in chunks(column):
        row, h, _, _ = words(offsets, data, table)
        count = np.bincount(row, minlength=len(offsets) - 1)
        r, g, _ = grams(row, h, words_a_shingle)
        cut = np.searchsorted(r, np.arange(len(count) + 1))
        begin = np.cumsum(count) - count
        for i, n in enumerate(count.tolist()):
            if n >= words_a_shingle:
                own = np.sort(g[cut[i]:cut[i + 1]])
                keep = np.ones(len(own), bool)
                keep[1:] = own[1:] != own[:-1]
                yield first + i, own[keep]
            elif n:
                s = slice(begin[i], begin[i] + n)
                whole = grams(row[s], h[s], n)[1]
                yield first + i, mix(whole ^ np.uint64(n))


def _sketches(words_a_shingle: int, k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .textbytes import mix

        for batch in batches:
            n = batch.num_rows
            size, print_, cut, kept = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros(n + 1, np.int64), []
            for i, own in _sets(batch.column("text"), words_a_shingle):
                size[i] = len(own)
                print_[i] = own.sum(), mix(own).sum()
                kept.append(own[:k])
                cut[i + 1] = len(kept[-1])
            flat = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(print_[:, 0].copy().view(np.int64)),
                 pa.array(print_[:, 1].copy().view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.cumsum(cut).astype(np.int32)), pa.array(flat.view(np.int64)))],
                names=["doc_id", "n_shingles", "p1", "p2", "sketch"])

    return run


def _whole_sets(words_a_shingle: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows, sets = [], []
            for i, own in _sets(batch.column("text"), words_a_shingle):
                rows.append(i)
                sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())),
                                              pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return run


def _linked_pairs(sets, threshold: int):
    """Which pairs of sets are similar, as a matrix: intersections are products of incidence columns, a stretch at a time."""
    import numpy as np

    size = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), size)
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column_of = np.cumsum(count > 1) - 1                     # only hashes that two sets have
    shared = count[column] > 1
    of, column = of[shared], column_of[column[shared]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for start in range(0, int(column_of[-1]) + 1 if len(column_of) else 0, 4096):
        s = slice(*np.searchsorted(column, [start, start + 4096]))
        part = np.zeros((len(sets), 4096), np.float32)
        part[of[s], column[s] - start] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    return 100 * common.astype(np.float64) >= threshold * union


def _block_links(threshold: int, reach: float):
    """Rows (hub, lo, hi, own block, id, distance, set) sorted by block pair to the links between the two blocks."""

    def links(rows):
        import numpy as np

        lo, hi = rows[0][1], rows[0][2]
        d = np.array([np.inf if r[5] is None else r[5] for r in rows])
        own = np.array([r[3] for r in rows])
        ok = _linked_pairs([r[6] for r in rows], threshold)
        ok &= ~((d <= reach)[:, None] & (d <= reach)[None, :])
        if lo != hi:
            ok &= own[:, None] != own[None, :]
        a, b = np.nonzero(np.triu(ok, 1))
        ids = np.array([r[4] for r in rows], np.int64)
        return ids[a], ids[b]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def told(groups):
            u, v = (np.concatenate(x) for x in zip(*map(links, groups)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        rows = []
        for batch in batches:
            plain = [batch.column(i).to_pylist() for i in range(6)]
            flat, cut = batch.column(6).flatten().to_numpy(), batch.column(6).offsets.to_numpy()
            cut = cut - cut[0]
            done = []
            for i, row in enumerate(zip(*plain)):
                if rows and rows[-1][:3] != row[:3]:
                    done.append(rows)
                    rows = []
                rows.append((*row, flat[cut[i]:cut[i + 1]]))
            if done:
                yield told(done)
        if rows:
            yield told([rows])

    return run


def _unsigned(c):
    return F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(2 ** 63))))


def near_duplicates(docs: DataFrame, threshold: int = 85, words_a_shingle: int = 3, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text).

    Documents are linked when 100 * intersection >= threshold * union of their sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(docs.mapInArrow(_sketches(words_a_shingle, k),
                                  "doc_id long, n_shingles long, p1 long, p2 long, sketch array<long>"), "op3")
    same = ["n_shingles", "p1", "p2"]
    classes = rows.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    own = rows.where("n_shingles > 0").select("doc_id", *same, "sketch")
    # a class is named by its smallest doc_id; its sketch comes from that row
    reps = own.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", *same])
    reps = staged(reps.select(F.col("doc_id").alias("id"), "n_shingles", "sketch"), "op3")

    # sets whose size allows no other similar set (5 / 6 < 0.85) need no list
    least = next(n for n in range(1, 1000) if 100 * n >= threshold * (n + 1))
    at = F.sequence(F.lit(1), F.greatest(F.size("sketch") - F.col("run") + 1, F.lit(1)))
    keys = (reps.where(F.col("n_shingles") >= least)
            .withColumn("run", F.explode(F.when(F.col("n_shingles") <= 5, F.array(*map(F.lit, (RUN - 2, RUN - 1, RUN))))
                                         .when(F.col("n_shingles") <= 15, F.array(F.lit(RUN - 1), F.lit(RUN)))
                                         .otherwise(F.array(F.lit(RUN)))))
            .select("id", F.explode(F.transform(at, lambda i: F.xxhash64(F.slice("sketch", i, F.col("run"))))).alias("list")))

    lists = staged(keys.groupBy("list").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("n > 1"), "op3")
    # lists of the same two documents are one; only of larger ones the members must be looked up
    two = lists.where("n = 2").groupBy("low", "high").agg(F.min("list").alias("list"))
    members = (two.select("list", F.explode(F.array("low", "high")).alias("id")).withColumn("n", F.lit(2).cast("long"))
               .unionByName(keys.join(lists.where("n > 2").select("list", "n"), "list").select("list", "id", "n")))
    star = hub_pairs(staged(members.withColumn("size", F.lit(None).cast("long")), "op3"), "op3")

    # the sketches and full sets of the documents that share a list, read once
    ids = staged(star.select("id").unionByName(star.select(F.col("hub").alias("id"))).distinct(), "op3")
    few = ids.count() <= BROADCAST_IDS
    wanted = ids.withColumnRenamed("id", "doc_id")
    wanted = F.broadcast(wanted) if few else wanted
    hubs = star.select(F.col("hub").alias("id")).distinct()
    sketch_of = lambda which: reps.join(F.broadcast(which) if few else which, "id", "left_semi")
    sets = staged(docs.join(wanted, "doc_id", "left_semi")
                  .mapInArrow(_whole_sets(words_a_shingle), "id long, set array<long>"), "op3")

    # far: similarity at twice the linking distance; six standard deviations of the estimate below it is surely farther
    far = 2 * threshold / 100 - 1
    margin = 6 * (far * (1 - far) / k) ** 0.5
    sa = sketch_of(hubs).select(F.col("id").alias("hub"), F.col("n_shingles").alias("na"), F.col("sketch").alias("ska"))
    sb = sketch_of(ids).select("id", F.col("n_shingles").alias("nb"), F.col("sketch").alias("skb"))
    union = F.slice(F.array_sort(_unsigned(F.array_union("ska", "skb"))), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(_unsigned("ska"), _unsigned("skb")), union))
    estimate = shared / F.least(F.size(F.array_union("ska", "skb")), F.lit(k))
    close = (F.least("na", "nb") >= far * F.greatest("na", "nb")) & (estimate >= far - margin)
    told = staged(star.select("hub", "id").distinct().join(sa, "hub").join(sb, "id").select("hub", "id", close.alias("close")), "op3")
    common = F.size(F.array_intersect("sa", "sb"))
    # rounding may leave a distance just over the limit
    reach = 1 - threshold / 100 + 1e-9
    near = (told.where("close").join(sets.select(F.col("id").alias("hub"), F.col("set").alias("sa")), "hub")
            .join(sets.withColumnRenamed("set", "sb"), "id")
            .select("hub", "id", (1 - common / (F.size("sa") + F.size("sb") - common)).alias("distance")))
    judged = near.unionByName(told.where("not close").select("hub", "id", F.lit(None).cast("double").alias("distance")))
    judged = staged(judged.withColumn("link", F.coalesce(F.col("distance") <= reach, F.lit(False))), "op3")

    # members of a hub that may be linked with each other: neither both linked with it, nor one linked and one far
    middle = F.col("distance").between(reach, 2 * reach)
    hubs = (judged.groupBy("hub").agg(F.count_if(~F.col("link")).alias("apart"), F.count_if(middle).alias("middle"),
                                      F.count("*").alias("n"))
            .where("apart > 1 or middle > 0")
            .withColumn("blocks", F.ceil(F.when(F.col("middle") > 0, F.col("n")).otherwise(F.col("apart")) / BLOCK).cast("int")))
    blocks = (judged.join(hubs, "hub").where(~F.col("link") | (F.col("middle") > 0))
              .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("hub", "id", "distance", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))
    within = (blocks.join(sets, "id").repartition("hub", "lo", "hi").sortWithinPartitions("hub", "lo", "hi", "id")
              .select("hub", "lo", "hi", "own", "id", "distance", "set").mapInArrow(_block_links(threshold, reach), "u long, v long"))
    links = judged.where("link").select(F.col("hub").alias("u"), F.col("id").alias("v")).unionByName(staged(within, "op3"))
    found = components(links)
    by_class = classes.drop("n").join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        *same, F.coalesce("component", "rep").alias("component"))
    return (rows.drop("sketch").join(by_class, same, "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, least(3, len(w)) AS n, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), c AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach(a, b) AS (
  SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b
), m AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""


@query("op3_near_dedup", ORACLE)
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
