"""Operator 11: ranked lexical search, a hybrid of term- and document-at-a-time.

Documents are cut into blocks as they are read; a block is an inverted index
over the terms that some item asks for: for each term its documents and
occurrences, in order.  The index is written once.  Document frequencies are
summed over the blocks, and give each item's terms their weights.

A task takes its blocks one after another and keeps the best documents of each
item found so far.  In a block an item's short lists are added up term by
term: the sums are an accumulator, from there on read like one more list whose
bound is its largest sum.  The long lists and this one are then read document
by document, a window of documents at a time: a window whose bounds cannot
reach the k-th best score is skipped; else only documents of those lists are
looked at without which the k-th best cannot be reached, and the others are
asked by binary search for documents that can still qualify.  Each task gives
k rows an item; Spark ranks these.

Items are visited in rounds of bounded size, each a broadcast.  Terms are
64-bit hashes of words; a bit table of fixed size keeps out the words nobody
asks for.

Null and empty texts have no term.  Items without item_id, and items without a
term, get no rows; an item that occurs twice is ranked once, two texts of one
item_id are ranked each.  Rows with equal doc_id are documents each; rows
without doc_id come last among equal scores.  Empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.sources.tables import read_table

from .common import documents, query, staged
from .decontamination import BITS, SEPARATORS, _bit_table

BLOCK_DOCS = 16_384
BLOCK_POSTINGS = 4_000_000
WINDOW = 1024                  # documents whose bounds are looked at together
SHORT_SHARE = 8                # lists that hold at most one in so many of a block's documents are added up
ROUND_TERMS = 500_000          # terms of the items of one round

BLOCK = "ids array<long>, n array<long>, h array<long>, df array<long>, doc binary, tf binary"


def _terms(batches):
    """item, h: the distinct terms of each item."""
    import numpy as np
    import pyarrow as pa

    from .textbytes import chunks, table_without, words

    table = table_without(SEPARATORS)
    for batch in batches:
        ids = batch.column("item").to_numpy()
        for first, offsets, data in chunks(batch.column("item_text")):
            row, h, _, _ = words(offsets, data, table)
            pairs = np.unique(np.stack((row.astype(np.int64), h.view(np.int64)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[first + pairs[:, 0]]), pa.array(pairs[:, 1])], names=["item", "h"])


def _index(bits, block_docs: int):
    """Blocks of a partition's documents."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .textbytes import chunks, table_without, words

        wanted, table = np.frombuffer(bits.value, np.uint8), table_without(SEPARATORS)
        ids, lengths, found = [], [], []

        def block():
            hs, docs, tf = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            order = np.lexsort((docs, hs))
            hs, docs, tf = hs[order], docs[order], tf[order]
            terms, df = np.unique(hs, return_counts=True)
            row = [pa.concat_arrays(ids), pa.array(np.concatenate(lengths)), pa.array(terms), pa.array(df.astype(np.int64))]
            row = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row]
            row += [pa.array([docs.astype(np.int32).tobytes()], pa.binary()), pa.array([tf.astype(np.int32).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["ids", "n", "h", "df", "doc", "tf"])

        for batch in batches:
            for first, offsets, data in chunks(batch.column("text")):
                rows = len(offsets) - 1
                row, h, _, _ = words(offsets, data, table)
                slot = h >> np.uint64(64 - BITS)
                asked = (wanted[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                row_asked, h_asked = row[asked], h[asked].view(np.int64)
                order = np.lexsort((h_asked, row_asked))
                row_asked, h_asked = row_asked[order], h_asked[order]
                starts = np.flatnonzero(np.concatenate(([True], (row_asked[1:] != row_asked[:-1]) | (h_asked[1:] != h_asked[:-1])))) \
                    if len(row_asked) else np.zeros(0, np.int64)
                tf = np.diff(np.append(starts, len(row_asked)))
                before = sum(map(len, ids))
                found.append((h_asked[starts], before + row_asked[starts], tf))
                ids.append(batch.column("doc_id").slice(first, rows))
                lengths.append(np.bincount(row, minlength=rows).astype(np.int64))
                if before + rows >= block_docs or sum(len(f[0]) for f in found) >= BLOCK_POSTINGS:
                    yield block()
                    ids, lengths, found = [], [], []
        if ids:
            yield block()

    return run


class Block:
    """One block's lists, with each posting's share of the score before the term's weight."""

    def __init__(self, row, total_docs: int, total_terms: int, window: int = WINDOW):
        import numpy as np

        self.ids, self.known = row["ids"]
        n = row["n"]
        self.terms, df = row["h"], row["df"]
        self.doc, tf = np.frombuffer(row["doc"], np.int32), np.frombuffer(row["tf"], np.int32).astype(np.int64)
        self.cut = np.concatenate(([0], np.cumsum(df)))
        m = 100 - 50 + (50 * n * total_docs) // max(1, total_terms)
        self.share = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc])
        self.docs = len(n)
        self.window = window
        self.edges = np.arange(0, self.docs + window, window)
        self.longs: dict = {}

    def list(self, t: int):
        a, b = self.cut[t], self.cut[t + 1]
        return self.doc[a:b], self.share[a:b]

    def windows(self, t: int):
        """For a long list: where each window begins in it, and the window's largest share."""
        import numpy as np

        if t not in self.longs:
            doc, share = self.list(t)
            at = np.searchsorted(doc, self.edges)
            best = np.zeros(len(self.edges) - 1, np.int64)
            some = at[1:] > at[:-1]
            best[some] = np.maximum.reduceat(share, at[:-1][some])
            self.longs[t] = at, best
        return self.longs[t]


class Best:
    """The k best (score, doc_id) of one item; without doc_id last among equals."""

    def __init__(self, k: int):
        import numpy as np

        self.k, self.score, self.ids, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """A score below which no document can be among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score, ids, known):
        import numpy as np

        score, ids, known = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -score))[:self.k]
        self.score, self.ids, self.known = score[order], ids[order], known[order]


def search_block(block: Block, h, w, best: Best, short_share: int = SHORT_SHARE) -> None:
    """Add to ``best`` what the block holds for an item's terms ``h`` of weights ``w``."""
    import numpy as np

    if not len(block.terms):
        return
    at = np.minimum(np.searchsorted(block.terms, h), len(block.terms) - 1)
    here = (block.terms[at] == h) & (w > 0)
    terms, w = at[here], w[here]
    size = block.cut[terms + 1] - block.cut[terms]
    short = size <= max(best.k, block.docs // short_share)
    sums = np.zeros(block.docs, np.int64)
    for t, weight in zip(terms[short].tolist(), w[short].tolist()):
        doc, share = block.list(t)
        sums[doc] += weight * share
    least = best.least()
    if block.docs > best.k:
        least = max(least, int(np.partition(sums, block.docs - best.k)[block.docs - best.k]))
    lists = [(weight, *block.list(t), *block.windows(t)) for t, weight in zip(terms[~short].tolist(), w[~short].tolist())]
    n = len(block.edges) - 1
    padded = np.zeros(n * block.window, np.int64)
    padded[:block.docs] = sums
    # bounds by window: those of the long lists, and last that of the sums
    bounds = np.stack([weight * top for weight, _, _, _, top in lists] + [padded.reshape(n, block.window).max(axis=1)])
    for j in np.flatnonzero(bounds.sum(axis=0) >= least).tolist():
        bound = bounds[:, j]
        if bound.sum() < least:
            continue                                    # the k-th best has risen since
        order = np.argsort(bound, kind="stable")
        needed = order[np.cumsum(bound[order]) >= least].tolist()   # a document of none of these stays below
        first, last = int(block.edges[j]), min(int(block.edges[j + 1]), block.docs)
        mark = np.zeros(last - first, bool)
        for i in needed:
            if i == len(lists):
                mark |= sums[first:last] > 0
            else:
                _, doc, _, cut, _ = lists[i]
                mark[doc[cut[j]:cut[j + 1]] - first] = True
        found = np.flatnonzero(mark) + first
        score = sums[found]
        left = int(bound[:-1].sum())
        for i in order[::-1].tolist():                  # largest bound first
            if i == len(lists):
                continue
            alive = score + left >= least
            found, score = found[alive], score[alive]
            weight, doc, share, cut, _ = lists[i]
            a, b = cut[j], cut[j + 1]
            if b > a and len(found):
                place = np.minimum(np.searchsorted(doc[a:b], found), b - a - 1)
                score = score + np.where(doc[a:b][place] == found, weight * share[a:b][place], 0)
            left -= int(bound[i])
        alive = score >= least
        if alive.any():
            best.add(score[alive], block.ids[found[alive]], block.known[found[alive]])
            least = max(least, best.least())


def _search(k: int, asked, total_docs: int, total_terms: int, window: int, short_share: int):
    """item, doc_id, score: the best k of a task's blocks for each item."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        items, cuts, h, w = asked.value
        bests = [Best(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                value = {c: batch.column(c)[i] for c in batch.schema.names}
                row = {c: value[c].values.to_numpy(zero_copy_only=False) for c in ("n", "h", "df")}
                ids = value["ids"].values
                row["ids"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
                row |= {c: value[c].as_py() for c in ("doc", "tf")}
                block = Block(row, total_docs, total_terms, window)
                for best, a, b in zip(bests, cuts[:-1], cuts[1:]):
                    search_block(block, h[a:b], w[a:b], best, short_share)
        for item, best in zip(items, bests):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(best.score), item)), pa.array(best.ids, mask=~best.known), pa.array(best.score)],
                names=["item", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, block_docs: int = BLOCK_DOCS, window: int = WINDOW,
           short_share: int = SHORT_SHARE) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    import numpy as np

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = (items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
             .select("item_id", F.xxhash64("item_id", "text").alias("item"), F.col("text").alias("item_text")).distinct())
    terms = staged(items.mapInArrow(_terms, "item long, h long"), "op11-terms")
    bits = bytearray(1 << (BITS - 3))
    for row in terms.select("h").coalesce(16).mapInArrow(_bit_table, "bits binary").toLocalIterator():    # 2 MB each
        bits = bytearray((int.from_bytes(bits, "little") | int.from_bytes(row.bits, "little")).to_bytes(len(bits), "little"))
    index = staged(docs.mapInArrow(_index(spark.sparkContext.broadcast(bytes(bits)), block_docs), BLOCK), "op11-index")
    told = index.select(F.size(F.filter("n", lambda x: x > 0)).alias("d"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"))
    total_docs, total_terms = (x or 0 for x in told.agg(F.sum("d"), F.sum("t")).first())
    df = (index.select(F.explode(F.arrays_zip("h", "df")).alias("p")).groupBy(F.col("p.h").alias("h")).agg(F.sum("p.df").alias("df")))
    weight = F.floor(1000 * F.log((2 * F.lit(total_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = staged(terms.join(df, "h").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("h", weight.alias("w")))).alias("terms")),
                      "op11-items")
    count = weighted.agg(F.sum(F.size("terms"))).first()[0] or 0
    rounds = math.ceil(count / ROUND_TERMS)
    best = None
    for r in range(rounds):
        rows = weighted.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r).collect()     # about ROUND_TERMS terms
        cuts = np.cumsum([0, *(len(x.terms) for x in rows)])
        h = np.array([t.h for x in rows for t in x.terms], np.int64)
        w = np.array([t.w for x in rows for t in x.terms], np.int64)
        asked = spark.sparkContext.broadcast(([x.item for x in rows], cuts, h, w))
        found = index.mapInArrow(_search(k, asked, total_docs, total_terms, window, short_share), "item long, doc_id long, score long")
        best = found if best is None else best.unionAll(found)
    if best is None:
        best = spark.createDataFrame([], "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM documents
), p AS (
  SELECT rid, doc_id, t, count(*) AS tf FROM d GROUP BY ALL
), s AS (
  SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY rid
), c AS (
  SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM s
), q AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE item_id IS NOT NULL
), w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c
), r AS (
  SELECT item_id, q.text, rid, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // nt)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN p USING (t) JOIN s USING (rid), c GROUP BY item_id, q.text, rid, doc_id
)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
WINDOW o AS (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER o <= 50
"""


@query("op11_lexical", ORACLE)
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
