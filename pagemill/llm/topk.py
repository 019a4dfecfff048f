"""Operator 2: exact top-k inner-product search by no-random-access aggregation.

Vectors are cut into blocks; a block holds one list per component, sorted by
value.  A query reads all lists of a block from their better end in step.
After each stretch every vector has a lower bound (components read, plus the
worst value of each unread list) and an upper bound (components read, plus the
value at which each unread list stands).  Vectors whose upper bound is below
the k-th best lower bound are dropped; once none outside the k candidates can
qualify the scores of those left are resolved in full.  The best k of each
block are merged by Spark.

Vectors that are null, or hold a null or non-finite component, take no part.
Shorter vectors count as padded with zeros.  Ties go to the smaller vec_id.
Rows with equal vec_id are separate candidates; a query never meets a row with
its own vec_id, and a repeated query row gives its answer once.  Scores must
fit 64 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.sources.tables import read_table

from .common import query

BLOCK_ROWS = 4096
QUERY_ROWS = 512
DEPTHS = (0.1, 0.3, 0.6, 1.0)   # shares of a list read before bounds are compared
RESOLVE = 64                    # so few vectors left are scored in full


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and ``x`` = floor(scale * component) for the vectors that take part."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double"))
                   | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
            .select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x")))


def _matrix(lists):
    import numpy as np

    width = max((len(x) for x in lists), default=0)
    m = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        m[i, : len(x)] = x
    return m


def nra_block(ids, values, qids, queries, k: int):
    """(query row, vec_id, score) of the best k vectors of one block for each query.

    A query reads a component's list from its large end where its own
    component is positive, else from its small end.  What has been read at a
    depth is the same for all queries but for the end, so the bounds of all
    queries that are still open come from four matrix products a depth.
    """
    import numpy as np

    n, d = values.shape
    exact = max(1, np.abs(values).max(initial=0)) * max(1, np.abs(queries).max(initial=0)) * d < 2 ** 52
    x, q = (values.astype(float), queries.astype(float)) if exact else (values, queries)
    alive = ids[None, :] != qids[:, None]
    if n > RESOLVE:
        order = np.argsort(x, axis=0, kind="stable")
        lists = np.take_along_axis(x, order, axis=0)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
        ends = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
        still = np.arange(len(q))
        for depth in sorted({max(1, int(n * share)) for share in DEPTHS}):
            read = np.hstack([place >= n - depth, place < depth])
            both = np.hstack([x, x])
            worst = np.hstack([lists[0], lists[-1]])               # the last entries of the lists
            front = np.hstack([lists[n - depth], lists[depth - 1]])  # where the lists stand
            e = ends[still]
            low = e @ (read * (both - worst)).T + (e @ worst)[:, None]
            high = e @ (read * (both - front)).T + (e @ front)[:, None]
            low[~alive[still]] = np.iinfo(np.int64).min
            kth = np.partition(low, n - k, axis=1)[:, n - k]
            alive[still] &= high >= kth[:, None]
            still = still[alive[still].sum(axis=1) > RESOLVE]
            if not len(still):
                break
    rows, vids, scores = [], [], []
    for i in range(len(q)):
        keep = np.flatnonzero(alive[i])
        score = values[keep] @ queries[i]
        best = np.lexsort((ids[keep], -score))[:k]
        rows += [i] * len(best)
        vids += ids[keep[best]].tolist()
        scores += score[best].tolist()
    return rows, vids, scores


def _search(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out_q, out_v, out_s = [], [], []
            for row in batch.to_pylist():
                ids = np.array(row["ids"], np.int64)
                values = _matrix(row["xs"])
                queries = _matrix(row["qs"])
                width = max(values.shape[1], queries.shape[1])
                values = np.pad(values, ((0, 0), (0, width - values.shape[1])))
                queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
                qids = np.array(row["qids"], np.int64)
                at, vid, score = nra_block(ids, values, qids, queries, k)
                out_q += qids[at].tolist()
                out_v += vid
                out_s += score
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.int64())],
                names=["query_id", "vec_id", "score"])

    return run


def _blocks(df: DataFrame, rows: int, n: int) -> DataFrame:
    """Rows dealt evenly over ceil(n / rows) blocks by a hash of id and content; a block is one row."""
    count = max(1, -(-n // rows))
    return (df.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(count)).cast("int"))
            .groupBy("block").agg(F.collect_list(F.struct("vec_id", "x")).alias("rows")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of ``vectors`` for each row of ``queries``.

    Both inputs have vec_id and x (``quantised``).  Blocks have an expected
    4,096 vectors and 512 queries, so a task's size does not grow with the input.
    """
    n, m = vectors.count(), queries.select("vec_id").distinct().count()
    qblocks = _blocks(queries.dropDuplicates(["vec_id"]), QUERY_ROWS, m)
    n_q = max(1, -(-m // QUERY_ROWS))
    work = (_blocks(vectors, BLOCK_ROWS, n)
            .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
            .join(qblocks.select(F.col("block").alias("qblock"), F.col("rows").alias("qrows")), "qblock")
            .repartition(F.col("block"), F.col("qblock"))
            .select(F.col("rows.vec_id").alias("ids"), F.col("rows.x").alias("xs"),
                    F.col("qrows.vec_id").alias("qids"), F.col("qrows.x").alias("qs")))
    found = work.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query("op2_topk", ORACLE)
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quantised(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(x, x.where(F.col("vec_id") % 50 == 0))
