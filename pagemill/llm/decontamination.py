"""Operator 8: benchmark decontamination by winnowing.

Words are lower-cased runs of letters, digits and non-ASCII characters.  Of
each sliding window of consecutive k-grams the one with the least hash is kept
as a fingerprint; with k = 5 and 6 k-grams a window, any shared span of 10
words or more shares a fingerprint.  Fingerprints of documents and benchmark
are joined, and each hit is extended word by word along its diagonal (document
position minus item position).  Runs of ``span`` equal words are hits.  Items
of fewer than ``span`` words are one window: documents are also asked for runs
of those items' lengths.

Documents' fingerprints first pass a bit table of the benchmark's
fingerprints, of fixed size; the join then decides exactly.

Null and empty texts have no words; an item without words has no window.
Repeated rows: documents are judged row by row through a row key made of
doc_id (which may be null) and a hash of the text; an item_id counts once, whichever of its texts
occurs.  Empty
tables give no hits.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources.tables import read_table

from .common import documents, query, staged

K = 5
BITS = 24                   # the bit table: 2 MB
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]


def _winnowed(row, h, span: int):
    """(row, hash, first word) of the fingerprints of a stretch's words."""
    import numpy as np

    from .textbytes import grams

    row, g, at = grams(row, h, K)
    width = span - K + 1
    n = len(g) - width + 1
    if n <= 0:
        return row[:0], g[:0], at[:0]
    least = g[:n].copy()
    for d in range(1, width):
        np.minimum(least, g[d:n + d], out=least)
    kept = np.zeros(len(g), bool)
    for d in range(width):
        kept[d:n + d] |= least == g[d:n + d]
    return row[kept], g[kept], at[kept]


def _fingerprints(column, span: int, lengths):
    """For each row of a text column: number of words, [(hash, word position)]."""
    import numpy as np

    from .textbytes import chunks, grams, mix, table_without, words

    table = table_without(SEPARATORS)
    for first, offsets, data in chunks(column):
        row, h, _, _ = words(offsets, data, table)
        count = np.bincount(row, minlength=len(offsets) - 1)
        begin = np.cumsum(count) - count
        found = [_winnowed(row, h, span)]
        for m in lengths:
            r, g, at = grams(row, h, m)
            found.append((r, mix(g ^ np.uint64(m)), at))
        r, g, at = (np.concatenate(x) for x in zip(*found))
        yield first, count, r, g.view(np.int64), at - begin[r]


def _items(span: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("item").to_numpy()
            for first, count, r, g, at in _fingerprints(batch.column("item_text"), span, range(1, span)):
                # a short item is asked for as a whole, a long one by its fingerprints
                whole = count[r] < span
                length = np.where(whole, count[r], 0)
                keep = ~whole | (at == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:][r[keep]]), pa.array(g[keep]), pa.array(at[keep]), pa.array(length[keep])],
                    names=["item", "h", "item_at", "whole"])

    return run


def _documents(span: int, lengths, bits):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            n = batch.num_rows
            n_words, hashes, places = np.zeros(n, np.int64), [], []
            cut = np.zeros(n + 1, np.int64)
            for first, count, r, g, at in _fingerprints(batch.column("text"), span, lengths):
                n_words[first:first + len(count)] = count
                slot = g.view(np.uint64) >> np.uint64(64 - BITS)
                ok = (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                r, g, at = r[ok], g[ok], at[ok]
                order = np.argsort(r, kind="stable")
                hashes.append(g[order])
                places.append(at[order])
                cut[first + 1:first + 1 + len(count)] = np.bincount(r, minlength=len(count))
            cut = np.cumsum(cut).astype(np.int32)
            join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n_words),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(join(hashes))),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(join(places)))],
                names=["doc_id", "key", "n_words", "h", "doc_at"])

    return run


def _bit_table(rows):
    """Bits of one task's hashes, as one row."""
    import numpy as np
    import pyarrow as pa

    bits = np.zeros(1 << (BITS - 3), np.uint8)
    some = False
    for batch in rows:
        slot = batch.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
        np.bitwise_or.at(bits, slot >> np.uint64(3), (1 << (slot & np.uint64(7))).astype(np.uint8))
        some = some or len(slot) > 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])


def _extended(span: int):
    """Rows with text and seeds (item_id, item_text, shift) to hit words and items."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        from .textbytes import table_without

        table = table_without(SEPARATORS).tobytes()

        def split(text: str):
            return text.encode().translate(table).replace(b"\0", b" ").split(b" ")

        def words(text):
            return np.array([x for x in split(text) if x], object)

        for batch in batches:
            out = {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_hit": [], "n_items": [], "items_sha256": []}
            for text, seeds in zip(batch.column("text").to_pylist(), batch.column("seeds").to_pylist()):
                doc, items, known = words(text), set(), {}
                cover = np.zeros(len(doc) + 1, np.int64)
                for s in seeds:
                    item = known.get(s["item"])
                    if item is None:
                        item = known[s["item"]] = words(s["item_text"])
                    need, lo = min(span, len(item)), max(0, s["shift"])
                    hi = min(len(doc), s["shift"] + len(item))
                    same = np.concatenate(([False], doc[lo:hi] == item[lo - s["shift"]:hi - s["shift"]], [False]))
                    turns = np.flatnonzero(same[1:] != same[:-1])
                    for a, b in zip(turns[::2], turns[1::2]):
                        if b - a >= need:
                            cover[lo + a] += 1
                            cover[lo + b] -= 1
                            items.add(s["item_id"])
                out["n_hit"].append(int((np.cumsum(cover) > 0).sum()))
                out["n_items"].append(len(items))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([out["doc_id"], out["key"], pa.array(out["n_hit"], pa.int64()),
                                              pa.array(out["n_items"], pa.int64()), pa.array(out["items_sha256"], pa.string())],
                                             names=list(out))

    return run


def _of_row(rows: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with what is told of their (doc_id, key); doc_id may be null."""
    more = more.withColumnRenamed("doc_id", "_doc_id").withColumnRenamed("key", "_key")
    return rows.join(more, rows["doc_id"].eqNullSafe(more["_doc_id"]) & (rows["key"] == more["_key"]), how).drop("_doc_id", "_key")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs``.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.  ``key``
    tells rows with the same doc_id apart.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    items = (benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
             .select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("item_text"),
                     F.xxhash64("item_id", "text").alias("item")).distinct())
    prints = staged(items.mapInArrow(_items(span), "item long, h long, item_at long, whole long"), "op8-items")
    lengths = sorted(r.whole for r in prints.where("whole > 0").select("whole").distinct().collect())   # under span values
    bits = bytearray(1 << (BITS - 3))
    for row in prints.select("h").coalesce(16).mapInArrow(_bit_table, "bits binary").toLocalIterator():
        bits = bytearray((int.from_bytes(bits, "little") | int.from_bytes(row.bits, "little")).to_bytes(len(bits), "little"))
    found = staged(docs.mapInArrow(_documents(span, lengths, spark.sparkContext.broadcast(bytes(bits))),
                                   "doc_id long, key long, n_words long, h array<long>, doc_at array<long>"), "op8-docs")
    seeds = (found.where(F.size("h") > 0)
             .select("doc_id", "key", F.explode(F.arrays_zip("h", "doc_at")).alias("s"))
             .select("doc_id", "key", F.col("s.h").alias("h"), F.col("s.doc_at").alias("doc_at"))
             .join(prints, "h")
             .select("doc_id", "key", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct())
    # a document's seeds are bounded by its words and the items that share them
    seeds = (seeds.join(items, "item")
             .groupBy("doc_id", "key").agg(F.collect_list(F.struct("item", "item_id", "item_text", "shift")).alias("seeds")))
    hits = (_of_row(docs, seeds, "inner").mapInArrow(_extended(span), "doc_id long, key long, n_hit long, n_items long, items_sha256 string")
            .dropDuplicates(["doc_id", "key"]))
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"   # SHA-256 of no bytes
    return (_of_row(found.select("doc_id", "key", "n_words"), hits, "left")
            .select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items_sha256", F.lit(empty)).alias("items_sha256"),
                    F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), m AS (
  SELECT doc_id, item_id, i, n FROM runs JOIN win USING (n, g)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), item AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""


@query("op8_decontamination", ORACLE)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", "item_id", "text")).drop("key")
