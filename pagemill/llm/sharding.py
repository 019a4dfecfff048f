"""Operator 6: sharding by histogram sort, law ``bytes``.

Sort key: ``key`` = 64-bit hash of the text, then a hash of doc_id.  Exact
bytes below candidate key boundaries are counted across all partitions; each
round divides only the intervals that still hold a splitter, until every
splitter meets the tolerance; then the rows are exchanged once.

Documents with equal texts form a group.  Groups larger than
``total / (n_shards * 64)`` cannot be balanced by splitters between groups.
There are at most ``64 * n_shards`` of them; they are placed one by one, largest
first, on the shard with the least bytes, and the splitters of the other rows
aim at what each shard still lacks.  A group that does not fit there is cut by
further splitters, on the hash of doc_id: it fills the shard and goes on in the
next one, so a group of any size leaves the shards even.  Only what shares
text and doc_id stays together whatever its size.

Null text: no bytes, size 1, crc 0; all null texts are one group apart from
the empty texts' group.  Rows with equal (doc_id, text) are separate rows with
slots of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, query, staged

DIGIT = 10                      # key bits that one round resolves: 1,024 candidate boundaries an interval
NULL_KEY = -(2 ** 63) + 1     # key of null texts
LARGE_PARTS = 64                # a group above 1/64 of a shard's target is placed by itself


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(NULL_KEY)).otherwise(F.xxhash64("text")).alias("key"))


def _unsigned(key: int) -> int:
    return key & (2 ** 64 - 1)


def _place(groups: list[tuple[int, int, bool]], n_shards: int, total: int) -> tuple[dict[int, int], dict[int, list[tuple[int, int]]]]:
    """Large groups (key, bytes, whether it can be cut): shard of those that stay whole, (shard, bytes) parts of the others."""
    load, target = [0] * n_shards, total / n_shards
    placed, cut = {}, {}
    for key, size, can_cut in sorted(groups, key=lambda g: (-g[1], g[0])):
        shard = min(range(n_shards), key=lambda s: (load[s], s))
        if not can_cut or load[shard] + size <= target:
            placed[key] = shard
            load[shard] += size
            continue
        parts = []
        while size > 0:
            shard = min(range(n_shards), key=lambda s: (load[s], s))
            take = min(size, max(1, int(target - load[shard])))
            parts.append((shard, take))
            load[shard] += take
            size -= take
        cut[key] = parts
    return placed, cut


def _lacks(load: list[int], total: int) -> list[float]:
    """What each shard lacks to the water level; shards above it get nothing more."""
    rest, open_ = total - sum(load), sorted(load)
    level = 0.0
    for i in range(len(load)):
        level = (rest + sum(open_[: i + 1])) / (i + 1)
        if i + 1 == len(load) or level <= open_[i + 1]:
            break
    return [max(0.0, level - x) for x in load]


def histogram_splitters(rows: DataFrame, targets: list[float], tolerance: float, max_rounds: int = 7) -> list[int]:
    """Unsigned 64-bit keys s_1 <= ... <= s_m: bytes of keys below s_i meet targets[i] within ``tolerance``.

    ``rows`` has ``key`` and ``size``.  A round sends at most
    len(targets) * 2**DIGIT sums to the driver, whatever the input size.
    """
    lo, below, shift = [0] * len(targets), [0] * len(targets), 64
    done: list[int | None] = [None] * len(targets)
    for _ in range(max_rounds):
        todo = [i for i in range(len(targets)) if done[i] is None]
        if not todo:
            break
        step = max(0, shift - DIGIT)
        top = F.shiftrightunsigned("key", shift) if shift < 64 else F.lit(0).cast("long")
        intervals = sorted({lo[i] >> shift for i in todo})
        counted = (rows.where(top.isin([x - 2 ** 64 if x >= 2 ** 63 else x for x in intervals]))
                   .groupBy(F.shiftrightunsigned("key", step).alias("cell") if step else F.col("key").alias("cell"))
                   .agg(F.sum("size").alias("bytes")).collect())
        cells = sorted((_unsigned(r.cell), r.bytes) for r in counted)
        for i in todo:
            acc, end = below[i], (lo[i] >> shift) + 1
            own = [(c, b) for c, b in cells if (c << step) >> shift == lo[i] >> shift]
            for cell, size in own:
                if acc + size > targets[i]:
                    lo[i], below[i] = cell << step, acc
                    near_low, near_high = targets[i] - acc, acc + size - targets[i]
                    if near_low <= tolerance:
                        done[i] = cell << step
                    elif near_high <= tolerance or step == 0:
                        done[i] = (cell + 1) << step if near_high <= near_low else cell << step
                    break
                acc += size
            else:
                done[i] = end << shift
        shift = step
    return [d if d is not None else x for d, x in zip(done, lo)]


def _splitters_below(key: Column, splitters: list[int]) -> Column:
    """How many of the unsigned splitters are at most ``key``."""
    # signed comparison after flipping the top bit keeps the unsigned order
    order = key.bitwiseXOR(F.lit(-(2 ** 63)))
    return sum([F.when(order >= F.lit(s - 2 ** 63), 1).otherwise(0) if s < 2 ** 64 else F.lit(0) for s in splitters], F.lit(0)).cast("int")


def _plan(docs: DataFrame, n_shards: int, tolerance: float):
    """Staged sizes and keys, their number, the shard of a ``key`` as a function of a DataFrame."""
    spark = docs.sparkSession
    rows = staged(_measured(docs), "op6")
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    large_at = max(1, total // (n_shards * LARGE_PARTS))
    by_doc = F.xxhash64("doc_id")
    groups = (rows.groupBy("key").agg(F.sum("size").alias("bytes"), (F.min(by_doc) < F.max(by_doc)).alias("can_cut"))
              .where(F.col("bytes") > large_at).collect())     # at most n_shards * LARGE_PARTS rows
    placed, cut = _place([(r.key, r.bytes, r.can_cut) for r in groups], n_shards, total)
    large = F.broadcast(spark.createDataFrame(
        [(k, s, None) for k, s in placed.items()] + [(k, None, i) for i, k in enumerate(cut)],
        "key long, large_shard int, cut_group long"))
    # the groups to cut lie one after the other in an order of their own: number, then hash of doc_id
    bits = len(cut).bit_length()
    in_cut = F.shiftleft("cut_group", 64 - bits).bitwiseOR(F.shiftrightunsigned(by_doc, bits))
    goals, acc = [], 0
    for _, take in (part for parts in cut.values() for part in parts):
        acc += take
        goals.append(acc)
    cut_rows = rows.join(large.where("cut_group is not null"), "key").select(in_cut.alias("key"), "size")
    cut_at = histogram_splitters(cut_rows, goals[:-1], tolerance * total / n_shards / 2) if cut else []
    # a group's last part ends where the group does, whatever the tolerance
    ends = [sum(len(p) for p in list(cut.values())[:i + 1]) - 1 for i in range(len(cut))]
    for i, end in enumerate(ends[:-1]):
        cut_at[end] = (i + 1) << (64 - bits)
    at = _splitters_below(in_cut, cut_at)
    shards = [s for parts in cut.values() for s, _ in parts]
    cut_shard = F.element_at(F.array(*[F.lit(s) for s in shards]), at + 1) if cut else F.lit(None).cast("int")

    load = [0] * n_shards
    for r in rows.join(large, "key").groupBy(F.coalesce("large_shard", cut_shard).alias("shard")).agg(F.sum("size").alias("bytes")).collect():
        load[r.shard] = r.bytes
    goals, acc = [], 0.0
    for x in _lacks(load, total)[:-1]:
        acc += x
        goals.append(acc)
    splitters = histogram_splitters(rows.join(large, "key", "left_anti"), goals, tolerance * total / n_shards)
    small_shard = _splitters_below(F.col("key"), splitters)

    def dealt(df: DataFrame) -> DataFrame:
        shard_ = F.when(F.col("cut_group").isNotNull(), cut_shard).otherwise(F.coalesce("large_shard", small_shard))
        return df.join(large, "key", "left").withColumn("shard", shard_).drop("large_shard", "cut_group")

    return rows, n_rows, dealt


def shard(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.002, rows_a_task: int = 1_000_000) -> DataFrame:
    """Shard and slot of each row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A shard's rows are sorted by ``parts`` tasks; the one exchange is by (shard, part).
    """
    rows, n_rows, dealt = _plan(docs, n_shards, tolerance)
    parts = max(4, -(-n_rows // (n_shards * rows_a_task)))
    rows = dealt(rows).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    base = counts.select("shard", "part", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("key", "doc_id", "size", "text_crc32")
    return (rows.withColumn("at", F.row_number().over(within) - 1)
            .join(F.broadcast(base) if n_shards * parts <= 100_000 else base, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("base") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, tolerance: float = 0.002,
                 files_a_shard: int = 4) -> None:
    """Write whole documents as Parquet folders ``shard=0`` ... of near equal bytes, after one exchange."""
    _, _, dealt = _plan(docs, n_shards, tolerance)
    key = F.when(F.col("text").isNull(), F.lit(NULL_KEY)).otherwise(F.xxhash64("text"))
    file = F.pmod(F.xxhash64("doc_id"), F.lit(files_a_shard))
    (dealt(docs.withColumn("key", key)).drop("key")
     .repartition(n_shards * files_a_shard, "shard", file).write.partitionBy("shard").parquet(path))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
