"""Structured Streaming twins of the batch operators.

Sources are file streams over the events table; every sink is written
under the cluster's shared checkpoint folder (``spark.checkpoint.dir``), so
a restarted driver or lost executor resumes from the checkpoint and the
per-batch outputs are idempotent (overwritten by batch id).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import admission as A
from pagemill.operators import usage as G
from pagemill.session import checkpoint_dir
from pagemill.sources import fixtures as FX


def _events_stream(spark: SparkSession, sf_dir: str, files_a_batch: int | None = None) -> DataFrame:
    """The events table as a stream of its part files (a table stored as one file streams as that file)."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    if files_a_batch:
        source = source.option("maxFilesPerTrigger", files_a_batch)
    # as a pattern the path may be one file or a folder of part files
    return source.parquet(f"{path[:-1]}[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _run_dir(spark: SparkSession, name: str, run: str | None) -> str:
    """Folder of a stream's output and progress; a named ``run`` resumes, else each call starts anew."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{run or uuid.uuid4().hex}")


def _partials(stream: DataFrame, rollup, out: str) -> DataFrame:
    """Each micro-batch's ``rollup`` in ``batch_id=N``, written by overwrite, and read back.

    A retried batch replaces its own partial, and since all measures add, late
    rows and open days are in the sum like any others.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        rollup(batch).write.mode("overwrite").parquet(os.path.join(out, "partials", f"batch_id={batch_id}"))

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(out, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(os.path.join(out, "partials")).drop("batch_id")


def stream_usage(spark: SparkSession, sf_dir: str, run: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """Continuous counter upsert, as additive partials per micro-batch."""
    events = FX.usage_events_from(_events_stream(spark, sf_dir, files_a_batch))
    partials = _partials(events, G.rollup_usage, _run_dir(spark, "usage", run))
    return G.merge_usage(partials)


def stream_daily(spark: SparkSession, sf_dir: str, run: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """Daily event counts, complete whatever order the events arrive in.

    A watermark would drop late rows and withhold open days; partial counts
    per batch need neither.
    """
    ev = _events_stream(spark, sf_dir, files_a_batch)

    def daily(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))

    partials = _partials(ev, daily, _run_dir(spark, "daily", run))
    return partials.groupBy("day", "event_type").agg(F.sum("n").alias("n"))


def write_beacons(batch: DataFrame, batch_id: int, out: str) -> None:
    """The sinks of one micro-batch of beacons: counters of the accepted, and the rejected as they came.

    The batch is judged once and kept for both sinks.  Each sink's part of a
    batch is replaced as a whole, so a batch that is run again leaves one copy.
    """
    judged = A.beacon_status(batch).persist()
    try:
        for name, rows in (("accepted", G.rollup_usage(beacon_usage(judged))), ("rejected", judged.where("status <> 204"))):
            rows.write.mode("overwrite").parquet(os.path.join(out, name, f"batch_id={batch_id}"))
    finally:
        judged.unpersist()


def beacon_usage(judged: DataFrame) -> DataFrame:
    """Usage events of the accepted beacons."""
    none = F.lit(None).cast("string")
    return judged.where("status = 204").select(
        "ts", F.col("event").alias("event_name"), F.when(F.col("event") == "browser_page_view", "loaded").otherwise("recorded").alias("outcome"),
        none.alias("cache_status"), F.col("page").alias("source"), none.alias("provider"), F.col("status").alias("status_code"),
        *[F.lit(0).alias(m) for m in G.MEASURES])


def stream_beacons(spark: SparkSession, sf_dir: str, run: str | None = None, files_a_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(usage counters of the accepted beacons, rejected beacons) after the stream has read what there is."""
    out = _run_dir(spark, "beacons", run)
    stream = FX.beacons_from(_events_stream(spark, sf_dir, files_a_batch))
    q = (stream.writeStream.foreachBatch(lambda batch, batch_id: write_beacons(batch, batch_id, out))
         .option("checkpointLocation", os.path.join(out, "checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    read = lambda name: spark.read.parquet(os.path.join(out, name)).drop("batch_id")
    return G.merge_usage(read("accepted")), read("rejected")
