"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources.tables import read_table

LLM_QUERIES: dict = {}
_HELD: list[dict] = []       # the state of the operator that this Python worker served last
LLM_ORACLES: dict[str, str] = {}
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` as a query of this subpackage."""

    def deco(fn):
        LLM_QUERIES[name] = fn
        if oracle is not None:
            LLM_ORACLES[name] = oracle
        return fn

    return deco


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", *(cols or ("doc_id", "text")))


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``.

    Only a local master may go without the setting (tests); then a temporary
    folder of this machine is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="pagemill-llm-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staged(df: DataFrame, name: str, partitions_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    The shuffle files behind the table go as soon as it is written; the table
    itself stays until ``discard``.
    """
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP)
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write
    if partitions_by:
        writer = writer.partitionBy(partitions_by)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``staged`` tables; nothing that is still to run may read them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def worker_holds(state: dict) -> dict:
    """``state``, now the only one that this Python worker keeps between tasks.

    Workers go from one operator to the next; without this the tables and
    caches of all operators they have served add up.
    """
    if _HELD and _HELD[0] is not state:
        _HELD[0].clear()
        _memory_returned()
    _HELD[:] = [state]
    return state


def worker_frees(state: dict) -> None:
    """Drop ``state`` at a task's end, with the Arrow memory that the worker keeps for further batches.

    An idle worker lives on for a minute, beside the tasks of the next step.
    """
    state.clear()
    _memory_returned()


def _memory_returned() -> None:
    """Give what this process has freed back to the machine: Arrow's pool and the C library keep it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)        # glibc
    if trim is not None:
        trim(0)


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0


def sha256_text(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; ``PAGEMILL_TOKENIZERS`` overrides the folder."""
    folder = os.environ.get("PAGEMILL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
