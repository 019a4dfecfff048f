"""Sinks with a commit step: documents as files (K03) and the keyed result store.

Both keep versions beside each other and a small pointer that names the one
that counts.  A version is written as a whole before the pointer is replaced,
in one step; a write that fails, or a task that is run again, leaves files no
pointer names.  Old versions stay until :func:`drop_old_versions`.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pagemill.operators.freshness import latest_per_key

POINTER = "CURRENT"


class TaskFiles(WriterCommitMessage):
    """Folder of one task's files."""

    def __init__(self, folder: str | None, files: int):
        self.folder, self.files = folder, files


class DocumentWriter(DataSourceWriter):
    """Writes column ``markdown`` of each row to the file named in ``filename``.

    A task writes into a folder of its own; the pointer lists the folders of
    the tasks that counted, one a partition.
    """

    def __init__(self, path: str):
        self.path, self.version = path, f"version-{uuid.uuid4().hex[:12]}"

    def write(self, rows):
        folder, files = f"{self.version}/{uuid.uuid4().hex[:12]}", 0
        for row in rows:
            name = row["filename"]
            if not name or name != os.path.basename(name) or name in (".", ".."):
                raise ValueError(f"no file name: {name!r}")
            if not files:
                os.makedirs(os.path.join(self.path, folder))
            # a name that occurs twice in one task is an error, not a lost document
            with open(os.path.join(self.path, folder, name), "x", encoding="utf-8", newline="") as f:
                f.write(row["markdown"] or "")
            files += 1
        return TaskFiles(folder if files else None, files)

    def commit(self, messages):
        told = [m for m in messages if m is not None and m.folder]
        os.makedirs(self.path, exist_ok=True)
        fresh = os.path.join(self.path, f"{POINTER}.{self.version}")
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump({"version": self.version, "folders": sorted(m.folder for m in told), "files": sum(m.files for m in told)}, f)
        os.replace(fresh, os.path.join(self.path, POINTER))

    def abort(self, messages):
        """Nothing names the files of this version; they are dropped with the old versions."""


class DocumentSink(DataSource):
    """``df.write.format("pagemill_documents").mode("overwrite").option("path", folder).save()``.

    ``folder`` is a path that the driver and all executors mount.
    """

    @classmethod
    def name(cls):
        return "pagemill_documents"

    def schema(self):
        return "filename string, markdown string"

    def writer(self, schema, overwrite):
        return DocumentWriter(self.options["path"])


def write_documents(docs: DataFrame, path: str) -> None:
    """Each row (filename, markdown) as a file; the new files replace those of the last call at once.

    Names must be unique; the rows of one name are sent to one task, which
    fails if it meets a name twice.
    """
    spark = docs.sparkSession
    spark.dataSource.register(DocumentSink)
    dealt = docs.select("filename", "markdown").repartition("filename")
    dealt.write.format(DocumentSink.name()).mode("overwrite").option("path", path).save()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """filename and markdown of the version that counts (an empty table if there is none).

    Spark's readers pass over files without a byte, so documents without text are not told.
    """
    try:
        with open(os.path.join(path, POINTER), encoding="utf-8") as f:
            folders = json.load(f)["folders"]
    except FileNotFoundError:
        folders = []
    if not folders:
        return spark.createDataFrame([], "filename string, markdown string")
    files = spark.read.format("binaryFile").load([os.path.join(path, x) for x in folders])
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), F.col("content").cast("string").alias("markdown"))


# ------------------------------------------------------------- keyed store
def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the store's version that counts."""
    at, files = _files(spark, f"{path}/{POINTER}")
    if not files.util().exists(at):
        return None
    return spark.read.text(f"{path}/{POINTER}").first()[0].strip()


def read_versioned(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/{version}")


def upsert_versioned(new: DataFrame, path: str, key: str = "cache_key", order: str = "fetched_at") -> str:
    """The last row of each key of the store and ``new``, as the store's next version; its name.

    Readers see the old version until the pointer is replaced, and the new one
    after; a failure before leaves the old.
    """
    spark = new.sparkSession
    old = read_versioned(spark, path)
    rows = new if old is None else old.unionByName(new)
    version = f"version-{uuid.uuid4().hex[:12]}"
    latest_per_key(rows, key, order).write.parquet(f"{path}/{version}")
    _replace_pointer(spark, path, version)
    return version


def _replace_pointer(spark: SparkSession, path: str, version: str) -> None:
    jvm = spark._jvm
    fresh, files = _files(spark, f"{path}/{POINTER}.{version}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE, jvm.org.apache.hadoop.fs.CreateFlag.OVERWRITE)
    out = files.create(fresh, flags, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(bytearray(f"{version}\n".encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), how)


def drop_old_versions(spark: SparkSession, path: str) -> list[str]:
    """Remove the versions that the pointer does not name; their names.  Not while a write or a read of them runs."""
    at, files = _files(spark, f"{path}/{POINTER}")
    if not files.util().exists(at):
        return []
    told = spark.read.text(f"{path}/{POINTER}").first()[0].strip()
    kept = json.loads(told)["version"] if told.startswith("{") else told
    gone = [s.getPath() for s in files.util().listStatus(_files(spark, path)[0]) if s.getPath().getName().startswith("version-") and s.getPath().getName() != kept]
    for p in gone:
        files.delete(p, True)
    return [p.getName() for p in gone]
