"""What the operators share: tables, the shared folder, materialised intermediates."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of this process only where that is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: intermediates are written there")
        found = "file://" + tempfile.mkdtemp(prefix="gridmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_own: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; Hadoop deletes it when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/gridmill/{spark.sparkContext.applicationId}"
    if path not in _own:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _own.add(path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing, _lock = {}, threading.Lock()


class _cleaned:
    """While writes run, Spark drops the shuffle files that led to what was written; the first one in sets that, the last one out takes it back."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        with _lock:
            n, before = _writing.get(id(self.spark), (0, None))
            if not n:
                before = self.spark.conf.get(_CLEANUP, None)
                self.spark.conf.set(_CLEANUP, "true")
            _writing[id(self.spark)] = n + 1, before

    def __exit__(self, *_: object) -> None:
        with _lock:
            n, before = _writing.pop(id(self.spark))
            if n > 1:
                _writing[id(self.spark)] = n - 1, before
            elif before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it: cuts lineage, and survives the loss of executors.

    The shuffle files that led there have done their work once all is written; Spark is told to drop them then.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a driver-built file of checked size to the shared folder; returns its URI."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{own_dir(spark)}/{uuid.uuid4().hex}/{name}")
    out = path.getFileSystem(conf).create(path)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()
    return path.toUri().toString()


#: Rows that Spark hands to Python at once; the default of 10000 long texts would fill a worker's memory.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS where they are at Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def docs_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns named, whatever else df carries."""
    bound_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
