"""The session that the jobs expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC, so that truncating local times never meets a zone change; partitions are replaced one by one on overwrite.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "gridmill", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=CONF | more).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path for a job's own files, under the folder that driver and executors share (spark.checkpoint.dir); Hadoop deletes it when the driver's JVM ends.

    Where that setting is missing and all run on one machine, as in tests, a local folder stands for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = f"{root.rstrip('/')}/gridmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return path


#: Rows of a table that a task gets of it.
TASK_ROWS = 250_000


def tasks_for(table: DataFrame) -> int:
    """How many tasks a table's rows are dealt to. A scan's rows are counted by its files' footers."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))


def dealt(table: DataFrame, *keys: str) -> DataFrame:
    """A scan's rows dealt by keys to tasks whose number grows with the rows, so that a task's work and memory don't. What follows by these keys needs no other exchange."""
    return table.repartition(tasks_for(table), *keys)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in a scratch folder and rereads it: what is built on it twice is computed once, and a lost executor costs its own tasks only."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
