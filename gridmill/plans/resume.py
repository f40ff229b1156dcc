"""Resumable listings: a run's state by dataset, whether an earlier one may be taken up, and what a run would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.sources.sinks import read_whole, save_whole

#: An earlier state is taken up only if all of these are as they were. Fixed names.
PARAMETERS = ["dataset_id", "window_from", "window_to", "page_size", "download_order", "max_docs_per_dataset", "archive_url"]


def same_parameters(a: str, b: str) -> Column:
    """Whether two structs agree in all PARAMETERS; a missing one agrees with a missing one only."""
    out = F.lit(True)
    for name in PARAMETERS:
        out = out & F.col(f"{a}.{name}").cast("string").eqNullSafe(F.col(f"{b}.{name}").cast("string"))
    return out


def starts(wanted: DataFrame, states: DataFrame) -> DataFrame:
    """Where each wanted run begins: first_page, next_doc_index, and whether its earlier state was taken up or is discarded.

    wanted has PARAMETERS; states has them with status, last_page and next_doc_index. A state of other
    parameters is discarded, a finished one begins anew.
    """
    held = states.select(F.col("dataset_id").alias("__id"), F.struct(*PARAMETERS).alias("__then"), "status", "last_page", "next_doc_index")
    both = wanted.withColumn("__now", F.struct(*PARAMETERS)).join(held, F.col("dataset_id") == F.col("__id"), "left")
    good = F.coalesce(F.col("__id").isNotNull() & same_parameters("__now", "__then") & (F.col("status") != "done"), F.lit(False))
    found = F.when(F.col("__id").isNull(), "new").when(good, "resumed").otherwise("discarded")
    first = F.when(good, F.coalesce("last_page", F.lit(0)) + 1).otherwise(1)
    return both.select(*wanted.columns, found.alias("state"), first.cast("int").alias("first_page"), F.when(good, F.coalesce("next_doc_index", F.lit(0))).otherwise(0).cast("int").alias("next_doc_index"))


def states_of(listed: DataFrame, done: DataFrame, parameters: DataFrame) -> DataFrame:
    """The state to write after a run: parameters, highest listed page, documents listed and finished, and status."""
    pages = listed.groupBy("dataset_id").agg(F.max("page").alias("last_page"), F.count("*").alias("total_docs"))
    ended = done.groupBy("dataset_id").agg(F.count("*").alias("next_doc_index"))
    both = parameters.join(pages, "dataset_id", "left").join(ended, "dataset_id", "left")
    n, m = F.coalesce("total_docs", F.lit(0)), F.coalesce("next_doc_index", F.lit(0))
    return both.select(*parameters.columns, F.coalesce("last_page", F.lit(0)).alias("last_page"), n.cast("int").alias("total_docs"), m.cast("int").alias("next_doc_index"), F.when(m >= n, "done").otherwise("running").alias("status"))


STATE = "dataset_id string, window_from string, window_to string, page_size int, download_order string, max_docs_per_dataset int, archive_url string, last_page int, total_docs int, next_doc_index int, status string"


def save_states(states: DataFrame, path: str) -> None:
    """Saves the states of a run's datasets (see states_of) beside those of all others, all at once."""
    spark = states.sparkSession
    shape = spark.createDataFrame([], STATE).schema
    new = states.select(*[(F.col(f.name) if f.name in states.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])
    others = read_whole(spark, path, STATE).join(new.select("dataset_id"), "dataset_id", "left_anti").select(*shape.names)
    save_whole(others.unionByName(new), path)


def saved_states(spark: SparkSession, path: str) -> DataFrame:
    """All datasets' states, as the last run that ended its save left them: what starts() takes."""
    return read_whole(spark, path, STATE)


def dry_run(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """What a run would fetch and skip, by dataset, without doing it: listed, there already, to fetch, and the bytes of these (unknown ones count as none)."""
    there = have.select(*keys).distinct().withColumn("__there", F.lit(True))
    marked = wanted.join(there, keys, "left").withColumn("__skip", F.coalesce("__there", F.lit(False)))
    size = F.when(~F.col("__skip") & (F.col("bytes") > 0), F.col("bytes")).otherwise(0)
    return marked.groupBy("dataset_id").agg(F.count("*").alias("listed"), F.sum(F.col("__skip").cast("int")).alias("there"), F.sum((~F.col("__skip")).cast("int")).alias("to_fetch"), F.sum(size).alias("bytes"))
