"""Checks of curated tables: each returns its findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.timeparse import parse_datetime, parse_iso
from gridmill.operators.aggregates import duplicates, null_rates

__all__ = ["duplicates", "null_rates"]


def unparsed_postings(df: DataFrame, posting: str, *keys: str) -> DataFrame:
    """Rows whose posting time is there but can't be parsed; blanks are no issue."""
    t = F.trim(F.col(posting).cast("string"))
    return df.where((t != "") & F.coalesce(parse_datetime(posting), parse_iso(posting)).isNull()).select(*keys, F.col(posting).alias("posting"))


def missing_days(df: DataFrame, day: str, *keys: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Days between a key's first and last (or the given ones) that it has no row for."""
    have = df.where(F.col(day).isNotNull()).select(*keys, F.col(day).cast("date").alias("day")).distinct()
    ends = have.groupBy(*keys).agg((F.lit(start).cast("date") if start else F.min("day")).alias("a"), (F.lit(end).cast("date") if end else F.max("day")).alias("b"))
    spine = ends.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return spine.join(have, [*keys, "day"], "left_anti")


def missing_months(df: DataFrame, day: str, *keys: str) -> DataFrame:
    have = df.where(F.col(day).isNotNull()).select(*keys, F.trunc(F.col(day).cast("date"), "MM").alias("month")).distinct()
    ends = have.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = ends.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return spine.join(have, [*keys, "month"], "left_anti")


def common_gap(df: DataFrame, time: str, *keys: str) -> DataFrame:
    """The most frequent gap in seconds between a key's times (of equally frequent ones the shortest), and how often it comes."""
    times = df.where(F.col(time).isNotNull()).select(*keys, time).distinct()
    w = Window.partitionBy(*keys).orderBy(time)
    gap = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))) / 1e6
    counted = times.withColumn("gap_s", gap).where("gap_s is not null").groupBy(*keys, "gap_s").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("gap_s")).alias("g"))).alias("m")).select(*keys, (-F.col("m.g")).alias("gap_s"), F.col("m.n").alias("n"))


def all_null(df: DataFrame, *columns: str) -> DataFrame:
    """Of these columns, those without any value."""
    one = df.agg(*[F.count(c).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns]))).where("n = 0").select("column")


def shifted_rows(df: DataFrame, day: str, posting: str) -> DataFrame:
    """Rows whose date column holds a time of day and whose posting time is blank: their columns have moved."""
    return df.where(F.trim(F.col(day)).rlike(r"^\d{1,2}:\d{2}$") & (F.coalesce(F.trim(F.col(posting).cast("string")), F.lit("")) == ""))


def row_counts(raw: DataFrame, clean: DataFrame, *keys: str) -> DataFrame:
    """Rows before and after cleaning, by keys."""
    tag = lambda df, raw_rows: df.select(*keys, F.lit(int(raw_rows)).alias("r"), F.lit(int(not raw_rows)).alias("c"))
    return tag(raw, True).unionByName(tag(clean, False)).groupBy(*keys).agg(F.sum("r").alias("raw_rows"), F.sum("c").alias("clean_rows"))


def null_times(df: DataFrame, time: str) -> Column:
    return F.count(F.when(F.col(time).isNull(), 1))


def cache_issues(lines: DataFrame) -> DataFrame:
    """file, row_idx, value of JSONL cache lines (file, line_no, line) whose posting time is there but can't be parsed; bare documents and {page, doc} lines alike."""
    posting = F.coalesce(F.get_json_object("line", "$.doc.postDatetime"), F.get_json_object("line", "$.postDatetime"))
    return unparsed_postings(lines.select("file", F.col("line_no").alias("row_idx"), posting.alias("value")), "value", "file", "row_idx").withColumnRenamed("posting", "value")
