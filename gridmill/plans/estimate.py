"""Time and storage estimates from logs of finished days and from monthly files' sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.timeparse import days_in_month, inclusive_days, inclusive_months
from gridmill.operators.windows import intervals


def time_estimate(events: DataFrame, files: DataFrame, days: DataFrame, min_samples: int = 3, min_days: int = 2) -> DataFrame:
    """Hours that each dataset's days take.

    events (dataset_id, run, completed_at, row_idx), files (dataset_id, modified_at, day), days
    (dataset_id, days). A dataset's seconds a day are the mean gap between its finished days, if there
    are min_samples; else its files' time span over their covered days less one, if there are min_days;
    else the mean of the other datasets' means.
    """
    gaps = intervals(events, "completed_at", ["dataset_id", "run"], ["completed_at", "row_idx"])
    # Runs are put together by their sums, so that gaps never span two runs.
    logged = gaps.groupBy("dataset_id").agg(F.sum("samples").alias("samples"), (F.sum(F.col("samples") * F.col("mean_s")) / F.sum("samples")).alias("mean_s"), F.sum(F.col("samples") * (F.col("std_s") ** 2 + F.col("mean_s") ** 2)).alias("__q"))
    logged = logged.select("dataset_id", "samples", "mean_s", F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("samples") - F.col("mean_s") ** 2)).alias("std_s")).where(F.col("samples") >= min_samples)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    spans = files.groupBy("dataset_id").agg((seconds(F.max("modified_at")) - seconds(F.min("modified_at"))).alias("span"), F.countDistinct("day").alias("covered"))
    spans = spans.where((F.col("covered") >= min_days) & (F.col("span") > 0)).select("dataset_id", (F.col("span") / (F.col("covered") - 1)).alias("file_s"))
    both = days.join(logged, "dataset_id", "left").join(spans, "dataset_id", "left").withColumn("own_s", F.coalesce("mean_s", "file_s"))
    overall = both.agg(F.avg("own_s").alias("overall_s"))
    basis = F.when(F.col("mean_s").isNotNull(), "log").when(F.col("file_s").isNotNull(), "files").otherwise("mean")
    per_day = F.coalesce("own_s", "overall_s")
    return both.join(F.broadcast(overall)).select("dataset_id", "days", basis.alias("basis"), per_day.alias("seconds_per_day"), F.coalesce("std_s", F.lit(0.0)).alias("std_s"), (F.col("days") * per_day / 3600).alias("hours"))


def size_estimate(files: DataFrame, earliest: DataFrame, as_of: str) -> DataFrame:
    """Bytes of each dataset from its earliest day on: the mean of its months' bytes a day times the days.

    files (dataset_id, month, bytes), earliest (dataset_id, first_day); datasets without files or first day have no estimate.
    """
    months = files.groupBy("dataset_id").agg(F.avg("bytes").alias("month_bytes"), F.avg(F.col("bytes") / days_in_month(F.col("month"))).alias("day_bytes"), F.count("*").alias("months"))
    out = earliest.join(months, "dataset_id", "left").withColumn("days", inclusive_days(F.col("first_day"), F.lit(as_of).cast("date")))
    return out.withColumn("estimated_bytes", F.col("day_bytes") * F.col("days"))


def recent_estimate(files: DataFrame, earliest: DataFrame, as_of: str, recent: int = 5) -> DataFrame:
    """As size_estimate, from the mean of the last months' bytes times the months."""
    w = Window.partitionBy("dataset_id").orderBy(F.desc("month"))
    means = files.withColumn("__n", F.row_number().over(w)).groupBy("dataset_id").agg(F.avg(F.when(F.col("__n") <= recent, F.col("bytes"))).alias("recent_bytes"), F.sum("bytes").alias("local_bytes"))
    out = earliest.join(means, "dataset_id", "left").withColumn("months", inclusive_months(F.col("first_day"), F.lit(as_of).cast("date")))
    return out.withColumn("estimated_bytes", F.col("recent_bytes") * F.col("months"))


def with_total(df: DataFrame, key: str, *sums: str) -> DataFrame:
    """Rows of one for each key with their sums, and a row of all, whose key is 'TOTAL': one rollup, so df is read once."""
    out = df.rollup(key).agg(*[F.sum(c).alias(c) for c in sums], F.grouping(key).alias("__all"))
    return out.select(F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col(key)).alias(key), *sums)


def with_tiers(found: DataFrame, tiers: DataFrame) -> DataFrame:
    """Adds the tier of each dataset (a fixed table of a few rows); none for one that is in none."""
    return found.join(F.broadcast(tiers.select("dataset_id", "tier")), "dataset_id", "left")
