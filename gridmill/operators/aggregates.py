"""Means by time, resampling, counts, rates and dedupes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _clean(c: str) -> Column:
    """NaN takes no part in a mean, as a null doesn't."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def mean_by_time(df: DataFrame, time: str, values: dict[str, str], *keys: str) -> DataFrame:
    """Means of values (new name -> column) by time and keys; rows without a time take no part."""
    return df.where(F.col(time).isNotNull()).groupBy(time, *keys).agg(*[F.avg(_clean(c)).alias(n) for n, c in values.items()])


def mean_of_all(df: DataFrame, time: str) -> DataFrame:
    """Means of all other numeric columns by time."""
    numeric = [f.name for f in df.schema if f.name != time and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")]
    return mean_by_time(df, time, {c: c for c in numeric})


def bucket(time: Column | str, unit: str = "hour") -> Column:
    return F.date_trunc(unit, F.col(time) if isinstance(time, str) else time).cast("timestamp_ntz")


def resample(df: DataFrame, time: str, values: dict[str, str], *keys: str, unit: str = "hour", fill_gaps: bool = False) -> DataFrame:
    """Means by hour (or unit) as ``ts_local``, and keys. With fill_gaps, hours without rows between the first and last are there too, null; only without keys."""
    found = mean_by_time(df.withColumn("ts_local", bucket(time, unit)), "ts_local", values, *keys)
    if not fill_gaps:
        return found
    if keys:
        raise ValueError("gaps are filled for a whole system, not by key")
    ends = found.agg(F.min("ts_local").alias("a"), F.max("ts_local").alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("ts_local"))
    return spine.join(found, "ts_local", "left")


def resample_minutes(df: DataFrame, time: str, values: dict[str, str], *keys: str, minutes: int = 15) -> DataFrame:
    """Means in tumbling windows of so many minutes; the same columns work on a stream."""
    window = F.window(F.col(time), f"{minutes} minutes")
    return df.where(F.col(time).isNotNull()).groupBy(window, *keys).agg(*[F.avg(_clean(c)).alias(n) for n, c in values.items()]).withColumn("ts_local", F.col("window.start").cast("timestamp_ntz")).drop("window")


def frequencies(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by value, most frequent first; rows with a null key take no part."""
    held = df
    for k in keys:
        held = held.where(F.col(k).isNotNull())
    return held.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def null_rates(df: DataFrame) -> DataFrame:
    """Share of nulls (and NaN) of each column, highest first."""
    missing = lambda f: F.col(f"`{f.name}`").isNull() | (F.isnan(f"`{f.name}`") if f.dataType.typeName() in ("double", "float") else F.lit(False))
    one = df.agg(*[F.avg(missing(f).cast("double")).alias(f"r{i}") for i, f in enumerate(df.schema)])
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"r{i}").alias("null_rate")) for i, f in enumerate(df.schema)])
    return one.select(F.inline(pairs)).orderBy(F.desc("null_rate"), "column")


def mean_with_interval(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, sample deviation, rows and the half width of the mean's 95 % normal interval."""
    s = df.groupBy(*keys).agg(F.avg(_clean(value)).alias("mean"), F.stddev_samp(_clean(value)).alias("std"), F.count(_clean(value)).alias("n"))
    return s.withColumn("half_width", 1.96 * F.col("std") / F.sqrt("n"))


def first_rows(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of rows with the same keys the first in the given order (of columns, or ``-column`` for descending)."""
    by = [F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last() for o in order]
    # max_by over a struct would lose ties' order; a window sorts each key's rows, and keeps one before any are sent on.
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows repeat a key that another row has."""
    by_key = df.groupBy(*keys).agg((F.count("*") - 1).alias("more"))
    return by_key.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n_duplicates"), F.count(F.when(F.col("more") > 0, 1)).alias("n_keys"))


def coverage(df: DataFrame, value: Column, parsed: Column, *keys: str) -> DataFrame:
    """Rows, filled values and filled values that don't parse, by keys."""
    filled = F.trim(value.cast("string")) != ""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(F.when(filled, 1)).alias("filled"), F.count(F.when(filled & parsed.isNull(), 1)).alias("malformed"))
