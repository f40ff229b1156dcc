"""Operators over rows in order. Each takes its partition keys, so that no window spans the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.session import saved


def _order(order: list[str]) -> list:
    return [F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last() for o in order]


def lag_seconds(df: DataFrame, time: str, keys: list[str], order: list[str]) -> DataFrame:
    """Seconds since the row before, of the same keys; null for the first."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    return df.withColumn("seconds", (micros - F.lag(micros).over(w)) / 1e6)


def intervals(df: DataFrame, time: str, keys: list[str], order: list[str], most: float = 86400) -> DataFrame:
    """Mean and population deviation of the gaps between 0 (not included) and ``most`` seconds, by keys."""
    gaps = lag_seconds(df, time, keys, order).where((F.col("seconds") > 0) & (F.col("seconds") <= most))
    return gaps.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg("seconds").alias("mean_s"), F.stddev_pop("seconds").alias("std_s"))


def islands(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Runs of equal values in order: island number from 1, value, rows, by keys. The last run counts too."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    changed = F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1)
    marked = df.withColumn("__new", F.when(changed, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island", value).agg(F.count("*").alias("n_rows"))


def _parts(df: DataFrame, keys: list[str], order: list[str], extra: list[Column]) -> DataFrame:
    """Rows dealt by ranges of keys and order and written, with __part (of the range), __at (place in it, by keys) and the extra columns, which see the row before as lag() within the part."""
    by = [F.col(k).asc_nulls_last() for k in keys] + _order(order)
    dealt = saved(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "parts")
    w = Window.partitionBy("__part", *keys).orderBy(*_order(order))
    return dealt.select("*", F.row_number().over(w).alias("__at"), *[c.over(w).alias(f"__x{i}") for i, c in enumerate(extra)])


def _met(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what is known of their part; a null key meets a null key."""
    names = ["__part", *keys]
    other = parts.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(names)], *[c for c in parts.columns if c not in names])
    return rows.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(names)])).drop(*[f"__r{i}" for i in range(len(names))])


def spread_islands(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """As islands, for keys of so many rows that one task can't sort them: ranges of the order are searched by themselves, and stitched where a run goes over a border."""
    rows = _parts(df, keys, order, [F.lag(value)])
    new = F.when((F.col("__at") > 1) & F.col("__x0").eqNullSafe(F.col(value)), 0).otherwise(1)
    inside = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__local", F.sum(new).over(inside)).groupBy("__part", *keys, "__local", value).agg(F.count("*").alias("n_rows"))
    # A row for each part of a key: its first and last run.
    edges = local.groupBy("__part", *keys).agg(F.min_by(value, "__local").alias("__first"), F.max_by(value, "__local").alias("__last"), F.max("__local").alias("__n"))
    over = Window.partitionBy(*keys).orderBy("__part")
    joined = F.coalesce((F.row_number().over(over) > 1) & F.lag("__last").over(over).eqNullSafe(F.col("__first")), F.lit(False)).cast("int")
    steps = edges.withColumn("__joined", joined)
    before = F.sum(F.col("__n") - F.col("__joined")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    base = steps.select("__part", *keys, before.alias("__base"))
    placed = _met(local, base, keys).withColumn("island", F.col("__base") + F.col("__local"))
    return placed.groupBy(*keys, "island", value).agg(F.sum("n_rows").alias("n_rows"))


def spread_inversions(df: DataFrame, key: str, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """As inversions, for keys of so many rows that one task can't sort them: breaks are counted in ranges of the order and at their borders."""
    rows = _parts(df, keys, order, [F.lag(key)])
    back = lambda here, before: F.coalesce((here > before) if descending else (here < before), F.lit(False)) | (here.isNotNull() & before.isNull())
    broken = F.when((F.col("__at") > 1) & back(F.col(key), F.col("__x0")), 1).otherwise(0)
    local = rows.groupBy("__part", *keys).agg(F.count("*").alias("n_rows"), F.sum(broken).alias("__inside"), F.count(key).alias("n_keys"), F.min_by(key, "__at").alias("__first"), F.max_by(key, "__at").alias("__last"))
    over = Window.partitionBy(*keys).orderBy("__part")
    border = F.when((F.row_number().over(over) > 1) & back(F.col("__first"), F.lag("__last").over(over)), 1).otherwise(0)
    found = local.withColumn("__border", border)
    return found.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("__inside") + F.col("__border")).alias("n_inversions"), F.sum("n_keys").alias("n_keys"))


def spread_streaks(df: DataFrame, failed: str, keys: list[str], order: list[str]) -> DataFrame:
    """As streaks, for keys of so many rows that one task can't sort them: a streak at a range's start goes on from the range before."""
    rows = _parts(df, keys, order, [])
    inside = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    # The last row that did not fail: what is behind it is the streak; without one the streak reaches back beyond the part.
    bad = F.coalesce(F.col(failed), F.lit(False))
    local = rows.withColumn("__good", F.max(F.when(~bad, F.col("__at"))).over(inside))
    ends = local.groupBy("__part", *keys).agg(F.max("__at").alias("__n"), F.max("__good").alias("__last"))
    over = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # Failures up to a part's start: the rows of parts since the last that had a good one, and that one's own tail.
    ends = ends.withColumn("__upto", F.sum("__n").over(over)).withColumn("__since", F.max(F.when(F.col("__last").isNotNull(), F.coalesce("__upto", F.lit(0)) + F.col("__last"))).over(over))
    carried = ends.select("__part", *keys, (F.coalesce("__upto", F.lit(0)) - F.coalesce("__since", F.lit(0))).alias("__carried"))
    streak = F.when(F.col("__good").isNull(), F.col("__at") + F.col("__carried")).otherwise(F.col("__at") - F.col("__good"))
    return _met(local, carried, keys).select(*df.columns, streak.cast("long").alias("streak"))


def every_nth(df: DataFrame, n: int, column: str = "island") -> DataFrame:
    return df.where(F.col(column) % n == 0)


def schedule_hits(df: DataFrame, time: str, days: list[int], keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each date that falls on one of these days of the month."""
    day = F.col(time).cast("date")
    held = df.withColumn("day", day).where(F.dayofmonth("day").isin(days))
    w = Window.partitionBy(*keys, "day").orderBy(*_order(order))
    return held.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def inversions(df: DataFrame, key: str, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """Rows that break the order of ``key``: it runs back, or a key follows a missing one. A partition without any is sorted."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    before, here = F.lag(key).over(w), F.col(key)
    back = (here > before) if descending else (here < before)
    broken = F.coalesce(back, F.lit(False)) | (here.isNotNull() & before.isNull() & (F.row_number().over(w) > 1))
    return df.withColumn("__broken", broken.cast("int")).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum("__broken").alias("n_inversions"), F.count(key).alias("n_keys"))


def sort_status(found: DataFrame) -> DataFrame:
    """From inversions(): 'skipped' where no row has a key, 'already' where none breaks the order, else 'sorted' (it has to be)."""
    return found.withColumn("status", F.when(F.col("n_keys") == 0, "skipped").when(F.col("n_inversions") == 0, "already").otherwise("sorted"))


def offsets(df: DataFrame, count: str, keys: list[str], order: list[str]) -> DataFrame:
    """First and last row number (from 0; the last not included) of documents laid end to end."""
    w = Window.partitionBy(*keys).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("row_end", F.sum(count).over(w)).withColumn("row_start", F.col("row_end") - F.col(count))


def chunks(df: DataFrame, size: int, keys: list[str], order: list[str]) -> DataFrame:
    """Numbers rows in chunks of a fixed size, by keys."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def last_rows(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The first n rows in the given order, by keys (descending order gives the last)."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def streaks(df: DataFrame, failed: str, keys: list[str], order: list[str]) -> DataFrame:
    """Consecutive failures up to each row; a success sets the count back to 0."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    run = df.withColumn("__run", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "__run").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    return run.withColumn("streak", F.sum(F.col(failed).cast("int")).over(inside)).drop("__run")


def ordinals(df: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str, descending: bool = False) -> DataFrame:
    """Numbers the rows of each key from 1, by bucket (never null) and then by order.

    Rows are numbered within key and bucket; the counts of the buckets before, one row each, are added.
    A key of very many rows is so numbered by as many tasks as it has buckets.
    """
    sizes = df.groupBy(*keys, bucket).agg(F.count("*").alias("__held"))
    before = Window.partitionBy(*keys).orderBy(F.desc(bucket) if descending else F.asc(bucket)).rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.withColumn("__before", F.sum("__held").over(before) - F.col("__held")).drop("__held")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return df.join(starts, [*keys, bucket]).withColumn(name, F.row_number().over(inside) + F.col("__before")).drop("__before")


def tally(df: DataFrame, status: str = "status") -> DataFrame:
    """How many rows have each status."""
    return df.groupBy(status).agg(F.count("*").alias("n"))


def progress_rows(df: DataFrame, every: int, keys: list[str], order: list[str]) -> DataFrame:
    """The rows worth a log line: a key's first, its last and every n-th."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    all_ = Window.partitionBy(*keys)
    n = F.row_number().over(w)
    return df.withColumn("__i", n).withColumn("__n", F.count("*").over(all_)).where((F.col("__i") == 1) | (F.col("__i") == F.col("__n")) | (F.col("__i") % every == 0)).withColumnRenamed("__i", "place").drop("__n")
