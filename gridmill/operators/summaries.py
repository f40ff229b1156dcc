"""Summaries from one pass: totals beside their details, correlations of all pairs of columns, distinct counts that add up, counters of what a job reads, and rows that fail a check set aside."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gridmill.sources.files import path_exists


def rolled_up(df: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Aggregates by all keys, by each beginning of them and over all, from one scan; level is how many keys a row has (a null key of a row is no missing one)."""
    level = F.lit(len(keys)) - sum((F.grouping(k).cast("int") for k in keys), F.lit(0))
    return df.rollup(*keys).agg(*[c.alias(n) for n, c in sums.items()], level.cast("int").alias("level"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """left, right, n, corr of every pair of columns, over the rows that have both: one row of mergeable moments a task, whatever the rows."""
    pairs = list(combinations(columns, 2))
    both = lambda a, b: F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
    found = df.agg(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), both(a, b).alias("n"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr")) for a, b in pairs]).alias("pairs"))
    return found.select(F.inline("pairs"))


def scatter_sample(df: DataFrame, n: int, key: list[str]) -> DataFrame:
    """n rows for a scatter plot, the same in every run: those whose keys' hashes are smallest. A task hands on n rows at most, and samples of parts merge to that of the whole."""
    return df.orderBy(F.xxhash64(*key), *key).limit(n)


def month_sketches(df: DataFrame, month: str, *values: str, precision: int = 14) -> DataFrame:
    """month, sketch of its distinct values: to be kept, so that no window needs its rows again. The relative error is about 1.04 / sqrt(2**precision)."""
    value = F.col(values[0]) if len(values) == 1 else F.concat_ws("\x1f", *[F.coalesce(F.col(v).cast("string"), F.lit("\x00")) for v in values])
    return df.groupBy(month).agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def distinct_in(sketches: DataFrame, inside: Column) -> DataFrame:
    """About how many distinct values the months of this condition hold together: n. None at all is 0."""
    return sketches.where(inside).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("long").alias("n"))


def observed(df: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and what they count up to (a dict, by ``.get``) once the job that they are part of has run: no second pass."""
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


class StreamCounters(StreamingQueryListener):
    """Adds up what the batches of streams observe under this name (see DataFrame.observe), by query."""

    def __init__(self, name: str):
        self.name, self.totals = name, {}

    def onQueryStarted(self, event: object) -> None:
        self.totals.setdefault(str(event.id), {})

    def onQueryProgress(self, event: object) -> None:
        row = event.progress.observedMetrics.get(self.name)
        own = self.totals.setdefault(str(event.progress.id), {})
        for k, v in (row.asDict() if row else {}).items():
            own[k] = own.get(k, 0) + (v or 0)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        pass


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds reason: the name of the first rule that a row breaks (a rule that can't be decided is broken), null for a good row."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.withColumn("reason", reason)


CLEAN, QUARANTINE = "clean", "quarantine"


def write_checked(df: DataFrame, rules: dict[str, Column], path: str, mode: str = "append") -> None:
    """One pass that writes good rows and, with their reasons, the others: read them by clean_rows and quarantined."""
    checked(df, rules).withColumn("kind", F.when(F.col("reason").isNull(), CLEAN).otherwise(QUARANTINE)).write.mode(mode).partitionBy("kind").parquet(path)


def _kind(df_of: DataFrame, kind: str) -> DataFrame:
    return df_of.where(F.col("kind") == kind).drop("kind")


def clean_rows(table: DataFrame) -> DataFrame:
    return _kind(table, CLEAN).drop("reason")


def quarantined(table: DataFrame) -> DataFrame:
    return _kind(table, QUARANTINE)


def replayed(path: str, table: DataFrame, mend: Callable[[DataFrame], DataFrame], rules: dict[str, Column], to: str) -> None:
    """Mends the rows set aside and checks them again, into a new table at ``to`` beside the good ones; the old table stays as it was."""
    spark = table.sparkSession
    if path_exists(spark, to):
        raise FileExistsError(f"{to} exists; a replay of {path} needs a new place")
    write_checked(clean_rows(table).unionByName(mend(quarantined(table).drop("reason"))), rules, to, "errorifexists")
