"""Joins of series, of documents and their posting times, and of rows by their fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.text import blank_to_null, fingerprint
from gridmill.operators.windows import ordinals
from gridmill.session import saved

#: Row numbers that are filled by position together, and rows of one fingerprint that one task numbers.
STRETCH, MANY = 65536, 65536


def join_series(series: list[DataFrame], key: str = "ts_local", how: str = "outer") -> DataFrame:
    """Series of one row a time, side by side. All are exchanged by the key once; each join reuses that."""
    return reduce(lambda a, b: a.join(b, key, how), series).dropDuplicates([key])


def pivot_series(df: DataFrame, time: str, kind: str, value: str, kinds: list[str], prefix: str = "") -> DataFrame:
    """The same result as joining one mean a kind, from one pass and one exchange."""
    held = df.where(F.col(time).isNotNull() & F.col(kind).isin(kinds))
    return held.groupBy(time).agg(*[F.avg(F.when(F.col(kind) == k, F.col(value))).alias(f"{prefix}{k}") for k in kinds])


def lookup(docs: DataFrame, sources: list[DataFrame], key: str = "doc_id", value: str = "posting") -> DataFrame:
    """Each document's value from the first source (in order of priority) that has one; blanks are none. Within a source the first by ``row_idx`` counts."""
    ranked = [s.select(key, blank_to_null(value).alias(value), F.struct(F.lit(i).alias("source"), F.col("row_idx").cast("long").alias("row_idx")).alias("rank")) for i, s in enumerate(sources)]
    best = reduce(DataFrame.unionByName, ranked).where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, "rank").alias(value), F.min("rank")["source"].alias("source"))
    return docs.join(best, key, "left")


def not_known(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(known.select(key), key, "left_anti")


def selected(docs: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(wanted.select(key), key, "left_semi")


def fill_by_fingerprint(targets: DataFrame, sources: DataFrame, columns: list[str], posting: str = "posting", order: str = "row_idx", overwrite: bool = False, allow_unanimous: bool = False, bucket: Column | None = None) -> DataFrame:
    """Fills targets' missing posting times from sources with the same values in ``columns``.

    A multiset join: the n-th target row still to fill takes the n-th source row from the end; a source
    row is used once, and one whose posting time is blank is used up without filling. A target that has
    a posting time keeps it and uses none. With overwrite all targets are to be filled, but fingerprints
    of more than one source row are left blank, unless allow_unanimous and all of them agree. A coarse
    part of the order, if given as a bucket column, keeps a very frequent fingerprint from being one task's; both sides are then read
    twice.
    """
    key = fingerprint(columns)
    part = F.lit(0) if bucket is None else bucket
    s = sources.select(key.alias("__f"), F.col(posting).alias("__p"), F.col(order).alias("__o"), part.alias("__b"))
    t = targets.withColumn("__f", key)
    if overwrite:
        one = s.groupBy("__f").agg(F.count("*").alias("__n"), F.min("__p").alias("__lo"), F.max("__p").alias("__hi"))
        use = (F.col("__n") == 1) | (F.lit(allow_unanimous) & F.col("__lo").eqNullSafe(F.col("__hi")))
        return t.join(one.where(use).select("__f", F.col("__lo").alias("__new")), "__f", "left").withColumn(posting, blank_to_null("__new")).drop("__f", "__new")
    need = blank_to_null(posting).isNull()
    t = t.withColumn("__need", need).withColumn("__b", part)
    if bucket is None:
        t = t.withColumn("__k", F.row_number().over(Window.partitionBy("__f", "__need").orderBy(order)))
        s = s.withColumn("__k", F.row_number().over(Window.partitionBy("__f").orderBy(F.desc("__o"))))
    else:
        t = _numbered(t, ["__f", "__need"], [F.asc("__b"), F.col(order)])
        s = _numbered(s, ["__f"], [F.desc("__b"), F.desc("__o")], descending=True)
    t, s = t.withColumn("__k", F.when(F.col("__need"), F.col("__k"))).drop("__b"), s.drop("__o", "__b")
    return t.join(s, ["__f", "__k"], "left").withColumn(posting, F.when(F.col("__need"), blank_to_null("__p")).otherwise(F.col(posting))).drop("__f", "__k", "__need", "__p")


def _numbered(df: DataFrame, keys: list[str], by: list[Column], descending: bool = False) -> DataFrame:
    """Rows with their place from 1 (__k) among those of their keys (never null), by bucket (__b) and order. Only keys of very many rows are numbered by buckets; there are few of these, so all others' rows are exchanged once."""
    counted = df.select(*keys).groupBy(*keys).agg(F.count("*").alias("__n"))
    many = saved(counted.where(F.col("__n") > MANY).select(*keys), "many")
    few = df if many.isEmpty() else df.join(many, keys, "left_anti")
    few = few.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return few if many.isEmpty() else few.unionByName(ordinals(df.join(many, keys, "left_semi"), keys, "__b", by[1:], "__k", descending))


def collisions(rows: DataFrame, columns: list[str], tasks: int | None = None) -> DataFrame:
    """Values of the columns that more than one row has, and how many: fingerprints that don't tell rows apart. They are dealt to as many tasks as are named, so that what one counts doesn't grow with the rows."""
    held = rows.select(fingerprint(columns).alias("__f"))
    held = (held.repartition(tasks, "__f") if tasks else held).groupBy("__f").agg(F.count("*").alias("n")).where("n > 1")
    return held.select(*[F.col("__f")[f"f{i}"].alias(c) for i, c in enumerate(columns)], "n")




def fill_by_position(rows: DataFrame, docs: DataFrame, month: str = "month", row_idx: str = "row_idx", give: dict[str, str] | None = None) -> DataFrame:
    """Gives each row of a month the document it lies in; docs: month, doc_id, row_start, row_end (see windows.offsets), which don't overlap.

    Rows and the documents' first places are dealt by stretches of row numbers, and in the order of these a row takes the last
    document before it. A document that lies in several stretches begins in each of them, so rows are exchanged once, and no
    month and no document is one task's. give: new name -> column of docs, in place of doc_id.
    """
    give = give or {"doc_id": "doc_id"}
    stretch = lambda c: F.floor(F.col(c) / STRETCH).cast("long")
    own = F.struct(F.col("row_end").alias("end"), *[F.col(c).alias(n) for n, c in give.items()])
    spans = docs.where((F.col("row_end") > F.col("row_start")) & F.col(month).isNotNull())
    spans = spans.select(month, "row_start", own.alias("__doc"), F.explode(F.sequence(stretch("row_start"), F.floor((F.col("row_end") - 1) / STRETCH).cast("long"))).alias("__s"))
    starts = spans.select(month, "__s", "__doc", F.greatest(F.col("row_start"), F.col("__s") * STRETCH).alias("__at"), F.lit(0).alias("__kind"))
    both = rows.withColumns({"__s": stretch(row_idx), "__at": F.col(row_idx).cast("long"), "__kind": F.lit(1)}).unionByName(starts, allowMissingColumns=True)
    before = Window.partitionBy(month, "__s").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("__doc", F.last("__doc", ignorenulls=True).over(before)).where("__kind = 1")
    return held.select(*rows.columns, *[F.when(F.col(row_idx) < F.col("__doc.end"), F.col("__doc")[n]).alias(n) for n in give])


def renamed_ids(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Old ids replaced by new ones. aliases (old_id, new_id) is a fixed table of a few rows."""
    a = aliases.select(F.col("old_id").alias(column), F.col("new_id").alias("__new"))
    return df.join(F.broadcast(a), column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def mismatched_counts(docs: DataFrame, rows: DataFrame, key: str, expected: str) -> DataFrame:
    """Documents whose header's row count isn't that of their rows."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    return docs.join(counted, key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).where(F.col(expected) != F.col("n_rows"))
