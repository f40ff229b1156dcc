"""Orders of documents and rows. Missing keys come last in either direction; ties keep the rows' own order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions import timeparse as T

STRATEGIES = ["auto", "timestamp", "forecast-aware", "postdatetime"]


def sort_strategy(strategy: str, columns: list[str]) -> str:
    """'auto' is forecast-aware where both a target and an issue column exist, else by timestamp."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown sort strategy {strategy!r}")
    if strategy != "auto":
        return strategy
    have = T.lower_names(columns)
    both = any(c in have for c in T.TARGET_HINTS) and any(c in have for c in [*T.ISSUE_NAMES, *T.ISSUE_DATES])
    return "forecast-aware" if both else "timestamp"


def sort_order(option: str, download_order: str = "api") -> str | None:
    if option in ("ascending", "descending"):
        return option
    if option == "match-download-order":
        return "descending" if download_order == "newest-first" else "ascending"
    if option == "none":
        return None
    raise ValueError(f"unknown sort order {option!r}")


def sort_keys(columns: list[str], strategy: str = "auto") -> list[Column]:
    """The key's parts; a row is unparsed if the first is null."""
    kind, every = sort_strategy(strategy, columns), T.any_time(columns)
    if kind == "timestamp":
        return [every]
    if kind == "postdatetime":
        return [F.coalesce(T.issue_time(columns), every)]
    target, issue = T.target_time(columns), T.issue_time(columns)
    return [F.coalesce(target, issue, every), F.coalesce(issue, target, every)]


def _directed(keys: list[Column], order: str) -> list[Column]:
    return [k.desc_nulls_last() if order == "descending" else k.asc_nulls_last() for k in keys]


def monthly_sort(df: DataFrame, order: str | None, strategy: str = "auto", row_idx: str = "row_idx", within: list[str] | None = None) -> DataFrame:
    """Rows by their times; equal ones and unparsed ones by row_idx. within: columns (of a month's file) that are sorted each by itself, without a global order."""
    if order is None:
        return df
    by = [*_directed(sort_keys(df.columns, strategy), order), F.col(row_idx).asc()]
    if within:
        return df.repartition(*within).sortWithinPartitions(*within, *by)
    return df.orderBy(*by)


def posting_order(posting: str, day: str, hour: str, order: str = "ascending", row_idx: str = "row_idx") -> list[Column]:
    """Posting time, date and hour ending, each with missing ones last, then row_idx: for a sort or for a window."""
    keys = [T.parse_datetime(posting), T.parse_date(day).cast("date"), T.parse_hour_ending(hour)]
    return [*_directed(keys, order), F.col(row_idx).asc()]


def posting_sort(df: DataFrame, posting: str, day: str, hour: str, order: str = "ascending", row_idx: str = "row_idx") -> DataFrame:
    return df.orderBy(*posting_order(posting, day, hour, order, row_idx))


def document_order(df: DataFrame, order: str, time: str, doc_id: str = "doc_id") -> DataFrame:
    """'newest-first' or 'oldest-first', ties by the id as text in the same direction; 'api' is as it comes."""
    key = F.col(doc_id).cast("string")
    if order == "newest-first":
        return df.orderBy(F.col(time).desc_nulls_last(), key.desc())
    if order == "oldest-first":
        return df.orderBy(F.col(time).asc_nulls_last(), key.asc())
    if order != "api":
        raise ValueError(f"unknown document order {order!r}")
    return df


def top(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows; 0 is no limit. Spark keeps n rows a task before it merges."""
    by = [F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last() for o in order]
    return df.orderBy(*by).limit(n) if n > 0 else df.orderBy(*by)


def bottom(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows in this order, the very last first; missing keys, which come last, are among them."""
    by = [F.col(o[1:]).asc_nulls_first() if o.startswith("-") else F.col(o).desc_nulls_first() for o in order]
    return df.orderBy(*by).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)
