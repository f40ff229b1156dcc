"""Incremental jobs as Structured Streaming: consolidation of new documents, runs of equal values, windowed means, consecutive failures.

The stream's checkpoint is the resumable state: which files were read, and which rows of each document were seen.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridmill.sources.sinks import UNDATED, month_columns

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class rocks:
    """Queries started within keep their state in RocksDB, on the executors' disks and in the checkpoint; a new checkpoint's state is dealt to as many tasks as are asked for.

    A key's state goes to Python with each Arrow batch of its rows: where keys have large states and short rows, let batches hold many rows.
    """

    def __init__(self, spark: SparkSession, tasks: int | None = None, batch_rows: int | None = None):
        self.conf = spark.conf
        asked = {"spark.sql.shuffle.partitions": tasks, "spark.sql.execution.arrow.maxRecordsPerBatch": batch_rows}
        self.set = {_PROVIDER: _ROCKS} | {k: str(v) for k, v in asked.items() if v}

    def __enter__(self) -> None:
        self.before = {k: self.conf.get(k, None) for k in self.set}
        for k, v in self.set.items():
            self.conf.set(k, v)

    def __exit__(self, *_: object) -> None:
        for k, v in self.before.items():
            if v is None:
                self.conf.unset(k)
            else:
                self.conf.set(k, v)


def document_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON files of document rows as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def unseen(stream: DataFrame, key: str = "doc_id", ttl_days: int | None = None, row: str | None = None) -> DataFrame:
    """The stream's rows without those of documents' files that came before, in this batch or an earlier one.

    A document may come in several files, each with a part of its rows, and any of them may come again. Rows
    are told apart by their contents; equal rows of a document count as often as in the file that has most of them. State is
    kept by document, so a batch costs what it holds, whatever was there before; it is forgotten ttl_days after a document's last rows.
    Where a column says which row of its document a row is, name it: Spark's own deduplication then does all of this in the JVM.
    """
    if row and not ttl_days:
        return stream.dropDuplicates([key, row])
    columns = stream.columns

    def new(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        most: dict[str, int] = json.loads(state.get[0]) if state.exists else {}
        nth: Counter = Counter()
        for frame in frames:
            fresh = []
            for file, content in zip(frame["file_of_row"].tolist(), frame["content_of_row"].tolist(), strict=True):
                # The n-th of equal rows of a file is the n-th of any other file.
                nth[file, content] += 1
                fresh.append(nth[file, content] > most.get(content, 0))
                most[content] = max(most.get(content, 0), nth[file, content])
            if any(fresh):
                yield frame.loc[fresh, columns]
        state.update((json.dumps(most),))
        if ttl_days:
            state.setTimeoutDuration(ttl_days * 86_400_000)

    try:
        named = stream.select("*", F.col("_metadata.file_path").alias("file_of_row"))
    except AnalysisException:  # not a stream of files: each batch is one
        named = stream.withColumn("file_of_row", F.lit(""))
    named = named.withColumn("content_of_row", F.md5(F.to_json(F.struct(*[f"`{c}`" for c in columns]), {"ignoreNullFields": "false"})))
    return named.groupBy(key).applyInPandasWithState(new, stream.schema, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl_days else GroupStateTimeout.NoTimeout)


def consolidate(stream: DataFrame, table: str, checkpoint: str, posting: str = "posting", key: str = "doc_id", ttl_days: int | None = None, row: str | None = None) -> StreamingQuery:
    """Appends rows not seen before (see unseen) to their posting months, until what is there now is read.

    A batch replays after a crash under the same id; its rows are written to a folder of that id by
    overwriting, so a replay replaces them. The table is never read. Late documents need no watermark: they land in
    their own posting month.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = month_columns(batch, posting).withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "year", "month").parquet(table)

    with rocks(stream.sparkSession):
        return unseen(stream, key, ttl_days, row).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _packed(frame: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(held)).read_pandas()


def _stacked(*frames: pd.DataFrame) -> pd.DataFrame:
    there = [f for f in frames if len(f)]
    return pd.concat(there, ignore_index=True) if there else frames[0]


_OPEN = ["key", "island", "value", "n_rows", "first_us", "last_us"]


def _extended(open_: pd.DataFrame, sure: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Runs that end, and the last run of each key: open runs of many keys, at most one a key, gone on with by rows that all come after them.

    An open run of no rows was given already: it ends nothing, and only its number counts.
    """
    rows = pd.DataFrame({"key": sure["key"], "island": 1, "value": sure["value"], "n_rows": 1, "first_us": sure["at"], "last_us": sure["at"]})
    both = _stacked(open_, rows)
    key = pd.factorize(both["key"], use_na_sentinel=False)[0]
    value = pd.factorize(both["value"], sort=True)[0]  # null: -1, so first
    began = np.arange(len(both)) >= len(open_)
    order = np.lexsort((value, both["first_us"].to_numpy(), began, key))
    both, key, value = both.iloc[order], key[order], value[order]
    n = both["n_rows"].to_numpy()
    of_key = np.r_[True, key[1:] != key[:-1]]
    new = of_key | np.r_[True, (value[1:] != value[:-1]) | (n[:-1] == 0)]
    starts = np.flatnonzero(new)
    found = both.iloc[starts].reset_index(drop=True)
    found["n_rows"], found["last_us"] = np.add.reduceat(n, starts), np.maximum.reduceat(both["last_us"].to_numpy(), starts)
    # Islands go on from that of the key's first run.
    at = np.arange(len(found))
    first = np.maximum.accumulate(np.where(of_key[starts], at, 0))
    found["island"] = found["island"].to_numpy()[first] + at - first
    last = np.r_[of_key[starts][1:], True]
    return found[~last & (found["n_rows"] > 0)], found[last]


def runs(stream: DataFrame, key: str, time: str, value: str, late: str = "2 hours", idle_seconds: int = 86_400, buckets: int = 1024) -> DataFrame:
    """key, island (from 1), value, n_rows, first_at, last_at: runs of equal values in order of time, as windows.islands gives them for a table.

    Rows wait in state until the watermark has passed them, so their order of arrival is of no matter; a run is given when another
    value follows, or when the watermark is idle_seconds past its last row. Rows of equal times are ordered by value.
    State is kept by bucket of keys (null keys have one of their own), so that a batch has a call for each bucket, not for each key: choose so
    many buckets that a task can hold one's waiting rows, and Arrow batches (see rocks) that hold a bucket's new rows. The number stays as it is for all of a checkpoint.
    """
    idle = idle_seconds * 1_000_000

    def update(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto = state.getCurrentWatermarkMs() * 1000
        waiting, open_ = map(_unpacked, state.get) if state.exists else (pd.DataFrame(columns=["key", "at", "value"]), pd.DataFrame(columns=_OPEN))
        if not state.hasTimedOut:
            waiting = _stacked(waiting, *(f[["key", "at", "value"]] for f in frames))
        sure = waiting["at"] < upto
        done = []
        if sure.any():
            ended, open_ = _extended(open_, waiting[sure])
            done.append(ended)
            waiting = waiting[~sure]
        alone = (open_["n_rows"] > 0) & ~open_["key"].isin(waiting["key"])
        over = alone & (open_["last_us"] + idle < upto)
        if over.any():
            done.append(open_[over])
            open_ = open_.assign(n_rows=open_["n_rows"].where(~over, 0), value=open_["value"].where(~over, None))
        state.update((_packed(waiting), _packed(open_)))
        # The next time at which something is certain.
        ahead = [*([waiting["at"].min()] if len(waiting) else []), *([open_["last_us"][alone & ~over].min() + idle] if (alone & ~over).any() else [])]
        if ahead:
            state.setTimeoutTimestamp(max(int(min(ahead)) // 1000, upto // 1000 + 1))
        yield from done

    kind = {f.name: f.dataType for f in stream.schema}[key].simpleString()
    bucket = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(buckets)))
    rows = stream.withWatermark(time, late).select(bucket.alias("bucket"), F.col(key).alias("key"), F.col(time).alias("time_"), F.unix_micros(time).alias("at"), F.col(value).cast("string").alias("value"))
    found = rows.groupBy("bucket").applyInPandasWithState(update, f"key {kind}, island long, value string, n_rows long, first_us long, last_us long", "waiting binary, open binary", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("key", "island", "value", "n_rows", F.timestamp_micros("first_us").alias("first_at"), F.timestamp_micros("last_us").alias("last_at"))


def windowed_mean(stream: DataFrame, time: str, value: str, *keys: str, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Means in tumbling windows, final once the watermark has passed them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, f"{minutes} minutes"), *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("ts"), *keys, "mean", "n")


def failure_breaks(stream: DataFrame, key: str, time: str, failed: str, limit: int = 5, cooldown: float = 0.0) -> DataFrame:
    """A row whenever a key's consecutive failures reach the limit, after which the count begins anew; rows of a batch count in time order.

    For ``cooldown`` seconds after such a break nothing counts.
    """

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, until = state.get if state.exists else (0, float("-inf"))
        rows = pd.concat(list(frames)).sort_values(time)
        out = []
        for at, bad in zip(rows[time], rows[failed], strict=True):
            if at.timestamp() < until:
                continue
            streak = streak + 1 if bad else 0
            if streak == limit:
                out.append((name[0], at))
                streak, until = 0, at.timestamp() + cooldown
        state.update((streak, until))
        yield pd.DataFrame(out, columns=[key, time])

    kind = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind[key]}, {time} {kind[time]}", "streak int, until double", "append", GroupStateTimeout.NoTimeout)


__all__ = ["UNDATED", "consolidate", "document_stream", "failure_breaks", "rocks", "runs", "unseen", "windowed_mean"]
