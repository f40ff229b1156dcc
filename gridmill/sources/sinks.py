"""Writes: partitioned tables, document appends without repeats, manifests, failures, summaries, listings."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridmill.functions.text import blank_to_null, clean_header, event_line, posting_column
from gridmill.functions.timeparse import parse_iso
from gridmill.registry import POSTING_NAMES
from gridmill.sources.files import file_system, first_line, path_exists

UNDATED = "undated"


def month_columns(df: DataFrame, posting: str) -> DataFrame:
    """Adds year and month (as text) of posting; 'undated' without one."""
    ts = parse_iso(posting)
    return df.withColumn("year", F.coalesce(F.date_format(ts, "yyyy"), F.lit(UNDATED))).withColumn("month", F.coalesce(F.date_format(ts, "MM"), F.lit(UNDATED)))


def write_table(df: DataFrame, path: str, by: list[str] = ("dataset_id", "year", "month"), mode: str = "append") -> None:
    """Parquet by partition. Rows of a partition are dealt to several tasks if they are many (the rebalance hint splits them), so that no month is one task's."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str] = ("dataset_id", "year", "month")) -> None:
    """Rewrites only the partitions that df has rows of; a failed job leaves the old ones."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_documents(rows: DataFrame, path: str, known: DataFrame | None, posting: str = "posting") -> DataFrame:
    """Appends rows (dataset_id, doc_id, posting, ...) of documents that the table doesn't hold yet; returns what it wrote.

    The table's own doc_id is the marker, so a document is never there without its mark or twice.
    """
    new = rows if known is None else rows.join(known.select("doc_id"), "doc_id", "left_anti")
    out = month_columns(new, posting)
    write_table(out, path)
    return out


def reconciled(rows: DataFrame, header: list[str], posting_value: Column | None = None) -> DataFrame:
    """Rows under a table's header: its posting column under whichever alias each side has, its other columns by name.

    Columns that only the rows have come behind; those they lack, and a posting time that they lack, are
    blank. posting_value (a document's own posting time) fills rows that have none.
    """
    theirs, mine = posting_column(header), posting_column(rows.columns)
    name = theirs or mine or POSTING_NAMES[0]
    at = blank_to_null(f"`{mine}`") if mine else F.lit(None).cast("string")
    filled = F.coalesce(at, blank_to_null(posting_value)) if posting_value is not None else at
    have = {c.strip(): c for c in reversed(rows.columns)}
    ordered = list(dict.fromkeys([*clean_header(header), *clean_header(rows.columns)]))
    cell = lambda c: F.coalesce(F.col(f"`{have[c]}`").cast("string"), F.lit("")) if c in have else F.lit("")
    return rows.select(F.coalesce(filled, F.lit("")).alias(name), *[cell(c).alias(c) for c in ordered])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table whose months may have been written with different columns: the union of all, null where a month lacks one."""
    return spark.read.option("mergeSchema", True).parquet(path)


def append_reconciled(rows: DataFrame, path: str, posting_value: Column | None = None) -> DataFrame:
    """Appends rows under the table's own header (see reconciled) to their posting months; returns what was written.

    Columns that the table lacks are added by what is written now: nothing that is there is written again, and
    read_table gives them as null for earlier rows. The first append makes the table.
    """
    spark = rows.sparkSession
    header = [c for c in read_table(spark, path).columns if c not in ("year", "month")] if path_exists(spark, path) else []
    out = reconciled(rows, header, posting_value)
    dated = month_columns(out, out.columns[0])
    write_table(dated, path, ["year", "month"])
    return dated


_CURRENT = "_current"


def save_whole(df: DataFrame, path: str) -> None:
    """Replaces what path holds by df's rows, all at once: they are written beside it, and one rename says that they count.

    A job that dies before leaves the old rows; readers (read_whole) have either. The version before is kept for those
    that still read it, older ones are deleted.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path, before = jvm.org.apache.hadoop.fs.Path, _version(spark, path)
    fs, note = Path(path).getFileSystem(conf), Path(f"{path}/{_CURRENT}-{version}")
    out = fs.create(note)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(Path(path).toUri(), conf) if "://" in path else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(note), fs.makeQualified(Path(f"{path}/{_CURRENT}")), over)
    for status in fs.listStatus(Path(path)):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)


def _version(spark: SparkSession, path: str) -> str | None:
    at = f"{path}/{_CURRENT}"
    return first_line(spark, at) if path_exists(spark, at) else None


def read_whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What save_whole saved last; no rows if nothing was."""
    version = _version(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{version}") if version else spark.createDataFrame([], schema)


def clear_files(spark: SparkSession, files: DataFrame, archive: str | None = None, dry_run: bool = False) -> dict[str, int]:
    """Deletes files (path), or moves them under archive/<dataset>/<year>/<month>/ as they lie; how many were 'moved', 'deleted', 'gone' before, or 'planned'.

    A file of the same name and size in the archive takes the place of one that is moved; one of another size stays, and the
    new one gets a suffix. Only names pass through the driver, one after the other.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path, done = jvm.org.apache.hadoop.fs.Path, Counter()
    for r in files.select("path").toLocalIterator():
        at = Path(r.path)
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            done["gone"] += 1
        elif dry_run:
            done["planned"] += 1
        elif archive is None:
            done["deleted"] += bool(fs.delete(at, False))
        else:
            month, year, dataset = at.getParent(), at.getParent().getParent(), at.getParent().getParent().getParent()
            folder = f"{archive.rstrip('/')}/{dataset.getName()}/{year.getName()}/{month.getName()}"
            fs.mkdirs(Path(folder))
            to, n = Path(f"{folder}/{at.getName()}"), 0
            if fs.exists(to) and fs.getFileStatus(to).getLen() == fs.getFileStatus(at).getLen():
                fs.delete(at, False)
            else:
                while fs.exists(to):
                    n += 1
                    to = Path(f"{folder}/{at.getName()}.dup{n}")
                if not fs.rename(at, to):
                    raise OSError(f"{r.path} could not be moved to {to}")
            done["moved"] += 1
    return dict(done)


def with_posting_column(df: DataFrame, name: str = "postDateTime") -> DataFrame:
    """The table with a posting-time column first, blank where it had none."""
    return df if name in df.columns else df.select(F.lit("").alias(name), *[f"`{c}`" for c in df.columns])


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines in part files, appended: earlier runs' entries stay, since lookups read them. files.manifest reads them back."""
    df.write.mode("append").json(path)


def failure_rows(spark: SparkSession, failures: list[tuple[str, str, str, int | None, str]]) -> DataFrame:
    """timestamp, dataset_id, stage, doc_id, page, error of a run's failures."""
    df = spark.createDataFrame(failures, "dataset_id string, stage string, doc_id string, page int, error string")
    return df.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "*")


def write_log(events: DataFrame, path: str) -> None:
    """events (event, fields): a line each."""
    events.select(event_line("event", "fields").alias("value")).write.mode("append").text(path)


def run_summary(stats: DataFrame) -> DataFrame:
    """One row: totals of the counters and a map of each dataset's, from (dataset_id, counter columns)."""
    counters = [c for c in stats.columns if c != "dataset_id"]
    own = F.map_from_entries(F.collect_list(F.struct("dataset_id", F.struct(*counters))))
    return stats.agg(*[F.sum(c).alias(c) for c in counters], own.alias("datasets"))


def markdown(df: DataFrame) -> DataFrame:
    """A table's rows as Markdown lines (value), in the table's order."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("value"))


def markdown_header(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)


def redundant_documents(docs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Documents (dataset_id, month, doc_id) whose month is complete and well formed: coverage rows = filled, nothing malformed. These may be archived or deleted."""
    done = coverage.where((F.col("rows") > 0) & (F.col("rows") == F.col("filled")) & (F.col("malformed") == 0)).select("dataset_id", "month")
    return docs.join(done, ["dataset_id", "month"], "left_semi")


def document_files(docs: DataFrame, path: str) -> None:
    """Writes each document's CSV text (dataset_id, month, doc_id, text) under its folder, as text of one partition a document's month."""
    docs.select("dataset_id", "month", "doc_id", F.col("text").alias("value")).write.mode("append").partitionBy("dataset_id", "month", "doc_id").text(path)


def json_report(df: DataFrame) -> DataFrame:
    """A table's rows as JSON lines (value), nulls included."""
    return df.select(F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def tab_report(df: DataFrame) -> DataFrame:
    """A table's rows as lines (value) of values between tabs; nulls are blank, tabs and line breaks in values become spaces."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[\t\r\n]", " ")
    return df.select(F.concat_ws("\t", *[cell(c) for c in df.columns]).alias("value"))


def sort_cache(found: DataFrame) -> DataFrame:
    """What a sort found of each file (file, n_rows, strategy, order, status, modified_at), as the rows that a later sort looks up."""
    return found.select("file", F.col("n_rows").cast("long").alias("n_rows"), "strategy", "order", "status", F.col("modified_at").cast("timestamp_ntz").alias("modified_at"))


def still_sorted(files: DataFrame, cache: DataFrame, strategy: str, order: str) -> DataFrame:
    """Files (file, modified_at) that need no sort: the cache knows them as sorted this way, unchanged since."""
    good = cache.where((F.col("strategy") == strategy) & (F.col("order") == order) & F.col("status").isin("sorted", "already")).select("file", "modified_at")
    return files.join(good, ["file", "modified_at"], "left_semi")


def export_files(lines: DataFrame, path: str, key: str, order: list[str], name: Callable[[str], str], large: bool = False) -> None:
    """One text file for each key, of its rows' ``value`` in order, under path/name(key): the layout that other tools read.

    A file is one task's, so this is for files that have to be single; tables are written by partition
    (write_table). Where files are few and large, large deals rows by ranges of key and order: tasks sort and write
    parts of files, and what is left to one task is to put a file's parts together, byte by byte.
    Tasks write files beside their places, and when all are written, tasks move them to their names, where they replace
    what was there: the driver does nothing by file. A row without a key is an error, and so are two keys of one name.
    Arrow's file systems are written so; in other stores files are moved through Hadoop, one after the other.
    """
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(conf).makeQualified(at).toString().rstrip("/")
    try:
        file_system(root)
    except (pa.ArrowInvalid, OSError):  # a store that Arrow doesn't know, or whose client library isn't here
        return _export_through_hadoop(lines, path, key, order, name)
    made = f"{root}/_writing-{uuid.uuid4().hex}"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(f"{made}/{uuid.uuid4().hex}")
        fs.create_dir(folder)
        out, last, done, part = None, None, [], TaskContext.get().partitionId()
        for batch in batches:
            runs, start = pc.run_end_encode(batch.column(0)), 0
            for k, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if k != last or not done:
                    if out:
                        out.close()
                    out, last = (fs.open_output_stream(f"{folder}/{len(done)}") if k else None), k
                    done.append((k or None, f"{folder}/{len(done)}", name(k) if k else None, part))
                if out:
                    out.write(_bytes(batch.column(1), start, end))
                start = end
            if len(done) > 10000:  # the last one goes on
                yield _named(done[:-1])
                done = done[-1:]
                folder = f"{folder}_"
                fs.create_dir(folder)
        if out:
            out.close()
        yield _named(done)

    def whole(r: Row) -> Row:
        fs, to = file_system(f"{made}/{uuid.uuid4().hex}")
        with fs.open_output_stream(to) as out:
            for part in r.parts:
                with fs.open_input_stream(part.made) as held:
                    while block := held.read(1 << 22):
                        out.write(block)
        return Row(made=to, name=r.name)

    def moved(rows: Iterator[Row]) -> None:
        (fs, base), folders = file_system(root), set()
        for r in rows:
            to = f"{base}/{r.name}"
            folder, file = to.rsplit("/", 1)
            if folder not in folders:
                fs.create_dir(folder)
                folders.add(folder)
            if fs.get_file_info(r.made).type == pafs.FileType.NotFound:
                if fs.get_file_info(to).type == pafs.FileType.NotFound:
                    raise OSError(f"{r.made} could not be moved to {to}")
                continue  # an attempt of this task before has moved it
            if isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(crc := f"{folder}/.{file}.crc").type == pafs.FileType.File:
                fs.delete_file(crc)  # Hadoop's checksum of the file that was there
            fs.move(r.made, to)

    try:
        dealt = lines.repartitionByRange(key, *order) if large else lines.repartition(key)
        value = F.concat(F.coalesce(F.col("value").cast("string"), F.lit("")), F.lit("\n")).cast("binary")
        rows = dealt.sortWithinPartitions(key, *order).select(F.col(key).cast("string").alias("key"), value.alias("value"))
        rows.mapInArrow(written, _MADE).write.parquet(f"{made}/names")
        names = spark.read.schema(_MADE).parquet(f"{made}/names")
        files = names.groupBy("name").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.max("key").alias("other"), F.min("made").alias("made"))
        bad = files.where((F.col("key") != F.col("other")) | F.col("name").isNull() | (F.lit(not large) & (F.col("n") > 1))).head(1)
        if bad:
            raise ValueError(f"{key}: {'a row has no key' if bad[0].name is None else f'{bad[0].name!r} has several files'}; nothing was moved")
        cut = []
        if large:  # A range's border cuts no more than one file, so these are no more than the tasks.
            several = names.join(files.where("n > 1").select("name"), "name").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("part", "made"))).alias("parts")).collect()
            cut = spark.sparkContext.parallelize(several, len(several)).map(whole).collect() if several else []
        files.where("n = 1").select("made", "name").repartition(spark.sparkContext.defaultParallelism).foreachPartition(moved)
        if cut:
            spark.sparkContext.parallelize(cut, len(cut)).foreachPartition(moved)
    finally:
        fs, folder = file_system(made)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


def _bytes(column: pa.Array, start: int, end: int) -> pa.Buffer:
    """The bytes of a binary column's values from start to end, which Arrow holds one after the other."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first, last = int(at[column.offset + start]), int(at[column.offset + end])
    return data.slice(first, last - first)


_MADE = "key string, made string, name string, part int"


def _named(files: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], pa.int32() if i == 3 else pa.string()) for i in range(4)], ["key", "made", "name", "part"])


def _export_through_hadoop(lines: DataFrame, path: str, key: str, order: list[str], name: Callable[[str], str]) -> None:
    """As export_files, in a store that only Hadoop reaches: names pass through the driver, and files are moved one after the other."""
    spark = lines.sparkSession
    made = f"{path.rstrip('/')}/_writing"
    lines.repartition(key).sortWithinPartitions(key, *order).select(key, "value").write.mode("overwrite").partitionBy(key).text(made)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(conf)
    held: dict[str, object] = {}
    for status in fs.globStatus(Path(f"{made}/{key}=*/part-*")):
        # Folder names have special characters as %XX.
        value = unquote(status.getPath().getParent().getName().split("=", 1)[1])
        if value == "__HIVE_DEFAULT_PARTITION__" or value in held:
            raise ValueError(f"{key}: {'a row has no key' if value not in held else f'{value!r} has several files'}; nothing was moved")
        held[value] = status.getPath()
    for value, made_at in held.items():
        to = Path(f"{path.rstrip('/')}/{name(value)}")
        fs.mkdirs(to.getParent())
        if fs.exists(to):
            fs.delete(to, False)
        if not fs.rename(made_at, to):
            raise OSError(f"{made_at} could not be moved to {to}")
    fs.delete(Path(made), True)


def export_monthly(df: DataFrame, path: str, dataset_id: str, month: str, order: list[str]) -> None:
    """Monthly CSV files <id>/<YYYY>/<MM>/<id>_<YYYYMM>.csv of df's columns, quoted as needed; month is text YYYYMM."""
    columns = [c for c in df.columns if c != month]
    quoted = lambda c: F.when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    cells = [F.coalesce(quoted(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns]
    body = df.select(month, F.lit(1).alias("__part"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(order)], F.concat_ws(",", *cells).alias("value"))
    head = df.select(month).distinct().select(month, F.lit(0).alias("__part"), F.lit(",".join(columns)).alias("value"))
    lines = head.unionByName(body, allowMissingColumns=True)
    export_files(lines, path, month, ["__part", *[f"__{i}" for i in range(len(order))]], lambda m: f"{dataset_id}/{m[:4]}/{m[4:]}/{dataset_id}_{m}.csv", large=True)
