"""Scans of monthly tables, per-document files, caches, markers, logs, manifests and file metadata."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions.text import blank_to_null, clean_header, csv_cell, csv_cells, csv_records, doc_id_of, event_parts, event_value, file_link, json_doc_id, posting_column
from gridmill.functions.timeparse import month_of_path, parse_iso
from gridmill.session import saved

#: Monthly files are <id>_YYYYMM.csv; documents beside them are <name>__<doc id>.csv or .zip.
MONTHLY = "_[0-9][0-9][0-9][0-9][0-9][0-9].csv"


def in_window(month: Column, start: str | None, end: str | None) -> Column:
    """Whether a month overlaps the window of days. Months are of posting, not of delivery: never prune exact delivery days by them."""
    ok = F.lit(True)
    if start:
        ok = ok & (month >= F.trunc(F.lit(start).cast("date"), "MM"))
    if end:
        ok = ok & (month <= F.trunc(F.lit(end).cast("date"), "MM"))
    return ok


def monthly_files(spark: SparkSession, root: str, dataset_id: str | None = None) -> DataFrame:
    """path, bytes, modified_at, dataset_id, month of every monthly file; contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{dataset_id or '*'}{MONTHLY}").load(root)
    name = F.regexp_extract("path", r"([^/]+)_\d{6}\.csv$", 1)
    return listed.select("path", F.col("length").alias("bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"), name.alias("dataset_id"), month_of_path("path").alias("month")).where(~F.col("dataset_id").contains("__"))


def file_of(path: str = "_metadata.file_path") -> Column:
    """The path of the file a row was read from, as it is named: Spark's own column has it encoded for URLs."""
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


def lines_of(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """file, line_no (from 0, in file order), line, header (the file's first line) and broken (whether a quote of the file stays open at a line's end) of every line of text files.

    Files are read once, in splits by as many tasks as they need, and written with each line's place in its
    split. A split's first line number is the count of the lines before it, from one small aggregate of a row a split.
    """
    return _placed(*_split_lines(spark, paths, glob))


def _split_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines by path and split, as they were written, and a row a split: its first line's number, the file's name and header, and whether the file is broken."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    read = reader.text(paths).select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__id"), "value")
    read = saved(read, "lines")
    odd = F.max((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2)
    splits = saved(read.groupBy("__path", "__split").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"), odd.alias("__odd")), "splits")
    # A file's header is the first line of its first split: of all lines only these splits' are read again.
    first = splits.where("__split = 0").select("__path", F.col("__first").alias("__id"))
    heads = read.where("__split = 0").join(first, ["__path", "__id"]).select("__path", F.regexp_replace("value", "^\ufeff", "").alias("header"))
    before, whole = Window.partitionBy("__path").orderBy("__split"), Window.partitionBy("__path")
    starts = splits.withColumn("__start", F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).withColumn("broken", F.max("__odd").over(whole) == 1)
    return read, saved(starts.join(heads, "__path", "left").select("__path", "__split", "__first", "__start", file_of("__path").alias("file"), "header", "broken"), "starts")


def _placed(read: DataFrame, starts: DataFrame) -> DataFrame:
    number = F.col("__id") - F.col("__first") + F.col("__start")
    line = F.when(number == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    told = [c for c in starts.columns if c not in ("__path", "__split", "__first", "__start", "file", "header", "broken")]
    return read.join(starts, ["__path", "__split"]).select("file", number.alias("line_no"), line.alias("line"), "header", "broken", *told)


def numbered_rows(spark: SparkSession, paths: str | list[str], glob: str | None = None, told: dict[str, Column] | None = None) -> DataFrame:
    """file, header, row_idx (from 0, in file order) and text of every CSV record but the header and blank ones, and what else file and header tell (told), which isn't made anew for each row.

    Row order is data here. A file with line breaks inside quotes is read whole, by one task, since its lines
    are no records; all others are read in splits.
    """
    read, starts = _split_lines(spark, paths, glob)
    told = told or {}
    broken = [r.file for r in starts.where("broken").select("file").distinct().collect()]  # names of files, not rows
    rows = _placed(read, saved(starts.withColumns(told), "told") if told else starts)
    rows = rows.where(~F.col("broken") & (F.col("line_no") > 0) & (F.trim("line") != "")).select("file", "header", (F.col("line_no") - 1).alias("row_idx"), "line", *told)
    if broken:
        whole = spark.read.text(broken, wholetext=True).select(file_of().alias("file"), csv_records(F.regexp_replace("value", "^\ufeff", "")).alias("__r"))
        parts = whole.select("file", F.get("__r", F.lit(0)).alias("header"), "__r").withColumns(told).select("file", "header", F.posexplode(F.slice("__r", 2, F.size("__r"))).alias("row_idx", "line"), *told)
        rows = rows.unionByName(parts.withColumn("row_idx", F.col("row_idx").cast("long")))
    return rows


def first_line(spark: SparkSession, path: str) -> str:
    """A file's first line, without a byte order mark, read through Hadoop; no more than a buffer of the file is fetched."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(at.getFileSystem(conf).open(at), "UTF-8"))
    try:
        return (reader.readLine() or "").lstrip("\ufeff")
    finally:
        reader.close()


def headers(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The header's names of each file, of which only the first lines are read; one that is cut inside quotes ends there."""
    with ThreadPoolExecutor(8) as pool:
        return [[c.strip() for c in next(csv.reader([h]), [])] for h in pool.map(lambda p: first_line(spark, p), paths)]


def monthly_paths(spark: SparkSession, root: str, dataset_id: str, start: str | None = None, end: str | None = None) -> list[str]:
    """Names of a dataset's monthly files; none is an error."""
    files = monthly_files(spark, root, dataset_id).where(in_window(F.col("month"), start, end))
    if not (paths := [r.path for r in files.select("path").orderBy("path").collect()]):
        raise FileNotFoundError(f"no monthly file of {dataset_id} under {root}")
    return paths


def read_monthly(spark: SparkSession, root: str, dataset_id: str, schema: T.StructType | str | None = None, columns: list[str] | None = None, start: str | None = None, end: str | None = None, origin: bool = False) -> DataFrame:
    """All monthly files of a dataset as text columns (or by the schema given); no file is an error.

    Per-document files in the same folders are left out. Columns not asked for are pruned by the reader.
    origin adds source_file and source_month.
    """
    paths = monthly_paths(spark, root, dataset_id, start, end)
    reader = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).option("mode", "PERMISSIVE")

    def read(shape: T.StructType | str, chosen: list[str]) -> DataFrame:
        df = reader.schema(shape).csv(chosen)
        if not origin:
            return df
        return df.select("*", file_of().alias("source_file"), month_of_path(file_of()).alias("source_month"))

    if schema is not None:
        df = read(schema, paths)
    else:  # headers may differ by month: the union of all, by name. Only first lines are read for them.
        alike: dict[tuple[str, ...], list[str]] = {}
        for h, p in zip(headers(spark, paths), paths, strict=True):
            alike.setdefault(tuple(h), []).append(p)
        frames = [read(T.StructType([T.StructField(c, T.StringType()) for c in h]), p) for h, p in alike.items()]
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f, allowMissingColumns=True)
    extra = ["source_file", "source_month"] if origin else []
    named = [c for c in df.columns if c not in extra]
    return df.select(*[f"`{c}`" for c in columns or named], *extra)


def monthly_rows(spark: SparkSession, root: str, dataset_id: str, start: str | None = None, end: str | None = None) -> tuple[DataFrame, list[str]]:
    """month (text YYYYMM), row_idx, posting and the other columns (as text) of a dataset's monthly files, and these columns' names.

    Headers come from the files' first lines, so a row's cells are taken by places that are known before it is read.
    """
    paths = monthly_paths(spark, root, dataset_id, start, end)
    heads = list(dict.fromkeys(map(tuple, headers(spark, paths))))
    columns = list(dict.fromkeys(c for h in heads for c in clean_header(list(h))))
    lines = numbered_rows(spark, paths, told={"month": month_text("file"), "__h": F.concat_ws("\n", csv_cells("header"))})

    def cell(name_of) -> Column:
        """The cell of each header's own column; a repeated name keeps its first."""
        out = F.lit(None).cast("string")
        for h in heads:
            if (name := name_of(list(h))) in h:
                out = F.when(F.col("__h") == "\n".join(h), csv_cell("line", F.lit(h.index(name)))).otherwise(out)
        return F.coalesce(out, F.lit(""))

    return lines.select("month", "row_idx", cell(posting_column).alias("posting"), *[cell(lambda _, c=c: c).alias(c) for c in columns]), columns


def month_text(path: str) -> Column:
    """month (text YYYYMM) of a monthly file or of a file beside it."""
    return F.regexp_extract(path, r"_(\d{6})\.csv[^/]*$", 1).alias("month")


def unposted_months(spark: SparkSession, root: str, dataset_id: str, start: str | None = None, end: str | None = None) -> list[str]:
    """Months (text YYYYMM) whose monthly file has no posting-time column."""
    paths = monthly_paths(spark, root, dataset_id, start, end)
    return [re.search(r"_(\d{6})\.csv$", p)[1] for p, h in zip(paths, headers(spark, paths), strict=True) if not posting_column(h)]


def month_markers(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """month (text YYYYMM), doc_position, doc_id of the marker files beside monthly files: the documents in the order in which their rows were laid."""
    lines = lines_of(spark, root, f"{dataset_id}{MONTHLY}.docids")
    return lines.select(month_text("file"), F.col("line_no").alias("doc_position"), F.trim("line").alias("doc_id")).where("doc_id <> ''")


def sort_classes(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """month (text YYYYMM) and classification of the sort notes beside monthly files: 'skipped' (never sorted) or 'sorted'; others are left out."""
    notes = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{dataset_id}{MONTHLY}.sortcache.json").text(root, wholetext=True)
    found = notes.select(month_text(file_of()), F.trim(F.get_json_object("value", "$.classification")).alias("classification"))
    return found.where(F.col("classification").isin("sorted", "skipped"))


def month_documents(spark: SparkSession, root: str, columns: list[str], dataset_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents beside a dataset's monthly files: (month, doc_id) of each (month: text YYYYMM, by folder), and month, doc_id, row_idx, columns of their rows.

    Documents are opened once; of several files of a document in a month the first by path counts. Which these are is told by
    the names, before any file is opened, so texts are not exchanged.
    """
    own = f"{root.rstrip('/')}/{dataset_id}"
    raw = in_fewer_tasks(_listed(spark, own if dataset_id and path_exists(spark, own) else root))
    at = r"/(\d{4})/(\d{2})/[^/]*$"
    month = F.concat(F.regexp_extract("path", at, 1), F.regexp_extract("path", at, 2)).alias("month")
    named = saved(raw.select("path", doc_id_of("path").alias("doc_id"), month).where(F.col("doc_id").isNotNull()), "names")
    docs = saved(named.groupBy("month", "doc_id").agg(F.min("path").alias("path"), F.count("*").alias("n")), "documents")
    again = named.join(docs.where("n > 1").select("month", "doc_id", F.col("path").alias("__first")), ["month", "doc_id"]).where(F.col("path") != F.col("__first")).select("path")
    opened = opened_documents(raw.join(saved(again, "again"), "path", "left_anti"))
    rows = document_rows(opened.select(month, "doc_id", "text"), columns=columns)
    return docs.select("month", "doc_id"), saved(rows.select("month", "doc_id", F.col("row_idx").cast("long").alias("row_idx"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns]), "document_rows")


def in_fewer_tasks(files: DataFrame) -> DataFrame:
    """A scan of whole files with an eighth of its tasks, if there are many: Spark counts 4 MB for opening one, so a task would have no more than 32 small files."""
    return files.coalesce(max(files.sparkSession.sparkContext.defaultParallelism * 4, files.rdd.getNumPartitions() // 8))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def dataset_ids(spark: SparkSession, root: str) -> DataFrame:
    """dataset_id of the folders that hold monthly files, each once."""
    return monthly_files(spark, root).select("dataset_id").distinct()


def tables_by_stem(spark: SparkSession, root: str, prefix: str = "") -> dict[str, DataFrame]:
    """One table for each CSV file under root whose name has the prefix, also as temporary views."""
    found = {}
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}*.csv").load(root).select("path").orderBy("path").collect()
    for r in listed:
        stem = r.path.rsplit("/", 1)[1].removesuffix(".csv")
        found[stem] = spark.read.option("header", True).csv(r.path)
        found[stem].createOrReplaceTempView(re.sub(r"\W", "_", stem))
    return found


def decode(raw: bytes) -> str:
    """UTF-8 with or without a byte order mark, else Latin-1."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def members(raw: bytes) -> list[tuple[str, bytes]]:
    """Files in a ZIP; none if it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    except zipfile.BadZipFile:
        return []


def csv_text(name: str, raw: bytes) -> str | None:
    """A document's CSV text: itself, or of a ZIP the first .csv member, else the first member."""
    if not (name.lower().endswith(".zip") or raw[:4] == b"PK\x03\x04"):
        return decode(raw)
    inside = members(raw)
    chosen = next((b for n, b in inside if n.lower().endswith(".csv")), inside[0][1] if inside else None)
    return None if chosen is None else decode(chosen)


def any_file(spark: SparkSession, root: str, glob: str) -> bool:
    """Whether any file under root has a name of this form."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path")
    return bool(found.head(1))


def document_paths(spark: SparkSession, root: str, glob: str = "*__*") -> DataFrame:
    """path, doc_id of per-document files, unopened; sidecars are left out."""
    return _listed(spark, root, glob).select("path", doc_id_of("path").alias("doc_id")).where(F.col("doc_id").isNotNull())


def documents(spark: SparkSession, root: str, glob: str = "*__*") -> DataFrame:
    """path, doc_id, text of per-document files; sidecars are left out. ZIPs have no Spark codec, so files are opened in tasks."""
    return opened_documents(_listed(spark, root, glob))


def _listed(spark: SparkSession, root: str, glob: str = "*__*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def opened_documents(raw: DataFrame) -> DataFrame:
    """path, doc_id, text of files (path, content) whose names hold a document's id: CSV as it is, or the CSV in a ZIP; UTF-8, else Latin-1."""
    held = raw.withColumn("doc_id", doc_id_of("path")).where(F.col("doc_id").isNotNull()).select("path", "doc_id", "content")

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["path", "doc_id"]].assign(text=[csv_text(p, bytes(c)) for p, c in zip(f["path"], f["content"], strict=True)])

    return held.mapInPandas(opened, "path string, doc_id string, text string")


def bulk_documents(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """doc_id, text, problem of a ZIP of ``<doc id>.zip`` files of one CSV each. strict: another number of CSVs is a problem; else the first counts."""
    return opened_bulks(spark.read.format("binaryFile").load(path), strict)


def opened_bulks(raw: DataFrame, strict: bool = True) -> DataFrame:
    """doc_id, text, problem of the documents in ZIPs of ZIPs (content)."""

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for content in f["content"]:
                for name, inner in members(bytes(content)):
                    csvs = [(n, b) for n, b in members(inner) if n.lower().endswith(".csv")]
                    doc_id = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    if not csvs or strict and len(csvs) != 1:
                        rows.append((doc_id, None, f"{len(csvs)} CSV files"))
                    else:
                        rows.append((doc_id, decode(csvs[0][1]), None))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "problem"])

    return raw.select("content").mapInPandas(opened, "doc_id string, text string, problem string")


def unpacked(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, text of the files in ZIPs under path whose names stay inside the folder they would be extracted to."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, name, decode(b)) for p, content in zip(f["path"], f["content"], strict=True) for name, b in members(bytes(content))]
            yield pd.DataFrame(rows, columns=["archive", "name", "text"])

    return safe_members(raw.mapInPandas(opened, "archive string, name string, text string"))


def safe_members(names: DataFrame, name: str = "name") -> DataFrame:
    """Archive members that stay inside the folder they are extracted to."""
    n = F.regexp_replace(name, r"\\", "/")
    return names.where(~n.rlike(r"^(/|[A-Za-z]:)") & ~n.rlike(r"(^|/)\.\.(/|$)"))


def document_rows(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The documents' CSV rows: other columns, row_idx, and values (name -> text), or the columns named instead (null where a document lacks one).

    JSON bodies and header-only documents give none; a line break inside quotes belongs to its cell. A document's header
    is resolved once: the first place of each of its names, or of each column asked for.
    """
    body = F.regexp_replace(F.col(text), "^\ufeff", "")
    others = [c for c in docs.columns if c != text]
    # Records are cut once: as a generator's row, since Spark repeats an expression wherever its column is used.
    usable = docs.where(~F.ltrim(body).rlike(r"^[{\[]")).select(*others, F.explode(F.array(csv_records(body))).alias("__l")).where(F.size("__l") > 1)
    heads = usable.withColumn("__h", csv_cells(F.element_at("__l", 1)))
    if columns is not None:
        heads = heads.withColumn("__at", F.array(*[F.array_position("__h", F.lit(c)).cast("int") - 1 for c in columns]))
    else:
        heads = heads.withColumn("__n", F.filter(F.array_distinct("__h"), lambda x: x != "")).withColumn("__at", F.transform("__n", lambda k: F.array_position("__h", k).cast("int") - 1))
    names = ["__at"] if columns is not None else ["__at", "__n"]
    rows = heads.select(*others, *names, F.posexplode(F.slice("__l", 2, F.size("__l") - 1)).alias("row_idx", "__row"))
    if columns is not None:
        return rows.select(*others, "row_idx", *[csv_cell("__row", F.get("__at", F.lit(i))).alias(c) for i, c in enumerate(columns)])
    rows = rows.withColumn("__v", csv_cells("__row"))
    return rows.select(*others, "row_idx", F.map_from_arrays("__n", F.transform("__at", lambda i: F.get("__v", i))).alias("values"))


def listing_cache(spark: SparkSession, path: str) -> DataFrame:
    """page, doc (JSON text), doc_id, posting, row_idx of a JSONL cache of {page, doc} lines or bare documents; bad lines are left out."""
    lines = lines_of(spark, path).select("file", F.col("line_no").alias("row_idx"), "line")
    inner = F.get_json_object("line", "$.doc")
    held = lines.where(F.get_json_object("line", "$").isNotNull()).withColumn("doc", F.coalesce(inner, F.col("line"))).withColumn("page", F.get_json_object("line", "$.page").try_cast("int"))
    return held.select("file", "row_idx", "page", "doc", json_doc_id("doc").alias("doc_id"), blank_to_null(F.get_json_object("doc", "$.postDatetime")).alias("posting")).where(F.col("doc_id").isNotNull())


def last_page(cache: DataFrame) -> DataFrame:
    """file, page: the highest page each listing cache holds; 0 where no line names one."""
    return cache.groupBy("file").agg(F.coalesce(F.max("page"), F.lit(0)).alias("page"))


def first_postings(cache: DataFrame) -> DataFrame:
    """doc_id and its first posting time that isn't blank."""
    return cache.where(F.col("posting").isNotNull()).groupBy("doc_id").agg(F.min_by("posting", F.struct("file", "row_idx")).alias("posting"))


_ENTRY = "dataset_id string, doc_id string, postDateTime string, post_datetime string, filename string, size string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """dataset_id, doc_id, posting, filename, bytes of manifests: JSON arrays (one a file), and JSON lines as write_manifest writes them (part files)."""
    part = F.col("_metadata.file_name").startswith("part-")
    whole = spark.read.option("multiLine", True).schema(_ENTRY).json(path).where(~part)
    lines = spark.read.schema(_ENTRY).json(path).where(part)
    df = whole.unionByName(lines)
    return df.select("dataset_id", "doc_id", F.coalesce(blank_to_null("postDateTime"), blank_to_null("post_datetime")).alias("posting"), "filename", F.col("size").try_cast("bigint").alias("bytes")).where(blank_to_null("doc_id").isNotNull())


def markers(spark: SparkSession, path: str) -> DataFrame:
    """file, row_idx, doc_id of marker files: an id a line, blanks left out."""
    return numbered_lines(spark, path).select("file", "row_idx", F.trim("line").alias("doc_id")).where("doc_id <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines_of(spark, path).select("file", F.col("line_no").alias("row_idx"), "line")


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """One row a state file, those that aren't JSON with nulls: file, status, last page, index, times and the failure."""
    df = spark.read.text(path, wholetext=True).select(F.regexp_extract(file_of(), r"([^/]+)\.json$", 1).alias("dataset_id"), "value")
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return df.select("dataset_id", get("status").alias("status"), get("last_page").try_cast("int").alias("last_page"), get("next_doc_index").try_cast("int").alias("next_doc_index"), get("total_docs").try_cast("int").alias("total_docs"), parse_iso(get("updated_at")).alias("updated_at"), get("failure").alias("failure"))


def run_events(spark: SparkSession, path: str, event: str = "DAY_COMPLETE") -> DataFrame:
    """run, row_idx, dataset_id, day, files, completed_at of a kind of event in run logs; the old spelling with a blank counts."""
    shape = event.replace("_", "[_ ]")
    lines = numbered_lines(spark, path).where(F.col("line").rlike(rf"(^|\s){shape}\s"))
    # A line is cut into its parts once: as a generator's row, since Spark repeats an expression wherever its column is used.
    f = lines.select("file", "row_idx", F.explode(F.array(event_parts("line"))).alias("parts"))
    get = lambda k: event_value("parts", k)
    return f.select(F.regexp_extract("file", "([^/]+)$", 1).alias("run"), "row_idx", get("dataset").alias("dataset_id"), get("date").try_cast("date").alias("day"), get("files").try_cast("int").alias("files"), parse_iso(get("completed_at")).alias("completed_at")).where("completed_at is not null and dataset_id is not null")


def objects_in(payload: object, preferred: list[str]) -> list[dict]:
    """The first list that holds objects: the payload itself, a preferred key's value, else depth first in the order of keys."""
    if isinstance(payload, list):
        return [x for x in payload if isinstance(x, dict)]
    if not isinstance(payload, dict):
        return []
    for k in [*[k for k in preferred if k in payload], *[k for k in payload if k not in preferred]]:
        if found := objects_in(payload[k], preferred):
            return found
    return []


def payload_rows(payloads: DataFrame, column: str, preferred: list[str]) -> DataFrame:
    """position and row (JSON text) of the objects in JSON payloads of any shape; text that isn't JSON has none."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        def rows(text: str | None) -> list[str]:
            try:
                return [json.dumps(x, ensure_ascii=False) for x in objects_in(json.loads(text), preferred)] if text else []
            except ValueError:
                return []

        return texts.map(rows)

    return payloads.select("*", F.posexplode(found(column)).alias("position", "row"))


def links(pages: DataFrame, html: str, base: str | None = None) -> DataFrame:
    """The pages' other columns, position and href of every anchor; relative links are joined to the base column."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    out = pages.select(*[c for c in pages.columns if c != html], F.posexplode(hrefs).alias("position", "href"))
    if base:
        site, folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
        full = F.when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("/"), F.concat(site, "href")).otherwise(F.concat(folder, "href"))
        out = out.withColumn("href", full)
    return out


def follow(found: DataFrame, pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """href of data files on pages (url, html) and on the pages these link to, one level down, each once.

    found: links (with href) of the first pages. A link to a page that pages holds is followed; all others are left.
    """
    nearer = found.select("href").distinct()
    onward = pages.select(url, html).join(nearer.withColumnRenamed("href", url), url, "left_semi").select(F.col(url).alias("__at"), html)
    further = links(onward, html, "__at").select("href")
    return nearer.unionByName(further).where(file_link("href")).distinct()


def filter_links(found: DataFrame, keywords: list[str], first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Links with any of the keywords (in any case) whose year, if they name one, is in range."""
    low = F.lower("href")
    hit = F.lit(not keywords)
    for k in keywords:
        hit = hit | low.contains(k.lower())
    year = F.regexp_extract("href", r"((?:19|20)\d{2})", 1).try_cast("int")
    inside = (year >= (first_year or 0)) & (year <= (last_year or 9999))
    return found.where(hit & F.coalesce(inside, F.lit(True)))


def posting_of(columns: list[str]) -> Column:
    """The posting-time text under whichever name a table has it; null without one."""
    name = posting_column(columns)
    return blank_to_null(f"`{name}`") if name else F.lit(None).cast("string")


def month_span(files: DataFrame) -> DataFrame:
    """dataset_id, first_second and last_second: the window of postings that its monthly files (dataset_id, month) ask for."""
    return files.groupBy("dataset_id").agg(F.date_format(F.min("month"), "yyyy-MM-dd'T'00:00:00").alias("first_second"), F.date_format(F.last_day(F.max("month")), "yyyy-MM-dd'T'23:59:59").alias("last_second"))


def listed_within(cache: DataFrame, spans: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Listed documents whose posting lies in their dataset's span; the first posting of each document counts."""
    at, edge = parse_iso("posting"), lambda c: parse_iso(c)
    return cache.join(spans, key).where((at >= edge("first_second")) & (at <= edge("last_second"))).drop("first_second", "last_second")


def has_documents(cache: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """Which keys have any document posted from start to end (both included): one row a key, existing or not."""
    at = parse_iso("posting")
    inside = F.coalesce(at.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")), F.lit(False))
    return cache.groupBy(*keys).agg(F.max(inside).alias("exists"))


def to_fetch(listed: DataFrame, have: DataFrame, name: str = "filename", size: str = "bytes") -> DataFrame:
    """Listed files that aren't there yet: one of that name counts if its size is the listed one, or none (or below 0) is listed."""
    h = have.select(F.col(name).alias("__n"), F.col(size).alias("__s"))
    same = (F.col(name) == F.col("__n")) & (F.col(size).isNull() | (F.col(size) < 0) | (F.col(size) == F.col("__s")))
    return listed.join(h, same, "left_anti")


def earliest(cache: DataFrame, *keys: str) -> DataFrame:
    """The first day of each key's documents, with its year and month, from what is listed rather than by probing a service."""
    day = F.min(parse_iso("posting").cast("date"))
    return cache.groupBy(*keys).agg(day.alias("first_day")).where("first_day is not null").select(*keys, F.year("first_day").alias("year"), F.month("first_day").alias("month"), "first_day")


def newest_run(runs: DataFrame, run: str = "run") -> DataFrame:
    """The rows of the run whose name comes last."""
    last = runs.agg(F.max(run).alias("__last"))
    return runs.join(F.broadcast(last), F.col(run) == F.col("__last"), "left_semi")


def edges(lines: DataFrame, n: int = 40, last: bool = False) -> DataFrame:
    """The first (or last) n lines of each file, in order of row_idx."""
    w = Window.partitionBy("file").orderBy(F.desc("row_idx") if last else F.asc("row_idx"))
    return lines.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
