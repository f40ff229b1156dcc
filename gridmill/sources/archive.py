"""A paged archive listing as a Spark data source, for tables and for streams: ``spark.read`` / ``readStream.format("archive_pages")``.

Pages are JSON documents named page-<n>.json under ``path``, as an archive service returns them ({"archives": [...]},
{"items": [...]} or a list), in any store that Arrow's file systems reach (local, S3, GCS, HDFS). Each partition reads a range of
pages, so listings are fetched in parallel and a lost task fetches its own pages again.

An index ``pages.json`` ({"<n>": ["<first posting>", "<last posting>"]}), where there is one, tells what each page spans: a
table's filter on ``posting`` then prunes pages before they are opened. As a stream, the offset is the last page read,
and a restart goes on behind the page of its checkpoint. ``maxPagesPerBatch`` is how many pages a batch admits; since Spark
asks a source for its newest offset before it tells where the checkpoint is, this needs ``position``, a file of the query's own in which
the reader notes the last page that a batch was planned to.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridmill.functions.text import json_doc_id
from gridmill.functions.timeparse import parse_iso
from gridmill.sources.files import file_system, objects_in

KEYS = ["archives", "items", "documents", "data", "products"]
#: What describes a listing rather than being a part of it.
_ABOUT = ("_meta", "_links", "product")


def rows_of(payload: object) -> list[dict]:
    """The first list of objects: the payload, a preferred key's value, else depth first; descriptions of the listing aside."""
    if isinstance(payload, dict):
        payload = {k: v for k, v in payload.items() if k not in _ABOUT}
    return objects_in(payload, KEYS)


class Pages(InputPartition):
    def __init__(self, numbers: list[int]):
        self.numbers = numbers


class Listing:
    """The pages under a path."""

    def __init__(self, options: dict[str, str]):
        self.path, self.each = options["path"], int(options.get("pagesPerPartition") or 8)
        self.start = int(options.get("startPage") or 1)

    def files(self) -> tuple[pafs.FileSystem, str]:
        return file_system(self.path)

    def numbers(self) -> list[int]:
        fs, root = self.files()
        found = (re.fullmatch(r"page-(\d+)\.json", f.base_name) for f in fs.get_file_info(pafs.FileSelector(root)))
        return sorted(n for m in found if m and (n := int(m[1])) >= self.start)

    def load(self, name: str) -> object:
        fs, root = self.files()
        with fs.open_input_stream(f"{root.rstrip('/')}/{name}") as f:
            return json.loads(f.read().decode("utf-8-sig"))

    def spans(self) -> dict[int, tuple[str, str]]:
        fs, root = self.files()
        if fs.get_file_info(f"{root.rstrip('/')}/pages.json").type == pafs.FileType.NotFound:
            return {}
        return {int(k): (v[0], v[1]) for k, v in self.load("pages.json").items()}

    def ranges(self, numbers: list[int]) -> list[Pages]:
        return [Pages(numbers[i : i + self.each]) for i in range(0, len(numbers), self.each)]

    def rows(self, partition: Pages) -> Iterator[tuple]:
        for n in partition.numbers if partition else ():  # Spark asks for one partition where there are none
            for i, d in enumerate(rows_of(self.load(f"page-{n}.json"))):
                doc_id = next((str(d[k]) for k in ("docId", "docLookupId", "doclookupId") if d.get(k)), None)
                yield n, i, doc_id, d.get("postDatetime"), d.get("constructedName") or d.get("friendlyName"), json.dumps(d, ensure_ascii=False)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pages, self.low, self.high = Listing(options), "", "\uffff"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of posting (ISO text, which sorts as its times do) are noted for pruning; Spark still applies every filter to the rows."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("posting",):
                self.low = max(self.low, f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("posting",):
                self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[Pages]:
        numbers = self.pages.numbers()
        if self.low or self.high != "\uffff":
            spans = self.pages.spans()
            numbers = [n for n in numbers if n not in spans or spans[n][0] <= self.high and spans[n][1] >= self.low]
        return self.pages.ranges(numbers)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.pages.rows(partition)


class StreamReader(DataSourceStreamReader):
    """Pages in order of their numbers; the offset is the last page that was admitted."""

    def __init__(self, options: dict[str, str]):
        self.pages, self.most, self.note = Listing(options), int(options.get("maxPagesPerBatch") or 0), options.get("position")
        if self.most and not self.note:
            raise ValueError("maxPagesPerBatch needs position, a file in which the last admitted page is noted")
        self.at = self.noted()

    def noted(self) -> int:
        first = self.pages.start - 1
        if not self.note:
            return first
        fs, path = file_system(self.note)
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return first
        with fs.open_input_stream(path) as f:
            return max(first, int(f.read()))

    def initialOffset(self) -> dict:
        return {"page": self.pages.start - 1}

    def latestOffset(self) -> dict:
        fresh = [n for n in self.pages.numbers() if n > self.at]
        if self.most:
            fresh = fresh[: self.most]
        return {"page": fresh[-1] if fresh else self.at}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        # A batch's end is in the checkpoint before it is planned here, so the note is never ahead of it.
        self.at = end["page"]
        if self.note:
            fs, path = file_system(self.note)
            with fs.open_output_stream(path) as f:
                f.write(str(self.at).encode())
        return self.pages.ranges([n for n in self.pages.numbers() if start["page"] < n <= end["page"]])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        pass  # pages stay where they are


class ArchivePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_pages"

    def schema(self) -> str:
        return "page int, position int, doc_id string, posting string, name string, doc string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def archive_pages(spark: SparkSession, path: str, first_page: int = 1, last_page: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The same rows as the data source's, read through Spark's own file readers, so from any store that Spark reads.

    first_page is where an earlier listing left off (see states); start and end bound the posting times, both included.
    """
    number = F.regexp_extract(F.col("_metadata.file_path"), r"page-(\d+)\.json$", 1).cast("int")
    pages = spark.read.option("pathGlobFilter", "page-*.json").text(path, wholetext=True).select(number.alias("page"), "value").where(F.col("page") >= first_page)
    if last_page is not None:
        pages = pages.where(F.col("page") <= last_page)

    @F.pandas_udf("array<string>")
    def listed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [json.dumps(d, ensure_ascii=False) for d in rows_of(json.loads(t))])

    rows = pages.select("page", F.posexplode(listed("value")).alias("position", "doc"))
    get = lambda k: F.get_json_object("doc", f"$.{k}")
    out = rows.select("page", "position", json_doc_id("doc").alias("doc_id"), get("postDatetime").alias("posting"), F.coalesce(get("constructedName"), get("friendlyName")).alias("name"), "doc")
    at = parse_iso("posting")
    if start:
        out = out.where(at >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.where(at <= F.lit(end).cast("timestamp_ntz"))
    return out


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchivePages)
