"""Table functions for SQL text: documents to rows, ZIP archives to members, pages to links.

    SELECT d.doc_id, r.* FROM documents d, LATERAL csv_rows(d.text, 'day,price') r

They are for queries written as text; in Python code document_rows, unpacked and links of gridmill.sources.files do the
same in the JVM. A document, archive or page is one call; a null one gives no rows.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gridmill.sources.files import decode, members


class CsvRows:
    """csv_rows(text, 'a,b'): row_idx and the columns named (null where the document lacks one), by the document's own header. JSON bodies give none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        if not columns.isConstantExpression or not columns.value:
            raise ValueError("csv_rows needs its columns as a constant, such as 'day,price'")
        names = [c.strip() for c in next(csv.reader([columns.value]))]
        return AnalyzeResult(StructType([StructField("row_idx", IntegerType()), *[StructField(c, StringType()) for c in names]]))

    def eval(self, text: str | None, columns: str) -> Iterator[tuple]:
        text = (text or "").removeprefix("﻿")
        if text.lstrip()[:1] in ("{", "["):
            return
        rows = (r for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r))
        head = [c.strip() for c in next(rows, [])]
        places = [head.index(c.strip()) if c.strip() in head else len(head) for c in next(csv.reader([columns]))]
        for i, row in enumerate(rows):
            yield (i, *(row[p].strip() if p < len(row) and p < len(head) else None for p in places))


class ZipMembers:
    """zip_members(content): name and text of an archive's files; none if it isn't one."""

    def eval(self, content: bytes | None) -> Iterator[tuple]:
        for name, raw in members(bytes(content or b"")):
            yield name, decode(raw)


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.found.append(href)


class PageLinks:
    """page_links(html, base): position and href of a page's anchors; relative ones are joined to base, if it is given."""

    def eval(self, html: str | None, base: str | None) -> Iterator[tuple]:
        anchors = _Anchors()
        anchors.feed(html or "")
        for i, href in enumerate(anchors.found):
            yield i, urljoin(base, href) if base else href


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("csv_rows", udtf(CsvRows))
    spark.udtf.register("zip_members", udtf(ZipMembers, returnType="name string, text string"))
    spark.udtf.register("page_links", udtf(PageLinks, returnType="position int, href string"))
