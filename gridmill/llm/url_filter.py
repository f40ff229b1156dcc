"""Operator 2, URL filters: a memory-mapped sorted array of 64-bit xxhash keys, probed by binary search.

The rules' strings (host + path prefix) are hashed, sorted by hash and written with their full
strings to one file in the shared folder. Spark hands that file to every executor
(``SparkContext.addFile``), where tasks memory-map it. A url's probes are its host's suffixes and its
path's prefixes of the sizes (labels, characters) that rules have together, so a url has no more of
them than rules have shapes, however long it is; each hit is confirmed on the stored string, so
collisions of the hash never decide.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the
default verdict. Of the rules that fit, the one with the longest string wins; between equally long
ones that with the longer host. A repeated rule string keeps its first verdict. Repeated rows are
judged each by itself, an empty table gives no rows, very long urls are taken whole, and columns other
than the two named are not read.
"""

from __future__ import annotations

import mmap
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import put_bytes, table

#: The production list: (verdict, host followed by path prefix). Fixed values.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
VERDICTS = ["allow", "block"]
#: The file goes whole to every executor: its size is checked against this.
MAX_BYTES = 2 << 30
_HEAD = struct.Struct("<QQ")


def digest_bytes(rules: list[tuple[str, str]]) -> bytes:
    """Header (rules, shapes); sorted keys; verdict numbers; string offsets; distinct shapes (host labels, path length); string bytes."""
    kept = list({rule: verdict for verdict, rule in reversed(rules)}.items())
    strings = [rule.encode() for rule, _ in kept]
    keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
    order = np.argsort(keys, kind="stable")
    strings = [strings[i] for i in order]
    blob = b"".join(strings)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype("<i8")
    verdicts = np.array([VERDICTS.index(kept[i][1]) for i in order], "<i8")
    hosts = [rule.partition("/")[0] for rule, _ in kept]
    shapes = np.array(sorted({(host.count(".") + 1, len(rule) - len(host)) for host, (rule, _) in zip(hosts, kept, strict=True)}), "<i8").reshape(-1, 2)
    return _HEAD.pack(len(keys), len(shapes)) + keys[order].astype("<u8").tobytes() + verdicts.tobytes() + ends.tobytes() + shapes.tobytes() + blob


class Digest:
    """The file, mapped into this process."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, m = _HEAD.unpack_from(self.map, 0)
        at = _HEAD.size
        self.keys = np.frombuffer(self.map, "<u8", n, at)
        self.verdicts = np.frombuffer(self.map, "<i8", n, at + 8 * n)
        self.ends = np.frombuffer(self.map, "<i8", n + 1, at + 16 * n)
        self.shapes = np.frombuffer(self.map, "<i8", 2 * m, at + 24 * n + 8).reshape(-1, 2).tolist()
        self.blob = at + 24 * n + 8 + 16 * m

    def string(self, i: int) -> bytes:
        return self.map[self.blob + self.ends[i] : self.blob + self.ends[i + 1]]

    def find(self, probes: list[bytes]) -> list[int]:
        """For each probe the rule with that very string, or -1."""
        if not probes or not len(self.keys):
            return [-1] * len(probes)
        wanted = np.array([xxhash.xxh64_intdigest(p) for p in probes], np.uint64)
        at = np.searchsorted(self.keys, wanted)
        found = np.full(len(probes), -1)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted):
            j = at[i]
            while j < len(self.keys) and self.keys[j] == wanted[i]:
                if self.string(j) == probes[i]:
                    found[i] = j
                    break
                j += 1
        return found.tolist()


def probes(host: str, path: str, shapes: list[list[int]]) -> list[str]:
    """Host suffixes at label bounds with path prefixes, of the given shapes (labels, characters); best rule first."""
    most = max((labels for labels, _ in shapes), default=0)
    # The last labels only: what is before them stays in one piece.
    parts = host.rsplit(".", most)
    held = len(parts) if len(parts) <= most else most
    made = [(".".join(parts[-labels:]), path[:size]) for labels, size in shapes if labels <= held and size <= len(path)]
    return [h + p for h, p in sorted(made, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """id, host, path, rule and verdict of every url."""
    spark = df.sparkSession
    data = digest_bytes(rules)
    if len(data) > MAX_BYTES:
        raise ValueError(f"the rules' digest has {len(data)} bytes; executors map at most {MAX_BYTES}")
    uri = put_bytes(spark, f"digest-{uuid.uuid4().hex}", data)  # a session never takes a second file of one name
    spark.sparkContext.addFile(uri)
    name = uri.rsplit("/", 1)[1]
    rest = F.expr("substring(url, locate('://', url) + 3)")
    host = F.regexp_extract("rest", r"^([^/?#]*)", 1)
    split = (
        df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
        .withColumn("rest", F.when(F.col("url").contains("://"), rest))
        .select("id", F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")).alias("host"), F.coalesce(F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))
    )
    kind = split.schema["id"].dataType.simpleString()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = Digest(SparkFiles.get(name))
        for batch in batches:
            owner, asked, strings = [], [], []
            for i, (h, p) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                for probe in probes(h, p, digest.shapes):
                    owner.append(i)
                    asked.append(probe.encode())
                    strings.append(probe)
            rule: list[str | None] = [None] * batch.num_rows
            verdict = [default] * batch.num_rows
            for i, string, j in zip(owner, strings, digest.find(asked), strict=True):
                if j >= 0 and rule[i] is None:
                    rule[i], verdict[i] = string, VERDICTS[int(digest.verdicts[j])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return split.mapInArrow(match, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = """
WITH split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM split
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), hits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
       arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM hits GROUP BY page_id
"""
