import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gridmill.sources import archive, sinks
from gridmill.sources import files as S
from gridmill.streaming import consolidate as C


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in members:
            z.writestr(n, b)
    return out.getvalue()


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "NP6-905-CD/2025/12"
    d.mkdir(parents=True)
    (d / "NP6-905-CD_202512.csv").write_text("DeliveryDate,HourEnding,p\n12/01/2025,1,5\n12/01/2025,2,6\n")
    (d / "x__77.csv").write_text("DeliveryDate,HourEnding,p\n12/09/2025,1,5\n")
    (d / "x__78.zip").write_bytes(zipped([("readme.txt", b"no"), ("a.csv", "h\ncaf\u00e9\n".encode("latin-1"))]))
    (d / "x__79.csv").write_text(' {"error": "x"}')
    (d / "x__80.docids").write_text("1\n")
    e = tmp_path / "NP6-905-CD/2025/11"
    e.mkdir(parents=True)
    (e / "NP6-905-CD_202511.csv").write_text("postDateTime,DeliveryDate,HourEnding\n2025-11-01T00:00:00,11/01/2025,9\n")
    return tmp_path


def test_monthly_scans(spark, root):
    found = S.monthly_files(spark, str(root), "NP6-905-CD").collect()
    assert sorted((r.dataset_id, str(r.month)) for r in found) == [("NP6-905-CD", "2025-11-01"), ("NP6-905-CD", "2025-12-01")] and all(r.bytes > 0 for r in found)
    df = S.read_monthly(spark, str(root), "NP6-905-CD")
    assert df.count() == 3 and set(df.columns) == {"postDateTime", "DeliveryDate", "HourEnding", "p"}
    assert S.read_monthly(spark, str(root), "NP6-905-CD", start="2025-12-15").count() == 2
    assert S.read_monthly(spark, str(root), "NP6-905-CD", "DeliveryDate string, HourEnding string, p string", columns=["p"], start="2025-12-15").columns == ["p"]
    with pytest.raises(FileNotFoundError):
        S.read_monthly(spark, str(root), "NP0-000-CD")
    rows = S.numbered_rows(spark, str(root / "NP6-905-CD/2025/12"), "NP6-905-CD_202512.csv").orderBy("row_idx").collect()
    assert [(r.row_idx, r.line) for r in rows] == [(0, "12/01/2025,1,5"), (1, "12/01/2025,2,6")]
    assert set(S.tables_by_stem(spark, str(root), "NP6")) == {"NP6-905-CD_202511", "NP6-905-CD_202512"}


def test_documents(spark, root):
    docs = S.documents(spark, str(root))
    assert {r.doc_id: r.text for r in docs.collect()}["78"] == "h\ncafé\n" and docs.count() == 3
    rows = S.document_rows(docs).collect()
    assert sorted((r.doc_id, r.row_idx, r["values"].get("p") or r["values"].get("h")) for r in rows) == [("77", 0, "5"), ("78", 0, "café")]
    (root / "bulk.zip").write_bytes(zipped([("1.zip", zipped([("a.csv", b"x\n1\n")])), ("2.zip", zipped([("a.csv", b"x"), ("b.csv", b"y")])), ("3.zip", b"bad")]))
    got = {r.doc_id: (r.text, r.problem) for r in S.bulk_documents(spark, str(root / "bulk.zip")).collect()}
    assert got == {"1": ("x\n1\n", None), "2": (None, "2 CSV files"), "3": (None, "0 CSV files")}
    assert {r.doc_id for r in S.bulk_documents(spark, str(root / "bulk.zip"), strict=False).where("text is not null").collect()} == {"1", "2"}


def test_caches_and_logs(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"page": 1, "doc": {"docId": "5", "postDatetime": ""}}\n{"docId": "6", "postDatetime": "t6"}\n\n{bad\n{"page": 3, "doc": {"docId": "5", "postDatetime": "t5"}}\n')
    cache = S.listing_cache(spark, str(tmp_path / "c.jsonl"))
    assert cache.count() == 3 and cache.agg(F.max("page")).first()[0] == 3
    assert {r.doc_id: r.posting for r in S.first_postings(cache).collect()} == {"5": "t5", "6": "t6"}
    (tmp_path / "run1.log").write_text("EVENT x\nDAY_COMPLETE dataset=A date=2025-01-01 year=2025 month=01 files=3 completed_at=2025-01-02T00:00:10Z\nDAY COMPLETE dataset=A date=2025-01-02 files=4 completed_at=2025-01-02T00:00:30Z\nDAY_COMPLETE dataset=A date=x files=q completed_at=bad\n")
    got = S.run_events(spark, str(tmp_path / "run1.log")).orderBy("row_idx").collect()
    assert [(r.run, r.files, r.completed_at.second) for r in got] == [("run1.log", 3, 10), ("run1.log", 4, 30)]
    (tmp_path / "m.docids").write_text("1\n\n 2 \n")
    assert [r.doc_id for r in S.markers(spark, str(tmp_path / "m.docids")).orderBy("row_idx").collect()] == ["1", "2"]
    (tmp_path / "man.json").write_text(json.dumps([{"dataset_id": "A", "doc_id": "1", "post_datetime": "t", "size": "12"}, {"doc_id": ""}]))
    assert [tuple(r) for r in S.manifest(spark, str(tmp_path / "man.json")).collect()] == [("A", "1", "t", None, 12)]
    state = tmp_path / "state"
    state.mkdir()
    (state / "A.json").write_text(json.dumps({"status": "running", "last_page": 3, "updated_at": "2025-01-01T00:00:00Z"}))
    (state / "B.json").write_text("{bad")
    assert {r.dataset_id: r.last_page for r in S.checkpoints(spark, str(state)).collect()} == {"A": 3, "B": None}


def test_payloads_and_links(spark):
    df = spark.createDataFrame([(1, '[{"a":1},{"a":2}]'), (2, '{"items":[{"a":3}]}'), (3, '{"_links":{}}')], "i int, p string")
    assert sorted((r.i, json.loads(r.row)["a"]) for r in S.payload_rows(df, "p", ["archives", "items"]).collect()) == [(1, 1), (1, 2), (2, 3)]
    pages = spark.createDataFrame([(1, "http://h/x/y.html", '<a href="/z2019.zip">q</a><A class="k" HREF=\'b2031.csv\'>r</A><a href="http://o/c.pdf">')], "id int, url string, html string")
    found = S.links(pages, "html", "url")
    assert [r.href for r in found.orderBy("position").collect()] == ["http://h/z2019.zip", "http://h/x/b2031.csv", "http://o/c.pdf"]
    assert [r.href for r in S.filter_links(found, ["CSV", "zip"], 2000, 2020).collect()] == ["http://h/z2019.zip"]


def test_archive_source(spark, tmp_path):
    for n, payload in ((1, {"archives": [{"docId": 1, "postDatetime": "t"}]}), (2, {"_embedded": {"items": [{"docLookupId": "2"}]}}), (3, {"_links": {}, "_meta": {}, "product": {"x": [{"docId": 9}]}})):
        (tmp_path / f"page-{n}.json").write_text(json.dumps(payload))
    archive.register(spark)
    read = lambda **o: spark.read.format("archive_pages").option("path", str(tmp_path)).options(**o).load()
    assert sorted((r.page, r.doc_id) for r in read(pagesPerPartition=1).collect()) == [(1, "1"), (2, "2")]
    assert [r.page for r in read(startPage=2).collect()] == [2]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("A", "1", "2025-11-30T23:00:00", 1), ("A", "2", None, 2)], "dataset_id string, doc_id string, posting string, v int")
    sinks.append_documents(rows, path, None)
    known = spark.read.parquet(path)
    assert sinks.append_documents(rows, path, known).count() == 0
    got = {(r.doc_id, str(r.year), str(r.month)) for r in spark.read.parquet(path).collect()}
    assert got == {("1", "2025", "11"), ("2", "undated", "undated")}
    new = sinks.month_columns(rows.where("doc_id = '1'").withColumn("v", F.lit(9)), "posting")
    sinks.replace_partitions(new, path)
    assert sorted((r.doc_id, r.v) for r in spark.read.parquet(path).collect()) == [("1", 9), ("2", 2)]
    plan = spark.read.parquet(path).where("year = '2025'").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<v:int>" in plan


def test_reports(spark, tmp_path):
    f = sinks.failure_rows(spark, [("A", "bulk", "1", None, "boom")]).first()
    assert f.error == "boom" and f.timestamp.endswith("Z")
    s = sinks.run_summary(spark.createDataFrame([("A", 1, 2), ("B", 3, 4)], "dataset_id string, ok int, bad int")).first()
    assert (s.ok, s.bad, s.datasets["B"].ok) == (4, 6, 3)
    df = spark.createDataFrame([("a", None)], "x string, y int")
    assert sinks.markdown(df).first().value == "| a |  |" and sinks.markdown_header(df).startswith("| x | y |")
    names = spark.createDataFrame([("ok/a.csv",), ("../x",), ("/abs",), ("a/../../b",), ("C:\\x",)], "name string")
    assert [r.name for r in S.safe_members(names).collect()] == ["ok/a.csv"]
    sinks.write_log(spark.createDataFrame([("E", {"a": "1"})], "event string, fields map<string,string>"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).first().value == "E a=1"
    sinks.write_manifest(df, str(tmp_path / "m"))
    sinks.write_manifest(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    docs = spark.createDataFrame([("A", 1, "d1"), ("A", 2, "d2")], "dataset_id string, month int, doc_id string")
    cov = spark.createDataFrame([("A", 1, 5, 5, 0), ("A", 2, 5, 4, 0)], "dataset_id string, month int, rows int, filled int, malformed int")
    assert [r.doc_id for r in sinks.redundant_documents(docs, cov).collect()] == ["d1"]
    assert sinks.with_posting_column(df).columns == ["postDateTime", "x", "y"]


def test_consolidation_resumes(spark, tmp_path):
    land, table, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "check")
    land.mkdir()
    schema = "dataset_id string, doc_id string, posting string, v int"
    put = lambda n, rows: (land / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("dataset_id", "doc_id", "posting", "v"), r, strict=True))) for r in rows))
    run = lambda: C.consolidate(C.document_stream(spark, str(land), schema), table, check).awaitTermination()
    put(1, [("A", "1", "2025-11-30T23:00:00", 1), ("A", "1", "2025-11-30T23:00:00", 2)])
    run()
    put(2, [("A", "1", "2025-11-30T23:00:00", 1), ("A", "2", "2024-01-01T00:00:00", 5)])
    run()
    run()
    assert sorted((r.doc_id, r.v, int(r.month)) for r in spark.read.parquet(table).collect()) == [("1", 1, 11), ("1", 2, 11), ("2", 5, 1)]


def test_streamed_windows_and_breaks(spark, tmp_path):
    src = spark.createDataFrame([("2025-01-01 00:05:00", "k", 1.0, True), ("2025-01-01 00:25:00", "k", 3.0, True), ("2025-01-01 09:00:00", "k", 5.0, False)], "ts string, k string, v double, bad boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    src.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "s"))
    for name, df, mode in (("w", C.windowed_mean(stream(), "ts", "v", "k"), "append"), ("b", C.failure_breaks(stream(), "k", "ts", "bad", 2), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert [(r.mean, r.n) for r in spark.table("w").collect()] == [(2.0, 2)]
    assert [(r.k, r.ts.minute) for r in spark.table("b").collect()] == [("k", 25)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"row {i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "a b+c%.csv").write_text("﻿h1,h2\n" + "\n".join(lines) + "\n")
    (tmp_path / "e.csv").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = S.numbered_rows(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line for r in sorted(got, key=lambda r: r.row_idx)] == lines
    assert [r.row_idx for r in sorted(got, key=lambda r: r.row_idx)] == list(range(3000))
    assert {r.header for r in got} == {"h1,h2"} and {r.file.rsplit("/", 1)[1] for r in got} == {"a b+c%.csv"}


def test_manifests_of_both_forms(spark, tmp_path):
    df = spark.createDataFrame([(f"d{i}", "A", f"t{i}") for i in range(6)], "doc_id string, dataset_id string, postDateTime string")
    sinks.write_manifest(df.coalesce(1), str(tmp_path / "m"))
    (tmp_path / "m" / "old.json").write_text('[\n {"doc_id": "d9", "dataset_id": "A",\n  "post_datetime": "t9", "size": 5},\n {"doc_id": " "}\n]')
    got = {r.doc_id: (r.posting, r.bytes) for r in S.manifest(spark, str(tmp_path / "m")).collect()}
    assert got == {f"d{i}": (f"t{i}", None) for i in range(6)} | {"d9": ("t9", 5)}


def test_breaks_cool_down(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    rows = [("k", at + dt.timedelta(seconds=i), True) for i in range(10)]
    src = spark.createDataFrame(rows, "k string, ts timestamp, bad boolean")
    src.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "s"))
    C.failure_breaks(stream, "k", "ts", "bad", 2, cooldown=4).writeStream.format("memory").queryName("cool").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.ts.second for r in spark.table("cool").collect()) == [1, 6]


def test_zip_members_are_unpacked_safely(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("ok/a.csv", "../out.csv", "b.csv"):
            z.writestr(name, name.upper())
    assert sorted((r.name, r.text) for r in S.unpacked(spark, str(tmp_path)).collect()) == [("b.csv", "B.CSV"), ("ok/a.csv", "OK/A.CSV")]
