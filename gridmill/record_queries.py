"""Queries of the operators over files, documents, headers and run records, with their SQL.

They write files of the driver's tables to a scratch folder of the shared directory, as the market's
tools leave them (monthly CSV files, listing caches, manifests, markers, logs, archive pages), and read
them back through the library. orders stand for documents (o_orderpriority a dataset, o_orderdate the
posting time), lineitem for their rows.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill import jobs, registry
from gridmill.catalog_queries import _RESOLVED, customer_requests, query, rounded, table
from gridmill.functions import text as X
from gridmill.functions import timeparse as T
from gridmill.operators import aggregates as A
from gridmill.operators import joins as J
from gridmill.operators import quality as Q
from gridmill.operators import reshape as R
from gridmill.operators import sorts as O
from gridmill.operators import windows as W
from gridmill.plans import backfill as B
from gridmill.plans import estimate as E
from gridmill.plans import resume as P
from gridmill.session import dealt, saved, scratch, tasks_for
from gridmill.sources import archive
from gridmill.sources import files as S
from gridmill.sources import sinks as K
from gridmill.streaming import consolidate as ST

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """orders as documents: dataset_id, doc_id, posting (ISO text), and what else they have."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderkey").cast("string").alias("doc_id"), F.date_format("o_orderdate", ISO).alias("posting"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")


# Sources and sinks.


@query("""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, min(o_orderpriority) AS least
FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1999-07-01' GROUP BY 1""")
def monthly_scan(spark, d):
    """Monthly CSV files, some with a posting column and some without, scanned over a window of months."""
    root, o = scratch(spark, "monthly"), table(spark, d, "orders")
    rows = o.select(F.date_format("o_orderdate", "yyyyMM").alias("m"), "o_orderkey", F.concat(F.lit('"'), "o_orderpriority", F.lit(", quoted")).alias("label"), F.date_format("o_orderdate", ISO).alias("postDateTime"))
    K.export_monthly(rows.where("o_orderkey is not null and m < '199801'"), root, "NP6-346-CD", "m", ["o_orderkey"])
    K.export_monthly(rows.where("m >= '199801'").drop("postDateTime"), root, "NP6-346-CD", "m", ["o_orderkey"])
    found = S.read_monthly(spark, root, "NP6-346-CD", start="1995-03-10", end="1999-06-02", origin=True)
    label = F.regexp_replace("label", '^"|, quoted$', "")
    return found.groupBy(F.col("source_month").alias("month")).agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"), F.min(label).alias("least"))


@query("SELECT strftime(o_orderdate, '%Y%m') AS month, CAST(row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderkey) - 1 AS BIGINT) AS row_idx, CAST(o_orderkey AS VARCHAR) AS line FROM orders")
def line_numbers(spark, d):
    """Each row's number in its monthly file, from splits of files."""
    root = scratch(spark, "lines")
    K.export_monthly(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("m"), "o_orderkey"), root, "NP4-732-CD", "m", ["o_orderkey"])
    return S.numbered_rows(spark, root, "NP4-732-CD_*.csv").select(F.regexp_extract("file", r"_(\d{6})\.csv$", 1).alias("month"), "row_idx", "line")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, 'NP3-565-CD' AS dataset_id, true AS some_bytes FROM orders GROUP BY 1")
def monthly_file_list(spark, d):
    root = scratch(spark, "list")
    K.export_monthly(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("m"), "o_orderkey"), root, "NP3-565-CD", "m", ["o_orderkey"])
    listed = S.monthly_files(spark, root).join(S.dataset_ids(spark, root), "dataset_id", "left_semi")
    return listed.select(F.date_format("month", "yyyy-MM").alias("month"), "dataset_id", (F.col("bytes") > 0).alias("some_bytes"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS row_idx,
       l_returnflag || ', "' || l_linestatus || '"' AS label, CAST(l_quantity AS BIGINT) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def document_rows(spark, d):
    """CSV documents with quoted commas and quotes, opened and cut into rows."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    label = F.concat(F.lit('"'), "l_returnflag", F.lit(', ""'), "l_linestatus", F.lit('"""'))
    line = F.concat(label, F.lit(","), F.col("l_quantity").cast("long").cast("string"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("v")))), lambda x: x["v"])
    docs = li.join(o, "l_orderkey").groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.concat(F.lit("label, quantity ,label\r\n"), F.array_join(rows, "\r\n")).alias("text"))
    found = S.document_rows(docs)
    return found.select("doc_id", "row_idx", F.col("values")["label"].alias("label"), F.col("values")["quantity"].cast("long").alias("quantity"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, s_name AS name, s_nationkey AS nation FROM supplier")
def document_files(spark, d):
    """A document of each supplier written to a file, found by the id in its name and opened."""
    root, s = scratch(spark, "files"), table(spark, d, "supplier")
    header = s.select("s_suppkey", F.lit(0).alias("i"), F.lit("name,nation").alias("value"))
    body = s.select("s_suppkey", F.lit(1).alias("i"), F.concat("s_name", F.lit(","), F.col("s_nationkey").cast("string")).alias("value"))
    K.export_files(header.unionByName(body), root, "s_suppkey", ["i"], lambda k: f"report__{k}.csv")
    return S.document_rows(S.documents(spark, root)).select("doc_id", F.col("values")["name"].alias("name"), F.col("values")["nation"].cast("int").alias("nation"))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 0 AS row_idx, CASE s_suppkey % 5 WHEN 1 THEN 'é' || s_name WHEN 4 THEN s_name || chr(10) || 'x' ELSE s_name END AS name FROM supplier WHERE s_suppkey % 5 <> 2""")
def document_archives(spark, d):
    """Documents as they come: with a byte order mark, in a ZIP beside other files and in Latin-1, JSON bodies instead of rows, ZIPs by content alone, line breaks inside quotes."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")

    def packed(frames):
        for f in frames:
            rows = []
            for key, name in zip(f["s_suppkey"], f["s_name"], strict=True):
                kind, out = key % 5, io.BytesIO()
                text = {0: f"\ufeffname\n{name}\n", 1: f"name\r\né{name}\r\n", 2: '{"error": "none"}', 3: f"name\n{name}\n", 4: f'name\n"{name}\nx"\n'}[kind]
                if kind in (1, 3):
                    with zipfile.ZipFile(out, "w") as z:
                        z.writestr("about.txt", "name\nno")
                        z.writestr("rows.CSV", text.encode("latin-1"))
                rows.append((f"/x/report__{key}.{'zip' if kind == 1 else 'csv'}", out.getvalue() or text.encode()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    docs = S.opened_documents(s.mapInPandas(packed, "path string, content binary"))
    return S.document_rows(docs, columns=["name"]).select("doc_id", "row_idx", "name")


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE WHEN s_suppkey % 4 < 3 THEN s_name END AS text, CASE s_suppkey % 4 WHEN 3 THEN '0 CSV files' END AS problem FROM supplier WHERE s_suppkey % 4 <> 2
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, '2 CSV files' FROM supplier WHERE s_suppkey % 4 = 2""")
def bulk_archives(spark, d):
    """ZIPs of documents' ZIPs, a bulk for each nation; those of another number of CSV files are told."""
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name")

    def packed(key, f):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, name in zip(f["s_suppkey"], f["s_name"], strict=True):
                inner = io.BytesIO()
                with zipfile.ZipFile(inner, "w") as y:
                    for i in range({2: 2, 3: 0}.get(k % 4, 1)):
                        y.writestr(f"{i}.csv", name)
                z.writestr(f"bulk/{k}.zip", inner.getvalue())
        return pd.DataFrame({"content": [out.getvalue()]})

    return S.opened_bulks(s.groupBy("s_nationkey").applyInPandas(packed, "content binary"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS posting FROM orders WHERE o_orderkey % 7 <> 0")
def listing_cache(spark, d):
    """A listing cache of pages, bare documents and broken lines; the first posting of each document counts."""
    root, o = scratch(spark, "cache"), _docs(spark, d)
    posting = F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("posting"))
    doc = F.to_json(F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.col("doc_id")).alias("docId"), F.col("doc_id").alias("docLookupId"), posting.alias("postDatetime")))
    line = F.when(F.col("o_orderkey") % 3 == 0, doc).otherwise(F.concat(F.lit('{"page": 3, "doc": '), doc, F.lit("}")))
    broken = F.when(F.col("o_orderkey") % 5 == 0, F.concat(line, F.lit("\n{broken"))).otherwise(line)
    o.select(broken.alias("value")).write.text(root)
    return S.first_postings(S.listing_cache(spark, root))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderpriority AS dataset_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS posting, CAST(o_custkey AS BIGINT) AS bytes FROM orders")
def manifest_round_trip(spark, d):
    root = scratch(spark, "manifest")
    K.write_manifest(_docs(spark, d).select("dataset_id", "doc_id", F.col("posting").alias("postDateTime"), F.lit("f.csv").alias("filename"), F.col("o_custkey").cast("string").alias("size")), root)
    return S.manifest(spark, root).select("doc_id", "dataset_id", "posting", "bytes")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id FROM orders WHERE o_orderkey % 3 <> 0")
def marker_skip(spark, d):
    """Documents that no marker file names yet."""
    root, o = scratch(spark, "markers"), _docs(spark, d)
    o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("  "), "doc_id", F.lit(" ")).alias("value")).write.text(root)
    return J.not_known(o.select("doc_id"), S.markers(spark, root))


@query("SELECT event_type AS dataset_id, CAST(ts AS DATE) AS day, CAST(event_id AS INTEGER) AS files, date_trunc('second', ts) AS completed_at FROM events WHERE event_id % 4 <> 0")
def run_log(spark, d):
    """A run log written and scanned for its finished days; other events are left out."""
    root = scratch(spark, "log")
    e = dealt(table(spark, d, "events"), "event_id").select(
        F.when(F.col("event_id") % 4 == 0, "DAY_START").otherwise("DAY_COMPLETE").alias("event"),
        F.create_map(F.lit("dataset"), F.col("event_type"), F.lit("date"), F.date_format("ts", "yyyy-MM-dd"), F.lit("note"), F.lit('two "words" date=1999-01-01\n files=0'), F.lit("files"), F.col("event_id").cast("string"), F.lit("completed_at"), F.concat(F.date_format("ts", ISO), F.lit("Z"))).alias("fields"),
    )
    K.write_log(e, root)
    return S.run_events(spark, root).select("dataset_id", "day", "files", "completed_at")


@query("SELECT event_id, props || ' \"quoted\" back\\slash' || chr(10) || 'k=v' AS note, '2' AS again, NULL::VARCHAR AS absent FROM events")
def event_fields(spark, d):
    """Values with blanks, quotes, backslashes and line breaks come back as they were; of a repeated key the last counts."""
    fields = F.create_map(F.lit("again"), F.lit("1"), F.lit("note"), F.concat("props", F.lit(' "quoted" back\\slash\nk=v')))
    line = F.concat(X.event_line(F.lit("STEP"), fields), F.lit(" again=2"))
    f = table(spark, d, "events").select("event_id", X.event_fields(line).alias("f"))
    return f.select("event_id", F.col("f")["note"].alias("note"), F.col("f")["again"].alias("again"), F.try_element_at("f", F.lit("absent")).alias("absent"))


@query("SELECT o_orderpriority AS dataset_id, 'running' AS status, CAST(count(*) % 100 AS INTEGER) AS last_page, CAST(count(*) AS INTEGER) AS next_doc_index FROM orders GROUP BY 1 UNION ALL SELECT 'broken', NULL, NULL, NULL")
def resume_status(spark, d):
    """State files of each dataset, one of which isn't JSON."""
    root = scratch(spark, "states")
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset_id")).agg(F.count("*").alias("n"))
    states = o.select("dataset_id", F.lit(0).alias("i"), F.to_json(F.struct(F.lit("running").alias("status"), (F.col("n") % 100).alias("last_page"), F.col("n").alias("next_doc_index"))).alias("value"))
    bad = spark.createDataFrame([("broken", 0, "{not json")], "dataset_id string, i int, value string")
    K.export_files(states.unionByName(bad), root, "dataset_id", ["i"], lambda k: f"{k}.json")
    return S.checkpoints(spark, root).select("dataset_id", "status", "last_page", "next_doc_index")


_PAGED = """
WITH p AS (SELECT *, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS INTEGER) AS page, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 1000 AS INTEGER) AS position FROM orders)"""


@query(_PAGED + " SELECT page, position, CAST(o_orderkey AS VARCHAR) AS doc_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS posting FROM p WHERE page >= 2 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31 23:59:59'")
def archive_pages(spark, d):
    """Archive pages from the page that a listing left off at, within a window of posting times."""
    root = scratch(spark, "pages")
    o = _docs(spark, d).withColumn("day", F.lit(0))
    numbered = W.ordinals(o.withColumn("part", F.floor(F.col("o_orderkey") / 5000)), ["day"], "part", [F.col("o_orderkey")], "n").withColumn("page", F.floor((F.col("n") - 1) / 1000).cast("int") + 1)
    doc = F.struct(F.col("doc_id").alias("docId"), F.col("posting").alias("postDatetime"))
    pages = numbered.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("n", doc.alias("d")))).alias("rows"))
    value = F.to_json(F.struct(F.lit(1).alias("_meta"), F.struct(F.transform("rows", lambda r: r["d"]).alias("archives")).alias("result")))
    K.export_files(pages.select("page", F.lit(0).alias("i"), value.alias("value")), root, "page", ["i"], lambda k: f"page-{k}.json")
    return archive.archive_pages(spark, root, first_page=2, start="1995-01-01", end="1998-12-31 23:59:59").select("page", "position", "doc_id", "posting")


@query("SELECT l_orderkey, l_linenumber AS n, l_quantity AS q FROM lineitem")
def payload_rows(spark, d):
    """Objects of payloads whose list lies below other keys, beside lists that hold none."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    shape = F.when(F.col("l_orderkey") % 2 == 0, F.to_json(F.struct(F.array(F.lit(1)).alias("sizes"), F.struct(F.struct(F.collect_list(item).alias("rows")).alias("deep")).alias("body")))).otherwise(F.to_json(F.collect_list(item)))
    docs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(shape.alias("payload"))
    found = S.payload_rows(docs, "payload", ["archives", "items", "data"])
    return found.select("l_orderkey", F.get_json_object("row", "$.n").cast("int").alias("n"), F.get_json_object("row", "$.q").cast("double").alias("q"))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)
SELECT DISTINCT href || '.' || ['zip', 'html', 'csv', 'gz'][page_id % 4 + 1] AS href FROM l WHERE page_id % 4 <> 1 AND href <> ''""")
def link_follow(spark, d):
    """Data files that pages link to, directly or through one page between."""
    end = F.element_at(F.array(*map(F.lit, ("zip", "html", "csv", "gz"))), (F.col("page_id") % 4 + 1).cast("int"))
    links = S.links(table(spark, d, "pages").select("page_id", "html"), "html").where("href <> ''").withColumn("href", F.concat("href", F.lit("."), end))
    # Every second page is reached through an index page of its own.
    near = links.where("page_id % 2 = 0").select("href").unionByName(links.where("page_id % 2 = 1").select(F.concat(F.lit("http://index/"), "page_id").alias("href")))
    body = F.array_join(F.transform(F.collect_set("href"), lambda h: F.concat(F.lit("<a href='"), h, F.lit("'>x</a>"))), "\n")
    index = links.where("page_id % 2 = 1").groupBy(F.concat(F.lit("http://index/"), "page_id").alias("url")).agg(body.alias("html"))
    return S.follow(near, index.withColumn("html", F.replace("html", F.lit("href='/"), F.lit("href='x:/")))).withColumn("href", F.regexp_replace("href", "^x:|^http://index/", ""))


@query("SELECT event_type, year(ts) AS y, lpad(CAST(month(ts) AS VARCHAR), 2, '0') AS m, count(*) AS n FROM events GROUP BY ALL")
def month_partitions(spark, d):
    """Parquet by posting month, written and read by partition."""
    root = scratch(spark, "table")
    e = table(spark, d, "events").select(F.col("event_type").alias("dataset_id"), F.date_format("ts", ISO).alias("posting"))
    K.write_table(K.month_columns(e, "posting"), root)
    found = spark.read.schema("posting string, dataset_id string, year string, month string").parquet(root)
    return found.groupBy(F.col("dataset_id").alias("event_type"), F.col("year").cast("long").alias("y"), F.col("month").alias("m")).agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderpriority AS dataset_id, strftime(o_orderdate, '%Y') AS year, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS run FROM orders")
def append_unseen(spark, d):
    """A second append leaves out the documents that the first one wrote."""
    root, o = scratch(spark, "append"), _docs(spark, d).select("dataset_id", "doc_id", "posting", "o_orderkey")
    K.append_documents(o.where("o_orderkey % 2 = 0").withColumn("run", F.lit(1)), root, None)
    shape = "doc_id string, posting string, o_orderkey long, run int, dataset_id string, year string, month string"
    K.append_documents(o.withColumn("run", F.lit(2)), root, spark.read.schema(shape).parquet(root))
    return spark.read.schema(shape).parquet(root).select("doc_id", "dataset_id", "year", "run")


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN '1999-01-01T00:00:00' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS \"PostingTime\", '' AS price, CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders")
def append_reconciled(spark, d):
    """Document rows under a table's header: its posting alias, its columns first, the document's time where rows have none."""
    posting = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.date_format("o_orderdate", ISO))
    rows = table(spark, d, "orders").select("o_orderkey", posting.alias("postDateTime"), F.col("o_custkey").alias(" customer"))
    return K.reconciled(rows, ["PostingTime", "price", "customer "], F.lit("1999-01-01T00:00:00"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, part, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month FROM orders, (VALUES (1), (2)) AS t(part)")
def stream_consolidate(spark, d):
    """A stream of document files consolidated in two runs: a document's rows come in two files, some files twice in a run and some in both; each row is there once."""
    root = scratch(spark, "stream")
    o = _docs(spark, d).select("doc_id", "posting", "o_orderkey")
    shape = "doc_id string, posting string, o_orderkey long, part int"
    first, second = o.withColumn("part", F.lit(1)), o.withColumn("part", F.lit(2))
    for files in ([first.where("o_orderkey % 3 < 2"), first.where("o_orderkey % 3 < 1")], [first.where("o_orderkey % 3 > 0"), second]):
        for f in files:
            f.write.mode("append").json(f"{root}/in")
        ST.consolidate(ST.document_stream(spark, f"{root}/in", shape), f"{root}/out", f"{root}/state", row="part").awaitTermination()
    return spark.read.schema(f"{shape}, year string, month string").parquet(f"{root}/out").select("doc_id", "part", "year", "month")


@query("""
WITH r AS (SELECT user_id, ts, event_type, event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS island FROM (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)))
SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n_rows FROM m GROUP BY ALL""")
def stream_runs(spark, d):
    """Runs of equal events of each user from a stream of three batches, whose rows come out of order; a last row lets the watermark pass them all."""
    root = scratch(spark, "runs")
    e = table(spark, d, "events").where("user_id is not null and ts is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    end = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), (F.col("ts") + F.expr("interval 10 years")).alias("ts"), F.lit("end").alias("event_type"))
    third, tasks = F.pmod(F.xxhash64("user_id", "ts", "event_type"), F.lit(3)), tasks_for(table(spark, d, "events"))
    for part in (*(e.where(third == i) for i in range(3)), end):
        part.write.mode("append").parquet(f"{root}/in")
        found = ST.runs(spark.readStream.schema(e.schema).parquet(f"{root}/in"), "user_id", "ts", "event_type", "60 days", 86_400 * 60, 16 * tasks)
        with ST.rocks(spark, tasks, 1_000_000):
            q = found.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/out").where("key <> -1").select(F.col("key").alias("user_id"), "island", F.col("value").alias("event_type"), "n_rows")


@query("SELECT p_partkey, '| ' || p_partkey || ' | ' || p_name || ' |' AS md, p_partkey || chr(9) || p_name AS tab, '{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\"}' AS json FROM part")
def reports(spark, d):
    """Rows as Markdown, tab-separated and JSON lines."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    key = F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("p_partkey")
    md, tab, js = (f(p).select(key, F.col("value").alias(n)) for f, n in ((K.markdown, "md"), (K.tab_report, "tab"), (K.json_report, "json")))
    return md.join(tab, "p_partkey").join(js, "p_partkey")


@query("SELECT CAST(sum(a) AS BIGINT) AS rows_read, CAST(sum(b) AS BIGINT) AS errors, count(*) AS n_datasets, CAST(sum(a) FILTER (k = 'click') AS BIGINT) AS clicks FROM (SELECT event_type AS k, count(*) AS a, count(*) FILTER (value > 50) AS b FROM events GROUP BY 1)")
def run_summary(spark, d):
    stats = table(spark, d, "events").groupBy(F.col("event_type").alias("dataset_id")).agg(F.count("*").alias("rows_read"), F.count(F.when(F.col("value") > 50, 1)).alias("errors"))
    return K.run_summary(stats).select("rows_read", "errors", F.size("datasets").cast("long").alias("n_datasets"), F.col("datasets")["click"]["rows_read"].alias("clicks"))


@query("SELECT o_orderkey, o_orderpriority AS dataset_id FROM orders JOIN (SELECT strftime(o_orderdate, '%Y-%m') AS m FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 11 = 0) = 0) ON strftime(o_orderdate, '%Y-%m') = m")
def cleanup_gate(spark, d):
    """Documents of months whose rows all have a well-formed posting time may go."""
    o = table(spark, d, "orders").select(F.lit("x").alias("k"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("p"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.date_format("o_orderdate", ISO)).alias("posting"))
    covered = A.coverage(o, F.col("posting"), T.parse_iso("posting"), "month").withColumn("dataset_id", F.lit("x"))
    return K.redundant_documents(o.withColumnRenamed("k", "dataset_id"), covered).select("o_orderkey", F.col("p").alias("dataset_id"))


@query("SELECT name FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN '../' || p_name WHEN 1 THEN '/etc/' || p_name WHEN 2 THEN 'a/..b/' || p_name WHEN 3 THEN 'C:' || p_name ELSE 'x\\..\\' || p_name END || p_partkey AS name, p_partkey % 5 AS k FROM part) WHERE k = 2")
def safe_members(spark, d):
    m = F.col("p_partkey") % 5
    start = F.when(m == 0, "../").when(m == 1, "/etc/").when(m == 2, "a/..b/").when(m == 3, "C:").otherwise("x\\..\\")
    return S.safe_members(table(spark, d, "part").select(F.concat(start, "p_name", F.col("p_partkey").cast("string")).alias("name")))


@query("SELECT o_orderpriority AS file FROM orders GROUP BY 1 HAVING count(*) % 2 = 0")
def sort_cache(spark, d):
    """Files that an earlier sort left in this order and that have not changed since."""
    held = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("file")).agg(F.count("*").alias("n_rows"), F.max("o_orderdate").alias("modified_at"))
    known = K.sort_cache(held.select("*", F.lit("auto").alias("strategy"), F.lit("ascending").alias("order"), F.when(F.col("n_rows") % 2 == 0, "already").otherwise("failed").alias("status")))
    return K.still_sorted(held, known, "auto", "ascending").select("file")


# Listings: windows, existence, what is to be fetched.


@query("SELECT o_orderkey FROM orders JOIN (SELECT o_orderpriority AS p, date_trunc('month', min(o_orderdate)) AS a, last_day(max(o_orderdate)) AS b FROM orders WHERE o_orderdate < TIMESTAMP '1996-02-10' GROUP BY 1) ON o_orderpriority = p WHERE o_orderdate >= a AND CAST(o_orderdate AS DATE) <= b")
def metadata_span(spark, d):
    """Listed documents within the months of the files at hand."""
    o = _docs(spark, d)
    files = o.where("o_orderdate < timestamp_ntz'1996-02-10'").select("dataset_id", F.trunc("o_orderdate", "MM").alias("month"))
    return S.listed_within(o, S.month_span(files)).select("o_orderkey")


@query("SELECT o_custkey, coalesce(bool_or(o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'), false) AS \"exists\" FROM orders GROUP BY 1")
def archive_window(spark, d):
    return S.has_documents(_docs(spark, d), "1996-01-01", "1996-12-31", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 <> 0))")
def fetch_by_size(spark, d):
    """Listed files that aren't there with their listed size; an unknown size is no reason to fetch again."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("filename"), F.when(F.col("o_orderkey") % 3 == 0, -1).when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).cast("long").alias("bytes"))
    have = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("filename"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("bytes"))
    return S.to_fetch(o, have).select("o_orderkey")


@query("SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(year(min(o_orderdate)) AS INTEGER) AS year, CAST(month(min(o_orderdate)) AS INTEGER) AS month FROM orders GROUP BY 1")
def earliest_dates(spark, d):
    return S.earliest(_docs(spark, d), "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = (SELECT max(o_orderpriority) FROM orders)")
def newest_run(spark, d):
    return S.newest_run(table(spark, d, "orders"), "o_orderpriority").select("o_orderkey")


@query("SELECT file, line, edge FROM (SELECT o_orderpriority AS file, o_orderkey AS line, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS b FROM orders), (VALUES ('first'), ('last')) AS e(edge) WHERE (edge = 'first' AND a <= 40) OR (edge = 'last' AND b <= 40)")
def log_edges(spark, d):
    """The first and the last 40 lines of each file."""
    lines = table(spark, d, "orders").select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("line"), F.col("o_orderkey").alias("row_idx"))
    both = S.edges(lines).withColumn("edge", F.lit("first")).unionByName(S.edges(lines, last=True).withColumn("edge", F.lit("last")))
    return both.select("file", "line", "edge")


@query("""
SELECT o_custkey AS dataset_id, CASE o_custkey % 4 WHEN 0 THEN 'resumed' WHEN 3 THEN 'new' ELSE 'discarded' END AS state,
       CAST(CASE WHEN o_custkey % 4 = 0 THEN n % 50 + 1 ELSE 1 END AS INTEGER) AS first_page, CAST(CASE WHEN o_custkey % 4 = 0 THEN n ELSE 0 END AS INTEGER) AS next_doc_index
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def resume_plan(spark, d):
    """A run takes an earlier state up only if its seven parameters agree and it isn't done."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("dataset_id")).agg(F.count("*").alias("n"))
    fixed = [F.lit("2020-01-01").alias("window_from"), F.lit("2020-12-31").alias("window_to"), F.lit("api").alias("download_order"), F.lit(None).cast("int").alias("max_docs_per_dataset"), F.lit("u").alias("archive_url")]
    m = F.col("dataset_id") % 4
    states = o.where(m != 3).select("dataset_id", F.when(m == 1, 10).otherwise(1000).alias("page_size"), *fixed, F.when(m == 2, "done").otherwise("running").alias("status"), (F.col("n") % 50).alias("last_page"), F.col("n").alias("next_doc_index"))
    return P.starts(o.select("dataset_id", F.lit(1000).alias("page_size"), *fixed), states).select("dataset_id", "state", "first_page", "next_doc_index")


@query("SELECT o_orderpriority AS dataset_id, CAST(max(o_custkey) AS BIGINT) AS last_page, CAST(count(*) AS INTEGER) AS total_docs, CAST(count(*) FILTER (o_orderstatus = 'F') AS INTEGER) AS next_doc_index, 'running' AS status FROM orders GROUP BY 1")
def run_states(spark, d):
    o = _docs(spark, d).withColumnRenamed("o_custkey", "page")
    return P.states_of(o, o.where("o_orderstatus = 'F'"), o.select("dataset_id").distinct())


@query("SELECT o_orderpriority AS dataset_id, count(*) AS listed, CAST(count(*) FILTER (o_orderkey % 3 = 0) AS BIGINT) AS there, CAST(count(*) FILTER (o_orderkey % 3 <> 0) AS BIGINT) AS to_fetch, CAST(coalesce(sum(o_custkey) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0), 0) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def dry_run(spark, d):
    """What a run would fetch, without fetching."""
    o = _docs(spark, d).withColumn("bytes", F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(F.col("o_custkey")))
    return P.dry_run(o, o.where("o_orderkey % 3 = 0"), ["dataset_id", "doc_id"])


@query("SELECT DISTINCT url, params FROM (SELECT p_brand AS url, p_size % 3 AS params FROM part)")
def candidate_calls(spark, d):
    """Candidate requests, each (url, parameters) once."""
    return table(spark, d, "part").select(F.col("p_brand").alias("url"), (F.col("p_size") % 3).alias("params")).dropDuplicates(["url", "params"])


@query(_RESOLVED + " SELECT c_custkey, dataset_id, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY nth) - 1 AS INTEGER) AS position FROM r WHERE dataset_id NOT IN ('NP6-788-CD', 'NP6-331-CD')")
def excluded_datasets(spark, d):
    """Each customer's datasets without the excluded ones, which may be named by old ids."""
    return registry.resolved(customer_requests(spark, d), ["np6-788-er", " NP6-331-CD"]).withColumnRenamed("request", "c_custkey")


# Backfill.


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents' rows and postings by document."""
    li = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey"])
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.date_format("o_orderdate", ISO).alias("posting"))
    rows = li.join(o, "l_orderkey").select("month", F.col("l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("doc_position"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("row_idx"), F.col("l_partkey").cast("string").alias("part"), F.col("l_linenumber").cast("string").alias("line"))
    postings = o.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_orderkey") % 10 != 0, F.col("posting")).alias("posting"), F.lit(0).alias("row_idx"))
    return rows, postings


def _months(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Months of rows, the documents' rows they came from, and postings by document. In some months rows are missing, so positions don't hold. Both kinds of rows are written once, since they are read several times."""
    rows, postings = _sources(spark, d)
    rows = saved(rows, "sources")
    table_rows = W.ordinals(rows.where("not (month like '%-05' and doc_id % 97 = 1)"), ["month"], "doc_position", [F.col("row_idx")], "n").withColumn("row_idx", F.col("n") - 1)
    blank = F.when(F.col("row_idx") % 13 == 0, "kept").when(F.col("row_idx") % 2 == 0, " ")
    return saved(table_rows.select("month", "row_idx", blank.alias("posting"), "part", "line"), "rows"), rows, postings


_BACKFILL = """
WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem),
src AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS src_idx, CAST(l_partkey AS VARCHAR) AS part, CAST(l_linenumber AS VARCHAR) AS line,
               CASE WHEN l_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS p FROM li JOIN orders ON l_orderkey = o_orderkey),
rows_of AS (SELECT month, doc_id, part, line, p, row_number() OVER (PARTITION BY month ORDER BY doc_id, src_idx) - 1 AS row_idx FROM src WHERE NOT (month LIKE '%-05' AND doc_id % 97 = 1)),
old AS (SELECT *, CASE WHEN row_idx % 13 = 0 THEN 'kept' ELSE '' END AS posting FROM rows_of),
status AS (SELECT month, count(*) = (SELECT count(*) FROM src s WHERE s.month = old.month) AS aligned FROM old GROUP BY month)"""


@query(_BACKFILL + """,
s AS (SELECT *, row_number() OVER (PARTITION BY month, part, line ORDER BY doc_id DESC, src_idx DESC) AS k FROM src),
t AS (SELECT *, row_number() OVER (PARTITION BY month, part, line, posting = '' ORDER BY row_idx) AS k FROM old)
SELECT t.month, CAST(t.row_idx AS BIGINT) AS row_idx, CASE WHEN t.posting <> '' THEN t.posting WHEN aligned THEN coalesce(t.p, '') ELSE coalesce(s.p, '') END AS posting
FROM t JOIN status USING (month) LEFT JOIN s ON s.month = t.month AND s.part = t.part AND s.line = t.line AND s.k = t.k""")
def backfill_missing(spark, d):
    """Blank posting times filled by position where a month has just its documents' rows, else by fingerprint."""
    rows, sources, postings = _months(spark, d)
    return B.add_missing(rows, sources, [postings], ["part", "line"]).select("month", "row_idx", "posting")


@query(_BACKFILL + """,
u AS (SELECT month, part, line, count(*) AS n, min(p) AS p FROM src GROUP BY ALL)
SELECT old.month, CAST(row_idx AS BIGINT) AS row_idx, CASE WHEN aligned THEN coalesce(old.p, '') WHEN n = 1 THEN coalesce(u.p, '') ELSE '' END AS posting
FROM old JOIN status USING (month) LEFT JOIN u ON u.month = old.month AND u.part = old.part AND u.line = old.line""")
def backfill_overwrite(spark, d):
    """All posting times anew; a fingerprint of several source rows gives none."""
    rows, sources, postings = _months(spark, d)
    return B.add_missing(rows, sources, [postings], ["part", "line"], overwrite=True).select("month", "row_idx", "posting")


@query(_BACKFILL + """
SELECT month, CAST(row_number() OVER (PARTITION BY month ORDER BY p DESC NULLS LAST, doc_id, src_idx) - 1 AS BIGINT) AS row_idx, coalesce(p, '') AS posting, part, line FROM src""")
def backfill_rebuild(spark, d):
    """Months anew from their documents, newest posting first."""
    sources, postings = _sources(spark, d)
    return B.rebuild(saved(sources, "sources"), [postings], ["part", "line"], "descending")


@query(_BACKFILL + " SELECT month, part, line FROM src WHERE month LIKE '%-05' AND doc_id % 97 = 1")
def backfill_verify(spark, d):
    """Rows by which rebuilt months differ from the tables."""
    rows, sources, postings = _months(spark, d)
    return B.verify(rows, B.rebuild(sources, [postings], ["part", "line"]), ["part", "line"])


@query("""
WITH li AS (SELECT 1 + l_suppkey % 6 AS m, l_suppkey AS doc, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS v FROM lineitem WHERE l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY doc * 7919 % 10007, doc, v) - 1 AS i FROM li),
gone AS (SELECT min(doc) AS doc FROM li WHERE m = 6),
p AS (SELECT r.*, CASE WHEN r.doc = gone.doc THEN '' WHEN r.doc % 10 = 0 THEN '' WHEN r.doc % 3 <> 0 THEN '2025-01-' || lpad(CAST(1 + r.doc % 28 AS VARCHAR), 2, '0') || 'T00:00:00' ELSE '2025-02-' || lpad(CAST(1 + r.doc % 28 AS VARCHAR), 2, '0') || 'T00:00:00' END AS posting FROM r, gone)
SELECT 'add-missing' AS mode, '20250' || m AS month, CAST(i AS BIGINT) AS row_idx, posting, v FROM p
UNION ALL
SELECT 'rebuild', '20250' || m, CAST(row_number() OVER (PARTITION BY m ORDER BY CASE WHEN m = 6 OR posting = '' THEN NULL ELSE posting END NULLS LAST, i) - 1 AS BIGINT), CASE WHEN m = 6 THEN '' ELSE posting END, v FROM p""")
def backfill_files(spark, d):
    """The command over files: documents laid in the order of their markers, postings that caches and manifests tell differently, and a month that lacks a document."""
    root, name = scratch(spark, "backfill"), "NP6-905-CD"
    li = table(spark, d, "lineitem").where("l_suppkey is not null and l_orderkey is not null and l_linenumber is not null and l_partkey is not null")
    rows = li.select((1 + F.col("l_suppkey") % 6).alias("m"), F.col("l_suppkey").alias("doc"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("v"), (F.col("l_suppkey") * 7919 % 10007).alias("at"))
    month = F.concat(F.lit("20250"), F.col("m").cast("string"))
    # A document's values are put in order once; the monthly files hold the documents' values in the order of the markers.
    docs = rows.repartition(tasks_for(table(spark, d, "lineitem")), "doc").groupBy("doc", "m", "at").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    docs = saved(docs.select("doc", "m", "at", F.concat_ws("\n", "vs").alias("value")), "docs")
    ids = docs.select("doc", "m", "at")
    months = ids.select("m").distinct()
    at = lambda m: f"{name}/{m[:4]}/{m[4:]}/{name}_{m}.csv"
    head = months.select(month.alias("key"), F.lit(0).alias("i"), F.lit("v").alias("value"))
    lines = docs.select(month.alias("key"), F.lit(1).alias("i"), "at", "doc", "value")
    K.export_files(lines.unionByName(head, allowMissingColumns=True), f"{root}/raw", "key", ["i", "at", "doc"], at, large=True)
    K.export_files(ids.select(month.alias("key"), "at", "doc", F.col("doc").cast("string").alias("value")), f"{root}/raw", "key", ["at", "doc"], lambda m: f"{at(m)}.docids")
    K.export_files(months.select(month.alias("key"), F.lit('{"classification": "skipped"}').alias("value")), f"{root}/raw", "key", ["value"], lambda m: f"{at(m)}.sortcache.json")
    gone = ids.where("m = 6").agg(F.min("doc").alias("doc"))
    held = docs.join(F.broadcast(gone), "doc", "left_anti").select(F.concat(month, F.lit("-"), F.col("doc").cast("string")).alias("key"), F.concat(F.lit("v\n"), "value").alias("value"))
    K.export_files(held, f"{root}/raw", "key", [], lambda k: f"{name}/{k[:4]}/{k[4:6]}/report__{k[7:]}.csv")
    known = ids.where("doc % 10 <> 0").withColumn("day", F.concat(F.lpad((1 + F.col("doc") % 28).cast("string"), 2, "0"), F.lit("T00:00:00"))).withColumn("id", F.col("doc").cast("string"))
    line = F.to_json(F.struct(F.col("id").alias("docId"), F.concat(F.lit("2025-01-"), "day").alias("postDatetime")))
    known.where("doc % 3 <> 0").select(line.alias("value")).write.text(f"{root}/cache")
    K.write_manifest(known.select(F.lit(name).alias("dataset_id"), F.col("id").alias("doc_id"), F.concat(F.lit("2025-02-"), "day").alias("postDateTime")), f"{root}/manifest")
    parts = []
    for mode, order in (("add-missing", "none"), ("rebuild", "ascending")):
        jobs.backfill(spark, f"{root}/raw", f"{root}/{mode}", name, mode, order, f"{root}/manifest", f"{root}/cache")
        month_of = F.concat(F.lpad(F.col("year").cast("string"), 4, "0"), F.lpad(F.col("month").cast("string"), 2, "0"))
        parts.append(spark.read.parquet(f"{root}/{mode}").select(F.lit(mode).alias("mode"), month_of.alias("month"), "row_idx", "posting", "v"))
    return parts[0].unionByName(parts[1])


@query(_BACKFILL + " SELECT part, line, count(*) AS n FROM src GROUP BY 1, 2 HAVING count(*) > 1")
def fingerprint_collisions(spark, d):
    sources, _ = _sources(spark, d)
    return J.collisions(sources, ["part", "line"], tasks_for(table(spark, d, "lineitem")))


# Headers, columns, values.


@query("SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS \"postDateTime\", o_orderkey, o_custkey FROM orders")
def posting_first(spark, d):
    """The posting column first under its preferred name, other aliases and blank names left out."""
    o = table(spark, d, "orders").select("o_orderkey", F.lit("no").alias("PostingTime"), F.date_format("o_orderdate", ISO).alias(" postDatetime"), F.col("o_custkey").alias(" o_custkey "), F.lit(1).alias(" "))
    return R.posting_first(o, X.posting_column(o.columns))


@query("SELECT o_orderkey, 'header' AS by_header, 'preferred' AS by_name, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE o_orderpriority END AS first FROM orders")
def alias_rules(spark, d):
    """Of two posting aliases, the one that comes first in the header and the preferred one; per row the first of candidates that isn't blank."""
    m = F.col("o_orderkey") % 3
    o = table(spark, d, "orders").select("o_orderkey", F.lit("header").alias("PostingTime"), F.lit("preferred").alias("postDateTime"), F.when(m == 1, F.col("o_orderstatus")).otherwise("  ").alias("DeliveryDate"), F.when(m == 2, F.col("o_orderpriority")).alias("operday"))
    return o.select("o_orderkey", F.col(X.header_order_column(o.columns)).alias("by_header"), F.col(X.posting_column(o.columns)).alias("by_name"), X.first_value(o.columns, ["deliverydate", "OperDay"]).alias("first"))


@query("SELECT '' AS \"postDateTime\", c_custkey, c_name FROM customer")
def add_posting_column(spark, d):
    return K.with_posting_column(table(spark, d, "customer").select("c_custkey", "c_name"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS c_name, '' AS c_mktsegment FROM customer")
def conditional_update(spark, d):
    """A column overwritten where it is blank, and one cleared."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")).alias("c_name"))
    return c.select("c_custkey", R.fill_blank("c_name", F.lit("new")).alias("c_name"), F.lit("").alias("c_mktsegment"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, '' AS brand FROM customer UNION ALL SELECT CAST(p_partkey AS VARCHAR), '', p_brand FROM part")
def union_text(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return R.union_text([c, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))])


@query("SELECT c_custkey AS cust_key, c_name AS customer_name, c_acctbal AS acct_bal_usd FROM customer")
def snake_columns(spark, d):
    c = table(spark, d, "customer")
    return R.snake_columns(c.select(F.col("c_custkey").alias("CustKey"), F.col("c_name").alias("Customer Name"), F.col("c_acctbal").alias("AcctBal(USD)")))


@query("SELECT n_nationkey, n_name FROM nation")
def drop_columns(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(1).alias("load_mean"), F.lit(1).alias("load_std"), F.lit(1).alias("wind_mean"))
    return R.drop_product(n, ["load", "wind"], ["_mean", "_std"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1997-04-01'")
def month_overlap(spark, d):
    """Rows of the months that a window of days overlaps."""
    o = table(spark, d, "orders")
    return o.where(S.in_window(F.trunc("o_orderdate", "MM"), "1996-02-20", "1997-03-01")).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderkey % 24 AS DOUBLE) + CASE WHEN o_orderkey % 3 = 1 THEN 0.5 ELSE 0 END END AS he, o_orderdate - INTERVAL 1 DAY AS posted FROM orders")
def hour_numbers(spark, d):
    """Hours as numbers, and the posting day of day-ahead results."""
    m, h = F.col("o_orderkey") % 3, (F.col("o_orderkey") % 24).cast("string")
    he = F.when(m == 0, F.concat(F.lit(" "), h, F.lit(":00"))).when(m == 1, F.concat(h, F.lit(".5 :xx"))).otherwise(F.concat(F.lit("HE"), h))
    return table(spark, d, "orders").select("o_orderkey", T.parse_hour_number(he).alias("he"), T.posting_day(F.col("o_orderdate")).alias("posted"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL (o_orderkey % 24) HOUR AS ts FROM orders")
def offset_times(spark, d):
    """ISO times with offsets, converted to UTC."""
    n = F.col("o_orderkey")
    local = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (n % 24 - n % 5).cast("int"))
    text = F.concat(F.date_format(local, ISO), F.when(n % 5 == 0, "Z").otherwise(F.concat(F.lit("-0"), (n % 5).cast("string"), F.when(n % 2 == 0, ":00").otherwise("00"))))
    return table(spark, d, "orders").select("o_orderkey", T.parse_iso(text).alias("ts"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderdate + INTERVAL (CASE WHEN o_orderkey % 6 < 2 THEN o_orderkey % 24 ELSE 0 END) HOUR END AS ts,
       CASE WHEN o_orderkey % 6 IN (2, 3) THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def inferred_times(spark, d):
    """Times of any known form, and dates in the order of sort keys."""
    m = F.col("o_orderkey") % 6
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    text = F.when(m == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(m == 1, F.date_format(at, "M/d/yyyy HH:mm")).when(m == 2, F.date_format("o_orderdate", "M/d/yyyy")).when(m == 3, F.date_format("o_orderdate", "yyyy-MM-dd")).when(m == 4, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("soon")
    day = F.when(m.isin(2, 3), T.parse_sort_date(text))
    return table(spark, d, "orders").select("o_orderkey", T.infer_time(text).alias("ts"), day.alias("day"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) + INTERVAL 5 HOUR WHEN 1 THEN CAST(o_orderdate AS DATE) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE END AS any_time FROM orders")
def any_times(spark, d):
    """The first time that any of a row's columns gives."""
    m = F.col("o_orderkey") % 3
    o = table(spark, d, "orders").select("o_orderkey", F.when(m == 0, F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" 05:00"))).otherwise("").alias("SCEDTimestamp"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("DeliveryDate"), F.when(m == 1, "24:00").otherwise("x").alias("HourEnding"))
    return o.select("o_orderkey", T.any_time(o.columns).alias("any_time"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'http://x/' || event_id END AS link FROM events")
def json_ids(spark, d):
    """A document's id under whichever of its names, and its link."""
    m = F.col("event_id") % 4
    link = F.when(F.col("event_id") % 2 == 0, F.struct(F.struct(F.concat(F.lit("http://x/"), F.col("event_id").cast("string")).alias("href")).alias("self")))
    doc = F.to_json(F.struct(F.when(m == 0, "a").when(m == 3, " ").alias("docId"), F.when(m == 1, "b").alias("docLookupId"), F.when(m == 2, "c").alias("doclookupId"), link.alias("_links")))
    return table(spark, d, "events").select("event_id", X.json_doc_id(doc).alias("doc_id"), X.json_link(doc, "self").alias("link"))


@query("SELECT event_id, event_id % 3 = 0 AS by_name, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS DOUBLE) WHEN 1 THEN 90 WHEN 2 THEN 0 END AS wait FROM events")
def failure_texts(spark, d):
    """Failures of name resolution by their text, and seconds to wait from Retry-After headers."""
    m = F.col("event_id") % 4
    header = F.when(m == 0, F.col("event_id").cast("string")).when(m == 1, "Wed, 21 Oct 2015 07:29:30 GMT").when(m == 2, "Wed, 21 Oct 2015 07:00:00 GMT").otherwise("later")
    error = F.when(F.col("event_id") % 3 == 0, "Temporary failure in Name Resolution").when(F.col("event_id") % 3 == 1, "timed out")
    now = F.lit("2015-10-21 07:28:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", X.name_failure(error).alias("by_name"), X.retry_after(header, now).alias("wait"))


@query("SELECT page_id, page_id % 3 = 0 AS file FROM pages")
def file_links(spark, d):
    end = F.element_at(F.array(*map(F.lit, (".TGZ?x=1", ".txt", "/csv"))), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", X.file_link(F.concat(F.lit("http://x/y"), end)).alias("file"))


# Orders, counts, estimates.


@query("SELECT o_orderkey, o_custkey FROM orders")
def monthly_sort(spark, d):
    """Rows of each month's file in the order of their times, without a global order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("postDateTime"), F.trunc("o_orderdate", "MM").alias("month"))
    order = O.sort_order("match-download-order", "newest-first")
    return O.monthly_sort(o, order, "postdatetime", row_idx="o_orderkey", within=["month"]).select("o_orderkey", "o_custkey")


@query("SELECT CASE WHEN c = 1 THEN 'already' ELSE 'sorted' END AS status, count(*) AS n FROM (SELECT least(count(*), 2) AS c FROM orders GROUP BY o_custkey) GROUP BY 1")
def status_tally(spark, d):
    held = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("c")).select(F.when(F.col("c") == 1, "already").otherwise("sorted").alias("status"))
    return W.tally(held)


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE place = 1 OR place = n OR place % 5 = 0")
def progress_rows(spark, d):
    return W.progress_rows(table(spark, d, "orders"), 5, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("""
WITH k AS (SELECT event_type AS dataset_id, count(DISTINCT CAST(ts AS DATE)) AS days, epoch(max(ts)) - epoch(min(ts)) AS span, count(DISTINCT date_trunc('day', ts)) AS c FROM events GROUP BY 1)
SELECT dataset_id, CASE WHEN c >= 2 AND span > 0 THEN 'files' ELSE 'mean' END AS basis, round(CASE WHEN c >= 2 AND span > 0 THEN span / (c - 1) ELSE avg(span / nullif(c - 1, 0)) OVER () END, 4) AS seconds_per_day FROM k""")
def file_time_estimate(spark, d):
    """Where no log has enough days, files' time spans tell the seconds a day."""
    e = table(spark, d, "events")
    logged = e.where("ts is null").select(F.col("event_type").alias("dataset_id"), F.lit(0).alias("run"), F.col("ts").alias("completed_at"), F.col("event_id").alias("row_idx"))
    files = e.select(F.col("event_type").alias("dataset_id"), F.col("ts").alias("modified_at"), F.col("ts").cast("date").alias("day"))
    days = e.groupBy(F.col("event_type").alias("dataset_id")).agg(F.countDistinct(F.col("ts").cast("date")).alias("days"))
    return rounded(E.time_estimate(logged, files, days).select("dataset_id", "basis", "seconds_per_day"), "seconds_per_day", places=4)


_TIERED = [*registry.EARLIEST, "NP0-000-CD"]


@query("WITH t(dataset_id, tier) AS (VALUES " + ", ".join(f"('{x}', '{t}')" for t, ids in registry.TIERS.items() for x in ids) + "), n(k, dataset_id) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(_TIERED)) + f") SELECT n.dataset_id, tier, count(*) AS files, round(sum(o_totalprice), 2) AS bytes FROM orders JOIN n ON k = o_custkey % {len(_TIERED)} LEFT JOIN t USING (dataset_id) GROUP BY 1, 2")
def estimate_tiers(spark, d):
    """Files and bytes of datasets with the tier that each is in; one is in none."""
    name = F.element_at(F.array(*map(F.lit, _TIERED)), (F.col("o_custkey") % len(_TIERED) + 1).cast("int"))
    held = table(spark, d, "orders").where("o_custkey is not null").groupBy(name.alias("dataset_id")).agg(F.count("*").alias("files"), F.sum("o_totalprice").alias("bytes"))
    return rounded(E.with_tiers(held, registry.tiers(spark)).select("dataset_id", "tier", "files", "bytes"), "bytes", places=2)


@query("SELECT file, row_idx, value FROM (SELECT o_orderpriority AS file, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS BIGINT) AS row_idx, CASE WHEN o_orderkey % 9 = 0 THEN 'soon' WHEN o_orderkey % 4 = 0 THEN '' ELSE 'x' END AS value FROM orders) WHERE value = 'soon'")
def audit_caches(spark, d):
    """Unparsed posting times of JSONL caches, each with its file and line."""
    root = scratch(spark, "audit")
    o = table(spark, d, "orders")
    posting = F.when(F.col("o_orderkey") % 9 == 0, "soon").when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.date_format("o_orderdate", ISO))
    lines = o.select("o_orderpriority", "o_orderkey", F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("docId"), posting.alias("postDatetime"))).alias("value"))
    K.export_files(lines, root, "o_orderpriority", ["o_orderkey"], lambda k: f"{k}.docs.jsonl")
    return Q.cache_issues(S.lines_of(spark, root)).select(F.regexp_extract("file", r"([^/]+)\.docs\.jsonl$", 1).alias("file"), "row_idx", "value")
