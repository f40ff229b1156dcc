"""Queries of the one-pass summaries and of tables and states that grow from run to run, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.catalog_queries import query, rounded, table
from gridmill.functions import tables
from gridmill.functions import timeparse as T
from gridmill.operators import summaries as S
from gridmill.operators import windows as W
from gridmill.plans import resume
from gridmill.session import scratch
from gridmill.sources import sinks

#: Keys whose rows are a part of a document.
PART_KEYS = 1024
_LEVELS = "CAST(2 - grouping(o_orderpriority) - grouping(o_orderstatus) AS INTEGER)"


@query(f"SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price, {_LEVELS} AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_totals(spark, d):
    """Details, subtotals and the grand total of one scan."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    return rounded(S.rolled_up(o, ["o_orderpriority", "o_orderstatus"], n=F.count("*"), price=F.sum("o_totalprice")), "price", places=2)


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :])


@query(_PAIRS)
def column_correlations(spark, d):
    """Every pair of a table's number columns from one aggregate."""
    return rounded(S.correlations(table(spark, d, "lineitem"), _COLUMNS), "corr")


@query("""
SELECT w.name AS span, count(DISTINCT (l_partkey, l_suppkey)) AS points, true AS close FROM (VALUES ('1995', '1995-01', '1995-12'), ('1994-1996', '1994-01', '1996-12'), ('all', '0000', '9999')) AS w(name, a, b)
JOIN orders ON strftime(o_orderdate, '%Y-%m') BETWEEN a AND b JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def distinct_sketches(spark, d):
    """Distinct points of windows from sketches kept by month, held against exact counts: they are within four standard errors."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(o, "l_orderkey")
    kept = scratch(spark, "sketches")
    S.month_sketches(rows, "month", "l_partkey", "l_suppkey").write.parquet(kept)
    out = None
    for name, a, b in (("1995", "1995-01", "1995-12"), ("1994-1996", "1994-01", "1996-12"), ("all", "0000", "9999")):
        about = S.distinct_in(spark.read.parquet(kept), F.col("month").between(a, b))
        exact = rows.where(F.col("month").between(a, b)).agg(F.countDistinct("l_partkey", "l_suppkey").alias("points"))
        both = exact.unionByName(about, allowMissingColumns=True).agg(F.max("points").alias("points"), F.max("n").alias("n"))
        one = both.select(F.lit(name).alias("span"), "points", (F.abs(F.col("n") - F.col("points")) <= 4 * 1.04 / 128 * F.col("points") + 1).alias("close"))
        out = one if out is None else out.unionByName(one)
    return out.where("points > 0")


@query("SELECT count(*) AS rows_written, count(*) FILTER (value > 50) AS large, count(DISTINCT event_type) AS kinds FROM events")
def observed_counters(spark, d):
    """Counters of a write, seen while it wrote."""
    e, seen = S.observed(table(spark, d, "events"), rows_written=F.count("*"), large=F.count_if(F.col("value") > 50), kinds=F.size(F.collect_set("event_type")).cast("long"))
    e.write.parquet(scratch(spark, "observed"))
    return spark.createDataFrame([seen.get], "rows_written long, large long, kinds long")


@query("""
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'no day' WHEN 1 THEN 'no number' END AS reason FROM orders)
SELECT 'first' AS run, o_orderkey, reason FROM r UNION ALL SELECT 'replayed', o_orderkey, CASE WHEN reason = 'no day' THEN reason END FROM r""")
def quarantine(spark, d):
    """Rows that break a rule are set aside with the reason in the pass that writes the others; those that a later run can mend are replayed."""
    k = F.col("o_orderkey") % 9
    o = table(spark, d, "orders").select("o_orderkey", F.when(k == 0, "15:00").otherwise("12/01/2025").alias("day"), F.when(k == 1, "n/a").otherwise("1.5").alias("price"))
    rules = {"no day": T.parse_date("day").isNotNull(), "no number": F.col("price").try_cast("double").isNotNull()}
    path = scratch(spark, "checked")
    S.write_checked(o, rules, path)
    first = spark.read.parquet(path)
    S.replayed(path, first, lambda bad: bad.withColumn("price", F.replace("price", F.lit("n/a"), F.lit("0"))), rules, f"{path}-again")
    parts = []
    for run, held in (("first", first), ("replayed", spark.read.parquet(f"{path}-again"))):
        good = S.clean_rows(held).select("o_orderkey", F.lit(None).cast("string").alias("reason"))
        parts.append(good.unionByName(S.quarantined(held).select("o_orderkey", "reason")).select(F.lit(run).alias("run"), "o_orderkey", "reason"))
    return parts[0].unionByName(parts[1])


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS "key", strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS posting, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS customer,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END AS status, strftime(o_orderdate, '%m') AS month FROM orders WHERE o_orderdate IS NOT NULL""")
def append_growing(spark, d):
    """Two appends, the second under other names, in another order and with one more column: one table, nothing written twice."""
    o = table(spark, d, "orders").where("o_orderdate is not null").withColumn("at", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    path = scratch(spark, "growing")
    odd, even = o.where("o_orderkey % 2 = 1"), o.where("o_orderkey % 2 = 0")
    sinks.append_reconciled(odd.select(F.col("at").alias("PostingTime"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")), path)
    sinks.append_reconciled(even.select(F.col("o_orderkey").alias(" key"), F.col("o_custkey").alias("customer"), F.col("at").alias("postDateTime")), path)
    return sinks.read_table(spark, path).select("key", F.col("PostingTime").alias("posting"), "customer", "status", F.format_string("%02d", F.col("month").cast("int")).alias("month"))


@query("""
WITH r AS (SELECT o_orderpriority AS dataset_id, CAST(max(o_custkey) AS INTEGER) AS last_page, CAST(count(*) AS INTEGER) AS total_docs, CAST(count(*) FILTER (o_orderstatus = 'F') AS INTEGER) AS done FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT dataset_id, last_page, total_docs, CASE WHEN dataset_id < '3' THEN total_docs ELSE done END AS next_doc_index, CASE WHEN dataset_id < '3' OR done >= total_docs THEN 'done' ELSE 'running' END AS status FROM r""")
def saved_run_states(spark, d):
    """The states of a run saved, and a later run's of some datasets saved over theirs."""
    o = table(spark, d, "orders").where("o_orderpriority is not null").select(F.col("o_orderpriority").alias("dataset_id"), F.col("o_custkey").alias("page"), "o_orderstatus")
    path = scratch(spark, "states")
    names = o.select("dataset_id").distinct()
    resume.save_states(resume.states_of(o, o.where("o_orderstatus = 'F'"), names), path)
    later = o.where("dataset_id < '3'")
    resume.save_states(resume.states_of(later, later, names.where("dataset_id < '3'")), path)
    return resume.saved_states(spark, path).select("dataset_id", "last_page", "total_docs", "next_doc_index", "status")


@query("""
WITH e AS (SELECT 0 AS k, event_id, event_type, value FROM events WHERE event_id IS NOT NULL),
m AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS island FROM (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (ORDER BY event_id)))
SELECT CAST(island AS BIGINT) AS island, event_type, count(*) AS n_rows FROM m GROUP BY ALL""")
def whole_table_islands(spark, d):
    """Runs of equal events in the order of the whole table, which no single task sorts."""
    e = table(spark, d, "events").where("event_id is not null").select(F.lit(0).alias("k"), "event_id", "event_type")
    return W.spread_islands(e, "event_type", ["k"], ["event_id"]).select(F.col("island").cast("long").alias("island"), "event_type", "n_rows")


@query("""
WITH e AS (SELECT event_id, ts, value > 20 AS failed FROM events WHERE event_id IS NOT NULL),
i AS (SELECT count(*) AS n_rows, CAST(sum(CASE WHEN row_number > 1 AND ts IS NOT NULL AND (before IS NULL OR ts < before) THEN 1 ELSE 0 END) AS BIGINT) AS n_inversions FROM (SELECT ts, lag(ts) OVER w AS before, row_number() OVER w AS row_number FROM e WINDOW w AS (ORDER BY event_id))),
g AS (SELECT event_id, failed, sum(CASE WHEN coalesce(failed, false) THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS g FROM e),
s AS (SELECT max(n) AS longest FROM (SELECT count(*) FILTER (failed) AS n FROM g GROUP BY g))
SELECT n_rows, n_inversions, longest FROM i, s""")
def whole_table_order(spark, d):
    """Breaks of time's order and the longest streak of a whole table in the order of its ids, from ranges of it."""
    e = table(spark, d, "events").where("event_id is not null").select(F.lit(0).alias("k"), "event_id", "ts", (F.col("value") > 20).alias("failed"))
    found = W.spread_inversions(e, "ts", ["k"], ["event_id"]).select("n_rows", "n_inversions", F.lit(None).cast("long").alias("longest"))
    longest = W.spread_streaks(e, "failed", ["k"], ["event_id"]).agg(F.max("streak").alias("longest"))
    return found.unionByName(longest, allowMissingColumns=True).agg(F.max("n_rows").alias("n_rows"), F.max("n_inversions").cast("long").alias("n_inversions"), F.max("longest").alias("longest"))


@query("""
SELECT o_orderpriority AS doc_id, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS INTEGER) AS row_idx, CAST(o_orderkey AS VARCHAR) AS "key", 'x, "' || o_orderstatus || '"' AS label, CAST(NULL AS VARCHAR) AS missing
FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderkey IS NOT NULL AND o_orderstatus IS NOT NULL""")
def sql_document_rows(spark, d):
    """Documents cut into rows by SQL text alone: a lateral table function whose columns are named in the call.

    A call's rows are all in a Python worker's memory at once, and so are those of a batch of calls. These documents grow with the
    table, so they come in parts of a range of keys, each under the header, with the number of the rows before.
    """
    tables.register(spark)
    o = table(spark, d, "orders").where("o_orderpriority is not null and o_orderkey is not null and o_orderstatus is not null")
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(',"x, ""'), "o_orderstatus", F.lit('"""'))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"])
    keys = [F.col("o_orderpriority").alias("doc_id"), F.floor(F.col("o_orderkey") / PART_KEYS).alias("part")]
    starts = W.offsets(o.groupBy(*keys).agg(F.count("*").alias("n")), "n", ["doc_id"], ["part"]).select("doc_id", "part", "row_start")
    texts = o.groupBy(*keys).agg(F.concat(F.lit("key, label\r\n"), F.array_join(lines, "\r\n")).alias("text"))
    texts.join(starts, ["doc_id", "part"]).createOrReplaceTempView("sql_documents")
    return spark.sql("SELECT d.doc_id, CAST(d.row_start + r.row_idx AS INT) AS row_idx, r.key, r.label, r.missing FROM sql_documents d, LATERAL csv_rows(d.text, 'key,label,missing') r")
