import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridmill.operators import aggregates as A
from gridmill.operators import joins as J
from gridmill.operators import quality as Q
from gridmill.operators import reshape as R
from gridmill.operators import sorts as O
from gridmill.operators import windows as W
from gridmill.plans import estimate as E
from gridmill.plans import master as M


def fill(spark, sources, targets, **kw):
    s = spark.createDataFrame([(i, *r) for i, r in enumerate(sources)], "row_idx int, v string, posting string")
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(targets)], "row_idx int, v string, posting string")
    return [r.posting for r in J.fill_by_fingerprint(t, s, ["v"], **kw).orderBy("row_idx").collect()]


def test_fingerprints(spark):
    blank = ("a", "")
    assert fill(spark, [("a", "t1"), ("a", "t2")], [blank] * 3) == ["t2", "t1", None]
    assert fill(spark, [("a", "t1"), ("a", "")], [blank] * 2) == [None, "t1"]
    assert fill(spark, [("a", "t1"), ("a ", "t1")], [blank] * 2, overwrite=True) == [None, None]
    assert fill(spark, [("a", "t1"), ("a ", "t1")], [blank] * 2, overwrite=True, allow_unanimous=True) == ["t1", "t1"]
    assert fill(spark, [("a", "t1")], [("a", "x"), blank]) == ["x", "t1"]
    assert fill(spark, [(None, "t1")], [("", None)]) == ["t1"]


def test_monthly_sort(spark):
    rows = [(0, "12/01/2025", "3"), (1, None, "1"), (2, "12/01/2025", "1"), (3, "12/01/2025", "1")]
    df = spark.createDataFrame(rows, "row_idx int, DeliveryDate string, HourEnding string")
    assert [r.row_idx for r in O.monthly_sort(df, "ascending").collect()] == [2, 3, 0, 1]
    assert [r.row_idx for r in O.monthly_sort(df, "descending").collect()] == [0, 2, 3, 1]
    assert O.sort_strategy("auto", ["DeliveryDate", "postDateTime"]) == "forecast-aware" and O.sort_strategy("auto", ["DeliveryDate"]) == "timestamp"
    assert O.sort_order("match-download-order", "newest-first") == "descending" and O.sort_order("none") is None
    with pytest.raises(ValueError):
        O.sort_strategy("x", [])
    key = O.sort_keys(df.columns)[0]
    status = lambda d: W.sort_status(W.inversions(d.withColumn("key", key).withColumn("m", F.lit(1)), "key", ["m"], ["row_idx"])).first().status
    assert (status(df), status(df.where("row_idx > 1")), status(df.where("row_idx = 1"))) == ("sorted", "already", "skipped")


def test_document_and_posting_order(spark):
    df = spark.createDataFrame([("9", "x"), ("10", "x"), ("7", None)], "doc_id string, t string")
    assert [r.doc_id for r in O.document_order(df, "newest-first", "t").collect()] == ["9", "10", "7"]
    assert [r.doc_id for r in O.document_order(df, "oldest-first", "t").collect()] == ["10", "9", "7"]
    p = spark.createDataFrame([(0, "", "12/01/2025", "1"), (1, "2025-01-02 00:00:00", "12/01/2025", "2"), (2, "2025-01-02 00:00:00", "12/01/2025", "1")], "row_idx int, p string, d string, h string")
    assert [r.row_idx for r in O.posting_sort(p, "p", "d", "h").collect()] == [2, 1, 0]
    assert [r.row_idx for r in O.posting_sort(p, "p", "d", "h", "descending").collect()] == [1, 2, 0]


def test_gaps_of_resampling(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1, 0, 5), "a", 1.0), (dt.datetime(2025, 1, 1, 3, 5), "a", float("nan")), (None, "a", 7.0)], "ts timestamp_ntz, k string, v double")
    assert [(r.ts_local.hour, r.m) for r in A.resample(df, "ts", {"m": "v"}, fill_gaps=True).orderBy("ts_local").collect()] == [(0, 1.0), (1, None), (2, None), (3, None)]
    assert A.resample(df, "ts", {"m": "v"}, "k").count() == 2
    assert A.mean_of_all(df.select("ts", "v"), "ts").count() == 2


def test_checked_pivot(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (2, "A", 3.0)], "i int, k string, v double")
    assert sorted(map(tuple, R.checked_pivot(df, ["i"], "k", "v", ["A", "B"], "_x").collect())) == [(1, 1.0, 2.0), (2, 3.0, None)]
    with pytest.raises(Exception, match="repeated"):
        R.checked_pivot(df.union(df.limit(1)), ["i"], "k", "v", ["A", "B"]).collect()


def test_unions_and_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(None, 2)], "b string, c int")
    assert [tuple(r) for r in R.union_text([a, b]).collect()] == [("1", "x", ""), ("", "", "2")]
    assert R.posting_first(spark.createDataFrame([(1, 2, 3)], " a int, PostingTime int, b int"), "PostingTime").columns == ["postDateTime", "a", "b"]
    assert R.drop_product(spark.createDataFrame([(1, 2, 3)], "xA int, xB int, y int"), ["x"], ["A", "B"]).columns == ["y"]
    f = spark.createDataFrame([("", "n"), ("o", "n"), (None, "n")], "a string, n string")
    assert [r[0] for r in f.select(R.fill_blank("a", F.col("n"))).collect()] == ["n", "o", "n"]


def test_quality(spark):
    df = spark.createDataFrame([("2025-01-01", "15:00", ""), ("2025-01-04", "12/01/2025", "x"), ("2025-01-02", "12/01/2025", "2025-01-01T00:00:00Z"), ("2025-01-02", "1:00", None)], "day string, DeliveryDate string, posting string")
    assert [str(r.day) for r in Q.missing_days(df, "day").collect()] == ["2025-01-03"]
    assert Q.shifted_rows(df, "DeliveryDate", "posting").count() == 2
    assert [r.posting for r in Q.unparsed_postings(df, "posting", "day").collect()] == ["x"]
    assert [r.column for r in Q.all_null(df.withColumn("z", F.lit(None).cast("int")), "day", "z").collect()] == ["z"]
    assert Q.missing_days(df, "day", start="2024-12-31", end="2025-01-04").count() == 2


def test_estimates(spark):
    at = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    ev = spark.createDataFrame([("A", "r", at(s), i) for i, s in enumerate([0, 10, 10, 90010, 90030])] + [("B", "r", at(0), 0)], "dataset_id string, run string, completed_at timestamp_ntz, row_idx int")
    files = spark.createDataFrame([("B", at(0), dt.date(2025, 1, 1)), ("B", at(60), dt.date(2025, 1, 3))], "dataset_id string, modified_at timestamp_ntz, day date")
    days = spark.createDataFrame([("A", 36), ("B", 60), ("C", 10)], "dataset_id string, days int")
    got = {r.dataset_id: (r.basis, r.seconds_per_day, r.std_s) for r in E.time_estimate(ev, files, days, min_samples=2).collect()}
    assert got == {"A": ("log", 15.0, 5.0), "B": ("files", 60.0, 0.0), "C": ("mean", 37.5, 0.0)}
    f = spark.createDataFrame([("A", dt.date(2025, 1, 1), 310), ("A", dt.date(2025, 2, 1), 28)], "dataset_id string, month date, bytes long")
    first = spark.createDataFrame([("A", dt.date(2025, 1, 1)), ("B", None)], "dataset_id string, first_day date")
    size = {r.dataset_id: r.estimated_bytes for r in E.size_estimate(f, first, "2025-01-10").collect()}
    assert size["A"] == 55.0 and size["B"] is None
    assert {r.dataset_id: r.estimated_bytes for r in E.recent_estimate(f, first, "2025-03-10").collect()}["A"] == 507.0
    assert E.with_total(E.size_estimate(f, first, "2025-01-10"), "dataset_id", "estimated_bytes").where("dataset_id = 'TOTAL'").first().estimated_bytes == 55.0


def test_master(spark):
    load = spark.createDataFrame([("12/01/2025", "01:00", "10"), ("12/01/2025", "24:00", "30"), ("x", "1", "5")], "OperDay string, HourEnding string, TOTAL string")
    fc = spark.createDataFrame([("12/01/2025", "01:00", "11", "A", "Y", "2025-11-30T00:00:00"), ("12/01/2025", "01:00", "19", "A", "Y", "2025-11-30T05:00:00"), ("12/01/2025", "01:00", "90", "B", "N", "2025-12-05T00:00:00")], "DeliveryDate string, HourEnding string, SystemTotal string, Model string, InUseFlag string, postDateTime string")
    wind = spark.createDataFrame([("12/01/2025", "1", "3"), ("12/01/2025", "12/01/2025 02:00:00", "4")], "DELIVERY_DATE string, HOUR_ENDING string, ACTUAL_SYSTEM_WIDE string")
    solar = spark.createDataFrame([("12/01/2025", "1", "2")], "DELIVERY_DATE string, HOUR_ENDING string, SYSTEM_WIDE_GEN string")
    spp = spark.createDataFrame([("12/01/2025", "1", "1", "HB", "20.0"), ("12/01/2025", "1", "2", "HB", "22.0"), ("12/01/2025", "24", "4", "LZ", "-5"), ("13/45/2025", "x", "9", "HB", "NA")], "DeliveryDate string, DeliveryHour string, DeliveryInterval string, SettlementPointName string, SettlementPointPrice string")
    got = M.master(M.load(load), M.forecast(fc), M.wind(wind), M.solar(solar), M.price(spp)).collect()
    assert len(got) == 24 and got[0].net_load == 5.0 and got[0].load_forecast == 40.0 and got[0].price == 21.0
    assert got[1].wind == 4.0 and got[1].net_load is None and got[23].load_total == 30.0 and got[23].price == -5.0
    assert M.forecast(fc, in_use=True).first().load_forecast == 15.0
    assert M.forecast(fc, latest=True).first().load_forecast == 19.0
    assert M.price_by_point(spp).count() == 2


def test_windows(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([True, True, False, True])], "i int, bad boolean").withColumn("k", F.lit("x"))
    assert [r.streak for r in W.streaks(df, "bad", ["k"], ["i"]).orderBy("i").collect()] == [1, 2, 0, 1]
    assert [(r.island, r.n_rows) for r in W.islands(df, "bad", ["k"], ["i"]).orderBy("island").collect()] == [(1, 2), (2, 1), (3, 1)]
    assert [r.i for r in W.last_rows(df, 2, ["k"], ["-i"]).orderBy("i").collect()] == [2, 3]
    docs = W.offsets(spark.createDataFrame([("m", "a", 2), ("m", "b", 0), ("m", "c", 1)], "month string, doc_id string, n long"), "n", ["month"], ["doc_id"])
    rows = spark.range(4).select(F.lit("m").alias("month"), F.col("id").alias("row_idx"))
    assert [r.doc_id for r in J.fill_by_position(rows, docs).orderBy("row_idx").collect()] == ["a", "a", "c", None]


def test_ordinals_by_bucket_number_as_one_window_does(spark):
    df = spark.range(500).selectExpr("id % 3 AS k", "id div 40 AS b", "id AS o")
    up = W.ordinals(df, ["k"], "b", [F.col("o")], "n").collect()
    down = W.ordinals(df, ["k"], "b", [F.desc("o")], "n", descending=True).collect()
    for k in range(3):
        assert [r.o for r in sorted((r for r in up if r.k == k), key=lambda r: r.n)] == list(range(k, 500, 3))
        assert [r.o for r in sorted((r for r in down if r.k == k), key=lambda r: r.n)] == list(range(k, 500, 3))[::-1]


def test_windows_over_one_large_key_equal_those_of_one_task(spark):
    import random

    from gridmill.operators import windows as W

    r = random.Random(4)
    rows = [("big" if i % 50 else None, i, r.choice([None, 1, 1, 1, 2]), r.random() < 0.9 or 100 < i < 900) for i in range(3000)] + [("few", 0, 1, True)]
    df = spark.createDataFrame(rows, "k string, i int, v int, bad boolean").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges of so few rows
    try:
        for order in (["i"], ["-i"]):
            assert sorted(map(str, W.spread_islands(df, "v", ["k"], order).collect())) == sorted(map(str, W.islands(df, "v", ["k"], order).collect()))
            assert sorted(map(str, W.spread_streaks(df, "bad", ["k"], order).collect())) == sorted(map(str, W.streaks(df, "bad", ["k"], order).collect()))
            for down in (False, True):
                assert sorted(map(str, W.spread_inversions(df, "v", ["k"], order, down).collect())) == sorted(map(str, W.inversions(df, "v", ["k"], order, down).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_documents_spread_to_rows_are_never_broadcast(spark):
    docs = spark.createDataFrame([("m", "a", 0, 2), ("m", "b", 2, 3)], "month string, doc_id string, row_start long, row_end long")
    found = J.fill_by_position(spark.range(4).select(F.lit("m").alias("month"), F.col("id").alias("row_idx")), docs)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.row_idx, r.doc_id) for r in found.orderBy("row_idx").collect()] == [(0, "a"), (1, "a"), (2, "b"), (3, None)]


def test_tables_are_dealt_to_tasks_by_their_rows(spark, tmp_path):
    from gridmill import catalog_queries as C
    from gridmill import session

    spark.range(3000).select((F.col("id") % 700).alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"), F.col("id").cast("double").alias("l_extendedprice"), F.col("id").alias("l_partkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    each, session.TASK_ROWS = session.TASK_ROWS, 100
    try:
        assert session.tasks_for(spark.read.parquet(str(tmp_path / "lineitem.parquet"))) == 30
        plan = C.pivot_checked(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, v string")
        found = J.collisions(rows, ["v"], 30)
    finally:
        session.TASK_ROWS = each
    assert plan.count("Exchange") == 1 and "hashpartitioning(l_orderkey" in plan and ", 30)" in plan
    assert "hashpartitioning(__f" in (p := found._jdf.queryExecution().executedPlan().toString()) and p.count("Exchange") == 1
    assert [tuple(r) for r in found.collect()] == [("a", 2)]


def test_rebuilt_rows_of_one_number_have_an_order(spark):
    from gridmill.plans import backfill as B

    rows = [("m", 1, 1, 5, p, n) for p, n in [("b", "1"), ("a", "2"), ("c", "1"), ("a", "1")]]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "month string, doc_id int, doc_position int, row_idx long, part string, line string").coalesce(1)
        postings = spark.createDataFrame([(1, "2025-01-01T00:00:00", 0)], "doc_id int, posting string, row_idx int")
        got = [(r.part, r.line) for r in B.rebuild(df, [postings], ["part", "line"]).orderBy("row_idx").collect()]
        assert got == [("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")]
