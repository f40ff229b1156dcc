import json

import pytest
from pyspark.sql import functions as F

from gridmill.operators import summaries as S


def test_rollup_tells_null_keys_from_totals(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 4)], "k string, m string, v int")
    got = {(r.k, r.m, r.level): r.v for r in S.rolled_up(df, ["k", "m"], v=F.sum("v")).collect()}
    assert got == {("a", "x", 2): 1, ("a", None, 2): 2, (None, "x", 2): 4, ("a", None, 1): 3, (None, None, 1): 4, (None, None, 0): 7}
    plan = S.rolled_up(df, ["k"], v=F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 1 and "Union" not in plan


def test_correlations_of_rows_that_have_both(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 4.0, 1.0), (3, 6.0, 0.0), (None, 9.0, 5.0)], "a int, b double, c double")
    got = {(r.left, r.right): (r.n, r.corr) for r in S.correlations(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == (3, pytest.approx(1.0)) and got["a", "c"] == (2, pytest.approx(-1.0)) and got["b", "c"][0] == 3
    assert S.correlations(df.limit(0), ["a", "b"]).first().corr is None


def test_samples_of_parts_merge(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    whole = {r.id for r in S.scatter_sample(df, 20, ["id"]).collect()}
    parts = S.scatter_sample(df.where("id < 300"), 20, ["id"]).unionByName(S.scatter_sample(df.where("id >= 300"), 20, ["id"]))
    assert len(whole) == 20 and whole == {r.id for r in S.scatter_sample(parts, 20, ["id"]).collect()}


def test_sketches_add_up_over_months(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("m"), (F.col("id") % 7000).alias("v"), F.lit(None).cast("string").alias("w"))
    kept = S.month_sketches(df, "m", "v", "w")
    for inside, exact in ((F.lit(True), 7000), (F.col("m") == 1, 7000), (F.col("m") > 5, 0)):
        assert abs(S.distinct_in(kept, inside).first().n - exact) <= 0.04 * exact


def test_rows_set_aside_and_replayed(spark, tmp_path):
    rules = {"number": F.col("v").try_cast("int").isNotNull(), "small": F.col("v").try_cast("int") < 10}
    df = spark.createDataFrame([(1, "1"), (2, "x"), (3, "30"), (4, None)], "i int, v string")
    at, again = str(tmp_path / "t"), str(tmp_path / "again")
    S.write_checked(df, rules, at)
    table = spark.read.parquet(at)
    assert [r.i for r in S.clean_rows(table).collect()] == [1] and {r.i: r.reason for r in S.quarantined(table).collect()} == {2: "number", 3: "small", 4: "number"}
    S.replayed(at, table, lambda bad: bad.withColumn("v", F.coalesce("v", F.lit("4"))), rules, again)
    new = spark.read.parquet(again)
    assert sorted(r.i for r in S.clean_rows(new).collect()) == [1, 4] and S.quarantined(new).count() == 2
    with pytest.raises(FileExistsError):
        S.replayed(at, table, lambda bad: bad, rules, again)


def test_counters_of_a_job_and_of_a_stream(spark, tmp_path):
    df, seen = S.observed(spark.range(100), n=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1))
    df.write.parquet(str(tmp_path / "o"))
    assert seen.get == {"n": 100, "odd": 50}
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text("".join(json.dumps({"v": j}) + "\n" for j in range(i + 1)))
    counters = S.StreamCounters("rows")
    spark.streams.addListener(counters)
    try:
        stream = spark.readStream.schema("v int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).observe("rows", F.count("*").alias("n"), F.sum("v").alias("v"))
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert counters.totals[str(q.id)] == {"n": 6, "v": 4}
    finally:
        spark.streams.removeListener(counters)


def test_documents_of_sql_come_in_parts(spark, tmp_path):
    from gridmill import catalog_queries as C
    from gridmill import summary_queries as Q
    from tests.oracle import spark_rows, sql_rows

    spark.range(5000).selectExpr("id * 3 AS o_orderkey", "concat(id % 2, '-P') AS o_orderpriority", "'F' AS o_orderstatus").coalesce(1).write.parquet(str(tmp_path / "o"))
    next((tmp_path / "o").glob("part-*.parquet")).rename(tmp_path / "orders.parquet")
    found = Q.sql_document_rows(spark, str(tmp_path))
    sizes = [len(r.text) for r in spark.table("sql_documents").collect()]
    assert len(sizes) == 30 and max(sizes) < 16 * Q.PART_KEYS
    assert spark_rows(found) == sql_rows(C.ORACLES["sql_document_rows"], str(tmp_path))
