import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridmill import catalog_queries as C
from gridmill import registry
from gridmill.functions import text as X
from gridmill.functions import timeparse as T
from tests.oracle import spark_rows, sql_rows


def values(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *[e.alias(f"c{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()]


def day(y, m, d, h=0, mi=0, s=0):
    return dt.datetime(y, m, d, h, mi, s)


def test_dates(spark):
    texts = ["12/31/2025", "1/2/2025", "12/31/25", "12/31/75", "2025-12-31", " 2025-1-2 ", "junk", "", None, "13/45/2025", "2025-12-31T05:00:00Z", "2025-02-30"]
    got = [r[0] for r in values(spark, texts, T.parse_date("s"))]
    assert got == [day(2025, 12, 31), day(2025, 1, 2), day(2025, 12, 31), day(1975, 12, 31), day(2025, 12, 31), day(2025, 1, 2), None, None, None, None, day(2025, 12, 31, 5), None]


def test_times(spark):
    texts = ["2025-12-31 23:59:58", "12/31/2025 1:05", "2025-12-31T10:20", "2025-12-31T10:20:30-06:00", "2025-12-31T10:20:30Z", "2025-12-31", "5", "15:00", None]
    got = [r[0] for r in values(spark, texts, T.parse_datetime("s"))]
    assert got == [day(2025, 12, 31, 23, 59, 58), day(2025, 12, 31, 1, 5), day(2025, 12, 31, 10, 20), day(2025, 12, 31, 16, 20, 30), day(2025, 12, 31, 10, 20, 30), None, None, None, None]


def test_days_of_times(spark):
    texts = ["2025-12-31T10:20:30Z", "12/31/2025 24:00", "2025/1/2", "x"]
    assert [r[0] for r in values(spark, texts, T.parse_day("s"))] == [dt.date(2025, 12, 31), dt.date(2025, 12, 31), dt.date(2025, 1, 2), None]


def test_hour_endings(spark):
    texts = ["1", "01:00", "24:00", "24", "", "25", "abc", None, "0", "HE 7"]
    d = F.lit("2025-12-01").cast("timestamp_ntz")
    he = T.parse_hour_ending("s")
    got = values(spark, texts, he, T.he_begin(d.cast("date"), he), T.he_sort(d, he), T.he_wrap(d.cast("date"), he))
    assert [r[0] for r in got] == [1, 1, 24, 24, None, None, None, None, 0, 7]
    assert got[0][1:] == (day(2025, 12, 1), day(2025, 12, 1, 1), day(2025, 12, 1, 1))
    assert got[2][1:] == (day(2025, 12, 1, 23), day(2025, 12, 1, 23, 59), day(2025, 12, 1))
    assert got[5][1:] == (None, None, None)


def test_axes(spark):
    df = spark.createDataFrame([("12/01/2025", "05:00", "2025-11-30T01:02:03", None), ("junk", "24", "", "2025-12-02 01:00:00")], "DeliveryDate string, HourEnding string, postDateTime string, SCEDTimestamp string")
    got = [tuple(r) for r in df.select(T.target_time(df.columns), T.issue_time(df.columns), T.any_time(df.columns)).collect()]
    assert got == [(day(2025, 12, 1, 5), day(2025, 11, 30, 1, 2, 3), day(2025, 11, 30, 1, 2, 3)), (day(2025, 12, 2, 1), None, day(2025, 12, 2, 1))]


def test_calendar(spark):
    d = lambda s: F.lit(s).cast("date")
    r = spark.range(1).select(T.inclusive_days(d("2025-12-30"), d("2025-12-31")), T.inclusive_days(d("2025-12-31"), d("2025-12-01")), T.inclusive_months(d("2025-01-15"), d("2025-12-01")), T.days_in_month(d("2024-02-10")), T.month_of_path(F.lit("/a/NP6-905-CD/2025/12/NP6-905-CD_202512.csv"))).first()
    assert tuple(r) == (2, 0, 12, 29, dt.date(2025, 12, 1))


def test_text(spark):
    got = values(spark, ["1536", "12", "1e13", "NA", "nan", None], X.human_bytes(X.number("s")), X.short_bytes(X.number("s")), X.number("s", -1.0))
    assert got[0][:2] == ("1.50 KB", "1.5K") and got[1][:2] == ("12.00 B", "12B") and got[2][0] == "9.09 TB"
    assert [r[2] for r in got] == [1536.0, 12.0, 1e13, -1.0, -1.0, -1.0]
    assert [r[0] for r in values(spark, ["Yes", " 1", "off", "x"], X.boolean("s"))] == [True, True, False, None]
    assert [r[0] for r in values(spark, ["a/x__123.csv", "x__9", "x.csv", "x__7.docids"], X.doc_id_of("s"))] == ["123", "9", None, None]
    assert [r[0] for r in values(spark, ["http://h/a/b.zip?x=1&y", "http://h"], X.file_name_of_url("s"))] == ["b.zip", None]
    assert [r[0] for r in values(spark, ["http://h/?b=1&a=2&b=3", "http://h/"], X.query_keys("s"))] == [["a", "b"], []]
    assert [r[0] for r in values(spark, ["x.CSV?y", "x.html"], X.file_link("s"))] == [True, False]
    assert [r[0] for r in values(spark, ["[Errno 8] nodename nor servname provided", "timeout", None], X.name_failure("s"))] == [True, False, False]
    lines = values(spark, ["plain", 'has "quote" here', None], X.event_line(F.lit("EV"), F.create_map(F.lit("k"), F.col("s"))))
    assert [r[0] for r in lines] == ["EV k=plain", r'EV k="has \"quote\" here"', "EV k=null"]
    js = values(spark, ['{"docLookupId": "7", "_links": {"endpoint": {"href": "u"}}}', "{bad"], X.json_doc_id("s"), X.json_link("s", "endpoint"))
    assert js == [("7", "u"), (None, None)]


def test_names():
    assert X.snake_case("SettlementPointName") == "settlement_point_name" and X.snake_case("HOUR_ENDING") == "hour_ending" and X.snake_case("LMP (USD)") == "lmp_usd"
    assert X.posting_column(["a", "postdatetime"]) == "postdatetime" and X.posting_column(["PostingTime", "postDateTime"]) == "postDateTime" and X.posting_column(["x"]) is None
    assert X.choose_column(["operday", "Date"], ["OperDay", "Date"]) == "Date" and X.choose_column(["operday"], ["OperDay"]) == "operday"
    assert X.clean_header([" a ", "", "postDateTime", "a", "b"]) == ["a", "b"]


def test_profiles():
    assert registry.resolve_ids() == registry.PROFILES["core"]
    assert registry.resolve_ids(["market"], ["np6-348-cd", " NP6-905-CD "]) == [*registry.PROFILES["market"], "NP3-565-CD"]
    assert registry.resolve_ids([], ["X-1"]) == ["X-1"]
    with pytest.raises(ValueError):
        registry.resolve_ids(["nope"])


def test_event_text_and_csv_cells_come_back(spark):
    values = ['two words', 'say "hi" \\ there', "a=b c=d", "line\nbreak\ttab", "plain", "", None]
    df = spark.createDataFrame([(i, {"k": v, "z": "1"}) for i, v in enumerate(values)], "i int, f map<string,string>")
    back = df.select("i", X.event_fields(X.event_line(F.lit("E"), "f")).alias("f")).collect()
    assert {r.i: r.f["k"] for r in back} == {i: "null" if v is None else v for i, v in enumerate(values)}
    one = spark.createDataFrame([('E a=1 b="x" a="2 3" c=',)], "line string").select(X.event_fields("line").alias("f")).first().f
    assert one == {"a": "2 3", "b": "x", "c": ""}
    lines = ['1,"x, y",3', '"a ""q""",, z ', "", '"open,b', '"a"b,c']
    cells = [r.c for r in spark.createDataFrame([(x,) for x in lines], "line string").select(X.csv_cells("line").alias("c")).collect()]
    assert cells == [["1", "x, y", "3"], ['a "q"', "", "z"], [""], ['"open', "b"], ['"a"b', "c"]]


def test_link_suffixes(spark):
    links = ["x.TGZ", "x.tar?y=1", "x.gz#z", "x.xls", "x.pdf", "x.xml", "x.txt", "x"]
    got = spark.createDataFrame([(x,) for x in links], "l string").select(X.file_link("l").alias("f")).collect()
    assert [r.f for r in got] == [True] * 4 + [False] * 4


def test_table_functions_in_sql(spark):
    import io
    import zipfile

    from gridmill.functions import tables

    tables.register(spark)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.csv", "caf\u00e9".encode("latin-1"))
    docs = [("d", 'a, b\n1,"x\ny"\n\n2\n', bytearray(held.getvalue()), '<A HREF="/p?q=1">x</a> <a name="n">', "http://h/d/"), ("json", ' {"a": 1}', bytearray(b"no"), None, None), ("none", None, None, "<a href='r'>", None)]
    spark.createDataFrame(docs, "i string, text string, zip binary, html string, url string").createOrReplaceTempView("table_function_docs")
    sql = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert sql("SELECT d.i, r.* FROM table_function_docs d, LATERAL csv_rows(d.text, 'b,c,a') r") == [("d", 0, "x\ny", None, "1"), ("d", 1, None, None, "2")]
    assert sql("SELECT d.i, r.* FROM table_function_docs d, LATERAL zip_members(d.zip) r") == [("d", "a.csv", "caf\u00e9")]
    assert sorted(sql("SELECT d.i, r.* FROM table_function_docs d, LATERAL page_links(d.html, d.url) r")) == [("d", 0, "http://h/p?q=1"), ("none", 0, "r")]
    assert spark.sql("SELECT * FROM csv_rows('x,y', 'y,x')").columns == ["row_idx", "y", "x"]


def test_sizes_have_a_largest_unit_and_halves_go_to_the_even(spark):
    n = ["1073741824", "1152", "1664", str(131072 * 131072 * 64 + 131072), "1280"]
    got = values(spark, n, X.human_bytes(X.number("s"), "MB"), X.short_bytes(X.number("s"), "M"), X.human_bytes(X.number("s")))
    assert [r[0] for r in got] == ["1024.00 MB", "1.12 KB", "1.62 KB", "1048576.12 MB", "1.25 KB"]
    assert [r[1] for r in got] == ["1024.0M", "1.1K", "1.6K", "1048576.1M", "1.2K"]
    assert [r[2] for r in got] == ["1.00 GB", "1.12 KB", "1.62 KB", "1.00 TB", "1.25 KB"]


def test_human_bytes_equals_its_sql_on_large_sizes(spark, tmp_path):
    ids = [*range(120, 260), *range(4090, 4100), 131072, 262144, 393216]
    spark.createDataFrame([(i,) for i in ids], "page_id long").coalesce(1).write.parquet(str(tmp_path / "pages"))
    sql = C.ORACLES["human_bytes"].replace("FROM pages", f"FROM '{tmp_path}/pages/*.parquet'")
    spark.read.parquet(str(tmp_path / "pages")).write.parquet(str(tmp_path / "pages.parquet"))
    assert spark_rows(C.human_bytes(spark, str(tmp_path))) == sql_rows(sql, str(tmp_path / "none"))


def test_event_values_are_those_of_the_map(spark):
    lines = ['EV date=1 note="a \\"b\\" date=2\\n files=0" files=3', "EV date=1 date=2 dated=7", 'EV date="open', "EV xdate=1", "EV date=", None, 'EV date="\\u00e9"']
    got = values(spark, lines, X.event_value(X.event_parts("s"), "date"), F.try_element_at(X.event_fields("s"), F.lit("date")))
    assert [r[0] for r in got] == [r[1] for r in got] == ["1", "2", '"open', None, "", None, "é"]
