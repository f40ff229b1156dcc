import datetime
import itertools
import json
import random

from gridmill.operators import windows as W
from gridmill.sources import archive
from gridmill.streaming import consolidate as ST


def _put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def _run(spark, tmp_path, per_batch=1000):
    stream = ST.document_stream(spark, str(tmp_path / "in"), "doc_id string, posting string, v int", per_batch)
    query = ST.consolidate(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    return sorted((r.doc_id, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_a_document_in_several_files_and_files_that_come_again(spark, tmp_path):
    row = lambda d, v, p="2025-01-01T00:00:00": {"doc_id": d, "posting": p, "v": v}
    _put(tmp_path / "in", "a.json", [row("A", 1), row("B", 1), row("C", 1), row("C", 1)])
    _put(tmp_path / "in", "b.json", [row("B", 1)])  # B twice in one batch
    assert _run(spark, tmp_path) == [("A", 1), ("B", 1), ("C", 1), ("C", 1)]
    _put(tmp_path / "in", "c.json", [row("A", 2), row("C", 1)])  # A's other part, C again
    assert _run(spark, tmp_path) == [("A", 1), ("A", 2), ("B", 1), ("C", 1), ("C", 1)]
    _put(tmp_path / "in", "d.json", [row("C", 1), row("C", 1), row("C", 1), row("D", None, None)])
    _put(tmp_path / "in", "e.json", [row("A", 2), row("A", 3)])
    want = [("A", 1), ("A", 2), ("A", 3), ("B", 1), ("C", 1), ("C", 1), ("C", 1)]
    stream = ST.document_stream(spark, str(tmp_path / "in"), "doc_id string, posting string, v int", 1)
    ST.consolidate(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id, r.v) for r in rows if r.doc_id != "D") == want
    assert [(r.v, r.year) for r in rows if r.doc_id == "D"] == [(None, ST.UNDATED)]


def test_runs_of_a_stream_are_those_of_the_table(spark, tmp_path):
    start = datetime.datetime(2025, 1, 1)
    values = ["a", "a", "b", None, None, "b", "b", "b", "a", "c", "c", "a"]
    rows = [("k1", i, v) for i, v in enumerate(values)] + [("k2", i, "x") for i in range(12)]
    at = lambda i: (start + datetime.timedelta(minutes=i)).isoformat()
    folder = tmp_path / "in"
    # Three batches; within the allowed lateness rows come out of order.
    for n, part in enumerate(([0, 1, 3, 2], [5, 4, 7, 6], [8, 11, 9, 10])):
        _put(folder, f"{n}.json", [{"k": k, "ts": at(i), "v": v} for k, i, v in rows if i in part])
        stream = spark.readStream.schema("k string, ts timestamp, v string").json(str(folder))
        with ST.rocks(spark):
            q = ST.runs(stream, "k", "ts", "v", "10 minutes", 3600).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    _put(folder, "end.json", [{"k": "end", "ts": at(100_000), "v": None}])  # the watermark passes all that was
    for _ in range(2):
        with ST.rocks(spark):
            q = ST.runs(spark.readStream.schema("k string, ts timestamp, v string").json(str(folder)), "k", "ts", "v", "10 minutes", 3600).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.key, r.island, r.value, r.n_rows) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.key != "end")
    table = spark.createDataFrame(rows, "k string, i int, v string")
    want = sorted((r.k, r.island, r.v, r.n_rows) for r in W.islands(table, "v", ["k"], ["i"]).collect())
    assert got == want


def _runs(spark, tmp_path, shape="k long, ts timestamp, v string", late="10 minutes", idle=3600):
    with ST.rocks(spark):
        stream = spark.readStream.schema(shape).json(str(tmp_path / "in"))
        q = ST.runs(stream, "k", "ts", "v", late, idle).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_state_of_runs_does_not_grow_with_the_keys(spark, tmp_path):
    start, chance = datetime.datetime(2025, 1, 1), random.Random(8)
    keys = [None, *(2**60 + i for i in range(2999))]
    rows = [(k, i, chance.choice(["a", "b", None])) for k in keys for i in sorted(chance.choices(range(60), k=6))]
    at = lambda i: (start + datetime.timedelta(minutes=i)).isoformat()
    for n, (low, high) in enumerate(((0, 25), (25, 45), (45, 60))):
        part = [{"k": k, "ts": at(i), "v": v} for k, i, v in rows if low <= i < high]
        chance.shuffle(part)
        _put(tmp_path / "in", f"{n}.json", part)
        held = [s["numRowsTotal"] for p in _runs(spark, tmp_path).recentProgress for s in p["stateOperators"]]
        assert held and max(held) <= 1025  # the buckets, and that of null keys
    got = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < got.count()  # some runs end before the last batch
    _put(tmp_path / "in", "end.json", [{"k": 0, "ts": at(100_000), "v": None}])
    _runs(spark, tmp_path)
    by_key = {}
    for k, i, v in rows:
        by_key.setdefault(k, []).append((i, v is not None, v or ""))
    want = []
    for k, held in by_key.items():
        runs = [(there, v, list(g)) for (there, v), g in itertools.groupby(sorted(held), key=lambda r: r[1:])]
        want += [(k, n, v if there else None, len(g), at(g[0][0]), at(g[-1][0])) for n, (there, v, g) in enumerate(runs, 1)]
    found = [(r.key, r.island, r.value, r.n_rows, r.first_at.isoformat(), r.last_at.isoformat()) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.key != 0]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_a_run_ends_when_nothing_comes_for_long(spark, tmp_path):
    start = datetime.datetime(2025, 1, 1)
    at = lambda i: (start + datetime.timedelta(minutes=i)).isoformat()
    # Key 1 comes again after its run was given, key 2 within the time, key 3 never.
    batches = [[(1, 0, "a"), (1, 1, "a"), (2, 0, "a"), (3, 0, "c")], [(2, 50, "a"), (4, 200, "x")], [(1, 300, "a"), (2, 301, "b")], [(4, 100_000, None)]]
    for n, rows in enumerate(batches):
        _put(tmp_path / "in", f"{n}.json", [{"k": k, "ts": at(i), "v": v} for k, i, v in rows])
        _runs(spark, tmp_path)
        if n == 1:
            held = spark.read.parquet(str(tmp_path / "out")).collect()
            assert sorted((r.key, r.island, r.value, r.n_rows) for r in held) == [(1, 1, "a", 2), (2, 1, "a", 2), (3, 1, "c", 1)]
    got = sorted((r.key, r.island, r.value, r.n_rows) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.key != 4)
    assert got == [(1, 1, "a", 2), (1, 2, "a", 1), (2, 1, "a", 2), (2, 2, "b", 1), (3, 1, "c", 1)]


def _pages(folder, pages):
    folder.mkdir(exist_ok=True)
    for n, docs in pages.items():
        (folder / f"page-{n}.json").write_text(json.dumps({"_meta": {}, "archives": [{"docId": d, "postDatetime": p} for d, p in docs]}))


def test_a_listing_that_stops_goes_on_where_it_was(spark, tmp_path):
    archive.register(spark)
    root = tmp_path / "pages"
    _pages(root, {n: [(f"{n}-{i}", f"2025-01-{n:02d}T00:00:0{i}") for i in range(3)] for n in range(1, 6)})

    def run():
        stream = spark.readStream.format("archive_pages").option("path", str(root)).option("maxPagesPerBatch", "2").option("position", str(tmp_path / "position")).option("pagesPerPartition", "1").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [f"{n}-{i}" for n in (1, 2) for i in range(3)]
    assert run() == [f"{n}-{i}" for n in range(1, 5) for i in range(3)]
    assert run() == [f"{n}-{i}" for n in range(1, 6) for i in range(3)]
    _pages(root, {6: [("6-0", "2025-01-06T00:00:00")], 7: []})
    assert run()[-2:] == ["5-2", "6-0"] and len(run()) == 16


def test_pages_outside_the_filter_are_not_opened(spark, tmp_path):
    archive.register(spark)
    root = tmp_path / "pages"
    _pages(root, {n: [(f"{n}", f"2025-01-{n:02d}T00:00:00")] for n in range(1, 6)})
    (root / "pages.json").write_text(json.dumps({n: [f"2025-01-{n:02d}T00:00:00"] * 2 for n in range(1, 6)}))
    for n in (1, 2, 5):
        (root / f"page-{n}.json").write_text("{broken")  # opening one of these fails
    listed = spark.read.format("archive_pages").option("path", str(root)).load()
    inside = listed.where("posting >= '2025-01-03T00:00:00' and posting < '2025-01-04T12:00:00'")
    assert [r.doc_id for r in inside.orderBy("doc_id").collect()] == ["3", "4"]
    assert listed.where("posting > '2026'").count() == 0
