import json

import pytest
from pyspark.sql import functions as F

from gridmill import jobs
from gridmill.plans import backfill as B
from gridmill.sources import sinks


def test_backfill(spark):
    rows = [(1, 0, "", "a"), (1, 1, "x", "b"), (1, 2, None, "c"), (2, 0, "", "p"), (2, 1, "", "q"), (2, 2, "", "p")]
    months = spark.createDataFrame(rows, "month int, row_idx int, posting string, v string")
    src = [(1, "d1", 0, 0, "a"), (1, "d1", 0, 1, "b"), (1, "d2", 1, 0, "c"), (2, "d3", 0, 0, "p"), (2, "d4", 1, 0, "p")]
    sources = spark.createDataFrame(src, "month int, doc_id string, doc_position int, row_idx int, v string")
    first = spark.createDataFrame([("d1", "t1", 0), ("d2", "", 0), ("d3", "t3", 0)], "doc_id string, posting string, row_idx int")
    second = spark.createDataFrame([("d1", "no", 0), ("d2", "t2", 0), ("d4", "t4", 0)], "doc_id string, posting string, row_idx int")
    got = sorted((r.month, r.row_idx, r.posting) for r in B.add_missing(months, sources, [first, second], ["v"]).collect())
    assert got == [(1, 0, "t1"), (1, 1, "x"), (1, 2, "t2"), (2, 0, "t4"), (2, 1, ""), (2, 2, "t3")]
    over = sorted((r.month, r.row_idx, r.posting) for r in B.add_missing(months, sources, [first, second], ["v"], overwrite=True).collect())
    assert over == [(1, 0, "t1"), (1, 1, "t1"), (1, 2, "t2"), (2, 0, ""), (2, 1, ""), (2, 2, "")]
    new = B.rebuild(sources, [spark.createDataFrame([("d1", "2025-01-02T00:00:00", 0), ("d2", "2025-01-01T00:00:00", 0)], "doc_id string, posting string, row_idx int")], ["v"])
    assert [(r.row_idx, r.v) for r in new.where("month = 1").orderBy("row_idx").collect()] == [(0, "c"), (1, "a"), (2, "b")]
    assert B.verify(months.where("month = 1"), new.where("month = 1"), ["v"]).count() == 0 and B.verify(months, new, ["v"]).count() == 1
    assert {r.month: r.aligned for r in B.month_status(months, sources).collect()} == {1: True, 2: False}


def test_jobs(spark, tmp_path, capsys):
    root, d = tmp_path / "raw", "NP6-346-CD"
    for m, rows in ((11, ["2025-11-02T00:00:00,11/01/2025,02:00", ",11/01/2025,01:00"]), (12, ["bad,12/01/2025,01:00"])):
        folder = root / d / "2025" / f"{m}"
        folder.mkdir(parents=True)
        (folder / f"{d}_2025{m}.csv").write_text("postDateTime,OperDay,HourEnding\n" + "\n".join(rows) + "\n")
    assert [r.posting for r in jobs.audit(spark, str(root), [d]).collect()] == ["bad"]
    assert tuple(jobs.coverage(spark, str(root), d).first()) == (d, 3, 2, 1)
    size = {r.dataset_id: r.estimated_bytes for r in jobs.size(spark, str(root), "2025-12-31").collect()}
    assert size[d] > 0 and size["TOTAL"] == size[d]
    jobs.sort(spark, str(root), str(tmp_path / "sorted"), d)
    assert spark.read.parquet(str(tmp_path / "sorted")).count() == 3
    (tmp_path / "run.log").write_text("".join(f"DAY_COMPLETE dataset={d} date=2025-01-0{i} files=1 completed_at=2025-01-01T00:00:{i}0Z\n" for i in range(1, 6)))
    hours = {r.dataset_id: (r.basis, r.seconds_per_day) for r in jobs.time(spark, str(tmp_path / "run.log"), str(root), "2025-12-31").collect()}
    assert hours[d] == ("log", 10.0) and hours["NP6-905-CD"] == ("mean", 10.0)
    state = tmp_path / "state"
    state.mkdir()
    (state / "A.json").write_text(json.dumps({"status": "done"}))
    jobs.main(["status", "--state", str(state)])
    jobs.main(["datasets", "--profile", "market", "--dataset", "X"])
    out = capsys.readouterr().out
    assert "| A | done |" in out and "| NP6-788-CD | LMPs" in out


def _month(root, d, month, header, rows, docs, markers=None, sort=None):
    folder = root / d / month[:4] / month[4:]
    folder.mkdir(parents=True)
    (folder / f"{d}_{month}.csv").write_text("\n".join([header, *rows]) + "\n")
    if markers is not False:
        (folder / f"{d}_{month}.csv.docids").write_text("\n".join(markers or sorted(docs)) + "\n")
    if sort:
        (folder / f"{d}_{month}.csv.sortcache.json").write_text(json.dumps({"classification": sort}))
    for doc_id, lines in docs.items():
        (folder / f"report__{doc_id}.csv").write_text("\n".join(lines) + "\n")


def test_backfill_command(spark, tmp_path, capsys):
    root, d = tmp_path / "raw", "NP6-346-CD"
    # November has just its documents' rows, December lacks one.
    _month(root, d, "202511", "postDateTime,OperDay,Note", [",11/01/2025,\"a, b\"", "2025-11-09T00:00:00,11/02/2025,c"], {"1": ["OperDay,Note", "11/01/2025,\"a, b\""], "2": ["OperDay,Note", "11/02/2025,c"]})
    _month(root, d, "202512", "OperDay,PostingTime,Note", ["12/02/2025,,q"], {"3": ["OperDay,Note", "12/01/2025,p", "12/02/2025,q"]})
    (tmp_path / "manifest.json").write_text(json.dumps([{"dataset_id": d, "doc_id": "1", "postDateTime": "2025-11-02T00:00:00"}, {"dataset_id": "other", "doc_id": "2", "postDateTime": "x"}], indent=1))
    (tmp_path / "cache.jsonl").write_text('{"page": 1, "doc": {"docId": "3", "postDatetime": "2025-12-03T00:00:00"}}\n{bad\n')
    out = str(tmp_path / "out")
    run = lambda **o: {r.month: (r.rows, r.filled, r.malformed) for r in jobs.backfill(spark, str(root), out, d, manifests=str(tmp_path / "manifest.json"), caches=str(tmp_path / "cache.jsonl"), **o).collect()}
    want = {"202511": (2, 2, 0), "202512": (1, 1, 0)}
    assert run(dry_run=True) == want and not (tmp_path / "out").exists()
    assert run() == want
    got = sorted((r.row_idx, r.posting, r.OperDay, r.Note) for r in spark.read.parquet(out).collect())
    assert got == [(0, "2025-11-02T00:00:00", "11/01/2025", "a, b"), (0, "2025-12-03T00:00:00", "12/02/2025", "q"), (1, "2025-11-09T00:00:00", "11/02/2025", "c")]
    gone = sorted(r.path.rsplit("__", 1)[1] for r in jobs.removable(spark, str(root), out, d).collect())
    assert gone == ["1.csv", "2.csv", "3.csv"]
    assert run(mode="rebuild", order="descending") == {"202511": (2, 1, 0), "202512": (2, 2, 0)}
    assert [str(r.first_day) for r in jobs.earliest(spark, str(tmp_path / "cache.jsonl")).collect()] == ["2025-12-03"]
    with pytest.raises(ValueError):
        jobs.backfill(spark, str(root), out, d)
    assert jobs.main(["earliest", "--caches", str(tmp_path / "cache.jsonl")]) == 0
    (root / d / f"{d}.docs.jsonl").write_text('{"docId": "4", "postDatetime": "soon"}\n')
    assert jobs.main(["audit", "--root", str(root), "--dataset", d]) == 1
    assert "soon" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        jobs.main(["size", "--root", "x", "--as-of", "tomorrow"])
    assert jobs.chunk_size("2048") == 2048
    with pytest.raises(Exception, match="not between"):
        jobs.chunk_size("2049")


def _cache(path, postings):
    path.write_text("".join(json.dumps({"page": 1, "doc": {"docId": k, "postDatetime": v}}) + "\n" for k, v in postings.items()))
    return str(path)


def _rows(spark, out, month):
    df = spark.read.parquet(out).where(f"concat(format_string('%04d', int(year)), format_string('%02d', int(month))) = '{month}'")
    return [(r.posting, r.v) for r in df.orderBy("row_idx").collect()]


def test_backfill_lays_documents_in_the_order_of_the_markers(spark, tmp_path):
    root, d = tmp_path / "raw", "NP6-346-CD"
    docs = {"1": ["v", "same"], "2": ["v", "same"]}
    # Only a table without a posting column that was never sorted is filled by position.
    _month(root, d, "202511", "v", ["same", "same"], docs, markers=["2", "1"], sort="skipped")
    cache = _cache(tmp_path / "c.jsonl", {"1": "2025-11-01T00:00:00", "2": "2025-11-02T00:00:00"})
    out = str(tmp_path / "out")
    jobs.backfill(spark, str(root), out, d, caches=cache, order="none")
    assert _rows(spark, out, "202511") == [("2025-11-02T00:00:00", "same"), ("2025-11-01T00:00:00", "same")]
    new = str(tmp_path / "new")
    jobs.backfill(spark, str(root), new, d, caches=cache, order="none", mode="rebuild")
    assert _rows(spark, new, "202511") == [("2025-11-02T00:00:00", "same"), ("2025-11-01T00:00:00", "same")]
    jobs.backfill(spark, str(root), new, d, caches=cache, mode="rebuild")
    assert _rows(spark, new, "202511") == [("2025-11-01T00:00:00", "same"), ("2025-11-02T00:00:00", "same")]


def test_backfill_by_fingerprint_where_order_is_not_known(spark, tmp_path):
    """With as many rows as the documents have, but sorted or with a posting column: rows are matched, not counted off."""
    root, d = tmp_path / "raw", "NP6-346-CD"
    docs = {"1": ["v", "from1"], "2": ["v", "from2"]}
    _month(root, d, "202511", "v", ["from2", "from1"], docs, markers=["1", "2"], sort="sorted")
    _month(root, d, "202512", "postDateTime,v", [",from2", ",from1"], docs, markers=["1", "2"], sort="skipped")
    cache, out = _cache(tmp_path / "c.jsonl", {"1": "2025-11-01T00:00:00", "2": "2025-11-02T00:00:00"}), str(tmp_path / "out")
    jobs.backfill(spark, str(root), out, d, caches=cache, order="none")
    for month in ("202511", "202512"):
        assert _rows(spark, out, month) == [("2025-11-02T00:00:00", "from2"), ("2025-11-01T00:00:00", "from1")]


def test_backfill_takes_state_before_manifest_before_service(spark, tmp_path):
    root, d = tmp_path / "raw", "NP6-346-CD"
    _month(root, d, "202511", "v", ["a", "b", "c", "d"], {k: ["v", k] for k in "abcd"})
    (tmp_path / "m.json").write_text(json.dumps([{"dataset_id": d, "doc_id": k, "postDateTime": f"2025-11-0{i}T00:00:00"} for k, i in (("a", 4), ("b", 5))]))
    cache = _cache(tmp_path / "c.jsonl", {"a": "2025-11-01T00:00:00", "b": ""})
    fetched = _cache(tmp_path / "f.jsonl", {"a": "2025-11-08T00:00:00", "b": "2025-11-08T00:00:00", "c": "2025-11-09T00:00:00"})
    out = str(tmp_path / "out")
    told = jobs.backfill(spark, str(root), out, d, manifests=str(tmp_path / "m.json"), caches=cache, fetched=fetched).first()
    assert _rows(spark, out, "202511") == [("2025-11-01T00:00:00", "a"), ("2025-11-05T00:00:00", "b"), ("2025-11-09T00:00:00", "c"), ("", "d")]
    assert (told.docs, told.docs_missing_posting, told.status, told.filled, told.filled_before) == (4, 1, "updated", 3, 0)


def test_months_that_cannot_be_repaired_stay(spark, tmp_path):
    root, d = tmp_path / "raw", "NP6-346-CD"
    _month(root, d, "202510", "v", ["x", "y"], {"1": ["v", "x"]}, markers=["1", "gone"])
    _month(root, d, "202511", "v", ["p"], {"3": ["v", "p"]}, markers=False)
    _month(root, d, "202512", "v", ["q"], {"4": ["v", "q", "r"]})
    # The same document id and folder of another dataset is none of this one's.
    _month(root, "NP6-905-CD", "202512", "v", ["z"], {"4": ["v", "z"]})
    cache, out = _cache(tmp_path / "c.jsonl", {"1": "2025-10-01T00:00:00", "4": "2025-12-01T00:00:00"}), str(tmp_path / "out")
    run = lambda **o: {r.month: (r.status, r.rows, r.filled, r.missing_sources) for r in jobs.backfill(spark, str(root), out, d, caches=cache, **o).collect()}
    want = {"202510": ("skipped_missing_sources", 2, 0, 1), "202511": ("missing_docids", 1, 0, 0), "202512": ("rebuilt", 2, 2, 0)}
    assert run(mode="rebuild", dry_run=True) == want | {"202512": ("planned", 2, 2, 0)}
    assert run(mode="rebuild") == want
    assert _rows(spark, out, "202510") == [("", "x"), ("", "y")] and _rows(spark, out, "202511") == [("", "p")]
    # What is missing for a rebuild doesn't keep the others' rows from being filled; those of before stay.
    assert run() == {"202510": ("updated_row_count_mismatch", 2, 1, 1), "202511": ("missing_docids", 1, 0, 0), "202512": ("updated_row_count_mismatch", 1, 1, 0)}
    assert _rows(spark, out, "202510") == [("2025-10-01T00:00:00", "x"), ("", "y")]
    assert run(mode="rebuild")["202510"] == ("skipped_missing_sources", 2, 1, 1)
    assert _rows(spark, out, "202510") == [("2025-10-01T00:00:00", "x"), ("", "y")]


def test_rows_in_posting_order(spark):
    rows = [(1, i, p) for i, p in enumerate(["2025-01-03T01:00:00", "", "2025-01-01T05:00:00", "2025-01-03T00:00:00", "2025-01-03T01:00:00"])]
    df = spark.createDataFrame(rows, "month int, row_idx long, posting string")
    got = lambda order: [r.posting[8:13] for r in B.in_posting_order(df, order).orderBy("row_idx").collect()]
    assert got("ascending") == ["01T05", "03T00", "03T01", "03T01", ""]
    assert got("descending") == ["03T01", "03T01", "03T00", "01T05", ""]


def test_exported_files_keep_their_keys_as_names(spark, tmp_path):
    lines = spark.createDataFrame([("a=b#1%", 1, "y"), ("a=b#1%", 0, "x"), ("c d", 0, "z")], "k string, i int, value string")
    for _ in range(2):
        sinks.export_files(lines, str(tmp_path / "out"), "k", ["i"], lambda k: f"{k}.txt")
    assert {p.name: p.read_text() for p in (tmp_path / "out").glob("*.txt")} == {"a=b#1%.txt": "x\ny\n", "c d.txt": "z\n"}
    with pytest.raises(ValueError, match="no key"):
        sinks.export_files(spark.createDataFrame([(None, 0, "x")], "k string, i int, value string"), str(tmp_path / "none"), "k", ["i"], str)


def test_export_writes_and_moves_files_in_tasks(spark, tmp_path, monkeypatch):
    def by_file(*_):
        raise AssertionError("files were moved by the driver")

    monkeypatch.setattr(sinks, "_export_through_hadoop", by_file)
    lines = spark.range(0, 3000, numPartitions=3).select((F.col("id") % 1000).alias("k"), "id", F.when(F.col("id") >= 1000, F.col("id")).cast("string").alias("value"))
    (tmp_path / "out/a").mkdir(parents=True)
    (tmp_path / "out/a/7.txt").write_text("old")
    (tmp_path / "out/a/.7.txt.crc").write_bytes(b"crc\0\0\0\2\0" + b"\0" * 4)  # Hadoop's checksum of another text
    sinks.export_files(lines, str(tmp_path / "out"), "k", ["id"], lambda k: f"a/{k}.txt")
    assert {p.name: p.read_text() for p in (tmp_path / "out/a").glob("*.txt")} == {f"{k}.txt": f"\n{k + 1000}\n{k + 2000}\n" for k in range(1000)}
    assert spark.read.text(str(tmp_path / "out/a/7.txt")).count() == 3 and [p.name for p in (tmp_path / "out").iterdir()] == ["a"]
    with pytest.raises(ValueError, match="several files"):
        sinks.export_files(lines, str(tmp_path / "two"), "k", ["id"], lambda k: "same")
    assert list((tmp_path / "two").iterdir()) == []


def test_a_save_that_fails_leaves_what_was_there(spark, tmp_path):
    path, shape = f"file://{tmp_path}/whole", "i long"
    assert sinks.read_whole(spark, path, shape).count() == 0
    sinks.save_whole(spark.range(3).select(F.col("id").alias("i")), path)
    old = sinks.read_whole(spark, path, shape)
    bad = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("i"))
    with pytest.raises(Exception, match="lost"):
        sinks.save_whole(bad, path)
    assert sinks.read_whole(spark, path, shape).count() == 3
    sinks.save_whole(spark.range(5).select(F.col("id").alias("i")), path)
    assert sinks.read_whole(spark, path, shape).count() == 5 and old.count() == 3  # the version before can still be read
    for _ in range(2):
        sinks.save_whole(sinks.read_whole(spark, path, shape), path)
    assert sum(p.name.startswith("v-") for p in (tmp_path / "whole").iterdir()) == 2


def test_clearing_of_documents(spark, tmp_path):
    root, d, out = tmp_path / "raw", "NP6-346-CD", str(tmp_path / "out")
    _month(root, d, "202511", "v", ["a", "b"], {"1": ["v", "a"], "2": ["v", "b"]})
    _month(root, d, "202512", "v", ["c"], {"3": ["v", "c"]})
    cache = _cache(tmp_path / "c.jsonl", {"1": "2025-11-01T00:00:00", "2": "2025-11-02T00:00:00"})
    jobs.backfill(spark, str(root), out, d, caches=cache)
    run = lambda **o: {r.done: r.files for r in jobs.clear(spark, str(root), out, d, **o).collect()}
    folder, kept = root / d / "2025/11", tmp_path / "archive" / d / "2025/11"
    assert run(dry_run=True) == {"planned": 2} and (folder / "report__1.csv").exists()
    kept.mkdir(parents=True)
    (kept / "report__1.csv").write_text("another")
    (kept / "report__2.csv").write_text((folder / "report__2.csv").read_text())
    assert run(archive=str(tmp_path / "archive")) == {"moved": 2}
    assert sorted(p.name for p in kept.iterdir() if not p.name.startswith(".")) == ["report__1.csv", "report__1.csv.dup1", "report__2.csv"]
    assert not (folder / "report__1.csv").exists() and (root / d / "2025/12/report__3.csv").exists()
    assert run() == {}


def test_options_from_a_config(tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps({"as-of": "2025-01-01", "time": {"logs": "x"}, "dataset": ["NP3-233-CD"], "none": None}))
    assert jobs.config(str(tmp_path / "c.json")) == {"as_of": "2025-01-01", "time_logs": "x", "dataset": ["NP3-233-CD"]}
    assert jobs.main(["datasets", "--config", str(tmp_path / "c.json"), "--dataset", "NP4-523-CD"]) == 0
    out = capsys.readouterr().out
    assert out.index("NP3-233-CD") < out.index("NP4-523-CD")
    with pytest.raises(SystemExit):
        jobs.main(["size", "--config", str(tmp_path / "c.json")])
    with pytest.raises(ValueError):
        jobs.config(str(tmp_path / "c.txt")) if (tmp_path / "c.txt").write_text("") == 0 else None


def test_large_files_are_sorted_by_ranges_and_put_together(spark, tmp_path):
    lines = spark.range(0, 20000, numPartitions=3).select(F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("k"), (20000 - F.col("id")).alias("i"), F.col("id").cast("string").alias("value"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges of so few rows
    try:
        for _ in range(2):
            sinks.export_files(lines, str(tmp_path / "out"), "k", ["i"], lambda k: f"{k}/{k}.txt", large=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {k: [str(i) for i in range(19999, -1, -1) if (i % 5 == 0) == (k == "b")] for k in "ab"}
    assert {k: (tmp_path / f"out/{k}/{k}.txt").read_text().split() for k in "ab"} == want
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b"]
    with pytest.raises(ValueError, match="several files"):
        sinks.export_files(lines, str(tmp_path / "two"), "k", ["i"], lambda k: "same", large=True)


def test_a_month_is_filled_by_many_tasks(spark, monkeypatch):
    """Rows meet documents by stretches of their numbers, and documents' row numbers are not spread by one task a month."""
    from gridmill.operators import joins as J

    monkeypatch.setattr(J, "STRETCH", 7)
    docs = spark.createDataFrame([("m", f"d{i}", i * 10, i * 10 + (10 if i % 3 else 9)) for i in range(20)] + [("m", "none", 50, 50), ("n", "x", 3, 40)], "month string, doc_id string, row_start long, row_end long")
    rows = spark.range(0, 420).select(F.when(F.col("id") < 210, "m").otherwise("n").alias("month"), (F.col("id") % 210).alias("row_idx"))
    found = J.fill_by_position(rows, docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(month" in plan and "__s" in plan
    for r in found.collect():
        want = (f"d{r.row_idx // 10}" if r.row_idx < 200 and (r.row_idx % 10 < 9 or r.row_idx // 10 % 3) else None) if r.month == "m" else ("x" if 3 <= r.row_idx < 40 else None)
        assert r.doc_id == want, r


def test_frequent_fingerprints_are_numbered_as_rare_ones(spark, monkeypatch):
    from gridmill.operators import joins as J

    sources = spark.createDataFrame([("f" if i % 4 else f"r{i % 8}", i, f"p{i}") for i in range(200)], "v string, row_idx int, posting string")
    targets = spark.createDataFrame([("f" if i % 3 else f"r{i % 8}", i, "kept" if i % 17 == 0 else "") for i in range(150)], "v string, row_idx int, posting string")
    fill = lambda: sorted(map(tuple, J.fill_by_fingerprint(targets, sources, ["v"], bucket=F.floor(F.col("row_idx") / 16)).collect()), key=lambda r: r[1])
    one = sorted(map(tuple, J.fill_by_fingerprint(targets, sources, ["v"]).collect()), key=lambda r: r[1])
    assert fill() == one
    monkeypatch.setattr(J, "MANY", 20)
    assert fill() == one


def test_verify_tells_each_row_as_often_as_it_differs(spark):
    rows = lambda *v: spark.createDataFrame([("m", x) for x in v], "month string, v string")
    found = B.verify(rows("a", "a", "a", "b", None), rows("a", "c", "c", "b", None), ["v"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(r.v for r in found.collect()) == ["a", "a", "c", "c"]
