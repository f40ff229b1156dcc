import hashlib
import math
import random
import re
import time
from collections import Counter

import duckdb
import pandas as pd

from gridmill.llm import secret_scan as S

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    more, covered = [], {p for a, _, b in base for p in range(a, b)}
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        value = m[0]
        if re.search(S.ALLOW, value) or all(re.search(S.WORD, word) for word in re.split(S.SEPARATOR, value)):
            continue
        bits = next(least for shape, least in S.CLASSES if re.search(shape, value))
        for word in S.PLACEHOLDERS:
            value = re.sub(f"(?i){word}", "." * len(word), value)
        high = []
        for i in range(len(value) - S.WINDOW + 1):
            w = value[i : i + S.WINDOW]
            if "." not in w and -sum(n / S.WINDOW * math.log2(n / S.WINDOW) for n in Counter(w).values()) >= bits - 1e-9:
                high.append(i)
        if high:
            left = set(range(m.start() + high[0], m.start() + high[-1] + S.WINDOW)) - covered
            ends = sorted(p + 1 for p in left if p + 1 not in left)
            more += [(a, 3, b) for a, b in zip(sorted(p for p in left if p - 1 not in left), ends, strict=True)]
    text_of = lambda spans: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*(sum(k == j for _, k, _ in base) for j in range(3)), hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(base + more))


def texts():
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    key = lambda n, a=alphabet: "".join(rng.choice(a) for _ in range(n))
    out = [None, "", "a", "🙂é " * 3 + "token=" + key(15), "passſword=abcdefghijklmnop", "secret: token: abcdefghijklmnop", "token=token=abcdefghijklmnop", "API_KEY : 'x' apikey=\"" + key(12) + '"', "password==" + key(11), "AKIAAKIA" + key(10, "ABC"), "AKIA" + key(13, "XYZ9"), "a" * 200000, "deadbeef" * 5000, "\n".join(["password=" + key(14)] * 300), key(3000), "id 123e4567-e89b-12d3-a456-426614174000", "some/path/to/a/very/long/file", "YOUR_API_TOKEN_PLACEHOLDER_1", "snake_case_name_that_is_long_enough", "Some/Path-2024/of_words/andCamelCase", "A-" * 95 + "bC1", key(40) + "Example" + key(40), key(30) + "yourXXXX" + key(12), "password: " + key(13) + "/" + key(30) + "deadbeef01234567" + key(25)]
    out += [key(24, a) for a in ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", alphabet[:62]) for _ in range(4)]
    for _ in range(60):
        bits = [rng.choice(["token=", "Secret : ", "passwd:'", "AKIA", key(rng.randrange(40)), key(rng.randrange(30), "0123456789abcdef"), "word ", "é🙂", "\n", " = ", '"']) for _ in range(14)]
        out.append("".join(bits))
    return out


def test_against_brute_force_and_sql(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(None, "token=abcdefghijkl1", None, None), (0, None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, base string")
    got = S.scan(df).toPandas()
    assert len(got) == len(rows)
    by = {r[0]: r[1] for r in rows}
    for r in got.itertuples():
        want = brute(by.get(None if pd.isna(r.doc_id) else int(r.doc_id)))
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == want, by.get(r.doc_id)
    documents = df.toPandas()  # noqa: F841  DuckDB reads it by name
    sql = duckdb.sql(S.ORACLE).df()
    assert sorted(map(str, got.fillna(-1).values.tolist())) == sorted(map(str, sql[got.columns].astype({"doc_id": "float"}).fillna(-1).values.tolist()))
    assert S.scan(df.limit(0)).count() == 0


def test_redaction(spark):
    rows = [(1, "a token=abcdefghijkl1 b", 23, "keep"), (2, None, None, None), (3, "clean", 99, "row"), (4, 'é password="b7db7aa4a5fcc78305" end', 35, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, base string")
    got = {r.doc_id: r for r in S.redact(df).collect()}
    assert S.redact(df).columns == df.columns
    assert (got[1].text, got[1].n_chars, got[1].base) == ("a [SECRET] b", 12, "keep")
    assert got[2].text is None and (got[3].text, got[3].n_chars) == ("clean", 99)
    assert got[4].text == 'é [SECRET]" end'


def test_plan_has_no_python(spark):
    plan = S.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_keys_of_every_alphabet_are_found(spark):
    rng = random.Random(5)
    alphabets = {"hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base62": S.ALPHABET[:62], "base64": S.ALPHABET[:64]}
    rows = [(i, name, "".join(rng.choice(a) for _ in range(24))) for name, a in alphabets.items() for i in range(200)]
    share = {r.name: r.n for r in S.with_spans(spark.createDataFrame(rows, "i long, name string, text string")).where("size(spans) > 0").groupBy("name").agg(S.F.count("*").alias("n")).collect()}
    assert all(share[name] >= 190 for name in alphabets), share


def test_very_long_keys_take_time_by_their_length(spark):
    rng = random.Random(6)
    keys = ["".join(rng.choice(S.ALPHABET) for _ in range(n)) for n in (100_000, 300_000)]
    began = time.perf_counter()
    got = {r.doc_id: r.spans for r in S.scan(spark.createDataFrame(list(enumerate(keys)), "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 60
    for i, k in enumerate(keys):
        spans = [x.split(":") for x in got[i].split(",")]
        assert min(int(a) for _, a, _ in spans) < 40 and max(int(b) for _, _, b in spans) > len(k) - 40


def test_length_alone_decides_nothing(spark):
    """A path or a name of plain words has no span, whatever its length; nor does a very long one overflow."""
    names = [("some/Path_of/words-12/" * 40)[:n] for n in (199, 200, 201, 400)] + ["Abcde" * 20_000, "word_" * 50_000, "A" * 100_000, "ab/" * 100_000]
    assert all(r.spans == "" for r in S.scan(spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")).collect())
    key = "kV9x+2Lq8/Zt4Wm1Rb7Y"
    paths = [("path/of/" * 60)[:n] + key for n in (176, 184, 600)]
    assert all(r.spans for r in S.scan(spark.createDataFrame(list(enumerate(paths)), "doc_id long, text string")).collect())


def test_very_many_matches_take_time_by_their_number(spark):
    rng = random.Random(7)
    hexes = lambda n: " ".join("%016x" % rng.getrandbits(64) for _ in range(n))
    small = spark.createDataFrame([(0, hexes(100))], "doc_id long, text string")
    S.scan(small).collect(), S.redact(small).collect()
    text = "é " + hexes(100_000)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    row = S.scan(df).first()
    print("scan", time.perf_counter() - began)
    assert time.perf_counter() - began < 10
    assert row.n_hex == 100_000 and tuple(row)[1:] == brute(text)
    began = time.perf_counter()
    assert S.redact(df).first().text == "é " + " ".join(["[SECRET]"] * 100_000)
    print("redact", time.perf_counter() - began)
    assert time.perf_counter() - began < 10
