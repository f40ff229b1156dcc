import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from gridmill.llm import ann, language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).toPandas().merge(docs.toPandas()[["doc_id", "lang"]], on="doc_id")
    test = got[got.held_out & (got.lang_pred != "und")]
    assert len(got) == docs.count() and len(test) > 200
    assert (test.lang_pred == test.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_texts(spark):
    rows = [(i, "the cat and the dog are here", "en", 1.0) for i in range(12)] + [(i, "der hund und die katze sind da", "de", 1.0) for i in range(12, 24)]
    odd = [(100, None, "en", None), (101, "", "de", None), (102, "12 34 !!", None, None), (None, "the dog", "en", None), (103, "und die katze " * 40000, None, None), (103, "the dog", None, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    got = language_id.identify(df).collect()
    assert len(got) == 30
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(100, "und"), (101, "und"), (102, "und"), (None, "en"), (103, "de"), (103, "en")} <= by
    assert language_id.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.where("lang is null and doc_id is not null")).collect()} == {"und"}
    kept = {r.doc_id for r in language_id.keep_identified(df).collect()}
    assert kept == {*range(24), None, 103}


def plain_bucket(gram):
    h = len(gram)
    for c, factor in zip(gram, language_id._FACTORS.tolist(), strict=False):
        h = (h ^ ord(c)) * factor % 2**32
        h ^= h >> 15
    return h % language_id.BUCKETS


def test_against_brute_force(spark):
    """Counts, probabilities and posteriors again, gram by gram."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    rows = rows[:110] + [(9001, None, "en"), (9002, "", "de"), (9003, "123 !", "fr"), (9004, "Éa", None)]
    grams = lambda t: [t[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1)]
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    langs = sorted({lang for i, t, lang in rows if t is not None and lang is not None and not held[i]})
    counts = {lang: Counter() for lang in langs}
    for i, t, lang in rows:
        if t is not None and lang is not None and not held[i]:
            counts[lang].update(plain_bucket(g) for g in grams(t.lower()))
    total = {lang: sum(counts[lang].values()) + 0.5 * language_id.BUCKETS for lang in langs}
    want = {}
    for i, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            want[i] = ("und", 0.0)
            continue
        bucket = [plain_bucket(g) for g in grams(t.lower())]
        log = {lang: sum(math.log((counts[lang][b] + 0.5) / total[lang]) for b in bucket) / 3 for lang in langs}
        best = max(langs, key=log.get)
        want[i] = (best, 1 / sum(math.exp(x - log[best]) for x in log.values()))
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.lang_pred) == (held[r.doc_id], want[r.doc_id][0])
        assert abs(r.score - want[r.doc_id][1]) < 1e-3


def test_grams_stay_inside_texts():
    texts = ["ab", "", "a", "xyz"]
    spans = [(b - a).tolist() for _, (a, b) in language_id.gram_buckets(*language_id.code_points(texts))]
    assert spans == [[2, 0, 1, 3], [1, 0, 0, 2], [0, 0, 0, 1]]


@pytest.fixture(scope="module")
def exact():
    return duckdb.sql(ann.ORACLE.replace("FROM embeddings q JOIN embeddings c", f"FROM '{SF}/embeddings.parquet' q JOIN '{SF}/embeddings.parquet' c")).df()


def test_recall_against_brute_force(spark, exact):
    got = ann.query(spark, SF).toPandas()
    assert len(got) == len(exact)
    both = got.merge(exact, on=["query_id", "vec_id"])
    assert len(both) >= 0.98 * len(exact)
    assert np.allclose(both.score_x, both.score_y, atol=1e-12)


def test_waves_agree(spark, exact):
    rows = ann.usable(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding")
    index = ann.build_index(rows, 64)
    got = ann.search(index, index.where("vec_id % 20 = 0").select("vec_id", "v"), 64, wave=64 * 7).toPandas()
    assert len(got.merge(exact, on=["query_id", "rank", "vec_id"])) >= 0.98 * len(exact)


def test_odd_vectors(spark):
    good = [(i, [float(i % 5), 1.0]) for i in range(0, 45)]
    odd = [(60, None), (80, []), (100, [0.0, 0.0]), (120, [1.0, None]), (140, [1.0, float("nan")]), (160, [1.0, float("inf")]), (180, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in good + odd], "vec_id long, embedding array<double>, score string")
    got = ann.nearest(df).toPandas()
    assert set(got.query_id) == {0, 20, 40} and (got.groupby("query_id").size() == 20).all()
    for q, rows in got.groupby("query_id"):
        v = np.array([0.0, 1.0])
        want = sorted((-float(np.dot(u, v)), i) for i, u in [*good, (20, [0.0, 1.0])] if i != q)[:20]
        assert [i for _, i in want] == rows.sort_values("rank").vec_id.tolist()
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [2, 64, 100])
def test_packed_bits_bound_the_inner_products(dim):
    rng = np.random.default_rng(dim)
    q, v = rng.normal(size=(30, dim)), rng.normal(size=(400, dim))
    turn = ann.rotation(dim)
    turned, x = q @ turn, (v / np.linalg.norm(v, axis=1, keepdims=True)) @ turn
    rounded, words = ann.Rounded(turned), ann.as_words(np.packbits(x >= 0, axis=1))
    signs = np.where(x >= 0, 1.0, -1.0)
    sums = rounded.signed_sums(slice(0, 30), words)
    # The bit counts give the rounded query's sums exactly, and rounding stays within its bound.
    near = rounded.low[:, None] + rounded.step[:, None] * np.rint((turned - rounded.low[:, None]) / rounded.step[:, None])
    assert np.allclose(sums, near @ signs.T)
    assert (np.abs(sums - turned @ signs.T) <= rounded.lost[:, None] * np.sqrt(dim) + 1e-9).all()


def test_many_waves_are_written_in_parts(spark, exact, monkeypatch):
    monkeypatch.setattr(ann, "TOGETHER", 2)
    rows = ann.usable(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding")
    index = ann.build_index(rows, 64)
    got = ann.search(index, index.where("vec_id % 20 = 0").select("vec_id", "v"), 64, wave=64 * 2).toPandas()
    assert len(got) == len(exact) and len(got.merge(exact, on=["query_id", "rank", "vec_id"])) >= 0.98 * len(exact)
