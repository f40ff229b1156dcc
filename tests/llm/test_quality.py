import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from gridmill.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = quality.query(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got.score.between(0, 1).all()
    test = got.merge(labels, on="doc_id")
    test = test[test.held_out]
    assert len(test) > 500 and (test.predicted == test.quality).mean() > 0.98
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()


def test_statistics_of_odd_texts():
    x = quality.statistics(pa.array([None, "", " \n ", "one", "word " * 600000, "a\x00b", "ü🙂"]))
    assert x.shape == (7, len(quality.NAMES)) and np.isfinite(x).all()
    assert (x[0] == x[1]).all()
    assert (quality.statistics(pa.array(["one two", "x\ny", "three"]))[2] == quality.statistics(pa.array(["three"]))[0]).all()


def test_missing_classes_and_nulls(spark):
    docs = spark.createDataFrame([(1, "some text here", 5.0), (2, None, None), (None, "more", 1.0), (1, "some text here", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 0), (3, 7, 0)], "doc_id long, quality int, held_out int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 4 and {r.score for r in got} == {1.0}
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_density_matches_the_formula():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    xs = [rng.normal(c, 1 + c, (200, d)) for c in (0, 1)]
    m = quality.Discriminant(np.array([200.0, 200.0]), np.array([x.sum(0) for x in xs]), np.array([x.T @ x for x in xs]))
    x = rng.normal(size=(5, d))
    log = []
    for c in (0, 1):
        cov = m.factor[c] @ m.factor[c].T
        diff = x - m.mean[c]
        log.append(np.log(0.5) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(log[0] - log[1])))


def plain_statistics(text):
    """NAMES of one text, from its words as strings."""
    text = text or ""
    raw = text.encode()
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0d]+", raw)]
    size = [len(w) for w in words]
    n, mean = len(words), sum(size) / max(1, len(words))
    spread = max(0.0, sum(x * x for x in size) / max(1, n) - mean**2) ** 0.5
    share = [(sum(b in set(c) for b in raw) / max(1, len(raw))) ** 0.5 for c in quality.CLASSES.values()]
    own = [0.0] * 5
    if words:
        five = [tuple(words[i : i + 5]) for i in range(n - 4)]
        lines = [tuple(re.findall(rb"[^\x20\x09-\x0d]+", line)) for line in raw.lower().split(b"\n")]
        lines = [line for line in lines if line]
        own = [len(set(words)) / n, (max(Counter(words).values()) / n) ** 0.5, (1 - len(set(five)) / len(five)) ** 0.5 if five else 0.0, (1 - len(set(lines)) / len(lines)) ** 0.5, np.log1p(len(raw) / (raw.count(b"\n") + 1))]
    return [np.log1p(len(raw)), np.log1p(n), np.log1p(mean), np.log1p(spread), *share, sum(x <= 3 for x in size) / max(1, n), *own]


def test_against_brute_force(spark):
    """Statistics, class moments and scores of a small table, all again in plain Python."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400).collect()]
    rows += [(90001, None), (90002, ""), (90003, "a\n\n b\na"), (90004, "Üx é 🙂 one ONE")]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    x = np.array([plain_statistics(t) for _, t in rows])
    assert np.allclose(quality.statistics(pa.array([t for _, t in rows])), x, atol=1e-9)
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows]
    label = dict(labels)
    mean, cov, n = [], [], []
    for c in (0, 1):
        mine = x[[label.get(i) == c and not h for (i, _), h in zip(rows, held, strict=True)]]
        assert len(mine) > 5
        n.append(len(mine))
        mean.append(mine.mean(axis=0))
        cov.append(np.cov(mine.T, bias=True))
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled) + 1e-4) + 1e-6 * np.eye(len(pooled))
    log = []
    for c in (0, 1):
        s, diff = 0.8 * cov[c] + 0.2 * pooled, x - mean[c]
        log.append(np.log(n[c] / sum(n)) - 0.5 * (np.linalg.slogdet(s)[1] + np.einsum("ij,ij->i", diff @ np.linalg.inv(s), diff)))
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(rows)
    for (i, _), h, w in zip(rows, held, want, strict=True):
        assert got[i].held_out == h and abs(got[i].score - w) < 1e-4 and got[i].predicted == int(got[i].score >= 0.7)
