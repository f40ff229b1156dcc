import hashlib
import random
import re

import duckdb
import pytest

from gridmill.llm import substring_dedup as S

SF = "/root/testdata/sf0.01"


def brute(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    least = {}
    for (doc, _), w in zip(rows, words, strict=True):
        if doc is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                least[k] = min(least.get(k, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if doc is not None and least[tuple(w[i : i + width])] < doc:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def corpus():
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(3000)}é"
    passages = [[word() for _ in range(n)] for n in (13, 14, 20, 55, 90)]
    texts = [None, "", "one", "same " * 40, "same " * 12, "same " * 13, "a b " * 30, "b a " * 30]
    for _ in range(120):
        t = [word() for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += p[a : a + rng.choice([8, 12, 13, 15, 60])] + [word() for _ in range(rng.randrange(6))]
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(t))
    texts += rng.choices(texts, k=30) + [t.replace("w1", "W1", 1) for t in rng.choices(texts[8:], k=20)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return rows + [rows[20], (rows[30][0], texts[40]), (rows[31][0], texts[9]), (None, texts[10]), (None, None)]


@pytest.mark.parametrize(("width", "anchor", "shard"), [(13, 5, 20000), (13, 5, 15), (4, 2, 3)])
def test_against_brute_force(spark, width, anchor, shard):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, anchors string, h1 int")
    got = S.dedup(df, width, anchor, shard, with_text=True).collect()
    want = brute(rows, width)
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, (r[:4] for r in want)))
    kept = {(r[0], r[3]): r[4] for r in want}
    assert all(r.kept_text == kept[r.doc_id, r.kept_sha256] for r in got if r.n_removed)
    assert S.dedup(df.limit(0)).count() == 0


def test_whole_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, S.query(spark, SF).collect()))
    assert got == sorted(r[:4] for r in brute(rows, 13))
    assert got == sorted(duckdb.sql(S.ORACLE.replace("FROM documents", f"FROM '{SF}/documents.parquet'")).fetchall())


def test_contexts_of_one_window_are_spread(spark):
    """A passage that all documents share, each with its own words around: no shard gets all contexts at its borders."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(15)), passage, *(f"z{i}x{j}" for j in range(15))])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.dedup(docs, shard_contexts=10).collect()
    assert sorted(map(tuple, got)) == sorted(r[:4] for r in brute(rows, 13))
    keys = S.summaries(S.docs_of(docs), 13, 5).select("doc_id", "anchors")
    cut = S.contexts_of(docs.join(keys, "doc_id"), 13, 5)
    contexts = cut.groupBy("anchor", "context").agg(S.F.min("doc_id").alias("least"), (S.F.min("doc_id") < S.F.max("doc_id")).alias("shared")).withColumn("digest", S.F.xxhash64("context", S.F.lit(13)))
    held = max(r["count"] for r in contexts.groupBy("anchor").count().collect())
    groups = S.dealt(contexts, 13, 10).groupBy("shard", "turn", "salt").count().collect()
    assert held >= 400 and max(r["count"] for r in groups) < 100
