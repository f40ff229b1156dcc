import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridmill.llm import jaccard_join as J
from gridmill.llm.components import components
from tests.llm.helpers import union_find

SF = "/root/testdata/sf0.01"


def sets_of(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", low)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    ids = [i for i, _ in rows]
    sets = [sets_of(t, k) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if ids[a] == ids[b] or (u := len(sets[a] | sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * u]
    root = union_find(len(rows), [a for a, _ in pairs], [b for _, b in pairs])
    least = {}
    for i, r in zip(ids, root, strict=True):
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(s), least[r]) for i, s, r in zip(ids, sets, root, strict=True))


def corpus():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = [None, "", " \n ", "One", "one", "one two", "ONE  two", "ü x y", "a b c", "a b c d"]
    for n in (8, 12, 20, 33, 60, 100, 101, 180, 400, 900):
        for _ in range(3):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(8):
                t = list(base)
                for _ in range(rng.choice([0, 1, 1, 2, n // 60, n // 40, n // 30])):
                    p = rng.randrange(len(t))
                    t[p : p + rng.choice([0, 1, 1])] = [word()] * rng.choice([0, 1])
                texts.append("\t".join(t))
            chain = list(base)
            for _ in range(4):
                chain[rng.randrange(n)] = word()
                texts.append(" ".join(chain).upper())
    passage = [word() for _ in range(120)]
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(5, 40))]) for _ in range(40)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True)) + [(3, texts[ids.index(3)]), (7, "another text of row seven entirely")]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 2048), (5, 80, 2048), (3, 90, 4), (1, 70, 8)])
def test_against_brute_force(spark, k, percent, block):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n string, label int")
    got = sorted(map(tuple, J.link(df, k, percent, block).collect()))
    assert got == brute(rows, k, percent)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, None), (4, "a b c d e"), (9, "a b c d e")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, J.link(df).collect()))) == sorted(map(str, [(None, 3, 4), (None, 0, None), (4, 3, 4), (9, 3, 4)]))
    assert J.link(df.limit(0)).count() == 0
    assert sorted(r.doc_id or -1 for r in J.keep_one(df.unionByName(df.where("doc_id = 4"))).collect()) == [-1, -1, 4]


def test_sql_agrees(spark):
    got = sorted(map(tuple, J.query(spark, SF).select("doc_id", "n_shingles", "component_id").collect()))
    want = duckdb.sql(J.ORACLE.replace("FROM documents", f"FROM '{SF}/documents.parquet'")).fetchall()
    assert got == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 40), st.sampled_from([70, 80, 90, 95]), st.integers(0, 99))
def test_linked_sets_share_a_bucket_and_pass_the_bound(common, more, other, percent, seed):
    h = np.random.default_rng(seed).integers(0, 2**64, common + more + other, dtype=np.uint64)
    a, b = np.unique(h[: common + more]), np.unique(np.concatenate([h[:common], h[common + more :]]))
    both, every = len(np.intersect1d(a, b)), len(np.union1d(a, b))
    if 100 * both >= percent * every and len(np.setxor1d(a, b)):
        assert set(J.bucket_keys(a, percent).tolist()) & set(J.bucket_keys(b, percent).tolist())
        f = J.folded([J.bitmap(a), J.bitmap(b)])
        assert np.bitwise_count(f[0] ^ f[1]).sum() <= J.most_different(np.array(len(a)), np.array(len(b)), percent)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(5, 5)]
    root = union_find(400, *zip(*edges, strict=True))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == root[i] for i in range(400))


def test_shared_shingles_are_counted_exactly(monkeypatch):
    monkeypatch.setattr(J, "BITS_AT_ONCE", 512)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 900, rng.integers(1, 400))).astype(np.uint64) for _ in range(30)]
    p, q = np.triu_indices(30, 1)
    assert J.Common(sets).of(p, q).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(p, q, strict=True)]
    assert J.Common([sets[0]]).of(np.array([0]), np.array([0])).tolist() == [0]


@pytest.mark.parametrize("n", [9, 60])
def test_a_large_group_of_near_copies_gives_no_more_rows_than_it_has(spark, monkeypatch, n):
    """Every text is some edits away from one that is not there: few pairs link, though all meet in buckets."""
    rng = random.Random(n)
    base = [f"w{i}" for i in range(n)]
    rows = []
    for i in range(1200):
        t = list(base)
        for _ in range(rng.randrange(1, n // 6 + 1)):
            t[rng.randrange(n)] = f"x{rng.randrange(100000)}"
        rows.append((i, " ".join(t)))
    handed = []
    real = J.tile_links

    def counted(dealt, sets, percent):
        found = real(dealt, sets, percent)
        handed.append((dealt.count(), found.count()))
        return found

    monkeypatch.setattr(J, "tile_links", counted)
    got = sorted(map(tuple, J.link(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 256).collect()))
    assert got == brute(rows, 5, 80)
    assert (handed or n == 9) and all(out < came for came, out in handed)


def test_keep_one_judges_texts_of_a_repeated_id_by_themselves(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (3, a + " more"), (3, b), (3, b), (7, b + " more"), (9, "other words here"), (9, None), (None, a)]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, a), (3, b), (9, "other words here"), (9, None), (None, a)]))
