import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridmill.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def brute(item, text):
    """Least edit distance of item to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), max_size=30))
def test_bit_parallel_distance(item, text):
    assert D.best_stretch(item, text) == brute(item, text)


def edited(words, share, rng):
    words = list(words)
    for _ in range(int(share * len(words))):
        p, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[p] = f"new{rng.randrange(10**9)}"
        elif kind == 1:
            words.insert(p, f"more{rng.randrange(10**9)}")
        else:
            del words[p]
    return words


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    return [[rng.choice(vocabulary) for _ in range(n)] for n in [1, 2, 4, 6, *range(8, 60, 3)]]


def test_against_brute_force(spark, items):
    rng = random.Random(5)
    texts = []
    for share in (0, 0.1, 0.2, 0.35):
        for item in items[4:]:
            noise = [f"w{rng.randrange(300)}" for _ in range(80)]
            texts.append(noise[:40] + edited(item, share, rng) + noise[40:])
    texts += [[], ["w1"], items[0], items[1], items[2] + ["x"]]
    docs = spark.createDataFrame([(i, " ".join(t).upper() if i % 2 else ", ".join(t), "x") for i, t in enumerate(texts)] + [(None, None, None), (900, None, None)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(t), "y") for i, t in enumerate(items)] + [(90, None, None), (91, " ...", None), (92, " ".join(items[-1]), None)], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.distance for r in D.contaminated(docs, bench).collect()}
    want = {(d, i): n for d, t in enumerate(texts) for i, item in enumerate(items) if (n := brute(item, t)) <= int(D.EDITS * len(item))}
    want |= {(d, 92): n for (d, i), n in want.items() if i == len(items) - 1}
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.97 * len(want)
    assert {k for k in want if want[k] == 0} <= set(got)
    again = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench, shard_bytes=500).collect()}
    assert again == set(got)
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.contaminated(docs.limit(0), bench).count() == 0


def test_planted_items_are_found(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    held = [(r.doc_id, i.item_id) for i in bench.collect() for r in docs.where(docs.text.contains(i.text)).select("doc_id").collect()]
    got = {(r.doc_id, r.item_id) for r in D.query(spark, SF).collect()}
    assert held and set(held) <= got


def test_joint_walks_equal_single_ones():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 4, (30, 20), dtype=np.uint64)
    item = w[3].copy()
    steps = np.array([D.sample_steps(20, r, 4) for r in range(12)])
    wanted = D.walks(item, steps, np.arange(12))
    want = [bool((D.walks(x, steps, np.arange(12)) == wanted).all(axis=1).any()) for x in w]
    assert D.agreeing(w, steps, wanted, np.arange(12)).tolist() == want and want[3] and not all(want)
