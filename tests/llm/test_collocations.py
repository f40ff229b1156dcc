import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridmill.llm import collocations as op
from tests.oracle import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


def brute(rows, least, keep=2000, share=80, scale=2_000_000, order=4):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, order + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    longer = Counter()
    for (lang, g), a in f.items():
        if a >= least and len(g) > 2:
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[lang, g[i : i + k]] = max(longer[lang, g[i : i + k]], a)
    out, each = [], {}
    for (lang, g), a in f.items():
        if a >= least and len(g) > 1 and not (longer[lang, g] and 100 * longer[lang, g] >= share * a):
            score, k = min((scale * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
            each.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    for lang, found in each.items():
        for i, (s, a, g, left, right) in enumerate(sorted(found)[:keep], 1):
            out.append((lang, i, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def random_texts(n, seed=5):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "été", "a\x00b", "x"]
    line = lambda: r.choice([" ", "  ", "\t"]).join(r.choice(words) for _ in range(r.randrange(9)))
    return [(r.choice(["en", "fr", None, ""]), "".join(line() + r.choice([".", ", ", "\n", "?", "\x0b", ";"]) for _ in range(r.randrange(12)))) for _ in range(n)]


def test_query_equals_sql(spark):
    assert spark_rows(op.query(spark, SF)) == sql_rows(op.ORACLE, SF)


@pytest.mark.parametrize("bits", [op.BITS, 1 << 15, 64])
def test_equals_brute_force_whatever_the_bitmap_holds(spark, bits):
    """A map of 64 bits is full and lets nearly everything through; the result is the same."""
    rows = random_texts(300)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert found(op.collocations(df, least=5, bits=bits)) == brute(rows, 5)


def test_keep_and_share(spark):
    rows = random_texts(200, 8)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(op.collocations(df, least=3, keep=4, share=30)) == brute(rows, 3, keep=4, share=30)


def test_edges(spark):
    rows = [("en", None), ("en", ""), (None, "a b" + " a b" * 40), ("de", "... ,,"), ("fr", "c d. " * 30), ("es", "c d. " * 29)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("phrase", "m", "k", "piece", "w")})
    assert found(op.collocations(df)) == brute(rows, 30)
    assert op.collocations(df.limit(0)).count() == 0


def test_long_pieces_are_cut_into_segments_that_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(op, "SEGMENT", 16)
    r = random.Random(2)
    rows = [("en", " ".join(r.choice("abcde") for _ in range(n))) for n in (1, 15, 16, 17, 18, 19, 20, 33, 500, 3000)] + [("en", "hot phrase here. ") for _ in range(3000)]
    assert found(op.collocations(spark.createDataFrame(rows, "lang string, text string"), least=10)) == brute(rows, 10)


def test_counts_past_64_bits_of_product(spark):
    """A count whose product with the scale doesn't fit in 64 bits."""
    n = 10**13
    one = spark.createDataFrame([("en", b"a", n * 2), ("en", b"b", n * 3)], "lang string, phrase binary, f long")
    two = spark.createDataFrame([("en", b"a b", n)], "lang string, phrase binary, f long")
    assert op.scored([one, two], 2_000_000, 80).first().score == 2_000_000 * n // (5 * n)
