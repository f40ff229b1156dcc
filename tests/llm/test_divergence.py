import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gridmill.llm import divergence as op
from tests.oracle import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


def brute(rows, least=3, scale=10**9, keep=200):
    """The contract over dictionaries, with every kept term in every group."""
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) for l, s, t in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        n[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, c in df[lang].items() if c >= least]
        sources = sorted({s for x, s, _ in docs if x == lang}, key=lambda s: s.encode())
        count = {s: [n[lang, s][t] for t in kept] for s in sources}
        p = {s: [1 + scale * (c + 1) // (sum(count[s]) + len(kept)) for c in count[s]] for s in sources}
        both = [sum(x) for x in zip(*count.values(), strict=True)]
        q = [1 + scale * (c + 1) // (sum(both) + len(kept)) for c in both]
        for s in sources:
            pairs = [(sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            terms = [((a - b) ** 2 // b, t) for a, b, t, c in zip(p[s], q, kept, count[s], strict=True) if c and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, keep)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def random_docs(n, seed=3):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma's", "été", "naïve", "x9y", "ß", "delta", "a", "b"] + [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    return [(r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s3", "s4", None]), " ".join(r.choice(words) for _ in range(r.randrange(60)))) for _ in range(n)]


def test_query_equals_sql(spark):
    assert spark_rows(op.query(spark, SF)) == sql_rows(op.ORACLE, SF)


def test_equals_brute_force_with_shards_and_streams(spark):
    rows = random_docs(150)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    want = brute(rows)
    assert found(op.audit(df)) == want
    assert found(op.audit(df, shard_terms=7, stream_words=50)) == want


def test_edges(spark):
    rows = [("en", "a", None), ("en", "b", ""), ("de", "only", "one one one"), (None, None, "zz zz"), (None, "x", "zz"), ("", "y", "zz Zz"), ("en", "c", "123 _[]{}~"), ("fr", "p", "Ab ab"), ("fr", "q", "aB"), ("fr", "q", "AB"), ("fr", "r", "")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit(1) for c in ("term", "n", "p", "q", "shard")})
    assert found(op.audit(df)) == brute(rows)
    assert op.audit(df.limit(0)).count() == 0


def test_very_long_text_and_hot_source(spark, monkeypatch):
    """A text of half a million words in small slices, and a source that holds nearly all rows."""
    monkeypatch.setattr(op, "SLICE", 1000)
    long = " ".join(f"w{chr(97 + i % 23)}{chr(97 + i % 7)}" for i in range(500_000))
    rows = [("en", "big", long)] + [("en", "hot", "waa wbb, wcc!") for _ in range(2000)] + [("en", "few", "waa waa")] * 3
    assert found(op.audit(spark.createDataFrame(rows, "lang string, source string, text string"), stream_words=20_000)) == brute(rows)
