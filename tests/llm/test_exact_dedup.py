import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridmill.llm import exact_dedup as op
from tests.oracle import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


def brute(rows):
    """doc_id, keep_id, group_size, kept, sha by a dictionary of normalised texts."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (d, _), t in zip(rows, norm, strict=True):
        if d is not None:
            groups.setdefault(t, []).append(d)
    out, stays = [], set()
    for (d, _), t in zip(rows, norm, strict=True):
        sha = hashlib.sha256(t.encode()).hexdigest()
        if d is None:
            out.append((None, None, 1, True, sha))
        else:
            least = min(groups[t])
            out.append((d, least, len(groups[t]), d == least and t not in stays, sha))
            if d == least:
                stays.add(t)
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.sha) for r in df.collect()], key=repr)


def test_query_equals_sql(spark):
    assert spark_rows(op.query(spark, SF)) == sql_rows(op.ORACLE, SF)


def test_chunks_combine_to_the_whole():
    r = random.Random(1)
    for n in (0, 1, 7, 64, 1000):
        data = bytes(r.randrange(256) for _ in range(n))
        whole = [sum((c + 1) * pow(b, i, p) for i, c in enumerate(data)) % p for b, p in zip(op.BASES, op.MODULI, strict=True)]
        import numpy as np

        parts, size = [], 16
        for i in range(0, max(n, 1), size):
            part = np.frombuffer(data[i : i + size], np.uint8)
            h = op.chunk_hashes(part, np.array([0, len(part)]), [op.powers(b, p, size) for b, p in zip(op.BASES, op.MODULI, strict=True)], op.MODULI)
            parts.append((len(part), [int(x[0]) for x in h]))
        assert op.combined(parts, op.BASES, op.MODULI) == (n, whole)


CASES = [
    (1, "a b"), (2, "a  b"), (3, "a\tb"), (4, "a b "), (5, None), (6, ""), (7, " "), (8, "\n\x0b"), (9, "é b"), (10, "é\r\nb"), (11, "a b"),
    (12, "x" * 500 + " y"), (13, "x" * 500 + "\n\ny"), (14, "x" * 501 + " y"), (15, "\x85a"), (16, " a"),
    (None, "a b"), (None, None), (20, "same"), (20, "same"), (20, "other"), (21, "same"), (20, "two  ways"), (20, "two ways"),
]


@pytest.mark.parametrize("how", [{}, {"chunk": 8, "salt_rows": 2}, {"bases": (2,), "moduli": (3,), "chunk": 64, "salt_rows": 1}])
def test_edges_long_texts_and_collisions(spark, how):
    """Small chunks make every text a long one; a modulus of three makes most fingerprints collide."""
    df = spark.createDataFrame(CASES, "doc_id long, text string")
    assert found(op.classes(df, **how)) == brute(CASES)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.classes(df).count() == 0 and op.keep_first(df).count() == 0


def test_hot_group_and_very_long_text(spark):
    long = ("lorem ipsum dolor " * 200_000).strip()
    rows = [(i, "copy  of one" if i % 3 else f"own {i}") for i in range(3000)] + [(9001, long), (9002, long.replace(" ", "\n")), (9003, long + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(op.classes(df)) == brute(rows)


def test_other_columns_pass_and_one_row_stays(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("x", "n", "f", "sha", "rep", "part", "keep_id")})
    left = op.keep_first(df)
    assert left.columns == df.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in left.where("doc_id is not null").collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in CASES if d is not None})
    assert left.where("doc_id is null").count() == 2
