import re

import corpus_pipeline as P
from gridmill.llm import language_id
from tests.llm.helpers import edit_distance, union_find

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in language_id.identify(docs).collect()}

    first = P.identify_language(spark, docs, SF)
    kept = {r.doc_id for r in first.collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.5} and first.columns == docs.columns

    second = P.join_near_copies(spark, first, SF)
    ids = sorted(kept)
    sets = [shingles(rows[i].text) for i in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if (u := len(sets[a] | sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * u]
    root = union_find(len(ids), [a for a, _ in pairs], [b for _, b in pairs])
    kept = {ids[i] for i in range(len(ids)) if root[i] == i}
    assert {r.doc_id for r in second.collect()} == kept and second.columns == docs.columns

    third = P.drop_contaminated(spark, second, SF)
    norm = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.translate({c: c + 32 for c in range(65, 91)}))
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {i for i in kept for item in items if edit_distance(item, norm(rows[i].text), int(0.2 * len(item)))}
    assert {r.doc_id for r in third.collect()} == kept - found and third.columns == docs.columns

    fourth = P.mask_secrets(spark, third, SF)
    assert fourth.columns == docs.columns and fourth.dtypes == docs.dtypes
    for r in fourth.collect():
        assert (r.text == rows[r.doc_id].text) or "[SECRET]" in r.text
        assert not re.search(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", r.text)

    last = P.run(spark, SF).toPandas()
    assert set(last.doc_id) == kept - found
    assert last.groupby("sequence_id")["length"].sum().max() <= 2048


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, h1 int, base string"
    text = "the quick brown fox jumps over the lazy dog again and again " * 3
    rows = [(1, None, None, None, None, 1, "x"), (2, "", "en", "s", 0, 2, None), (3, text, "en", "s", 9, 3, None), (3, text, "en", "s", 9, 3, None), (None, text, "en", "s", 9, 4, None), (5, text + "x", "en", "s", 9, 5, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        now = docs
        for _, stage in P.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns
        got = sorted((r.doc_id or -1) for r in P.STAGES[-1][1](spark, now, SF).collect())
        assert got in ([], [-1, 3])
