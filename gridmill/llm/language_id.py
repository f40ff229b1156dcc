"""Operator 3, language ID: multinomial naive Bayes over hashed character n-grams.

Grams of one to three code points of the lower-cased text are hashed into a fixed number of buckets.
Training counts them by language over a bounded sample of labelled rows; the log-probability matrix
(buckets x languages, of fixed size) is broadcast. Scoring gathers the matrix's rows for all grams of
a block of texts and sums them by text: a sparse product in numpy.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if
there is nothing to learn from. Equal scores go to the language that sorts first. held_out is false
for a null doc_id; such rows are not learned from either. Rows that repeat a doc_id are predicted each by
itself; very long texts are scored whole, a block at a time; an empty table gives no rows. Only doc_id,
text and lang are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import docs_of, table
from gridmill.llm.words import blocks

BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
#: Labelled rows of each language that training reads at most, about (sampled by a hash of their doc_id).
SAMPLE_PER_LANGUAGE = 4000
#: The matrix has this many columns at most; more languages are an error.
MAX_LANGUAGES = 512
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def held_out(residue: int, modulus: int) -> F.Column:
    """Whether the doc_id's checksum leaves the residue that is kept for testing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == residue, F.lit(False))


def gram_buckets(points: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets of all grams of these texts' code points, and where each text's grams begin and end."""
    starts = np.concatenate([[0], ends[:-1]])
    for k in ORDERS:
        n = max(0, len(points) - k + 1)
        h = np.full(n, k, np.uint32)
        for j in range(k):
            h = (h ^ points[j : j + n]) * _FACTORS[j]
            h ^= h >> np.uint32(15)
        # Grams that run over a text's end belong to none.
        yield h & np.uint32(BUCKETS - 1), np.stack([np.minimum(starts, n), np.clip(ends - k + 1, np.minimum(starts, n), n)])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    low = [t.lower() for t in texts]
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([len(t) for t in low])


def text_blocks(column: pa.Array, most: int = 1 << 16) -> Iterator[list[str]]:
    """Texts in lists of bounded total length; a long text is a list of its own."""
    texts = [t or "" for t in column.to_pylist()]
    for i, j in blocks(np.concatenate([[0], np.cumsum([len(t) for t in texts])]), most):
        yield texts[i:j]


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probability matrix, from (doc_id, text, lang)."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    langs = sorted(sizes)
    scale = 1 << 20
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(scale, scale * per_language // sizes[lang] + 1)))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share[F.col("lang")]).select("lang", "text").repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            langs_of, texts_of = batch.column("lang").to_pylist(), batch.column("text")
            for lang in set(langs_of):
                row = langs.index(lang)
                mine = texts_of.filter(pa.array([x == lang for x in langs_of]))
                for texts in text_blocks(mine):
                    for h, span in gram_buckets(*code_points(texts)):
                        inside = np.zeros(len(h) + 1, np.int64)
                        np.add.at(inside, span[0], 1)
                        np.add.at(inside, span[1], -1)
                        total[row] += np.bincount(h[np.cumsum(inside[:-1]) > 0], minlength=BUCKETS)
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(bucket), pa.array(total[row, bucket])], ["row", "bucket", "n"])

    summed = sample.mapInArrow(count, "row long, bucket long, n long").groupBy("row", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((BUCKETS, len(langs)), SMOOTHING)
    counts[summed["bucket"], summed["row"]] += summed["n"]
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def posterior(texts: list[str], langs: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the best language's number (-1: unknown) and its posterior under equal priors; evidence is divided by the number of orders."""
    letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
    if not langs or not letters.any():
        return np.full(len(texts), -1), np.zeros(len(texts))
    total = np.zeros((len(texts), len(langs)))
    for h, (a, b) in gram_buckets(*code_points(texts)):
        for column in range(len(langs)):
            sums = np.concatenate([[0.0], np.cumsum(weights[:, column][h], dtype=np.float64)])
            total[:, column] += sums[b] - sums[a]
    total /= len(ORDERS)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    return np.where(letters, odds.argmax(axis=1), -1), np.where(letters, 1 / odds.sum(axis=1), 0.0)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            names, scores = [], []
            for texts in text_blocks(batch.column("text")):
                best, score = posterior(texts, langs, weights)
                names += [langs[i] if i >= 0 else UNKNOWN for i in best]
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(guess, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Trains on the rows that are not held out and predicts every row."""
    named = docs_of(docs, F.col("lang").cast("string").alias("lang")).withColumn("held_out", held_out(1, 3))
    langs, matrix = train(named.where(~F.col("held_out")), per_language)
    return predict(named, langs, matrix)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """A pipeline's filter: rows whose language is found with at least this score stay, as they are."""
    named = docs_of(docs, F.col("lang").cast("string").alias("lang")).withColumn("held_out", held_out(1, 3))
    langs, matrix = train(named.where(~F.col("held_out")))
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for block in text_blocks(pa.array(texts, pa.large_string())):
            out += posterior(block, langs, shared.value)[1].tolist()
        return pd.Series(out, dtype="float64")

    return docs.where(score(F.col("text").cast("string")) >= least)
