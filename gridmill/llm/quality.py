"""Operator 9, quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a vector of statistics (lengths, shares of character classes, repetition), transformed
so that classes are near normal. Per label, Spark sums the vectors and their products over all
labelled training rows; the class covariances are those moments shrunk towards the pooled one and
its diagonal. The score is the posterior from log-density differences, whose Mahalanobis terms use
Cholesky factors computed once and sent with the task.

Defined results: a null text counts as empty; every row is scored. held_out is false for a null
doc_id. A label counts for every row of its doc_id; rows whose quality is neither 0 nor 1 teach
nothing. With fewer than two classes learned, all scores are the share of label 1 (0.5 if none).
Equal texts have equal scores; very long texts are measured whole, a block of bytes at a time; an empty
documents table gives no rows. Only doc_id, text and quality are read, so other columns may have any
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import docs_of, materialise, table
from gridmill.llm.language_id import held_out
from gridmill.llm.words import blocks, grams, utf8, word_hashes

#: Weight of the pooled covariance in a class's, of its diagonal in the pooled one, and the least score of a predicted 1.
SHRINK, DIAGONAL, THRESHOLD = 0.2, 0.1, 0.7
#: Bytes are counted in these classes.
CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "high": range(128, 256),
    "space": (32, 9, 11, 12, 13),
    "line": (10,),
    "stop": (46, 63),
    "comma": (44, 59, 58),
    "bang": (33,),
    "symbol": (35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126),
}
NAMES = ["bytes", "words", "word_bytes", "word_spread", *CLASSES, "short_words", "distinct_words", "top_word", "repeated_grams", "repeated_lines", "line_bytes"]


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    data, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    for i, j in blocks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        hashes, start, end, rows = word_hashes(part, at, lower=True)
        size, n = np.diff(at), np.diff(rows)
        some, width = np.maximum(size, 1), (end - start).astype(float)
        words = np.maximum(n, 1)
        mean = _sums(width, rows) / words
        spread = np.sqrt(np.maximum(0, _sums(width * width, rows) / words - mean**2))
        share = [np.sqrt(_sums(np.isin(np.arange(256), list(c))[part], at) / some) for c in CLASSES.values()]
        short = _sums(width <= 3, rows) / words
        own = np.zeros((j - i, 5))
        for d in range(j - i):
            h = hashes[rows[d] : rows[d + 1]]
            if len(h):
                _, count = np.unique(h, return_counts=True)
                own[d, 0], own[d, 1] = len(count) / len(h), count.max() / len(h)
                g = grams(h, 5)
                own[d, 2] = 1 - len(np.unique(g)) / len(g) if len(g) else 0
                text = part[at[d] : at[d + 1]]
                breaks = np.flatnonzero(text == 10)
                lines = np.split(h, np.searchsorted(start[rows[d] : rows[d + 1]] - at[d], breaks))
                keys = [x.tobytes() for x in lines if len(x)]
                own[d, 3] = 1 - len(set(keys)) / len(keys)
                own[d, 4] = np.log1p(len(text) / (len(breaks) + 1))
        out[i:j] = np.column_stack([np.log1p(size), np.log1p(n), np.log1p(mean), np.log1p(spread), *share, short, own[:, 0], np.sqrt(own[:, 1]), np.sqrt(own[:, 2]), np.sqrt(own[:, 3]), own[:, 4]])
    return out


class Discriminant:
    """Two normal densities with factors of their covariances, and the log odds of their shares."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float = SHRINK, diagonal: float = DIAGONAL):
        self.mean = sums / n[:, None]
        scatter = products / n[:, None, None] - self.mean[:, :, None] * self.mean[:, None, :]
        pooled = (scatter * n[:, None, None]).sum(axis=0) / n.sum()
        floor = 1e-4 + np.diag(pooled)
        pooled = (1 - diagonal) * pooled + diagonal * np.diag(floor) + 1e-6 * np.eye(len(floor))
        self.factor = [np.linalg.cholesky((1 - shrink) * s + shrink * pooled) for s in scatter]
        # The triangular factors' inverses, also triangular: a batch is whitened by one product.
        self.whiten = [np.tril(np.linalg.inv(f)) for f in self.factor]
        self.log_det = [2 * np.log(np.diag(f)).sum() for f in self.factor]
        self.log_prior = np.log(n / n.sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        log = []
        for c in (0, 1):
            z = self.whiten[c] @ (x - self.mean[c]).T
            log.append(self.log_prior[c] - 0.5 * (self.log_det[c] + (z * z).sum(axis=0)))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def learn(stats: DataFrame, labels: DataFrame) -> Discriminant | float:
    """From (doc_id, x) and (doc_id, quality): the discriminant, or the share of label 1 where a class is missing."""
    d = len(NAMES)
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    found = stats.join(taught, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("sums"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("products")).collect()
    by = {r.quality: r for r in found}
    if len(by) < 2:
        return float(next(iter(by), 0.5))
    products = np.zeros((2, d, d))
    for c in (0, 1):
        for (i, j), v in zip(pairs, by[c].products, strict=True):
            products[c, i, j] = products[c, j, i] = v
    return Discriminant(np.array([by[0].n, by[1].n], float), np.array([by[0].sums, by[1].sums]), products)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns from labels of rows that aren't held out."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "held_out", "x"])

    stats = materialise(docs_of(docs).withColumn("held_out", held_out(2, 4)).mapInArrow(measure, "doc_id long, held_out boolean, x array<double>"), "statistics")
    model = learn(stats.where(~F.col("held_out")), labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(NAMES))
            score = model.score(x) if isinstance(model, Discriminant) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
