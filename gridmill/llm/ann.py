"""Operator 10, approximate nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length one and rotated at random; the signs are its code. Stored beside the
packed bits are its length and the code's inner product with the rotated vector, the correction.
A rotated query is rounded to PLANES bits a component and packed by bit planes, so its inner product
with a code is a sum of bit counts of ANDs. That over the correction estimates the true one, with an
error that stays under ``epsilon * sqrt((1 - c^2) / c^2) / sqrt(dim - 1)`` with high probability, plus
the length of what rounding took from the query. Per block of codes a query reranks, on the original
vectors in double precision, those whose upper bound reaches its k-th best so far; others' vectors
aren't touched.

Every vector is indexed. Queries are taken in waves of bounded size, each broadcast to one scan of
the index; a task keeps k results a query and hands them on once, at its end. Of many waves each few
are written to the shared folder, so that no plan holds them all.

Defined results: vectors that are null, zero or empty or hold null or non-finite components take no
part, nor do rows without vec_id or with another dimension than the most frequent one (of equally
frequent ones the largest). Of rows that repeat a query's vec_id the smallest vector asks; as
candidates they all count, save for the query of that vec_id. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.llm.common import materialise, table

EVERY, K, EPSILON, SEED = 20, 20, 3.0, 7
#: Numbers in a wave's broadcast matrix; rows of codes met at once; queries met at once.
WAVE, ROWS, QUERIES = 4 << 20, 4096, 256
#: Bits of a rounded query's components; waves of which results are written together.
PLANES, TOGETHER = 6, 16


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the rows that take part, whatever their dimension."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    )


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def build_index(df: DataFrame, dim: int, seed: int = SEED) -> DataFrame:
    """vec_id, v, packed code, length and correction of every vector of this dimension; written to the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix_of(batch.column("v"), dim)
            top = np.abs(v).max(axis=1)  # lengths without overflow
            length = top * np.linalg.norm(v / top[:, None], axis=1)
            turned = (v / top[:, None]) @ turn
            turned /= np.linalg.norm(turned, axis=1, keepdims=True)
            code = np.packbits(turned >= 0, axis=1)
            correction = np.abs(turned).sum(axis=1) / np.sqrt(dim)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(correction)], ["vec_id", "v", "code", "length", "correction"])

    return materialise(df.where(F.size("v") == dim).mapInArrow(encode, "vec_id long, v array<double>, code binary, length double, correction double"), "codes")


class Best:
    """The k best of one query so far: larger score first, then smaller id."""

    __slots__ = ("ids", "scores", "k")

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0)

    @property
    def least(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def as_words(packed: np.ndarray) -> np.ndarray:
    """Packed bits (rows of bytes) as rows of 64-bit words."""
    wide = -(-packed.shape[1] // 8) * 8
    out = np.zeros((len(packed), wide), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


class Rounded:
    """Rotated queries rounded to PLANES bits: low + step * u, with u as bit planes, and the length of what rounding took."""

    def __init__(self, turned: np.ndarray):
        self.low = turned.min(axis=1)
        top = (1 << PLANES) - 1
        self.step = np.maximum(turned.max(axis=1) - self.low, 1e-300) / top
        u = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, top).astype(np.uint8)
        self.planes = [as_words(np.packbits((u >> b) & 1, axis=1)) for b in range(PLANES)]
        near = self.low[:, None] + self.step[:, None] * u
        self.total = near.sum(axis=1)
        self.lost = np.linalg.norm(turned - near, axis=1)

    def signed_sums(self, x: slice, codes: np.ndarray) -> np.ndarray:
        """For queries x and codes (rows of words): the sum of the query's components, each with the code's sign."""
        held = np.zeros((len(self.low[x]), len(codes)), np.int32)
        for b, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                held += np.bitwise_count(plane[x, w][:, None] & codes[:, w]).astype(np.int32) << b
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        return 2 * (self.low[x, None] * ones + self.step[x, None] * held) - self.total[x, None]


def scan(best: list[Best], query_ids: np.ndarray, queries: np.ndarray, rounded: Rounded, lengths: np.ndarray, ids: np.ndarray, v: np.ndarray, codes: np.ndarray, length: np.ndarray, correction: np.ndarray, epsilon: float) -> None:
    """Meets one block of codes with all queries."""
    dim = v.shape[1]
    words = as_words(codes)
    scale = length / (np.sqrt(dim) * correction)
    slack = length * epsilon * np.sqrt(np.maximum(0, 1 - correction**2)) / correction / np.sqrt(max(1, dim - 1)) + 1e-9 * length
    for a in range(0, len(queries), QUERIES):
        x = slice(a, a + QUERIES)
        # A code is a unit vector, so rounding moves its inner product by no more than the length it took.
        upper = rounded.signed_sums(x, words) * scale + lengths[x, None] * slack + rounded.lost[x, None] * (length / correction)
        for i, bound in enumerate(upper, a):
            found, k = best[i], best[i].k

            def exact(at: np.ndarray, i=i, found=found) -> None:
                at = at[ids[at] != query_ids[i]]
                if len(at):
                    found.add(ids[at], np.einsum("ij,j->i", v[at], queries[i]))

            if len(found.scores) < k and len(bound) > 2 * k:
                # The likeliest first, so that most of the rest falls under their k-th.
                first = np.argpartition(-bound, 2 * k)[: 2 * k]
                exact(first)
                bound = bound.copy()
                bound[first] = -np.inf
            exact(np.flatnonzero((bound >= found.least) & (bound > -np.inf)))


def search(index: DataFrame, queries: DataFrame, dim: int, k: int = K, epsilon: float = EPSILON, seed: int = SEED, wave: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest in the index of each (vec_id, v) of queries."""
    spark = index.sparkSession
    asked = queries.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    per_wave = max(1, wave // dim)
    waves = -(-asked.count() // per_wave)
    asked = materialise(asked.withColumn("wave", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, waves)))), "queries")
    schema = "query_id long, vec_id long, score double"
    found, written = None, []
    for w in range(waves):
        rows = asked.where(F.col("wave") == w).select("vec_id", "v").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast((np.asarray(rows["vec_id"]), matrix_of(rows["v"].combine_chunks(), dim)))

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, q = shared.value
            top = np.abs(q).max(axis=1)
            lengths = top * np.linalg.norm(q / top[:, None], axis=1)
            turned = Rounded(q @ rotation(dim, seed))
            best = [Best(k) for _ in query_ids]
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    part = batch.slice(a, ROWS)
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    scan(best, query_ids, q, turned, lengths, np.asarray(part.column("vec_id")), matrix_of(part.column("v"), dim), codes, np.asarray(part.column("length")), np.asarray(part.column("correction")), epsilon)
            n = [len(b.ids) for b in best]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, n)), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))], ["query_id", "vec_id", "score"])

        met = index.mapInArrow(meet, schema)
        found = met if found is None else found.unionByName(met)
        if waves > TOGETHER and w % TOGETHER == TOGETHER - 1:
            written.append(materialise(found, "waves"))
            found = None
    for part in written:
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # A task's list is bounded by k, so a query's window holds k rows a task at most.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K, epsilon: float = EPSILON) -> DataFrame:
    """The k nearest, by inner product, of each row whose id is divisible by every."""
    rows = usable(df, id_col, vec_col)
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    dim = common[0].dim if common else 1
    index = build_index(rows, dim)
    return search(index, index.where(F.col("vec_id") % every == 0).select("vec_id", "v"), dim, k, epsilon)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
