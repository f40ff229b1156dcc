"""Operator 13, exact dedup by composable polynomial fingerprints.

Texts are equal when they are identical after each run of white space (space, 0x09-0x0D) is one space.

1. Fingerprints. A text's fingerprint is its length and, for three primes p below 2**31, the sum of
   (byte + 1) * base**place mod p. Two neighbouring chunks combine by shifted arithmetic:
   f(AB) = f(A) + base**len(A) * f(B). Texts up to a chunk are hashed where they are read, whole batches at a
   time; longer ones are cut into chunks, which are dealt to all tasks, hashed there, and combined from
   their small results.
2. Groups. Rows with equal doc_id and equal text are counted first; then rows with equal fingerprints meet,
   as fingerprints only, combined before they are shuffled.
3. Comparison. Only rows whose fingerprint another row has give their texts. Each is compared chunk by chunk
   with the text of its group's smallest row, in a merge of two sorted streams of chunks; the chunks of that one
   row are repeated for every ``SALT_ROWS`` rows of the group, so no task gets a large group. Rows that differ
   from it (colliding fingerprints) are a group of their own and are compared again, until none is left.

Defined results: null text is an empty one; of equal texts the smallest doc_id stays, and of rows that repeat
this doc_id one stays. A row without doc_id cannot be named: it stays, is in no group, and has keep_id null and
group_size 1. An empty table gives no rows. Very long texts are hashed and compared in chunks; only their SHA-256, which
cannot be put together from parts, is computed by the task that reads them. Other columns of docs are not read,
so they may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import docs_of, materialise, table
from gridmill.llm.words import blocks

#: The three largest primes below 2**31, so that products and sums of a chunk stay in 64 bits, and a base for each.
MODULI, BASES = (2147483647, 2147483629, 2147483587), (911382323, 972663749, 1340958487)
#: Bytes of a chunk; a power of two up to 2**23.
CHUNK = 1 << 18
#: Rows of a group for which the chunks of its smallest row are repeated once.
SALT_ROWS = 256
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; a single space is one already."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def powers(base: int, p: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) mod p."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), p) % p])
    return out[:n]


def chunk_hashes(data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray], moduli: tuple[int, ...]) -> list[np.ndarray]:
    """For each modulus the hash of every row; rows are no longer than the tables of powers."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    out = [np.zeros(len(sizes), np.int64) for _ in moduli]
    if len(full):
        place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
        value = data.astype(np.int64) + 1
        for h, pw, p in zip(out, tables, moduli, strict=True):
            h[full] = np.add.reduceat(value * pw[place], offsets[:-1][full]) % p
    return out


def combined(parts: list[tuple[int, list[int]]], bases: tuple[int, ...], moduli: tuple[int, ...]) -> tuple[int, list[int]]:
    """Length and hashes of chunks laid end to end, from theirs."""
    n, out = 0, [0] * len(moduli)
    for size, hashes in parts:
        out = [(f + pow(b, n, p) * h) % p for f, h, b, p in zip(out, hashes, bases, moduli, strict=True)]
        n += size
    return n, out


def hashed(rows: DataFrame, keep: list[str], bases: tuple[int, ...], moduli: tuple[int, ...], chunk: int) -> DataFrame:
    """The columns kept, n (bytes) and f (hashes) of the binary column body, none longer than a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [powers(b, p, chunk) for b, p in zip(bases, moduli, strict=True)]
        for batch in batches:
            col = batch.column("body").cast(pa.large_binary())
            _, at, data = col.buffers()
            offsets = np.frombuffer(at, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            found = [chunk_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables, moduli) for i, j in blocks(offsets)]
            f = np.stack([np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(len(moduli))], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(col) + 1) * len(moduli), pa.int32()), pa.array(f.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.diff(offsets), pa.int64()), lists], [*keep, "n", "f"])

    types = dict(rows.dtypes)
    return rows.select(*keep, "body").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", n long, f array<long>")


def pieces(rows: DataFrame, chunk: int) -> DataFrame:
    """rows with part and its chunk of the binary column body in place of body; an empty body is one empty chunk."""
    cut = rows.withColumn("part", F.explode(F.expr(f"sequence(0, greatest(octet_length(body) - 1, 0) div {chunk})").cast("array<int>")))
    return cut.withColumn("body", F.expr(f"substring(body, part * {chunk} + 1, {chunk})"))


def fingerprints(docs: DataFrame, bases: tuple[int, ...], moduli: tuple[int, ...], chunk: int) -> DataFrame:
    """doc_id, x (hash of the text as it stands), sha (of the normalised text), n, f, copies: distinct rows and how often each comes."""
    text = normalised(F.col("text"))
    base = docs.withColumn("x", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("norm", text)
    base = base.withColumn("sha", F.sha2("norm", 256)).withColumn("body", F.col("norm").cast("binary"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk
    short = hashed(base.where(~long), ["doc_id", "x", "sha"], bases, moduli, chunk)
    dealt = pieces(base.where(long).select("doc_id", "x", "sha", "body", F.monotonically_increasing_id().alias("row")), chunk).repartition("row", "part")
    parts = hashed(dealt, ["doc_id", "x", "sha", "row", "part"], bases, moduli, chunk)
    parts = parts.groupBy("doc_id", "x", "sha", "row").agg(F.sort_array(F.collect_list(F.struct("part", "n", "f"))).alias("parts"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [combined([(c["n"], c["f"]) for c in row], bases, moduli) for row in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "x", "sha")), pa.array([n for n, _ in found], pa.int64()), pa.array([f for _, f in found], pa.list_(pa.int64()))], ["doc_id", "x", "sha", "n", "f"])

    long_rows = parts.mapInArrow(combine, "doc_id long, x long, sha string, n long, f array<long>")
    return short.unionByName(long_rows).groupBy("doc_id", "x", "sha", "n", "f").agg(F.count("*").alias("copies"))


def compared(docs: DataFrame, rows: DataFrame, least: DataFrame, chunk: int, salt_rows: int) -> DataFrame:
    """doc_id, x, n, f, rep (its group's smallest row) and same (equal to it), for rows (doc_id, x, n, f) of the groups in least."""
    wanted = rows.join(least, ["n", "f"]).withColumn("salts", F.ceil(F.col("rows") / salt_rows).cast("int"))
    # What is wanted has no bound, so it is merged with the texts at every size.
    texts = docs.withColumn("x", F.xxhash64(F.coalesce("text", F.lit("")))).join(wanted.drop("rows").hint("merge"), ["doc_id", "x"])
    # Rows that repeat a doc_id and its text give it once.
    texts = materialise(texts.select("doc_id", "x", "n", "f", "rep", "salts", normalised(F.col("text")).cast("binary").alias("body")), "texts")
    first = (F.col("doc_id") == F.col("rep.doc_id")) & (F.col("x") == F.col("rep.x"))
    one = pieces(texts.where(first), chunk).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    one = one.select("n", "f", "part", "salt", F.col("body").alias("__other"))
    each = pieces(texts.where(~first), chunk).withColumn("salt", F.pmod(F.xxhash64("doc_id", "x"), F.col("salts")).cast("int"))
    met = each.join(one, ["n", "f", "part", "salt"], "left").select("doc_id", "x", "n", "f", "rep", F.col("body").eqNullSafe(F.col("__other")).alias("same"))
    same = met.groupBy("doc_id", "x", "n", "f", "rep").agg(F.bool_and("same").alias("same"))
    return same.unionByName(least.select("rep.doc_id", "rep.x", "n", "f", "rep", F.lit(True).alias("same")))


def classes(docs: DataFrame, bases: tuple[int, ...] = BASES, moduli: tuple[int, ...] = MODULI, chunk: int = CHUNK, salt_rows: int = SALT_ROWS) -> DataFrame:
    """doc_id, x, keep_id, keep_x, group_size, kept, sha for every row of docs; x tells rows of a doc_id apart."""
    docs = docs_of(docs)
    prints = materialise(fingerprints(docs, bases, moduli, chunk), "prints")
    named = prints.where(F.col("doc_id").isNotNull())
    open_rows, settled = named.select("doc_id", "x", "n", "f"), []
    while True:
        # Written, so that a hot fingerprint's rows meet their one group in a join that Spark can split.
        least = materialise(open_rows.groupBy("n", "f").agg(F.min(F.struct("doc_id", "x")).alias("rep"), F.count("*").alias("rows")).where("rows > 1"), "least")
        if not least.limit(1).count():
            break
        done = materialise(compared(docs, open_rows, least, chunk, salt_rows), "compared")
        settled.append(done.where("same").select("doc_id", "x", F.col("rep.doc_id").alias("keep_id"), F.col("rep.x").alias("keep_x")))
        open_rows = done.where(~F.col("same")).select("doc_id", "x", "n", "f")
    alone = prints.select("doc_id", "x", "sha", "copies")
    if settled:
        found = settled[0]
        for more in settled[1:]:
            found = found.unionByName(more)
        # A hot class is many rows that meet its one size, which Spark splits; all else is joined by unique keys.
        sizes = found.join(alone, ["doc_id", "x"]).groupBy("keep_id", "keep_x").agg(F.sum("copies").alias("size"))
        rows = alone.join(found.join(sizes, ["keep_id", "keep_x"]), ["doc_id", "x"], "left")
    else:
        rows = alone.select("*", *(F.lit(None).cast("long").alias(c) for c in ("keep_id", "keep_x", "size")))
    own = F.col("doc_id").isNotNull()
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    first = F.coalesce((F.col("doc_id") == F.col("keep_id")) & (F.col("x") == F.col("keep_x")), F.col("keep_id").isNull())
    return rows.select(
        "doc_id",
        "x",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("keep_x", "x").alias("keep_x"),
        F.when(own, F.coalesce("size", "copies")).otherwise(1).cast("long").alias("group_size"),
        (~own | first & (F.col("i") == 1)).alias("kept"),
        "sha",
    )


def keep_first(docs: DataFrame, **how: object) -> DataFrame:
    """The rows of docs that stay, with all their columns; rows without doc_id stay."""
    key, x = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    stay = classes(docs, **how).where("kept and doc_id is not null").select(F.struct("doc_id", "x").alias("__key"))
    rows = docs.withColumn("__key", F.struct(key.alias("doc_id"), x.alias("x")))
    once = rows.where(key.isNotNull()).join(stay, "__key", "left_semi").dropDuplicates(["__key"])
    return once.unionByName(rows.where(key.isNull())).drop("__key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
