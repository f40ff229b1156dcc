"""Operator 11, phrase collocation mining.

Texts in lower case (A-Z only) are split into pieces at . , ; : ! ? and line ends, and pieces into words at
spaces and tabs. A phrase is 2 to ``order`` consecutive words of a piece that occur ``least`` times in a language.
Its score is the smallest floor(scale * a / (l + r)) over its cuts, a its count, l and r its two parts' counts.

1. Multiplicities. Equal pieces of a language become one row and a number, in each task and then by a shuffle. Pieces
   of more than ``SEGMENT`` words are cut into segments that overlap by order - 1 words; each answers for the
   n-grams that start in its first ``starts`` words, so every occurrence counts once.
2. Counts, one length after the other. A task gives its pieces' n-grams with their weights, added up within a block of
   pieces; they are dealt to buckets by hash, and a bucket is counted by duckdb, which goes to the task's own disk
   where its memory limit ends. From two words on only n-grams go there whose two n-grams of one word less
   may be frequent: a bitmap of a fixed ``BITS`` bits is sent to all tasks, with a bit for each frequent one's hash. It
   never loses an n-gram, since a phrase is no more frequent than its parts; where it fills up it only saves less.
3. Lookups. Every cut of a candidate asks for the counts of its two parts: requests are shuffled to the buckets
   of the counts, and the answers back to the candidates. All parts of a candidate are frequent, so all are there.
4. A candidate that lies inside a longer one of at least ``share`` percent of its count goes; the rest is ranked.

Defined results: null text is empty, null lang is `und`; a text or piece without words gives nothing. Ties go to the
smallest cut, then to score, count and phrase in byte order. Repeated rows count as often as they come. Very
long texts and pieces are segments; an empty table gives no rows. Only text and lang are read, so other columns may
have any names. Counts are 64-bit, products with them decimals.
"""

from __future__ import annotations

import itertools
import re
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.llm.common import bound_batches, materialise, table
from gridmill.llm.words import U, grams, mix, word_hashes

ORDER, LEAST, SCALE, SHARE, KEEP = 4, 30, 2_000_000, 80, 2000
#: Words of a segment; a longer piece is cut.
SEGMENT = 512
#: Bits of the map of frequent n-grams, 16 MB whatever the corpus.
BITS = 1 << 27
#: Pieces that a task holds before it hands them on, and bytes of pieces whose n-grams are added up together.
HELD, BLOCK = 200_000, 1 << 21
DUCKDB_MEMORY = "256MB"

_TO = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = re.compile(rb"  +")
_SPACE = np.arange(256) == 32


def segments(piece: bytes, order: int) -> Iterator[tuple[bytes, int]]:
    """A long piece's segments and how many words of each may start an n-gram."""
    at = np.flatnonzero(np.frombuffer(piece, np.uint8) == 32)
    start, end = np.concatenate([[0], at + 1]), np.concatenate([at, [len(piece)]])
    for i in range(0, len(start), SEGMENT):
        yield piece[start[i] : end[min(i + SEGMENT + order - 2, len(end) - 1)]], min(SEGMENT, len(start) - i)


def pieces_of(docs: DataFrame, order: int) -> DataFrame:
    """lang, piece (words with one space between, as bytes), starts, m: distinct pieces and how often they come."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            rows = [(lang, *key, m) for lang, bag in found.items() for key, m in bag.items()]
            found.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int32(), pa.int64()), strict=True)], ["lang", "piece", "starts", "m"])

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                text = text.translate(_TO)
                bag = found[lang]
                before = len(bag)
                for piece, m in Counter((_SPACES.sub(b" ", text) if b"  " in text else text).split(b"\n")).items():
                    piece = piece.strip(b" ")
                    if not piece:
                        continue
                    starts = piece.count(b" ") + 1
                    for key in segments(piece, order) if starts > SEGMENT else ((piece, starts),):
                        bag[key] += m
                held += len(bag) - before
                if held > HELD:
                    yield flush()
                    held = 0
        yield flush()

    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialise(texts.mapInArrow(cut, "lang string, piece binary, starts int, m long").groupBy("lang", "piece", "starts").agg(F.sum("m").alias("m")), "pieces")


def places(h: np.ndarray, k: int, lang: np.ndarray, bits: int) -> np.ndarray:
    """The bit of the k-gram that starts at each word (with what follows in the block, where its text ends before)."""
    g = grams(h, k)
    return (mix(g ^ lang[: len(g)]) & U(bits - 1)).astype(np.int64)


def bytes_and_bounds(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_binary())
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lang_hashes(col: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The column by dictionary, and a hash for each row."""
    coded = col.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()], U)
    return coded, own[np.asarray(coded.indices)] if len(own) else np.zeros(0, U)


def weighted(block: pa.Table, k: int, bits: np.ndarray | None) -> pa.RecordBatch:
    """lang, phrase, w: the k-grams of these pieces that may be frequent, each once with its weight."""
    block = block.combine_chunks()
    data, offsets = bytes_and_bounds(block.column("piece").chunk(0))
    coded, lang = lang_hashes(block.column("lang").chunk(0))
    h, start, end, rows = word_hashes(data, offsets, sep=_SPACE)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    at = np.arange(len(h))
    ok = (at - rows[:-1][row] < np.asarray(block.column("starts"))[row]) & (rows[1:][row] - at >= k)
    if bits is not None and len(h) >= k:
        place = places(h, k - 1, lang[row], len(bits) * 8)
        known = (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        ok[: len(known) - 1] &= known[:-1] & known[1:]
    at = np.flatnonzero(ok)
    lo, hi = start[at], end[at + k - 1]
    bounds = np.concatenate([[0], np.cumsum(hi - lo)])
    text = data[np.repeat(lo - bounds[:-1], hi - lo) + np.arange(bounds[-1])]
    phrase = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text)])
    rows_ = pa.table({"lang": np.asarray(coded.indices)[row[at]], "phrase": phrase, "w": np.asarray(block.column("m"))[row[at]]})
    out = rows_.group_by(["lang", "phrase"], use_threads=False).aggregate([("w", "sum")]).combine_chunks()
    names = coded.dictionary.take(out.column("lang").combine_chunks()) if len(out) else pa.array([], pa.string())
    return pa.RecordBatch.from_arrays([names, out.column("phrase").combine_chunks().cast(pa.binary()), out.column("w_sum").combine_chunks().cast(pa.int64())], ["lang", "phrase", "w"])


def counted(rows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f of those whose weights (lang, phrase, w) add up to least or more; a bucket is counted out of core."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("w", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b.cast(schema) for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": spill, "preserve_insertion_order": False}) as con:
            con.register("weights", pa.RecordBatchReader.from_batches(schema, itertools.chain([first], batches)))
            found = con.sql(f"SELECT lang, phrase, sum(w)::BIGINT AS f FROM weights GROUP BY ALL HAVING sum(w) >= {int(least)}")
            for b in found.to_arrow_reader(100_000):
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.binary()), b.column(2)], ["lang", "phrase", "f"])

    return rows.repartition("lang", "phrase").mapInArrow(count, "lang string, phrase binary, f long")


def bitmap(frequent: DataFrame, k: int, bits: int) -> np.ndarray:
    """Fixed number of bits, with one set for each phrase of k words; put together from parts of 4 kB."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_and_bounds(batch.column("phrase"))
            _, lang = lang_hashes(batch.column("lang"))
            h, _, _, rows = word_hashes(data, offsets, sep=_SPACE)
            found = places(h, k, np.repeat(lang, np.diff(rows)), bits)[rows[:-1]] if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found + 1)], ["place"])

    parts = frequent.mapInArrow(place, "place long").groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for part, held in parts.collect():
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(held, np.uint8)
    return out[: bits // 8]


def frequent_phrases(pieces: DataFrame, order: int, least: int, bits: int) -> list[DataFrame]:
    """For 1 to order words: lang, phrase, f of all n-grams that occur least times or more."""
    sc, out = pieces.sparkSession.sparkContext, []
    for k in range(1, order + 1):
        known = sc.broadcast(bitmap(out[-1], k - 1, bits)) if out else None

        def give(batches: Iterator[pa.RecordBatch], k: int = k, known=known) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.column("piece").nbytes
                if size >= BLOCK:
                    yield weighted(pa.Table.from_batches(held), k, known.value if known else None)
                    held, size = [], 0
            if size:
                yield weighted(pa.Table.from_batches(held), k, known.value if known else None)

        rows = pieces.mapInArrow(give, "lang string, phrase binary, w long")
        out.append(materialise(counted(rows, least), f"frequent{k}"))
    return out


def scored(frequent: list[DataFrame], scale: int, share: int) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates that lie in no longer one of that share of their count."""
    text = lambda df, k: df.select("lang", F.col("phrase").cast("string").alias("phrase"), "f", F.lit(k).alias("k"))
    counts, candidates = text(frequent[0], 1), None
    for k, df in enumerate(frequent[1:], 2):
        counts = counts.unionByName(text(df, k))
        candidates = text(df, k) if candidates is None else candidates.unionByName(text(df, k))
    words = candidates.withColumn("words", F.split("phrase", " "))
    piece = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    cuts = words.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    sides = F.array(F.struct(F.lit(0).alias("side"), piece(F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(1).alias("side"), piece(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))
    requests = cuts.select("lang", "phrase", "k", F.col("f").alias("a"), "cut", F.explode(sides).alias("s")).select("lang", "phrase", "k", "a", (F.col("cut") * 2 + F.col("s.side")).alias("slot"), F.col("s.part").alias("part"))
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    told = answers.groupBy("lang", "phrase", "k", "a").agg(F.map_from_entries(F.collect_list(F.struct("slot", "f"))).alias("of"))
    decimal = lambda c: F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")
    told = told.withColumn("parts", F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(c.alias("cut"), F.element_at("of", c * 2).alias("l"), F.element_at("of", c * 2 + 1).alias("r"))))
    best = F.array_min(F.transform("parts", lambda p: F.struct(F.call_function("div", decimal("a") * F.lit(scale), decimal(p["l"]) + decimal(p["r"])).alias("score"), p["cut"].alias("cut"), p["l"].alias("l"), p["r"].alias("r"))))
    told = told.select("lang", "phrase", "a", best.alias("best"))
    within = words.where("k > 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    within = within.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1))).select("lang", piece(F.col("first"), F.col("n")).alias("phrase"), "f")
    longest = within.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    stay = F.col("longer").isNull() | (decimal("longer") * 100 < decimal("a") * share)
    return told.join(longest, ["lang", "phrase"], "left").where(stay).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, order: int = ORDER, least: int = LEAST, scale: int = SCALE, share: int = SHARE, keep: int = KEEP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n (words of the language), score of each language's first phrases."""
    pieces = pieces_of(docs, order)
    all_words = pieces.groupBy("lang").agg(F.sum(F.col("m") * F.col("starts")).alias("n"))
    rows = scored(frequent_phrases(pieces, order, least, bits), scale, share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= keep)
    return top.join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), words AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), grams AS (
  SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM p))
), f AS (
  SELECT lang, k, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT lang, k, g, phrase, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), scores AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000::HUGEINT * c.a // (x.f + y.f), cut) AS place
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.g[1 : cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.g[cut + 1 :], ' ')
), inside AS (
  SELECT lang, array_to_string(g[i : i + n - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM f WHERE k > 2)) GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM scores s LEFT JOIN inside USING (lang, phrase) WHERE place = 1 AND (longer IS NULL OR 100 * longer < 80 * a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN words USING (lang) WHERE rank <= 2000
"""
