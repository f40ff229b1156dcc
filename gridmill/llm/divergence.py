"""Operator 12, source divergence audit by a two-pass vocabulary automaton.

Terms are runs of letters A-Z (in lower case) and characters beyond ASCII. A language keeps the terms that ``least`` of
its documents hold. With count occurrences of N in all, a kept term of V has p = 1 + floor(scale * (count + 1) / (N + V)),
in each (lang, source) group and in each language; two of them differ by f(p, q) = floor((p - q)**2 / q).

1. Document frequencies. A task takes each document's distinct terms and adds them up by language before they
   are shuffled.
2. Occurrences. Kept terms are dealt to shards by checksum, at most about ``SHARD_TERMS`` of a language each, and
   the documents' whole texts are read again and cut up in the same way: a shard gets the words that may be its, those
   of a source that a task meets several times once, with that number. In a shard's task the kept terms, padded with a
   space on either side, make an Aho-Corasick automaton; the words, padded likewise, stream through it, and each hit
   counts as often as its word came. A shard of many words is several streams, each with the shard's terms. No
   vocabulary is broadcast, and a task holds one shard's automaton.
3. Postings (lang, source, term, count) hold only terms that occur. A term that a group lacks has the group's
   smallest p, so a pair's sum over all kept terms is put together from three sparse parts: each group's p by how many
   terms have it, against the other's smallest; what the terms that both have add to that; and the terms that neither has.

Defined results: null text, lang and source are empty strings. Repeated rows are documents of their own. Ties rank in byte
order of the item. Very long texts pass in slices cut at spaces, whole; an empty table gives no rows; a
language of one source has no pairs, and one without kept terms has pairs of value 0. Only text, lang and source
are read, so other columns may have any names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.llm.common import bound_batches, materialise, table

LEAST, SCALE, KEEP = 3, 1_000_000_000, 200
#: Kept terms of a language in a shard's automaton, about, and words that stream through it in one task, about.
SHARD_TERMS, STREAM_WORDS = 50_000, 8_000_000
#: Words that a task holds before it hands them on, bytes of text split at once, words of a row that goes to a shard, and counts that a stream holds.
HELD, SLICE, ROW_WORDS, CELLS = 500_000, 1 << 22, 8_000, 4_000_000

#: Bytes to lower case; all that is in no term to spaces.
_TERMS = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice."""
    text, at = text.translate(_TERMS), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def document_frequencies(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, df of terms in least documents or more; the empty term's df is the number of words."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                mine: set[bytes] = set()
                for words in words_of(text):
                    mine.update(words)
                    held[lang][b""] += len(words)
                held[lang].update(mine)
            if sum(map(len, held.values())) > HELD:
                yield batch_of([(lang, *x) for lang, bag in held.items() for x in bag.items()], schema)
                held.clear()
        yield batch_of([(lang, *x) for lang, bag in held.items() for x in bag.items()], schema)

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, term binary, df long")
    return materialise(rows.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least), "frequencies")


def dealt_words(docs: DataFrame, shards: int, streams: int) -> DataFrame:
    """lang, shard, stream, source, text, times: the words of all documents, each in its shard's rows; a row has a word once, and how often it came."""
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("stream", pa.int32()), ("source", pa.string()), ("text", pa.binary()), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turn, size = defaultdict(Counter), TaskContext.get().partitionId(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            rows: list[tuple] = []
            for (lang, source), bag in held.items():
                dealt: list[tuple[list, list]] = [([], []) for _ in range(shards)]
                for word, n in bag.items():
                    words, times = dealt[crc32(word) % shards]
                    words.append(word)
                    times.append(n)
                for shard, (words, times) in enumerate(dealt):
                    for i in range(0, len(words), ROW_WORDS):
                        turn += 1
                        rows.append((lang, shard, turn % streams, source, b" ".join(words[i : i + ROW_WORDS]), times[i : i + ROW_WORDS]))
                if len(rows) > 100:
                    yield batch_of(rows, schema)
                    rows.clear()
            held.clear()
            yield batch_of(rows, schema)

        for batch in batches:
            for key, text in zip(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                bag = held[key]
                for words in words_of(text):
                    size -= len(bag)
                    bag.update(words)
                    size += len(bag)
                    if size > HELD:
                        yield from flush()
                        size, bag = 0, held[key]
        yield from flush()

    return docs.mapInArrow(run, "lang string, shard int, stream int, source string, text binary, times array<long>")


def recounted(rows: DataFrame) -> DataFrame:
    """lang, source, term, n from rows sorted so that in each shard's stream its terms (source null) come before the texts."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton, terms, counts = None, None, [], {}

        def flush() -> Iterator[pa.RecordBatch]:
            own = pa.array(terms, pa.binary())
            for source, n in counts.items():
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(found), pa.string()), pa.array([source] * len(found), pa.string()), own.take(pa.array(found)), pa.array(n[found])], schema=schema)
            counts.clear()

        for batch in batches:
            times = batch.column("times")
            for i, (*key, source, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "stream", "source", "text")), strict=True)):
                if key != at:
                    yield from flush()
                    at, automaton, terms = key, None, []
                if source is None:
                    terms = text.split(b" ")
                elif terms:
                    if automaton is None:
                        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                        for k, term in enumerate(terms):
                            automaton.add_word(f" {term.decode('latin-1')} ", k)
                        automaton.make_automaton()
                    # Each byte as a character: padded terms and texts match as their bytes do. A hit ends at the space behind its word.
                    if hits := list(automaton.iter(f" {text.decode('latin-1')} ")):
                        ends, found = np.array(hits, np.int64).T
                        gaps = np.flatnonzero(np.frombuffer(text + b" ", np.uint8) == 32) + 1
                        own = counts.get(source)
                        if own is None:
                            if len(counts) * len(terms) > CELLS:
                                yield from flush()
                            own = counts[source] = np.zeros(len(terms), np.int64)
                        own[found] += np.asarray(times[i].values)[np.searchsorted(gaps, ends)]
        yield from flush()

    return rows.mapInArrow(run, "lang string, source string, term binary, n long")


def postings_of(docs: DataFrame, least: int, shard_terms: int, stream_words: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term), and how often each source has those that occur there (lang, source, term, n), with all sources' count (every)."""
    known = document_frequencies(docs, least)
    kept = known.where("octet_length(term) > 0").select("lang", "term")
    most_terms = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    most_words = known.where("octet_length(term) = 0").agg(F.max("df")).first()[0] or 0
    shards = max(1, -(-most_terms // shard_terms))
    streams = max(1, -(-most_words // (shards * stream_words)))
    # A shard's terms are one row of bounded size.
    terms = kept.groupBy("lang", F.pmod(F.crc32("term"), F.lit(shards)).cast("int").alias("shard")).agg(F.array_join(F.collect_list(F.col("term").cast("string")), " ").cast("binary").alias("text"))
    terms = terms.select("lang", "shard", F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("stream"), F.lit(None).cast("string").alias("source"), "text", F.lit(None).cast("array<long>").alias("times"))
    rows = terms.unionByName(dealt_words(docs, shards, streams)).repartition("lang", "shard", "stream")
    rows = rows.sortWithinPartitions("lang", "shard", "stream", F.asc_nulls_first("source"))
    # Dealt by term once: a term's sources lie together, so its sum needs no other exchange.
    counts = recounted(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    every = F.sum("n").over(Window.partitionBy("lang", "term"))
    return kept, materialise(counts.select("lang", "source", F.col("term").cast("string").alias("term"), "n", every.alias("every")), "postings")


def share(n: Column, total: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / total), exactly; null where total is 0."""
    whole = F.when(total > 0, total).cast("decimal(20,0)")
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(scale), whole) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = LEAST, scale: int = SCALE, keep: int = KEEP, shard_terms: int = SHARD_TERMS, stream_words: int = STREAM_WORDS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: how far each source is from the others and from its language, and by which terms."""
    bound_batches(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept, postings = postings_of(docs, least, shard_terms, stream_words)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    whole = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").join(whole, "lang", "left").na.fill(0, ["total", "held", "v", "lang_total"])
    groups = materialise(groups.withColumn("low", share(F.lit(0), F.col("total") + F.col("v"), scale)), "groups")
    own = postings.join(groups.select("lang", "source", "total", "v", "low", "lang_total"), ["lang", "source"])
    own = materialise(own.select("lang", "source", "term", "low", share(F.col("n"), F.col("total") + F.col("v"), scale).alias("p"), share(F.col("every"), F.col("lang_total") + F.col("v"), scale).alias("q")), "shares")

    terms = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    side = lambda df, c, *names: df.select("lang", *(F.col(n).alias(f"{c}_{n}") for n in names))
    a, b = side(groups, "a", "source", "held", "low", "v"), side(groups, "b", "source", "held", "low")
    both = a.join(b, "lang").where("a_source <> b_source")
    neither = both.select("lang", "a_source", "b_source", F.coalesce((F.col("a_v") - F.col("a_held") - F.col("b_held")) * apart(F.col("a_low"), F.col("b_low")), F.lit(0)).cast("decimal(30,0)").alias("value"))
    alike = own.groupBy("lang", F.col("source").alias("x"), "p").agg(F.count("*").alias("terms"))
    against = alike.join(side(groups, "y", "source", "low"), "lang").where("x <> y_source")
    against = against.groupBy("lang", "x", "y_source").agg(exact(F.col("terms") * apart(F.col("p"), F.col("y_low"))).alias("there"), exact(F.col("terms") * apart(F.col("y_low"), F.col("p"))).alias("back"))
    a, b = side(own, "a", "term", "source", "p", "low").withColumnRenamed("a_term", "term"), side(own, "b", "term", "source", "p", "low").withColumnRenamed("b_term", "term")
    more = lambda x, y: apart(F.col(f"{x}_p"), F.col(f"{y}_p")) - apart(F.col(f"{x}_p"), F.col(f"{y}_low")) - apart(F.col(f"{x}_low"), F.col(f"{y}_p")) + apart(F.col(f"{x}_low"), F.col(f"{y}_low"))
    shared = a.join(b, ["lang", "term"]).where("a_source < b_source").groupBy("lang", F.col("a_source").alias("x"), "b_source").agg(exact(more("a", "b")).alias("there"), exact(more("b", "a")).alias("back"))
    parts = neither
    for df, y in ((against, "y_source"), (shared, "b_source")):
        parts = parts.unionByName(df.select("lang", F.col("x").alias("a_source"), F.col(y).alias("b_source"), F.col("there").cast("decimal(30,0)").alias("value")))
        parts = parts.unionByName(df.select("lang", F.col(y).alias("a_source"), F.col("x").alias("b_source"), F.col("back").cast("decimal(30,0)").alias("value")))
    pairs = parts.groupBy("lang", "a_source", "b_source").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), "value")

    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", order).unionByName(terms.withColumn("rank", order).where(F.col("rank") <= keep))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT id, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT DISTINCT lang, source FROM d
), p AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS p
  FROM (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)) WINDOW w AS (PARTITION BY lang, source)
), q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS q FROM (SELECT lang, term, sum(n) AS n FROM p GROUP BY ALL) WINDOW w AS (PARTITION BY lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) WHERE part = 'pair' OR rank <= 200
"""
