"""Operator 6, substring dedup by repeated-phrase automata.

A window is ``width`` consecutive words. A word goes if a window that covers it also starts in a
document with a smaller doc_id.

1. Copies. Documents with equal word sequences (by SHA-256 of the words) are one class, which its
   smallest doc_id stands for; of the others every word goes, if they have a window at all. Only classes
   go on.
2. Anchors. Among a window's ``anchor``-word grams the one with the smallest hash is its anchor, so equal
   windows have equal anchors, and windows that follow each other mostly share theirs. Anchors that only
   one document has cannot be in a recurring window.
3. Contexts. Windows with the same anchor in the same place make a context, at most 2 width - anchor words
   long. Documents with a recurring anchor give their contexts' words, grouped before they are shuffled:
   a passage that many documents hold is one row with its smallest doc_id and whether another has it.
4. Automata. Contexts are dealt to shards by anchor, which puts all windows that may be equal together.
   A shard confirms the recurring windows (word by word, not by hash), compiles them into an
   Aho-Corasick automaton over word numbers, and streams its contexts through it: each occurrence is a
   window's place in the context with the smallest doc_id that holds it. No shard gets all contexts of a
   window that very many have: such a window is aggregated first, and its contexts are salted.
5. Occurrences go back to the documents that have the context, and their words are removed.

Defined results: a null text has no words; rows without doc_id are left as they are and remove nothing
from others; rows that share a doc_id are judged each by itself against other doc_ids; rows that repeat
a doc_id and its text are alike. Ties go to the smaller doc_id. Very long texts are taken whole, as many
short stretches; an empty table gives no rows. Only doc_id and text are read, so other columns may have
any names.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import docs_of, materialise, table
from gridmill.llm.words import U, blocks, grams, mix, signed, utf8, word_hashes

WIDTH, ANCHOR = 13, 5
#: Distinct contexts that one automaton is compiled from, about: few enough for it to stay in a core's cache.
SHARD_CONTEXTS = 2_000


def anchored(words: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of one text: the place of its anchor, and all places' gram hashes."""
    g = grams(words, anchor)
    span = width - anchor + 1
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    return view.argmin(axis=1) + np.arange(len(view)), g


def spaced(text: np.ndarray) -> bytes:
    """The words of these bytes, one space between."""
    return b" ".join(text.tobytes().split())


def digest_of(words: np.ndarray) -> tuple[int, int]:
    """128 bits of a word sequence, as two signed numbers."""
    order = mix(np.arange(1, len(words) + 1, dtype=np.uint64))
    return int(signed(np.add.reduce(mix(words + order), keepdims=True))[0]), int(signed(np.bitwise_xor.reduce(mix(words ^ (order + U(1))), keepdims=True))[0])


def summaries(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """doc_id, n_words, digest h1 h2 of the word sequence, digest of the kept text as it is, distinct anchors; for every row."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n, h1, h2, sha, keys = [], [], [], [], []
            for i, j in blocks(offsets):
                part = data[offsets[i] : offsets[j]]
                at_byte = offsets[i : j + 1] - offsets[i]
                h, _, _, rows = word_hashes(part, at_byte)
                for d in range(j - i):
                    w = h[rows[d] : rows[d + 1]]
                    n.append(len(w))
                    one, two = digest_of(w)
                    h1.append(one)
                    h2.append(two)
                    sha.append(hashlib.sha256(spaced(part[at_byte[d] : at_byte[d + 1]])).hexdigest())
                    if len(w) >= width:
                        at, g = anchored(w, width, anchor)
                        keys.append(signed(np.unique(g[np.unique(at)])))
                    else:
                        keys.append(np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            lists = pa.LargeListArray.from_arrays(ends, np.concatenate(keys) if keys else np.zeros(0, np.int64)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sha, pa.string()), lists], ["doc_id", "n_words", "h1", "h2", "sha", "anchors"])

    return materialise(docs.mapInArrow(sum_up, "doc_id long, n_words long, h1 long, h2 long, sha string, anchors array<long>"), "summaries")


def contexts_of(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """doc_id, h1 (of the text), anchor, first window's word number, context (its words), for the anchors listed in the row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, listed = batch.column("doc_id").to_pylist(), batch.column("anchors")
            for i, j in blocks(offsets):
                part = data[offsets[i] : offsets[j]]
                h, start, end, rows = word_hashes(part, offsets[i : j + 1] - offsets[i])
                doc, digest, key, first, text = [], [], [], [], []
                for d in range(j - i):
                    lo, hi = rows[d], rows[d + 1]
                    if hi - lo < width:
                        continue
                    h1 = digest_of(h[lo:hi])[0]
                    at, g = anchored(h[lo:hi], width, anchor)
                    wanted = np.sort(np.asarray(listed[i + d].values)).view(U)
                    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
                    mine = g[at[edge[:-1]]]
                    for r in np.flatnonzero(np.isin(mine, wanted)).tolist():
                        a, b = int(edge[r]), int(edge[r + 1]) - 1 + width
                        doc.append(ids[i + d])
                        digest.append(h1)
                        key.append(int(mine[r : r + 1].view(np.int64)[0]))
                        first.append(a)
                        text.append(spaced(part[start[lo + a] : end[lo + b - 1]]))
                if doc:
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(digest, pa.int64()), pa.array(key, pa.int64()), pa.array(first, pa.int32()), pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "h1", "anchor", "first", "context"])

    return docs.mapInArrow(cut, "doc_id long, h1 long, anchor long, first int, context string")


#: What a row does in its shard: gives windows to the automaton and is searched, is searched only, gives only.
BOTH, SEARCHED, GIVEN = 0, 1, 2


def occurrences(contexts: list[str], least: list[int], shared: list[bool], roles: list[int], width: int, splits: list[int], turn: int) -> list[tuple[list[int], list[int]]]:
    """For each context, places of recurring windows and the smallest doc_id that holds each.

    Of a context that is split over several shards only the windows whose turn it is count.
    """
    numbers: dict[str, int] = {}
    names = [c.split(" ") for c in contexts]
    rows = [tuple(numbers.setdefault(w, len(numbers)) for w in c) for c in names]
    holders: dict[tuple, tuple[int, bool]] = {}
    for words, row, doc, many, role, parts in zip(names, rows, least, shared, roles, splits, strict=True):
        if role == SEARCHED:
            continue
        for i in range(len(row) - width + 1):
            if parts > 1 and zlib.crc32(" ".join(words[i : i + width]).encode()) % parts != turn:
                continue
            w = row[i : i + width]
            old = holders.get(w)
            holders[w] = (doc, many) if old is None else (min(old[0], doc), old[1] or many or old[0] != doc)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for w, (doc, many) in holders.items():
        if many:
            automaton.add_word(w, doc)
    if not len(automaton):
        return [([], [])] * len(rows)
    automaton.make_automaton()
    out = []
    for row in rows:
        hits = list(automaton.iter(row))
        out.append(([end - width + 1 for end, _ in hits], [doc for _, doc in hits]))
    return out


def dealt(contexts: DataFrame, width: int, shard_contexts: int) -> DataFrame:
    """Contexts with the shard, turn and salt that say which automaton searches them.

    An anchor with more contexts than a shard takes is split over several, each of which answers for
    its own windows, by their checksum, and gets the contexts that have any of them. A window that by
    itself has more contexts than a shard takes is hot: its contexts are salted over as many shards as
    they need, and each of these is given the one row that the window was aggregated to beforehand.
    """
    shards = max(1, -(-contexts.count() // shard_contexts))
    parts_of = lambda n: F.ceil(F.col(n) / shard_contexts).cast("int")
    window = lambda i: F.array_join(F.slice("words", i + 1, width), " ")
    places = F.sequence(F.lit(0), F.size("words") - width)
    large = materialise(contexts.groupBy("anchor").count().where(F.col("count") > shard_contexts).select("anchor", parts_of("count").alias("splits")), "large")
    hashes = F.array_distinct(F.transform(places, lambda i: F.xxhash64(window(i))))
    counted = contexts.join(large, "anchor", "left_semi").select("anchor", F.split("context", " ").alias("words")).select(F.explode(F.transform(hashes, lambda h: F.struct("anchor", h.alias("hash")))).alias("window"))
    # Grouped by the pair as one value: a hot anchor's windows are then combined before they are dealt anew, wherever its rows were joined.
    counted = counted.groupBy("window").count().select("window.*", "count")
    hot = materialise(counted.where(F.col("count") > shard_contexts).groupBy("anchor").agg(F.collect_list(F.struct("hash", parts_of("count").alias("salts"))).alias("hot")), "hot")
    rows = (
        contexts.join(large.join(hot, "anchor", "left"), "anchor", "left")
        .withColumn("splits", F.coalesce("splits", F.lit(1)))
        .withColumn("shard", F.when(F.col("splits") > 1, -1 - F.pmod(F.xxhash64("anchor"), F.lit(1 << 40))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))))
        .withColumn("words", F.split("context", " "))
    )
    heat = lambda x: F.filter("hot", lambda h: h["hash"] == F.xxhash64(x))
    cool = F.filter(F.transform(places, window), lambda x: F.col("hot").isNull() | (F.size(heat(x)) == 0))
    turns = F.array_distinct(F.transform(cool, lambda x: F.pmod(F.crc32(x), F.col("splits")).cast("long")))
    names = ["shard", "turn", "salt", "role", "splits", "anchor", "digest", "context", "least", "shared"]
    plain = rows.withColumn("turn", F.explode(F.when(F.col("splits") > 1, turns).otherwise(F.array(F.lit(0).cast("long"))))).withColumn("salt", F.lit(0)).withColumn("role", F.lit(BOTH))
    # The hash only picks candidates: windows are aggregated and searched by their words.
    warm = F.array_distinct(F.filter(F.transform(places, lambda i: F.struct(window(i).alias("window"), F.get(heat(window(i)), 0).alias("h"))), lambda x: x["h"].isNotNull()))
    held = rows.where(F.col("hot").isNotNull()).withColumn("w", F.explode(warm)).withColumn("splits", F.lit(1)).withColumn("turn", F.col("w.h.hash"))
    searched = held.withColumn("salt", 1 + F.pmod(F.xxhash64("digest"), F.col("w.h.salts")).cast("int")).withColumn("role", F.lit(SEARCHED))
    one = held.groupBy("shard", "turn", "splits", "anchor", F.col("w.window").alias("context"), F.col("w.h.salts").alias("salts")).agg(F.min("least").alias("least"), (F.max("shared") | (F.min("least") < F.max("least"))).alias("shared"))
    given = one.where("shared").withColumn("salt", F.explode(F.sequence(F.lit(1), F.col("salts")))).withColumn("role", F.lit(GIVEN)).withColumn("digest", F.lit(0).cast("long"))
    return plain.select(names).unionByName(searched.select(names)).unionByName(given.select(names))


def located(contexts: DataFrame, width: int, shard_contexts: int) -> DataFrame:
    """(anchor, digest, places, holders) of distinct contexts (anchor, digest, context, least, shared)."""

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        found = occurrences(rows["context"].tolist(), rows["least"].tolist(), rows["shared"].tolist(), rows["role"].tolist(), width, rows["splits"].tolist(), int(rows["turn"].iloc[0]))
        out = rows[["anchor", "digest"]].assign(places=[p for p, _ in found], holders=[h for _, h in found])
        return out[(out["places"].map(len) > 0) & (rows["role"] != GIVEN)]

    return dealt(contexts, width, shard_contexts).groupBy("shard", "turn", "salt").applyInPandas(scan, "anchor long, digest long, places array<int>, holders array<long>")


def remove_words(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h1, n_removed, digest and text of what is kept; docs: doc_id, text, h1, starts (windows whose words go)."""

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            digests, starts = batch.column("h1").to_pylist(), batch.column("starts")
            mine, n, sha, kept = [], [], [], []
            for i, j in blocks(offsets):
                part, at_byte = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, _, _, rows = word_hashes(part, at_byte)
                for d in range(j - i):
                    w = h[rows[d] : rows[d + 1]]
                    if digest_of(w)[0] != digests[i + d]:
                        continue
                    cover, at = np.zeros(len(w) + 1, np.int64), np.asarray(starts[i + d].values)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + width, -1)
                    stay = np.cumsum(cover[:-1]) == 0
                    left = b" ".join(itertools.compress(part[at_byte[d] : at_byte[d + 1]].tobytes().split(), stay.tolist()))
                    mine.append(i + d)
                    n.append(int(len(w) - stay.sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    kept.append(left)
            own = batch.select(["doc_id", "h1"]).take(pa.array(mine, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "h1", "n_removed", "new_sha", "kept"])

    return docs.mapInArrow(take_out, "doc_id long, h1 long, n_removed long, new_sha string, kept string")


def dedup(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, shard_contexts: int = SHARD_CONTEXTS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; with_text adds kept_text where words went (else null)."""
    docs = docs_of(docs)
    rows = summaries(docs, width, anchor)
    known = rows.where(F.col("doc_id").isNotNull())
    # Copies have equal SHA-256 of their words, not just equal hashes.
    classes = materialise(known.groupBy("h1", "h2", "n_words", "sha").agg(F.min("doc_id").alias("rep")), "classes")
    stand = known.join(classes.select(F.col("rep").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi")
    anchors = stand.select("doc_id", F.explode("anchors").alias("anchor"))
    recurring = materialise(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "recurring")
    listed = anchors.join(recurring, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    listed = materialise(listed, "listed")
    cut = materialise(contexts_of(docs.join(listed, "doc_id"), width, anchor).withColumn("digest", F.xxhash64("context", F.lit(width))), "contexts")
    distinct = materialise(cut.groupBy("anchor", "digest", "context").agg(F.min("doc_id").alias("least"), (F.min("doc_id") < F.max("doc_id")).alias("shared")), "distinct")
    places = materialise(located(distinct, width, shard_contexts), "places")
    pairs = cut.select("doc_id", "h1", "anchor", "first", "digest").join(places, ["anchor", "digest"])
    gone = F.expr("transform(filter(arrays_zip(places, holders), x -> x.holders < doc_id), x -> first + x.places)")
    starts = pairs.select("doc_id", "h1", gone.alias("at")).where("size(at) > 0").groupBy("doc_id", "h1").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("starts"))
    removed = remove_words(docs.join(starts, "doc_id"), width)
    removed = materialise((removed if with_text else removed.withColumn("kept", F.lit(None).cast("string"))).withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "h1"]), "removed")
    own = rows.select("doc_id", "n_words", "h1", "h2", "sha").join(classes, ["h1", "h2", "n_words", "sha"], "left").join(removed, ["h1", "rep"], "left")
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= width)
    mine = F.col("doc_id") == F.col("rep")
    out = own.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(mine, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(mine, F.coalesce("new_sha", "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).when(mine, F.col("kept")).alias("kept_text"),
    )
    return out if with_text else out.drop("kept_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rid, doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 13)
), least AS (
  SELECT k, min(doc_id) AS m FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 13)) AS p FROM windows JOIN least USING (k) WHERE m < doc_id)
), each_word AS (
  SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each_word ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
