"""Operator 8, benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows.

Texts and items become words: runs of letters and digits (bytes from 0x80 on count as letters),
A-Z lower-cased. A document is contaminated by an item if some stretch of it is within ``edits``
(a share of the item's words) insertions, deletions and substitutions of words of the item.

1. Regions. A stretch within k edits of an item of L words shares at least L - q + 1 - k q of its
   q-grams, so windows are made only where that many of an item's grams lie close together; no
   match is lost by it. q is the largest of 3, 2, 1 that leaves one gram at least.
2. Embedding. Every window of the item's length in a region, and the item, are walked by CGK: step j
   emits the current word and moves on if a random bit of (j, word) says so. Words at small edit
   distance give walks at small Hamming distance.
3. LSH. Each repetition walks with its own bits and compares a few sampled steps; a window that
   agrees on all of them in any repetition is a candidate. Repetitions follow from the recall asked
   for, at the chance of agreement that walks at the largest edit distance were measured to have.
4. Verification. The exact edit distance of the item to the best stretch at the candidate (Sellers'
   recurrence on whole machine words) decides.

Items go to the tasks in shards of a checked size. Defined results: null and empty texts, and items
without words, match nothing; a doc_id that is repeated or null is judged row by row, and rows of the
same (doc_id, item_id) give one result with the smallest distance that was verified. Items with equal
words are all named. Very long texts are scanned whole, a block of words at a time; empty tables of
documents or items give no rows. Only doc_id, item_id and text are read, so other columns may have any
names.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import docs_of, table
from gridmill.llm.words import U, blocks, grams, mix, utf8, word_hashes

EDITS, RECALL, SEED = 0.2, 0.99, 11
#: Steps compared in a repetition; the chance that a step agrees at the largest edit distance (measured over random edits of a fifth of the words: 0.46).
SAMPLED, AGREE = 3, 0.46
#: Repetitions go in rounds: a window range whose match one round has confirmed needs no more of them.
ROUNDS = [(0, 1), (1, 8), (8, None)]
#: Bytes of items that one task holds; the benchmark is scanned in as many shards as that takes.
SHARD_BYTES = 16 << 20
ALNUM = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def repetitions(recall: float = RECALL, sampled: int = SAMPLED, agree: float = AGREE) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled))


def _moves(now: np.ndarray, salt: np.ndarray | U) -> np.ndarray:
    """The random bits of (step, word): whether a walk goes on to its next word."""
    return ((now ^ salt) * U(0xBF58476D1CE4E5B9) >> U(63)).astype(np.int64)


def salts(seeds: np.ndarray, steps: int) -> np.ndarray:
    return mix((seeds.astype(U)[:, None] << U(32)) + np.arange(steps, dtype=np.uint64)[None, :])


def walks(words: np.ndarray, steps: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CGK walks of one window, a row for each seed: its words at that row's steps, 0 beyond the end."""
    salt, padded = salts(seeds, int(steps.max()) + 1), np.append(words, U(0))
    at, every = np.zeros(len(seeds), np.int64), np.empty(salt.shape, U)
    for j in range(salt.shape[1]):
        every[:, j] = padded[np.minimum(at, len(words))]
        at += _moves(every[:, j], salt[:, j])
    return np.take_along_axis(every, steps, axis=1)


def agreeing(windows: np.ndarray, steps: np.ndarray, wanted: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which windows (rows of word hashes) agree in some repetition with the wanted words at all its steps.

    All repetitions' walks go on together; one ends where it first differs.
    """
    n, width = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), U)], axis=1)
    last, salt = steps.max(axis=1), salts(seeds, int(steps.max()) + 1)
    due, want = np.zeros(salt.shape, bool), np.zeros(salt.shape, U)
    np.put_along_axis(due, steps, True, axis=1)
    np.put_along_axis(want, steps, wanted, axis=1)
    r, w = np.divmod(np.arange(len(steps) * n), n)
    at, hit = np.zeros(len(r), np.int64), np.zeros(n, bool)
    for j in range(salt.shape[1]):
        now = padded[w, np.minimum(at, width)]
        if due[:, j].any():
            same = ~due[r, j] | (now == want[r, j])
            hit[w[same & (last[r] == j)]] = True
            stay = same & (last[r] > j)
            r, w, at, now = r[stay], w[stay], at[stay], now[stay]
            if not len(r):
                break
        at += _moves(now, salt[r, j])
    return hit


def sample_steps(length: int, repetition: int, seed: int, sampled: int = SAMPLED) -> np.ndarray:
    """Steps within the part of the walk that is still inside the window, on average."""
    return np.sort(np.random.default_rng([seed, repetition, length]).choice(max(sampled, 2 * length), sampled, replace=False))


def best_stretch(item: list[int], text: list[int]) -> int:
    """Least edit distance of the item to any stretch of text: Myers' bit-parallel form of Sellers' recurrence."""
    m = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for w in text:
        eq = where.get(w, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(d | plus)), plus & d
        score += bool(up & top) - bool(down & top)
        best = min(best, score)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(d | up)), up & d
    return best


class Shard(NamedTuple):
    key: str
    ids: list[int]
    texts: list[str]


class Items:
    """One shard of the benchmark, ready to scan documents."""

    def __init__(self, ids: list[int], texts: list[str], edits: float, recall: float, seed: int):
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        hashes, _, _, rows = word_hashes(data, offsets, lower=True, sep=ALNUM)
        self.ids, self.seed, self.repeats = [], seed, repetitions(recall)
        self.words, self.k, self.q, self.need = [], [], [], []
        keys: dict[int, list[np.ndarray]] = {1: [], 2: [], 3: []}
        owner: dict[int, list[np.ndarray]] = {1: [], 2: [], 3: []}
        for i, item_id in enumerate(ids):
            w = hashes[rows[i] : rows[i + 1]]
            if not len(w):
                continue
            k = int(edits * len(w))
            q = next(q for q in (3, 2, 1) if q == 1 or len(w) - q + 1 - k * q >= max(1, q - 1))
            g = np.unique(grams(w, q))
            keys[q].append(g)
            owner[q].append(np.full(len(g), len(self.ids)))
            # Repeated grams of an item count once, so they are taken from what must be shared.
            self.need.append(max(1, len(w) - q + 1 - k * q - (len(w) - q + 1 - len(g))))
            self.ids.append(item_id)
            self.words.append(w)
            self.k.append(k)
            self.q.append(q)
        self.keys, self.owner, self.table = {}, {}, {}
        for q in keys:
            if keys[q]:
                every, mine = np.concatenate(keys[q]), np.concatenate(owner[q])
                order = np.argsort(every, kind="stable")
                self.keys[q], self.owner[q] = every[order], mine[order]
                self.table[q] = np.zeros(1 << 22, bool)
                self.table[q][(every >> U(42)).astype(np.int64)] = True
        self.walks = functools.lru_cache(maxsize=None)(self._walks)

    def _walks(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of an item: each repetition's steps, the item's own words there, and the seeds."""
        w, seeds = self.words[i], self.seed + np.arange(self.repeats)
        steps = np.array([sample_steps(len(w), r, self.seed) for r in range(self.repeats)])
        return steps, walks(w, steps, seeds), seeds

    def regions(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last): windows starting there may be within the item's edits."""
        for q, keys in self.keys.items():
            g = grams(words, q)
            at = np.flatnonzero(self.table[q][(g >> U(42)).astype(np.int64)])
            if not len(at):
                continue
            low, high = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            n = high - low
            if not n.any():
                continue
            pos = np.repeat(at, n)
            item = self.owner[q][np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            order = np.lexsort((pos, item))
            pos, item = pos[order], item[order]
            edge = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                i = int(item[a])
                need, length, k = self.need[i], len(self.words[i]), self.k[i]
                p = pos[a:b]
                if len(p) < need:
                    continue
                close = np.flatnonzero(p[need - 1 :] - p[: len(p) - need + 1] <= length + k)
                first, last = None, None
                for c in close.tolist():
                    x, y = max(0, int(p[c + need - 1]) - length - k), int(p[c])
                    if last is not None and x <= last + 1:
                        last = max(last, y)
                    else:
                        if last is not None:
                            yield i, first, last
                        first, last = x, y
                if last is not None:
                    yield i, first, last

    def matches(self, words: np.ndarray) -> dict[int, int]:
        """item -> least distance, for the items within their edits of some stretch of these words."""
        found: dict[int, int] = {}
        for i, first, last in self.regions(words):
            if found.get(i) == 0:
                continue
            item, k = self.words[i], self.k[i]
            length = len(item)
            for lo in range(first, last + 1, 4096):
                hi = min(last, lo + 4095)
                span = words[lo : hi + length]
                span = np.concatenate([span, np.zeros(max(0, hi - lo + length - len(span)), U)])
                windows = np.lib.stride_tricks.sliding_window_view(span, length)
                steps, wanted, seeds = self.walks(i)
                for r in ROUNDS:
                    part = slice(*r)
                    starts = np.flatnonzero(agreeing(windows, steps[part], wanted[part], seeds[part])) + lo
                    while len(starts):  # one verification for candidates that overlap
                        run = starts[starts <= starts[0] + 4 * length]
                        distance = best_stretch(item.tolist(), words[max(0, int(run[0]) - k) : int(run[-1]) + length + k].tolist())
                        if distance <= k and distance < found.get(i, k + 1):
                            found[i] = distance
                        starts = starts[len(run) :]
                    if i in found:
                        break
        return found


_kept: dict[tuple, Items] = {}


def _held(shared: Broadcast, edits: float, recall: float, seed: int) -> Items:
    """One shard's items are prepared once in a worker; the last one used is kept."""
    key = (shared.value.key, edits, recall, seed)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Items(shared.value.ids, shared.value.texts, edits, recall, seed)
    return _kept[key]


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL, seed: int = SEED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, item_words) of every item that a document holds."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    spark, found = docs.sparkSession, None
    for s in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Shard(uuid.uuid4().hex, [r.item_id for r in rows], [r.text for r in rows]))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = _held(shared, edits, recall, seed)
            for batch in batches:
                out = []
                data, offsets = utf8(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                for i, j in blocks(offsets):
                    hashes, _, _, rows = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True, sep=ALNUM)
                    for d in range(j - i):
                        out += [(ids[i + d], held.ids[x], n, len(held.words[x])) for x, n in held.matches(hashes[rows[d] : rows[d + 1]]).items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "distance", "item_words"])

        part = docs_of(docs).mapInArrow(scan, "doc_id long, item_id long, distance int, item_words int")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.first("item_words").alias("item_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
