"""Operator 4, token counts: byte-pair merging over a heap and a linked list; the count is symbols minus merges.

A text is cut at the special strings (each counts one) and then into words by the vocabulary's
pattern. A word's symbols form a linked list; a heap holds its adjacent pairs by merge rank. The
lowest pair is popped and merged until no pair has a rank. No token ids are made. Counts of words
are kept in a cache of bounded size in each Python worker, since words recur.

Defined results: a null text counts as empty (0 tokens); a very long word takes O(n log n) and
texts are never cut. Rows that repeat a doc_id, or have none, are counted each by itself; an empty table
gives no rows. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import docs_of, table

TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENS = 1024
#: Words whose counts one worker keeps; and the longest word kept.
CACHE_WORDS, CACHE_CHARS = 400_000, 64


def byte_symbols() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Counter(dict):
    """word -> number of tokens; a dict, so that known words cost one lookup."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in byte_symbols().items()}
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.bytes = [bytes([b]) for b in range(256)]

    def __missing__(self, word: str) -> int:
        n = self.merged(word.encode("utf-8"))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    def merged(self, word: bytes) -> int:
        """Symbols left after all merges."""
        n = len(word)
        if n < 2:
            return n
        rank, symbol = self.rank, [self.bytes[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            # A pair is stale once either of its symbols has been merged into another.
            if j >= n or symbol[i] is not a or symbol[j] is not b:
                continue
            symbol[i], symbol[j] = a + b, b""
            left -= 1
            k = after[j]
            after[i] = k
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := rank.get((symbol[x], symbol[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbol[x], symbol[y]))
            if k < n:
                before[k] = i
        return left

    def count(self, text: str) -> int:
        if self.cut is None:
            return sum(map(self.__getitem__, self.words(text)))
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.words(p))) for p in parts)


_counters: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    """One per worker and vocabulary."""
    if name not in _counters:
        _counters[name] = Counter(public_tokenizers.path(name))
    return _counters[name]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over max_tokens, for every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer)
        for batch in batches:
            n = np.fromiter((tokens.count(t.as_py() or "") for t in batch.column("text")), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs_of(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
