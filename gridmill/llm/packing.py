"""Operator 7, best-fit packing with bound-certified repacking.

Documents become token ids plus an end id, cut into pieces of at most ``capacity`` tokens (the first
may be shorter). Full pieces are sequences of their own. The other pieces are dealt to partitions of
bounded size, each packed by best-fit decreasing; dual-feasible functions give a lower bound of its
bins. A partition at its bound is certified: no packing of its pieces has fewer bins, and it keeps
them. Partitions with a gap exchange their pieces: eight of them are packed again together, the new
bins replace the old ones if they are fewer, and a union at its bound is certified. One that is not is
cut into eight again, whole bins each, and the next exchange is between other eight, until each has met
all others. The emptiest bin of each certified group, one in many thousands, is packed again with those
of the others at the end. Pieces move as rows of lengths, never as texts; no exchange takes more than
eight partitions' pieces.

With each piece come ``bins`` and ``lower_bound`` of the group that its sequence was packed in: where
they are equal the group is packed in as few sequences as can be (1 and 1 for a full piece).

Defined results: a null text is empty and packs as its end id alone; rows that repeat a doc_id, or
have none, are packed as documents of their own; an empty table gives no rows; very long texts, and
very long runs of blanks in them, are encoded whole. Only doc_id and text are read, so other columns
may have any names. Which of equally good packings is chosen is not defined.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridmill.llm.common import docs_of, materialise, table
from gridmill.llm.token_counts import byte_symbols

TOKENIZER, CAPACITY, END_ID = "byte_bpe_50k.json", 2048, 0
#: Pieces packed together, and partitions in an exchange.
PIECES, UNION = 100_000, 8


class Encoder:
    """Ids as the tokenizers library gives them.

    tiktoken runs the same vocabulary and pattern three times as fast. Texts whose characters are
    all of Latin scripts and common punctuation, where both libraries' character classes were
    compared one by one, go to it; every other text goes to tokenizers. So does a text with a very
    long run of blanks, on which tiktoken's pattern backtracks past its stack, or that it fails on.
    """

    other = regex.compile(r"[^\x00-ɏ‐-‧‰-⁞₠-₿]")
    blanks = regex.compile(r"(?<!\s)\s{100000}")  # begun at a run's start only, so that the search is linear

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = {c: b for b, c in byte_symbols().items()}
        ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if not self.other.search(text) and not (len(text) >= 100_000 and self.blanks.search(text)):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), "<u4")
            except ValueError:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def pieces_of(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode.ids(text.as_py() or ""), np.array([end_id], "<u4")).astype("<u4")
                bounds = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                rows += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs_of(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, by best-fit decreasing."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, made = 0, 0  # free: bit r is set if a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                free ^= 1 << room
        else:
            room, at = capacity, made
            made += 1
        bins[i], offsets[i] = at, capacity - room
        if room > size:
            if not open_bins[room - size]:
                free |= 1 << (room - size)
            open_bins[room - size].append(at)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the largest of the sums under dual-feasible functions, in whole numbers."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    upto, mass = np.cumsum(count), np.cumsum(count * sizes)
    # Below e nothing, above capacity - e a whole bin, the size itself between.
    e = np.arange(0, capacity // 2 + 1)
    below = np.where(e > 0, mass[np.maximum(e - 1, 0)], 0)
    cut = (upto[-1] - upto[capacity - e]) * capacity + mass[capacity - e] - below
    best = -(-int(cut.max()) // capacity)
    for k in range(1, 33):  # steps of 1 / k; a size that is a whole number of (k + 1)ths keeps its share
        steps = (k + 1) * sizes
        value = np.where(steps % capacity == 0, sizes * k, steps // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_COLUMNS}, part long, bin long, offset long, bins long, lower_bound long, state int"
#: A piece's bin is for good, goes to the next exchange, or is its group's emptiest, which is packed again with those of others.
SETTLED, OPEN, TAIL = 0, 1, 2


def _judged(rows: pd.DataFrame, bins: np.ndarray, offsets: np.ndarray, capacity: int, last: bool, tails: bool) -> pd.DataFrame:
    """Rows with their bins, the bound of all of them, and what becomes of each bin."""
    lengths = rows["length"].to_numpy()
    made, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
    state = np.full(len(rows), SETTLED if made == bound or last else OPEN)
    if made == bound and tails:
        fill = np.bincount(bins, lengths)
        if fill.min() < capacity:
            state[bins == fill.argmin()] = TAIL
    return rows.assign(bin=bins, offset=offsets, bins=made, lower_bound=bound, state=state)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES) -> DataFrame:
    """Adds sequence_id, offset, bins and lower_bound to pieces (doc_id, piece, start, length, ids_crc32)."""
    pieces = materialise(pieces, "pieces")
    one = F.lit(1).cast("long")
    full = pieces.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("bins"), one.alias("lower_bound"))
    rest = pieces.where(F.col("length") < capacity)
    parts = -(-rest.count() // per_partition)
    if not parts:
        return full
    rounds = 0
    while UNION**rounds < parts:
        rounds += 1

    def dealt_by(df: DataFrame, n: int) -> DataFrame:
        # The id is of the row's place in the written pieces: dealt evenly whatever the keys, and alike when a task is run again.
        return df.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))

    def packed_alone(last: bool, tails: bool):
        return lambda rows: _judged(rows, *best_fit(rows["length"].to_numpy(), capacity), capacity, last, tails)

    now = materialise(dealt_by(rest, parts).groupBy("part").applyInPandas(packed_alone(parts == 1, parts > 1), _PACKED), "packed")
    made = [now]
    for digit in range(rounds):
        step, last = UNION**digit, digit == rounds - 1

        def again(rows: pd.DataFrame, step: int = step, last: bool = last) -> pd.DataFrame:
            # The partitions of a group differ in one digit of their numbers, to the base UNION.
            old = pd.factorize(pd.MultiIndex.from_frame(rows[["part", "bin"]]))[0]
            bins, offsets = best_fit(rows["length"].to_numpy(), capacity)
            if bins.max() >= old.max():
                bins, offsets = old, rows["offset"].to_numpy()
            part = int(rows["part"].iloc[0])
            base = part - part // step % UNION * step
            return _judged(rows.assign(part=base + bins % UNION * step), bins, offsets, capacity, last, True)

        left = made[-1].where(F.col("state") == OPEN)
        if not left.head(1):
            break
        group = F.expr(f"part - (part div {step}) % {UNION} * {step}")
        made.append(materialise(left.groupBy(group).applyInPandas(lambda rows, *, f=again: f(rows), _PACKED), "repacked"))
    if parts > 1:
        tails = made[0]
        for m in made[1:]:
            tails = tails.unionByName(m)
        tails = materialise(tails.where(F.col("state") == TAIL).select(*[c.split()[0] for c in _COLUMNS.split(", ")]), "tails")
        n = -(-tails.count() // per_partition)
        if n:
            made.append(materialise(dealt_by(tails, n).groupBy("part").applyInPandas(packed_alone(True, False), _PACKED), "tails_packed"))
    packed = full
    for level, m in enumerate(made):
        number = (F.shiftleft(F.lit(level).cast("long"), 56) + F.shiftleft(F.col("part"), 24) + F.col("bin")).alias("sequence_id")
        packed = packed.unionByName(m.where(F.col("state") == SETTLED).select("doc_id", "piece", "start", "length", "ids_crc32", number, "offset", "bins", "lower_bound"))
    return packed


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(pieces_of(docs, tokenizer, capacity, end_id), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
