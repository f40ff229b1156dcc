"""Operator 5, n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

A document is the set of its k-word shingles. Documents with equal sets are one class, which its
smallest doc_id stands for; only classes are compared.

1. Tiles. Sizes fall into bands; a tile is a band and the sizes above it that can still link with it.
   Linked sets of a tile differ by at most D shingles. The shingles' hash range is cut into D + 1 + E
   parts, so at least 1 + E parts of linked sets are equal, and one of them is not empty as long as a
   set leaves no more than E parts empty (a set that does gives its empty parts too). A bucket is a
   tile, a part and the digest of a set's shingles there: sets that link meet in one, whatever they
   hold. Neither side is sampled or capped.
2. Links to the bucket's centre: the member whose buckets hold most members altogether, so the one
   with the fewest edits of a group of near copies. They connect nearly all; components follow.
3. Buckets that still hold several components are cut into blocks of bounded size, and blocks meet in
   pairs. A tile whose pairs of different components that the bound below allows are no more than its
   rows hands these on, each once over all tiles. Of any other tile only the documents in such pairs
   come again, with their sets, and all pairs of them are decided in their tile, which hands on a link
   for each time two of its components join. So what leaves a tile grows with its rows, not its pairs.
4. Bounds. A set's bitmap has the parity of its shingles by hash; the count of bits in which two
   differ is at most the count of shingles in which they do, which bounds the overlap from above.
   Pairs that pass are intersected as sorted arrays of 64-bit shingle hashes, exactly.

Defined results: without words or text a document has no shingles, is linked with nothing and its own
component; so is one without doc_id (component null). Rows that share a doc_id are one document.
Shingles are compared by 64-bit hashes. Very long texts are hashed as a whole; their buckets form
blocks of fewer rows. An empty table gives no rows. Only doc_id and text are read, so other columns
may have any names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import docs_of, materialise, table
from gridmill.llm.components import components
from gridmill.llm.words import U, blocks, grams, mix, signed, utf8, word_hashes

SHINGLE, PERCENT = 3, 90
#: A band's sizes grow by half; members of a bucket that meet as one block.
BAND, BLOCK_ROWS = 1.5, 1024
#: Shingles that a block's rows may have together, where they come as bitmaps and where as sets.
BLOCK_BITS, BLOCK_SHINGLES = 64 << 20, 1 << 20
#: Bytes of incidence bits that a tile compares at once.
BITS_AT_ONCE = 16 << 20


@functools.lru_cache(maxsize=None)
def band_start(k: int) -> int:
    return 1 if k == 0 else max(band_start(k - 1) + 1, int(band_start(k - 1) * BAND))


@functools.lru_cache(maxsize=1 << 16)
def tiles_of(n: int, percent: int) -> list[int]:
    """Tiles that a set of n shingles is in: its band's, and lower ones that reach up to it."""
    k = 0
    while band_start(k + 1) <= n:
        k += 1
    found = [k]
    while k > 0 and (band_start(k) - 1) * 100 // percent >= n:
        k -= 1
        found.append(k)
    return found


@functools.lru_cache(maxsize=None)
def tile_parts(k: int, percent: int) -> tuple[int, int]:
    """How many parts a tile has, and how many of a set's may be empty; no parts where only equal sets link."""
    a = band_start(k + 1) - 1
    differ = (a + a * 100 // percent) * (100 - percent) // (100 + percent)
    if not differ:
        return 0, 0
    n, m = band_start(k), differ + 1
    while True:
        # Parts that hold something, of m when n shingles fall into them: mean and variance.
        one, two = (1 - 1 / m) ** n, (1 - 2 / m) ** n if m > 1 else 0.0
        held, var = m * (1 - one), m * (m - 1) * two + m * one - (m * one) ** 2
        if held - 4 * max(0.0, var) ** 0.5 >= differ + 1 or m >= 16 * n:
            return m, m - differ - 1
        m += 1 + m // 16


@functools.lru_cache(maxsize=None)
def _tile(k: int, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    m, spare = tile_parts(k, percent)
    edges = np.array([(j << 64) // m for j in range(1, m)], U)
    return edges, mix(np.arange(m, dtype=np.uint64) + (U(k + 1) << U(40))), spare


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence is one where it is shorter than k."""
    if 0 < len(words) < k:
        return mix(grams(words, len(words)) + U(len(words)))
    return np.unique(grams(words, k))


def bucket_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of all buckets that this set is in."""
    out = []
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(s))])
    for k in tiles_of(len(s), percent):
        if not tile_parts(k, percent)[0]:
            continue
        edges, salt, spare = _tile(k, percent)
        at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        keys = mix(sums[at[1:]] - sums[at[:-1]] + salt)
        filled = at[1:] > at[:-1]
        out.append(keys if len(filled) - filled.sum() > spare else keys[filled])
    return np.concatenate(out) if out else np.zeros(0, U)


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the set by hash, one bit a shingle or more."""
    width = max(64, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & U(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit numbers, all as wide as the narrowest: halves are added as parities."""
    width = min(map(len, maps))
    out = np.empty((len(maps), width // 8), U)
    for i, b in enumerate(maps):
        row = np.frombuffer(b, U)
        while len(row) > width // 8:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out


def most_different(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """In how many shingles linked sets of these sizes can differ; -1 where none of them link."""
    s = a + b
    need = -(-percent * s // (100 + percent))
    return np.where(need <= np.minimum(a, b), s - 2 * need, -1)


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The shingle set of each text."""
    data, offsets = utf8(column)
    for i, j in blocks(offsets):
        hashes, _, _, rows = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        for d in range(j - i):
            yield shingles(hashes[rows[d] : rows[d + 1]], shingle)


def _digest(s: np.ndarray) -> tuple[int, int]:
    return int(signed(np.add.reduce(mix(s), keepdims=True))[0]), int(signed(np.bitwise_xor.reduce(mix(s + U(1)), keepdims=True))[0])


def digests(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n and the set's digest h1 h2 of every row; written to the shared folder."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), *_digest(s)) for s in _sets(batch.column("text"), shingle)]
            cols = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", "n", "h1", "h2"])

    return materialise(docs.mapInArrow(sum_up, "doc_id long, n long, h1 long, h2 long"), "digests")


def signatures(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n, bucket keys and bitmap of the rows (doc_id, text, h1, h2) whose set has that digest; written to the shared folder."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
            mine, size, keys, maps = [], [], [], []
            for i, s in enumerate(_sets(batch.column("text"), shingle)):
                if _digest(s) == (one[i], two[i]):
                    mine.append(i)
                    size.append(len(s))
                    keys.append(signed(bucket_keys(s, percent)))
                    maps.append(bitmap(s))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
            lists = pa.LargeListArray.from_arrays(ends, np.concatenate(keys) if keys else np.zeros(0, np.int64)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(mine, pa.int64())), pa.array(size, pa.int64()), lists, pa.array(maps, pa.binary())], ["doc_id", "n", "keys", "bits"])

    return materialise(docs.mapInArrow(sign, "doc_id long, n long, keys array<long>, bits binary"), "signatures")


def set_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and its sorted shingle hashes as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in _sets(batch.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return docs.mapInArrow(cut, "doc_id long, shingles binary")


def verified(pairs: DataFrame, signed_docs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those that link; written to the shared folder."""
    info = lambda c: signed_docs.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b"))
            most, keep = most_different(na, nb, percent), np.zeros(len(na), bool)
            x, y = (np.array(batch.column(c).to_pylist(), object) for c in ("bits_a", "bits_b"))
            narrow = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64)
            for w in np.unique(narrow[most >= 0]):
                at = np.flatnonzero((narrow == w) & (most >= 0))
                f = folded([*x[at], *y[at]])
                keep[at] = np.bitwise_count(f[: len(at)] ^ f[len(at) :]).sum(axis=1) <= most[at]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    passed = materialise(pairs.join(info("a"), "a").join(info("b"), "b").mapInArrow(bounded, "a long, b long").distinct(), "bounded")
    needed = passed.select(F.col("a").alias("doc_id")).unionByName(passed.select(F.col("b").alias("doc_id"))).distinct()
    sets = materialise(set_rows(docs.join(needed, "doc_id", "left_semi"), shingle), "sets")

    def intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                s = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)]))
                both = int((s[1:] == s[:-1]).sum())
                keep[i] = 100 * both >= percent * (len(s) - both) > 0
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    wide = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}"))
    return materialise(passed.join(wide("a"), "a").join(wide("b"), "b").mapInArrow(intersected, "a long, b long").distinct(), "links")


def tiles_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (key, i, j), one tile after the other."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        k, i, j = (np.asarray(now[c]) for c in ("key", "i", "j"))
        cut = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        at = [0, *cut.tolist()]
        for a, b in zip(at, at[1:], strict=False):
            yield now.slice(a, b - a)
        rest = now.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield rest


def allowed_pairs(rows: pa.Table, maps: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (p, q), p before q, of a tile's pairs of different labels whose bitmaps allow a link; between blocks only those across."""
    label, n, own = (np.asarray(rows[c]) for c in ("label", "n", "own"))
    across = rows["i"][0].as_py() != rows["j"][0].as_py()
    for a in range(0, len(n), 64):
        x = slice(a, a + 64)
        most = most_different(n[x, None], n[None, a:], percent)
        ok = (label[x, None] != label[None, a:]) & (most >= 0) & (np.arange(len(most))[:, None] < np.arange(most.shape[1]))
        if across:
            ok &= own[x, None] != own[None, a:]
        p, q = np.nonzero(ok)
        step = max(1, BITS_AT_ONCE // maps[0].nbytes)
        for i in range(0, len(p), step):
            r, t = p[i : i + step], q[i : i + step]
            fine = np.bitwise_count(maps[r + a] ^ maps[t + a]).sum(axis=1) <= most[r, t]
            if fine.any():
                yield r[fine] + a, t[fine] + a


def dealt_tiles(members: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """Members (key, node, label, n, ...) once for each tile (key, i, j) of their bucket's blocks."""
    sizes = members.groupBy("key").agg(F.count("*").alias("held"), F.sum("n").alias("mass"))
    count = F.ceil(F.greatest(F.col("held") / block_rows, F.col("mass") / block_shingles)).cast("int")
    own = members.join(sizes.select("key", count.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n")


_TILE = "key long, i int, j int, own int, node long, label long, n long"
_TILE_COLUMNS = [c.split()[0] for c in _TILE.split(", ")]


def with_partners(dealt: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Of each tile what its bitmaps leave open; info has (node, bits). Never more rows than the tile has.

    Pairs (node, other) of different labels that may link, if there are no more of them than rows; else
    (key, node, label, n) of the rows that are in any, with other null.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_in(batches):
            some, left, right, count = np.zeros(tile.num_rows, bool), [], [], 0
            for p, q in allowed_pairs(tile, folded(tile["bits"].to_pylist()), percent):
                some[p] = some[q] = True
                count += len(p)
                if count <= tile.num_rows:
                    left.append(p)
                    right.append(q)
            if count:
                few = count <= tile.num_rows
                mine = np.concatenate(left) if few else np.flatnonzero(some)
                rows = tile.select(["key", "node", "label", "n"]).take(pa.array(mine)).combine_chunks()
                other = tile["node"].take(pa.array(np.concatenate(right))).combine_chunks() if few else pa.nulls(len(mine), pa.int64())
                yield from rows.append_column("other", other).combine_chunks().to_batches()

    whole = dealt.join(info, "node").select(*_TILE_COLUMNS, "bits")
    return whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(look, "key long, node long, label long, n long, other long")


class Common:
    """How many shingles pairs of a tile's sets share, counted on bits of those that more than one set holds."""

    def __init__(self, sets: list[np.ndarray]):
        _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        held = count[ids] > 1
        self.row, self.id = row[held], number[ids[held]]
        self.rows, self.width = len(sets), int(number[-1]) + 1 if len(number) else 0
        # Columns are taken in slices, so that the bits stay small however many shingles there are.
        self.slice = max(64, BITS_AT_ONCE * 8 // len(sets) // 64 * 64)
        self.made: dict[int, np.ndarray] = {}

    def of(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        total = np.zeros(len(p), np.int64)
        for start in range(0, self.width, self.slice):
            bits = self._bits(start)
            step = max(1, BITS_AT_ONCE // bits[0].nbytes)
            for i in range(0, len(p), step):
                x = slice(i, i + step)
                total[x] += np.bitwise_count(bits[p[x]] & bits[q[x]]).sum(axis=1, dtype=np.int64)
        return total

    def _bits(self, start: int) -> np.ndarray:
        if start not in self.made:
            wide = -(-min(self.slice, self.width - start) // 64) * 8
            mine = (self.id >= start) & (self.id < start + self.slice)
            at = self.id[mine] - start
            # A set holds a shingle once, so adding bits is joining them.
            bits = np.bincount(self.row[mine] * wide + (at >> 3), weights=1 << (at & 7), minlength=self.rows * wide)
            self.made = {start: bits.astype(np.uint8).reshape(self.rows, wide).view(U)}
        return self.made[start]


def tile_links(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the labels of each tile; sets has (node, shingles)."""

    def decide(tile: pa.Table) -> tuple[list[int], list[int]]:
        # Rows that repeat a doc_id with another text come with each of its sets; a set's own size counts.
        arrays = [np.frombuffer(x.as_buffer(), U) for x in tile["shingles"]]
        node, n = np.asarray(tile["node"]), np.array(list(map(len, arrays)), np.int64)
        tile = tile.set_column(tile.column_names.index("n"), "n", pa.array(n))
        common = Common(arrays)
        root = np.unique(np.asarray(tile["label"]), return_inverse=True)[1]
        a, b = [], []
        for p, q in allowed_pairs(tile, folded([bitmap(x) for x in arrays]), percent):
            apart = root[p] != root[q]
            p, q = p[apart], q[apart]
            both = common.of(p, q)
            linked = 100 * both >= percent * (n[p] + n[q] - both)
            for x, y in zip(p[linked].tolist(), q[linked].tolist(), strict=True):
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    a.append(int(node[x]))
                    b.append(int(node[y]))
        return a, b

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_in(batches):
            a, b = decide(tile)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    whole = dealt.join(sets, "node").select(*_TILE_COLUMNS, "shingles")
    return whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(meet, "a long, b long")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links; written to the shared folder."""
    at = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root"))
    new = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    joined = components(new.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    nodes = found.select("node", "component").unionByName(joined.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    roots = joined.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return materialise(nodes.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "components")


def link(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    docs = docs_of(docs)
    rows = digests(docs, shingle)
    named = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = materialise(named.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # Rows that repeat a doc_id with another text tie their classes together.
    own = rows.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left")
    ties = own.where("rep <> doc_id").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    stand = signatures(docs.join(classes.select(F.col("rep").alias("doc_id"), "h1", "h2"), "doc_id"), shingle, percent)
    buckets = stand.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"), "n")
    shared = materialise(buckets.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "shared")
    members = materialise(buckets.join(shared, "key"), "members")
    weight = members.groupBy("node").agg(F.sum("held").alias("weight"))
    centers = members.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("center"))
    stars = members.join(centers, "key").where("node <> center").select(F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b")).distinct()
    found = components(verified(materialise(stars, "stars"), stand, docs, shingle, percent).unionByName(ties))
    labelled = materialise(members.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("label")), "labelled")
    # In a bucket of two the star was the only pair.
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("held")).where("lo < hi and held > 2").select("key")
    info = stand.select(F.col("doc_id").alias("node"), "bits")
    still = labelled.join(open_keys, "key", "left_semi")
    partners = materialise(with_partners(dealt_tiles(still, block_rows, BLOCK_BITS), info, percent), "partners")
    pairs = partners.where("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    crowds = partners.where("other is null").drop("other").distinct()
    more = verified(pairs, stand, docs, shingle, percent)
    if crowds.head(1):
        needed = docs.join(crowds.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
        sets = materialise(set_rows(needed, shingle).where("length(shingles) > 0"), "sets").withColumnRenamed("doc_id", "node")
        more = more.unionByName(tile_links(dealt_tiles(crowds, block_rows, BLOCK_SHINGLES), sets, percent))
    found = merged(found, more)
    final = found.select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    return own.join(final, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """A pipeline's filter: of each component the document with the smallest doc_id stays; so does a row without doc_id.

    Where doc_ids repeat, each text is judged by itself: of rows that repeat both doc_id and text one
    stays, and other texts of that doc_id stay unless they are near copies of a text that does.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1):
        joined = materialise(link(docs, shingle, percent), "joined")
        going = joined.where("component_id <> doc_id").select("doc_id").distinct()
        return docs.join(going, docs["doc_id"].cast("long") == going["doc_id"], "left_anti")
    # Numbers in the order of doc_id stand for its texts.
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__id"), F.sha2(text, 256).alias("__text"), text.alias("text")).dropDuplicates(["__id", "__text"])
    numbered = materialise(named.sort("__id", "__text").withColumn("doc_id", F.monotonically_increasing_id()), "texts")
    joined = materialise(link(numbered.select("doc_id", "text"), shingle, percent), "joined")
    staying = joined.where("component_id = doc_id").select("doc_id").join(numbered, "doc_id").select("__id", "__text")
    one = docs.withColumn("__text", F.sha2(text, 256)).dropDuplicates(["doc_id", "__text"])
    kept = one.join(staying, (one["doc_id"].cast("long") == staying["__id"]) & (one["__text"] == staying["__text"]), "left_semi")
    return kept.drop("__text").where("doc_id is not null").unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM d
), each_one AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingled
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common
  FROM each_one x JOIN each_one y ON x.g = y.g AND x.doc_id < y.doc_id AND x.n * 100 >= y.n * 90 AND y.n * 100 >= x.n * 90
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs WHERE 100 * common >= 90 * (na + nb - common)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, root) AS (
  SELECT DISTINCT a, a FROM both_ways
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON r.node = e.a WHERE r.root < e.b
), roots AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id
FROM shingled LEFT JOIN roots ON node = doc_id
"""
