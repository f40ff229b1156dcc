import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gridmill.llm import language_id as L
from gridmill.llm import words as W

PLAIN = "some plain words of a text "


def plain_hash(word):
    """The polynomial in whole numbers, one word at a time."""
    p, total = 1, 0
    for b in word:
        total += int(W._T[b]) * p
        p = p * int(W._P) % 2**64
    return int(W.mix(np.array([(total + len(word)) % 2**64], W.U))[0])


def test_hashes_of_words_at_the_ends_of_stretches():
    rng = random.Random(7)
    long = "y" * (W.STRETCH + 5)
    texts = ["x" * (W.STRETCH - 2) + " ab cd", " ".join("w" * rng.randrange(1, 40) for _ in range(9000)), None, "", f"a {long} b", " " * (W.STRETCH + 3) + "é end", "\t \n"]
    data, offsets = W.utf8(pa.array(texts))
    hashes, _, _, rows = W.word_hashes(data, offsets)
    for i, t in enumerate(texts):
        assert hashes[rows[i] : rows[i + 1]].tolist() == [plain_hash(w) for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())]


@pytest.mark.parametrize(("texts", "most"), [([PLAIN * 150] * 1000, 8 << 20), ([PLAIN * 150_000], 60 << 20)])
def test_hashing_holds_little(texts, most):
    """A batch of many texts, and one long text, of 4 MB each: what is held at once is a block's, and of a long text its words, not eight bytes a byte several times over."""
    column = pa.array(texts)
    tracemalloc.start()
    data, offsets = W.utf8(column)
    for i, j in W.blocks(offsets):
        W.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < most


def test_language_of_a_batch_holds_little():
    column, weights = pa.array([PLAIN * 150] * 1000), np.zeros((L.BUCKETS, 4), np.float32)
    tracemalloc.start()
    for texts in L.text_blocks(column):
        L.posterior(texts, list("abcd"), weights)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 12 << 20
