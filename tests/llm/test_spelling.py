"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loreweave.llm import spelling
from loreweave.llm.spelling import PositionIndex, spelling_variants


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def expected(rows, least=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= 5
    n = {w: k for w, k in counts.items() if k >= least}
    near = {w: [x for x in n if one_error(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def made_rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(40)] + ["ab" * 60, "b" * 70, "ÀÉÎÕÜ÷×"]
    words = []
    for k, w in enumerate(base * 3):
        i = rng.randrange(len(w))
        words += [w] * (1 + k % 9) + [w[:i] + rng.choice("abc") + w[i + rng.randint(0, 1) :]] * 3
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "\n"]).join(words[i::60]).replace("a", rng.choice("aA"))) for i in range(60)]
    return [*rows, rows[0], (None, "anything anything anything anythink anythink anythink"), (98, None), (99, ""), (100, "x" * 300_000 + " short")]


@pytest.mark.parametrize("bin_rows", [2048, 8])
def test_equal_to_brute_force(spark, monkeypatch, bin_rows):
    """Also where every block is hot and dealt over several indexes."""
    monkeypatch.setattr(spelling, "BIN_ROWS", bin_rows)
    monkeypatch.setattr(spelling, "LONG_LENGTH", 7 if bin_rows == 8 else 64)
    rows = made_rows()
    table = spark.createDataFrame([(i, t, "w", 5) for i, t in rows], "doc_id long, text string, word string, n int")
    got = {r["word"]: tuple(r) for r in spelling_variants(spark, table).collect()}
    want = expected(rows)
    assert got == want
    assert sum(1 for r in want.values() if r[1]) > 20 and any(r[2] != r[1] for r in want.values() if r[1])


def test_index_follows_all_errors():
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    index = PositionIndex(words)
    for n in range(1, 8):
        queries = [w for w in words if len(w) == n]
        bits = index.near(np.array([[ord(c) for c in w] for w in queries], dtype=np.uint32))
        found = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, : len(words)]
        for q, row in zip(queries, found, strict=True):
            assert [words[i] for i in np.flatnonzero(row)] == [w for w in words if one_error(q, w)]


def test_no_words(spark):
    table = spark.createDataFrame([(1, "a an the", "x")], "doc_id long, text string, root string")
    assert spelling_variants(spark, table).count() == 0
    assert spelling_variants(spark, table.limit(0)).count() == 0
