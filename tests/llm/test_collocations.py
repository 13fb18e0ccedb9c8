"""Quotient filters round trip and merge; collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loreweave.llm import collocations as C
from loreweave.llm import quotient as Q


@pytest.mark.parametrize(("bits", "cell_bits"), [((5, 5), 0), ((5, 5), 3), ((17, 17), 5), ((34, 17), 2), ((44, 44), 12), ((1, 1), 1)])
def test_filters_are_lossless(bits, cell_bits):
    rng = np.random.default_rng(sum(bits))
    size = min(3000, 1 << min(sum(bits) - 1, 12))
    left, right = (rng.integers(0, 1 << b, size).astype(np.uint64) for b in bits)
    left[: size // 3], right[: size // 3] = left[0], right[0]  # one n-gram of a third of all
    want = Counter(zip(left.tolist(), right.tolist(), strict=True))
    halves = Q.permuted(left, right, bits)
    assert all((a == b).all() for a, b in zip(Q.restored(*halves, bits), (left, right), strict=True))
    parts = [Q.tallied(*(h[k::3] for h in halves), bits) for k in range(3)]
    by_cell = defaultdict(list)
    for part in parts:
        for cell, data in zip(*Q.cells(*part, bits, cell_bits), strict=True):
            by_cell[cell].append((data, cell))
            back = Q.entries(data, cell, bits)
            assert (back[0] >> np.uint64(bits[0] - cell_bits) == cell).all()
    got = Counter()
    for filters in by_cell.values():
        a, b, n = Q.merged(filters, bits)
        order = np.lexsort((b, a))
        assert (order == np.arange(len(a))).all()
        a, b = Q.restored(a, b, bits)
        got.update(dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)))
    assert got == want


def test_filters_are_compact():
    rng = np.random.default_rng(1)
    bits = (17, 17)
    rows = Q.tallied(*Q.permuted(*(rng.integers(0, 1 << 17, 100_000).astype(np.uint64) for _ in bits), bits), bits)
    _, filters = Q.cells(*rows, bits, 4)
    assert sum(map(len, filters)) < 3 * len(rows[0])  # of sixteen bytes and a count as numbers


def expected(rows, least, top=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        text = "".join(c.lower() if c < "\x80" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3, 4):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        frequent = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        longer = [(p, n) for p, n in frequent.items() if len(p) > 2]
        for p, a in frequent.items():
            inside = [n for q, n in longer if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * n >= 80 * a for n in inside):
                score, cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        n = sum(v for p, v in f.items() if len(p) == 1)
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def made_rows():
    rng = random.Random(7)
    words = ["the", "of", "éa", "New", "york", "x-1", "日本", "a" * 300, "b" * 300 + "c", "q", "averylongword"]
    rows = []
    for _ in range(500):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ";"]) for _ in range(60))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text + "new york city hall " * 5))
    return [*rows, ("en", None), ("en", ""), ("fr", " .\n,"), rows[0], ("en", "of the " * 60_000 + "."), ("en", "\x85 \xa0 \x1c")]


@pytest.mark.parametrize("limits", [{}, {"MAX_IDS": 6, "TEXT_BYTES": 3000, "HELD": 500, "CELL_GRAMS": 50, "CELL_BITS": 2}, {"MAX_IDS": 0}])
def test_equal_to_brute_force(spark, monkeypatch, limits):
    """Also with words without ids, many flushes, and filters merged in two rounds."""
    for name, value in limits.items():
        monkeypatch.setattr(C, name, value)
    rows = made_rows()
    table = spark.createDataFrame([(lang, text, "p", 1) for lang, text in rows], "lang string, text string, phrase string, n int").repartition(3)
    got = sorted(tuple(r) for r in C.collocations(spark, table).collect())
    assert got == expected(rows, 30)
    assert len({r[0] for r in got}) == 3 and len(got) > 50


def test_top_ties_and_least(spark):
    rows = [("en", "a b. c d. e f. b a")] * 3 + [("en", "g h")] * 2
    table = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in C.collocations(spark, table, least=2, top=3).collect())
    assert got == expected(rows, 2, 3) and len(got) == 3


def test_no_candidates(spark):
    table = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    assert C.collocations(spark, table).count() == 0
    assert C.collocations(spark, table.limit(0)).count() == 0


def test_shared_hashes_are_noticed(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["one two three"])], names=["lang", "text"])
    list(C._count_words(5)(iter([batch])))
    hashes = C.W.word_hashes
    monkeypatch.setattr(C.W, "word_hashes", lambda *a: (hashes(*a)[0] * np.uint64(0), *hashes(*a)[1:]))
    with pytest.raises(C.SharedHash):
        list(C._count_words(5)(iter([batch])))
