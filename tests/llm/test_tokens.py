"""Token counts and packing: the library itself, and exact round trips."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from loreweave.llm import packing, tokens
from loreweave.llm.packing import pack
from loreweave.llm.sketch import places
from loreweave.llm.tokens import count_tokens

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, n_tokens long, start long"
ODD = ["", None, " ", "\n\n", "<|endoftext|>", "a<|endoftext|> b", "it's  we'll\t x", "é" * 5, "  lead", "trail  ", "1" * 300, "a" * 5000, "한글 テキスト 😀", "\x00\x01", "'s 's"]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA)


def test_ids_equal_the_library_on_whole_corpora():
    engine = tokens.engine()
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ODD
    for t in texts:
        assert tokens.token_ids(t, engine).tolist() == library_ids(t)


def test_ids_equal_the_library_on_code_points():
    engine = tokens.engine()
    points = [c for c in [*range(0x3200), *range(0x3200, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}a 1{chr(c)}1 {chr(c)} {chr(c)}{chr(c)}  {chr(c)}." for c in points]
    got = [tokens.token_ids(t, engine).tolist() for t in texts]
    assert got == [e.ids for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]


def test_safe_parts_give_the_ids_of_the_whole(monkeypatch):
    rng = random.Random(2)
    engine = tokens.engine()
    bits = [" ", "  ", "\n", "word", "x", "'s", "42", "<|endoftext|>", "é", "!?", " ", "\t "]
    for size in (1, 5, 40):
        for _ in range(200):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
            parts = list(tokens.parts(text, size))
            assert "".join(parts) == text
            assert [i for p in parts for i in library_ids(p)] == library_ids(text)
    monkeypatch.setattr(tokens, "PART_CHARS", 50)
    long = "The quick brown fox. " * 3000 + "x" * 70_000
    assert tokens.token_ids(long, engine).tolist() == library_ids(long)


def test_long_runs_of_blanks(spark):
    engine = tokens.engine()
    for blank in (" ", "\n", "\t", " \n", "\u3000", "\xa0 "):
        run = blank * (300_000 // len(blank))
        for text in (f"word{run}end", run, f"a{run}", f"{run}b c", f"x{run}<|endoftext|>{run}y {run}", f"{run}\x1c{run}"):
            assert tokens.token_ids(text, engine).tolist() == library_ids(text)
    for blank in (" ", "\t", "\n", " \t\n"):
        text = "word" + blank * 2_000_000 + "end"
        assert engine.decode(tokens.token_ids(text, engine).tolist()) == text
    rows = [(1, "word" + " " * 2_000_000 + "end"), (2, "\n" * 1_500_000), (3, "a b")]
    counts = {r["doc_id"]: r["n_tokens"] for r in count_tokens(table(spark, rows)).collect()}
    assert counts == {i: len(tokens.token_ids(t, engine)) for i, t in rows}
    assert sum(r["length"] for r in pack(table(spark, rows)).collect()) == sum(counts.values()) + 3


def test_counts(spark):
    rows = [*enumerate(ODD), (3, "again"), (None, "no id"), (99, "long text " * 60_000)]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(table(spark, rows)).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library_ids(t)), n > 1024) for i, t in rows]
    assert got == sorted(want, key=str)
    assert count_tokens(table(spark, [])).count() == 0


def test_batches_are_balanced():
    runs = list(tokens.balanced(np.array([5, 5, 100, 1, 1]), 10))
    assert runs == [(0, 2), (2, 3), (3, 5)]


def checked(rows, pieces):
    """Every id of every document once, sequences gapless and within the window; returns the padding."""
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array([*library_ids(t), 0], dtype="<u4"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        lengths = sorted(len(x) for x in ids[i])
        assert sum(p["length"] for p in parts) == sum(lengths) and all(p["doc_tokens"] in lengths for p in parts)
        for p in parts:
            assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in ids[i])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding


def test_packing_is_an_exact_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["red", "blue", "sky", "tree"]) + str(rng.randrange(9)) for _ in range(rng.choice([0, 3, 80, 900])))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "same text"), (102, "same text"), (None, "no id"), (103, "long " * 30_000)]
    pieces = pack(table(spark, rows).repartition(3), shard_bytes=4000).collect()
    assert checked(rows, pieces) == 0
    for i in range(80):
        spans = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == i)
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
    assert pack(table(spark, [])).count() == 0


def test_neighbours_share_words_and_fill_windows():
    texts = ["apple pear plum apple", "iron steel iron", "apple pear fig", "steel iron tin", "plum fig pear", "zinc"]
    hashes, counts = [], []
    for _, _, raw, offsets in packing.W.blocks(pa.array(texts)):
        w, _, _, c = packing.W.word_hashes(raw, offsets, packing.W.ALNUM_WORDS)
        hashes.append(w)
        counts.append(c)
    index = packing.Bm25(np.concatenate(hashes), np.concatenate(counts))
    used = np.zeros(6, dtype=bool)
    used[0] = True
    assert set(index.neighbours(0, used)) == {2, 4}
    assert list(index.neighbours(5, used)) == []
    order = packing.retrieval_order(index, np.array([3, 3, 3, 3, 3, 3]), window=9)
    assert sorted(order) == list(range(6)) and set(order[:3]) == {0, 2, 4}


def bm25(words, counts):
    """Score of each document for each document's words, word by word."""
    docs, n = np.split(words, np.cumsum(counts)[:-1]), len(counts)
    df = {w: sum(w in d for d in docs) for w in set(words.tolist())}
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            for w in set(docs[i].tolist()):
                tf = (docs[j] == w).sum()
                if tf and df[w] > 1:
                    out[i, j] += np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * counts[j] / counts.mean()))
    return out


def test_all_scores_and_orders_equal_brute_force(monkeypatch):
    monkeypatch.setattr(packing, "EXPANDED", 50)
    monkeypatch.setattr(packing, "FIRST", 3)
    rng = np.random.default_rng(1)
    for n in (1, 5, 40):
        counts = rng.integers(1, 12, n)
        words = rng.integers(1, 25, counts.sum()).astype(np.uint64)
        index = packing.Bm25(words, counts)
        want = bm25(words, counts)
        assert np.allclose(index.score_all(), want, atol=1e-4)
        used = rng.random(n) < 0.3
        for seed in range(n):
            got = list(index.neighbours(seed, used))
            assert set(got) == set(np.flatnonzero((want[seed] > 0) & ~used).tolist())
            assert all(want[seed, a] >= want[seed, b] - 1e-4 for a, b in zip(got, got[1:]))


def test_documents_with_a_rare_word_in_common_meet(spark):
    rng = random.Random(4)
    common = lambda: " ".join(rng.choice(["red", "blue", "sky", "tree"]) for _ in range(60))
    rows = [(i, f"{common()} rareword{i % 50}x") for i in range(200)] + [(900, None), (901, "")]
    near = packing.route(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    place = {r["doc_id"]: k for k, r in enumerate(near)}
    assert len(near) == 202
    for k in range(50):
        at = sorted(place[i] for i in range(k, 200, 50))
        assert at[-1] - at[0] == 3


def test_bm25_equals_the_formula():
    docs = [["a", "b", "a"], ["a", "c"], ["b", "c", "d", "d"]]
    code = {w: np.uint64(i + 1) for i, w in enumerate("abcd")}
    index = packing.Bm25(np.array([code[w] for d in docs for w in d]), np.array([3, 2, 4]))
    at = {int(w): k for k, w in enumerate(np.unique([code[x] for x in "abcd"]))}
    for w in "abcd":
        k = at[int(code[w])]
        df = sum(w in d for d in docs)
        for j in range(index.bounds[k], index.bounds[k + 1]):
            d = docs[index.doc[j]]
            tf, norm = d.count(w), 1.2 * (1 - 0.75 + 0.75 * len(d) / 3)
            assert np.isclose(index.weight[j], np.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + norm))


def test_routing_takes_little_more_than_reading_the_words():
    """The rarest word of each document by definition, and by far the most time goes to the hashes of the words."""
    rng = np.random.default_rng(7)
    some = np.array([f"w{i}" for i in range(30_000)])
    texts = [" ".join(some[(len(some) * rng.random(200) ** 3).astype(int)].tolist()) for _ in range(3000)] + ["", None, "w0 w0", "alone"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])

    def least(run):
        took = []
        for _ in range(3):
            start = time.process_time()
            out = run()
            took.append(time.process_time() - start)
        return min(took), out

    blocks = lambda: [packing.W.word_hashes(raw, offsets, packing.W.ALNUM_WORDS) for _, _, raw, offsets in packing.W.blocks(batch.column(1))]
    own, hashed = least(blocks)
    seen = np.zeros(1 << 18, dtype=np.int64)
    for words, _, _, many in hashed:
        for doc in np.split(words, np.cumsum(many)[:-1]):
            np.add.at(seen, places(np.unique(doc)), 1)
    counted, found = least(lambda: list(packing._document_words(batch)))
    assert (sum(np.bincount(places(w), minlength=len(seen)) for w in found) == seen).all()
    routed, rows = least(lambda: list(packing._routed(seen)(iter([batch]))))
    want = []
    for words, _, _, many in hashed:
        for doc in np.split(words, np.cumsum(many)[:-1]):
            best = min(((n if (n := seen[places(w)]) > 1 else 1 << 62, w, n) for w in np.unique(doc)), default=(0, np.uint64(0), 1))
            want.append((int(best[1].view(np.int64)), int(best[2])))
    assert [(w, n) for r in rows for w, n in zip(r["word"].to_pylist(), r["seen"].to_pylist(), strict=True)] == want
    assert counted + routed < 4.5 * own
