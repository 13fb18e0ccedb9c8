"""Encoding by speculation and verification: the library itself, and decoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from loreweave.llm import bpe

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BITS = ["'", "s", "re", "ll", "'s", "x", "the", "ing", " ", "\n", "é", "É", "ß", "12", "<|endoftext|>", "<|startoftext|>", "<|", "!", "ʼ", "Σ", "İ", "́", "日本", "😀", "ſ", "\x85", "\xa0", "\x1c", "\x00"]


def library(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library_on_documents_and_mixtures():
    rng = random.Random(3)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert bpe.vocabulary().ids(texts) == library(texts)


def test_ids_equal_the_library_on_code_points():
    points = [c for c in [*range(0x3200), *range(0x3200, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}a 1{chr(c)}1 {chr(c)} {chr(c)}{chr(c)}  {chr(c)}.'{chr(c)}'s" for c in points]
    assert bpe.vocabulary().ids(texts) == library(texts)


def test_words_of_repeated_letters_and_long_words(monkeypatch):
    rng = random.Random(4)
    words = ["a" * n for n in range(1, 80)] + ["ab" * 3000, "x" * 10_000, "é" * 3000]
    words += ["".join(rng.choice("aeinstrohl") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    want = library(words)
    own = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    assert own.ids(words) == want
    monkeypatch.setattr(bpe, "LONG_WORD", 3)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    assert bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json")).ids(words) == want


def test_pairs_are_judged_as_the_merges_do():
    """A pair of sound tokens fails exactly if merging the letters of both gives something else."""
    words = bpe.vocabulary()
    rng = np.random.default_rng(5)
    sound = words.token[words.token >= 0]
    inner = np.array([i for i in sound.tolist() if not words.strings[i].endswith("</w>")])
    a, b = rng.choice(inner, 4000), rng.choice(sound, 4000)
    crossed = words._crossed(a, b)
    letters = lambda i: bytes(words.letters[c] for c in words.strings[i].removesuffix("</w>"))
    seen = 0
    for x, y, bad in zip(a.tolist(), b.tolist(), crossed.tolist(), strict=True):
        if words.strings[y].endswith("</w>"):
            seen += 1
            assert (words.merge(letters(x) + letters(y)) != (x, y)) == bad
    assert seen > 1000 and 100 < crossed.sum() < 3900


def test_proposals_fail_and_are_mended():
    words = bpe.vocabulary()
    texts = [w.encode() for w in ("thandedre", "ndertion", "inging", "asheath")]
    ids, counts = words.propose(texts)
    assert counts.sum() == len(ids)
    proposed = [tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1])]
    merged = [words.merge(t) for t in texts]
    assert words.word_ids(texts) == merged and proposed != merged


def test_failing_words_are_merged_in_step(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeinstrohlé0") for _ in range(rng.choice((1, 2, 3, 8, 9, 16, 17, 31)))).encode() for _ in range(5000)]
    own = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    one_by_one = [own.merge(w) for w in words]
    assert own.merge_all(words) == one_by_one and own.merge_all([]) == []
    monkeypatch.setattr(own, "merge", None)  # word by word it took most of the time
    assert own.word_ids(words) == one_by_one


def test_round_trip_of_odd_rows(spark, monkeypatch):
    texts = ["", None, " ", "<|endoftext|>x<|startoftext|>", "It's THE end", "日本 İ ŉ", "word" + " " * 2_000_000 + "end", "many words here " * 90_000, "It's THE end"]
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, "no id", "n", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens int")
    got = {r["doc_id"]: r for r in bpe.round_trip(table).collect()}
    assert len(got) == len(rows)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t, _, _ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert tuple(got[i])[1:] == (len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False)))
    encoded = bpe.encode(table)
    assert {r["doc_id"]: len(r["ids"]) for r in encoded.collect()} == {i: r["n_tokens"] for i, r in got.items()}
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()}
    assert {i: digest(t) for i, t in decoded.items()} == {i: r["decoded_sha256"] for i, r in got.items()}
    assert bpe.round_trip(table.limit(0)).count() == 0
