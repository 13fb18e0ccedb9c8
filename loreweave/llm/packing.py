"""Packing documents into token windows with a sharded BM25 index.

Routing: a document goes where its rarest shared word sends it, so documents
that have rare words in common meet.  Rarity is the number of documents of a
word, counted over all of them in a sketch of fixed size; a word whose place
counts 1 is nobody else's.  Words of very many documents are split into parts.
The texts are shuffled once by word and part and sorted by them.

In a task, documents in this order make shards of ``SHARD_BYTES`` of text or
``SHARD_ROWS`` documents, whatever comes first.  A shard has an inverted index of
words.  All words of a seed query it, BM25 ranks all documents not yet used, and
they follow the seed in that order until the window is full; a document that
does not fit is cut, its rest starts the next window and is the next seed.  When
no unused document shares a word, the next unused one in order is the next seed.

Windows hold ``WINDOW`` ids.  What is left at the end of a shard goes into
sequences whose lengths are powers of two, which need no padding.

A document's ids are its tokens and the id ``END`` after them, so a null or
empty text is the single id ``END``.  Each id lies in exactly one piece.
Repeated rows are packed each; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordvec as W
from .sketch import count_hashes, places
from .tokens import engine, token_ids

WINDOW = 1024
END = 0
SHARD_BYTES, SHARD_ROWS = 8 << 20, 2048
K1, B = 1.2, 0.75
#: Words in more than this share of a shard's documents have dense rows of weights.
FREQUENT = 0.05
#: Postings added up at once, and neighbours sorted first.
EXPANDED, FIRST = 1_000_000, 32
#: Documents of one routing word that may meet in one place; more are dealt into parts.
ROUTED = 512

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bm25:
    """Inverted index of a shard: word -> documents and weights."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        n = len(counts)
        docs = np.repeat(np.arange(n, dtype=np.int64), counts)
        vocabulary, word = np.unique(words, return_inverse=True)
        pairs, tf = np.unique(word.astype(np.int64) * max(n, 1) + docs, return_counts=True)
        word, doc = pairs // max(n, 1), pairs % max(n, 1)
        df = np.bincount(word, minlength=len(vocabulary))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * counts / max(counts.mean() if n else 1.0, 1e-9))
        weight = idf[word] * tf * (K1 + 1) / (tf + norm[doc])
        self.n, self.word, self.doc, self.weight, self.df = n, word, doc, weight.astype(np.float32), df
        self.bounds = np.concatenate([[0], np.cumsum(df)])
        self.scores: np.ndarray | None = None

    def score_all(self) -> np.ndarray:
        """BM25 of every document (column) for every document's words (row).

        Frequent words are multiplied as dense rows, the others by their postings,
        rows of some documents at a time; words of one document say nothing.
        """
        n, often = self.n, self.df > max(FREQUENT * self.n, 1)
        row = np.cumsum(often) - 1
        dense = np.zeros((int(often.sum()), n), dtype=np.float32)
        some = often[self.word]
        dense[row[self.word[some]], self.doc[some]] = self.weight[some]
        scores = (dense > 0).astype(np.float32).T @ dense
        rare = np.flatnonzero(~some & (self.df[self.word] > 1))
        rare = rare[np.argsort(self.doc[rare], kind="stable")]
        many = self.df[self.word[rare]]
        upto = np.searchsorted(self.doc[rare], np.arange(n + 1))
        expanded = np.concatenate([[0], np.cumsum(many)])
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(expanded[upto], expanded[upto[low]] + EXPANDED, side="right")) - 1)
            high = min(high, low + max(EXPANDED // n, 1), n)
            own = slice(upto[low], upto[high])
            total = int(expanded[upto[high]] - expanded[upto[low]])
            start = self.bounds[self.word[rare[own]]]
            at = np.repeat(start - (expanded[own] - expanded[upto[low]]), many[own]) + np.arange(total)
            flat = np.repeat((self.doc[rare[own]] - low) * n, many[own]) + self.doc[at]
            scores[low:high] += np.bincount(flat, self.weight[at], (high - low) * n).reshape(high - low, n).astype(np.float32)
            low = high
        return scores

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that share a word with ``seed``, best first, ties by order."""
        if self.scores is None:
            self.scores = self.score_all()
        score = self.scores[seed]
        found = np.flatnonzero((score > 0) & ~used)
        if len(found) > 2 * FIRST:  # most windows need but the first few
            least = np.partition(score[found], len(found) - FIRST)[len(found) - FIRST]
            first, rest = found[score[found] >= least], found[score[found] < least]
            yield from first[np.argsort(-score[first], kind="stable")].tolist()
            found = rest
        yield from found[np.argsort(-score[found], kind="stable")].tolist()


def retrieval_order(index: Bm25, lengths: np.ndarray, window: int = WINDOW) -> list[int]:
    """Order in which documents fill the windows: each seed, then its neighbours while the window has room."""
    used = np.zeros(index.n, dtype=bool)
    order: list[int] = []
    fresh, room = 0, window

    def take(doc: int) -> bool:
        """Put ``doc`` next; whether it filled the window."""
        nonlocal room
        used[doc] = True
        order.append(doc)
        room -= int(lengths[doc])
        full = room <= 0
        if full:  # its rest opens the next window
            room = window - (-room % window)
        return full

    seed = -1
    while len(order) < index.n:
        if seed < 0:
            while used[fresh]:
                fresh += 1
            seed = fresh
            take(seed)
        after = -1
        for doc in index.neighbours(seed, used):
            if take(doc):
                after = doc
                break
        seed = after
    return order


def cut(order: list[int], lengths: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of the documents laid end to end."""
    total = int(lengths.sum())
    sizes = [window] * (total // window)
    rest = total % window
    sizes += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    sequence, offset = 0, 0
    for doc in order:
        start, left = 0, int(lengths[doc])
        while left:
            take = min(left, sizes[sequence] - offset)
            yield doc, start, take, sequence, offset
            start, left, offset = start + take, left - take, offset + take
            if offset == sizes[sequence]:
                sequence, offset = sequence + 1, 0


def _pack_shard(ids: list, column: pa.Array, encoder, first_sequence: int) -> tuple[pa.RecordBatch, int]:
    tokens = [np.append(token_ids(t, encoder), np.uint32(END)).astype("<u4") for t in column.to_pylist()]
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    hashes, counts = [], []
    for _, _, raw, offsets in W.blocks(column):
        words, _, _, per_doc = W.word_hashes(raw, offsets, W.ALNUM_WORDS)
        hashes.append(words)
        counts.append(per_doc)
    index = Bm25(np.concatenate(hashes), np.concatenate(counts))
    rows = list(cut(retrieval_order(index, lengths), lengths))
    doc, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
    crc = [zlib.crc32(tokens[d][s : s + n].tobytes()) for d, s, n, _, _ in rows]
    columns = [pa.array([ids[d] for d in doc.tolist()], pa.int64()), start, length, pa.array(crc, pa.int64()), lengths[doc], sequence + first_sequence, offset]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names), int(sequence.max()) + 1


def _pack(vocabulary: str, folder: str | None, shard_bytes: int, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        encoder = engine(vocabulary, folder)
        sequence = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        size = rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held, size, rows
            shard = pa.Table.from_batches(held).combine_chunks()
            texts = pc.fill_null(shard.column(1).combine_chunks(), "")
            out, used = _pack_shard(shard.column(0).to_pylist(), texts, encoder, sequence)
            sequence, held, size, rows = sequence + used, [], 0, 0
            return out

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            low = 0
            for i, n in enumerate(sizes.tolist()):
                size, rows = size + n, rows + 1
                if size >= shard_bytes or rows >= shard_rows:
                    held.append(batch.slice(low, i + 1 - low))
                    low = i + 1
                    yield flush()
            if low < len(sizes):
                held.append(batch.slice(low))
        if held:
            yield flush()

    return run


def _document_words(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The distinct words of each document, as far as ``places`` of their hashes go."""
    for _, _, raw, offsets in W.blocks(batch.column(1)):
        words, _, _, counts = W.word_hashes(raw, offsets, W.ALNUM_WORDS)
        if len(words):
            # A document's number and the rest of the hash in one sortable number.
            bits = np.uint64(len(counts).bit_length())
            both = np.sort(np.repeat(np.arange(len(counts), dtype=np.uint64) << (np.uint64(64) - bits), counts) | words >> bits)
            yield both[np.append(True, both[1:] != both[:-1])] << bits


def _rarest_words(words: np.ndarray, many: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that have words: their place, rarest shared word (ties: the least hash) and its count."""
    doc = np.flatnonzero(many)
    start = np.cumsum(many[doc]) - many[doc]
    n = counts[places(words)]
    shared = np.where(n > 1, n, np.iinfo(np.int64).max)
    best = np.minimum.reduceat(shared, start)
    first = np.minimum.reduceat(np.where(shared == np.repeat(best, many[doc]), words, np.iinfo(np.uint64).max), start)
    return doc, first, counts[places(first)]


def _routed(counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, offsets in W.blocks(batch.column(1)):
                words, _, _, many = W.word_hashes(raw, offsets, W.ALNUM_WORDS)
                key, seen = np.zeros(high - low, dtype=np.int64), np.ones(high - low, dtype=np.int64)
                if len(words):
                    doc, word, n = _rarest_words(words, many, counts)
                    key[doc], seen[doc] = word.view(np.int64), n
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(key), pa.array(seen)], names=["doc_id", "text", "word", "seen"])

    return run


def route(texts: DataFrame) -> DataFrame:
    """(doc_id, text) shuffled and sorted by rarest shared word; documents without words are dealt evenly."""
    counts = count_hashes(texts, _document_words)
    rows = texts.mapInArrow(_routed(counts), "doc_id long, text string, word long, seen long")
    own = F.xxhash64("text", "doc_id")
    part = F.when(F.col("word") == 0, own).otherwise(F.pmod(own, F.ceil(F.col("seen") / ROUTED)))
    return rows.withColumn("part", part).repartition("word", "part").sortWithinPartitions("word", "part", own, "doc_id").select("doc_id", "text")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids are unique: the partition's number and a count within it.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return route(texts).mapInArrow(_pack(vocabulary, folder, shard_bytes, shard_rows), SCHEMA)
