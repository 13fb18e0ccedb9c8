"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its features: hashed words, hashed
pairs of neighbouring words by the difference of their hashes (a word repeated
gives the same pair whatever the word), and hashed n-grams of 3 and 4 characters
of each word with a blank before and after it.  A softmax over the classes follows.
Vectors and output weights are learned together by stochastic gradient descent
(AdaGrad steps) in numpy.

The mean is linear, so for scoring the output weights are folded into the
vectors: a feature then counts by one number, the difference of the two classes.
Features of a text are looked up in blocks of bytes; long texts are not cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordvec as W
from .folds import held_out, labelled_texts

BUCKET_BITS = 16
DIMENSIONS = 8
#: Labelled rows of each label that may be learned from.
TRAIN_PER_LABEL = 2000
EPOCHS = 4
BATCH = 64
RATE = 0.3
THRESHOLD = 0.3
#: Lengths of character n-grams.
NGRAMS = (3, 4)
_SHIFT = np.uint64(64 - BUCKET_BITS)
#: Code points below 256: white space is 0, A-Z count as a-z.
_CODES = np.where(W.BLANK_WORDS, W._LOWER, 0).astype(np.uint32)


def _features(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of the features of a block, kind after kind."""
    docs = len(offsets) - 1
    words, _, _, counts = W.word_hashes(raw, offsets, W.BLANK_WORDS)
    owner = np.repeat(np.arange(docs), counts)
    yield (W.mix64(words ^ np.uint64(1)) >> _SHIFT).astype(np.int64), owner
    same = owner[1:] == owner[:-1]
    yield (W.mix64((words[1:] - words[:-1]) ^ np.uint64(2)) >> _SHIFT).astype(np.int64)[same], owner[1:][same]
    # Characters, a blank before each text and after the last: an n-gram lies within a word but for a blank at its ends.
    text = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    sizes = np.diff(np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets])
    owner = np.append(np.repeat(np.arange(docs), sizes + 1), docs - 1)
    code = np.zeros(len(owner), dtype=np.uint64)
    inside = np.ones(len(owner), dtype=bool)
    inside[np.append(np.cumsum(sizes + 1) - sizes - 1, -1)] = False
    code[inside] = np.where(text < 256, _CODES[np.minimum(text, 255)], text)
    filled = code > 0
    code = W.mix64(code + np.uint64(1))
    for width in NGRAMS:
        for at in range(0, len(code) - width + 1, W.SEGMENT_BYTES):
            stop = min(len(code) - width + 1, at + W.SEGMENT_BYTES)
            total, inner = np.full(stop - at, width, dtype=np.uint64), np.ones(stop - at, dtype=bool)
            for k in range(width):
                total += code[at + k : stop + k] * W.PLACES[k]
                if 0 < k < width - 1:
                    inner &= filled[at + k : stop + k]
            yield (W.mix64(total) >> _SHIFT).astype(np.int64)[inner], owner[at + 1 : stop + 1][inner]


class SubwordModel:
    """Learned vectors and output weights."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray, shift: float) -> None:
        self.vectors, self.output, self.bias, self.shift = vectors, output, bias, shift

    def folded(self) -> tuple[np.ndarray, float]:
        """One number a bucket, and the constant, of the log odds of class 1."""
        turn = self.output[1] - self.output[0]
        return self.vectors @ turn, float(self.bias[1] - self.bias[0]) + self.shift


def document_means(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text, shares adding up to 1."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for low, high, raw, offsets in W.blocks(pa.array(texts, pa.large_string())):
        parts = [(bucket, owner) for bucket, owner in _features(raw, offsets)]
        key = np.concatenate([o.astype(np.int64) << BUCKET_BITS | b for b, o in parts]) if parts else np.zeros(0, np.int64)
        key, counts = np.unique(key, return_counts=True)
        bounds = np.searchsorted(key >> BUCKET_BITS, np.arange(high - low + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n = counts[a:b].astype(np.float32)
            out.append((key[a:b] & (1 << BUCKET_BITS) - 1, n / max(n.sum(), 1.0)))
    return out


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> SubwordModel:
    """Stochastic gradient descent over shuffled batches of document means."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    output, bias = rng.normal(0, 0.5, (2, DIMENSIONS)).astype(np.float32), np.zeros(2, np.float32)
    seen_v = np.full(1 << BUCKET_BITS, 1e-8, np.float32)
    seen_o, seen_b = np.full((2, DIMENSIONS), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
            bucket = np.concatenate([docs[i][0] for i in batch])
            share = np.concatenate([docs[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(docs[i][0]) for i in batch])
            used, slot = np.unique(bucket, return_inverse=True)
            mix = np.zeros((len(batch), len(used)), np.float32)
            mix[owner, slot] = share
            mean = mix @ vectors[used]
            z = mean @ output.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            wrong = (p / p.sum(axis=1, keepdims=True) - target[batch]) / len(batch)
            step_v = mix.T @ (wrong @ output)
            step_o, step_b = wrong.T @ mean, wrong.sum(axis=0)
            seen_v[used] += (step_v**2).mean(axis=1)
            seen_o += step_o**2
            seen_b += step_b**2
            vectors[used] -= rate * step_v / np.sqrt(seen_v[used])[:, None]
            output -= rate * step_o / np.sqrt(seen_o)
            bias -= rate * step_b / np.sqrt(seen_b)
    return SubwordModel(vectors, output, bias, 0.0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = TRAIN_PER_LABEL) -> SubwordModel | None:
    """A model from a bounded sample of labelled rows that are not held out.

    ``per_label`` rows of each label come to the driver (their bytes are bounded,
    see ``folds``); the log odds are then shifted from the sample's share of labels to that of all rows learned from.
    None without labels of both kinds.
    """
    rows, counts = labelled_texts(docs, labels, id_col, text_col, label_col, per_label)
    got = np.array([r["label"] for r in rows], dtype=np.int64)
    if len(set(got.tolist())) < 2:
        return None
    model = train(document_means([r["text"] for r in rows]), got)
    model.shift = math.log(counts[1] / counts[0]) - math.log(got.sum() / (len(got) - got.sum()))
    return model


def _score(weights: np.ndarray, constant: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, offsets in W.blocks(batch.column(1)):
                total, count = np.zeros(high - low), np.zeros(high - low)
                for bucket, owner in _features(raw, offsets):
                    total += np.bincount(owner, weights[bucket], high - low)
                    count += np.bincount(owner, minlength=high - low)
                odds = total / np.maximum(count, 1) + constant
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(1 / (1 + np.exp(-odds)))], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", model: SubwordModel | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score (probability of label 1), predicted (score >= 0.3).

    Empty and null texts get the score of no feature: the constant alone.  Without
    labels to learn from every score is 0.5.  Rows of null ids count as held out;
    repeated rows are returned each.
    """
    model = model or learn(docs, labels, id_col, text_col, label_col)
    weights, constant = model.folded() if model else (np.zeros(1 << BUCKET_BITS), 0.0)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(_score(weights.astype(np.float32), constant), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
