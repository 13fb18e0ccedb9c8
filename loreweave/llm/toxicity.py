"""Toxicity by compression distance: one zstandard dictionary for ordinary text, one for toxic text.

Both are trained on whole texts (words in lower case, one blank between): the
ordinary one on ordinary documents, the toxic one on toxic documents.  Toxic
documents are mostly ordinary prose, which either compressor must know equally
well or chance matches hide the difference.  So one compressor has the ordinary
dictionary and the other has it with the toxic one before it; what the latter
saves on a window is the window's nearness to toxic text.

A window is ``WINDOW`` words; windows start every ``STEP`` words and cover the
whole text.  Each stands between two copies of a carrier that both dictionaries
end with, so even a short window is never stored raw and its length is exact to
the byte.

A document is described by its windows' savings: largest, mean of the three
largest, mean of all, and the shares beyond two thresholds, which are calibrated
as quantiles over ordinary documents apart from the dictionaries'; with the
number of windows a logistic function fitted on those documents gives the
probability, so that what counts as much depends on the text's length.

Where there is too little text for the trainer (some kilobytes), the texts' own
last bytes are the dictionary.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordvec as W
from .folds import held_out, labelled_texts

#: Labelled rows of each label that may be learned from; a quarter of them calibrates.
TRAIN_PER_LABEL = 3000
CARRIER = b"~=~=~=carrier=~=~"
LEVEL = 9
WINDOW, STEP = 8, 6
#: Largest dictionaries, and bytes of text for each byte of one.
ORDINARY_BYTES, TOXIC_BYTES = 1_000_000, 32_768
ORDINARY_RATIO, TOXIC_RATIO = 20, 60
#: Segment and match lengths of the trainer, and bytes of one training sample.
SEGMENT, MATCH, SAMPLE = 16, 8, 1000
#: Shares of ordinary windows below the two thresholds.
QUANTILES = (0.99, 0.999)
#: Windows compressed together.
TOGETHER = 20_000
FEATURES = 6


def _joined(low: bytes, first: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join(b" " + low[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True))


def _plain(text: str | None) -> bytes:
    """All words of a text in lower case, each after one blank."""
    return b"".join(_joined(W._LOWER[raw].tobytes(), *W.word_hashes(raw, offsets, W.ALNUM_WORDS)[1:3]) for _, _, raw, offsets in W.blocks(pa.array([text or ""], pa.large_string())))


def _dictionary(texts: list[bytes], limit: int, ratio: int) -> bytes:
    """Content of a dictionary trained on whole texts, cut into samples."""
    import zstandard

    samples = [t[i : i + SAMPLE] for t in texts for i in range(0, len(t), SAMPLE)]
    random.Random(5).shuffle(samples)
    size = min(limit, sum(map(len, samples)) // ratio)
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL, k=SEGMENT, d=MATCH).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-limit:]


class DistanceModel:
    """Two dictionaries, the thresholds of windows and the logistic function of a document."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = ordinary, toxic
        self.thresholds = np.array([4.0, 6.0])
        self.mean, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights, self.constant = np.zeros(FEATURES), 0.0
        self._coders = None

    def __getstate__(self):
        return self.__dict__ | {"_coders": None}

    def savings(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        import zstandard

        if self._coders is None:
            plain = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
            self._coders = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                held = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=plain)
                self._coders.append(zstandard.ZstdCompressor(dict_data=held, compression_params=plain))
        sizes = np.array([len(w) for w in windows], dtype=np.uint64)
        segments = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1)
        packed = zstandard.BufferWithSegments(b"".join(windows), segments.tobytes())
        one, two = (np.fromiter(map(len, c.multi_compress_to_buffer(packed, threads=1)), np.int64, len(windows)) for c in self._coders)
        return one - two

    def windows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, rows, document of each window, saving of each window) of blocks of whole texts."""
        for low, high, raw, offsets in W.blocks(column):
            _, first, end, counts = W.word_hashes(raw, offsets, W.ALNUM_WORDS)
            many = np.where(counts > 0, -(-np.maximum(counts - WINDOW + STEP, 1) // STEP), 0)
            owner = np.repeat(np.arange(high - low), many)
            stop = np.cumsum(counts)
            at = (stop - counts)[owner] + STEP * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
            upto = np.minimum(at + WINDOW, stop[owner]) if len(owner) else at
            text = W._LOWER[raw].tobytes()
            saved = np.zeros(len(owner), dtype=np.int64)
            for k in range(0, len(owner), TOGETHER):
                a, b = at[k : k + TOGETHER], upto[k : k + TOGETHER]
                words = [b" " + text[x:y] for x, y in zip(first[a[0] : b[-1]].tolist(), end[a[0] : b[-1]].tolist(), strict=True)]
                held = [CARRIER + b"".join(words[x:y]) + b" " + CARRIER for x, y in zip((a - a[0]).tolist(), (b - a[0]).tolist(), strict=True)]
                saved[k : k + TOGETHER] = self.savings(held)
            yield low, high - low, owner, saved

    def described(self, rows: int, owner: np.ndarray, saved: np.ndarray) -> np.ndarray:
        """Features of each document out of its windows' savings; zeros without a window."""
        out = np.zeros((rows, FEATURES))
        count = np.bincount(owner, minlength=rows)
        best = np.lexsort((-saved, owner))
        place = np.arange(len(best)) - np.repeat(np.cumsum(count) - count, count)
        has, many = count > 0, np.maximum(count, 1)
        out[has, 0] = saved[best[place == 0]]
        out[:, 1] = np.bincount(owner[best[place < 3]], saved[best[place < 3]], rows) / 3
        out[:, 2] = np.bincount(owner, saved, rows) / many
        for k, least in enumerate(self.thresholds):
            out[:, 3 + k] = np.bincount(owner, saved > least, rows) / many
        out[:, 5] = np.log1p(count)
        return out

    def features(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for low, rows, owner, saved in self.windows(column):
            yield low, self.described(rows, owner, saved)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.spread @ self.weights + self.constant, -30, 30)))

    def calibrate(self, texts: list[str | None], label: np.ndarray, odds: float) -> None:
        """Thresholds from ordinary texts, then the logistic function by Newton's steps; ``odds`` of label 1 in the whole.

        Prior odds lie halfway (in logarithms) between those of the labels and even
        ones: a toxic text that escapes counts more than an ordinary one reported.
        """
        parts = list(self.windows(pa.array(texts, pa.large_string())))
        owner = np.concatenate([low + o for low, _, o, _ in parts])
        saved = np.concatenate([s for *_, s in parts])
        plain = saved[label[owner] == 0]
        if len(plain):
            self.thresholds = np.quantile(plain, QUANTILES)
        x = self.described(len(texts), owner, saved)
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        a = np.concatenate([(x - self.mean) / self.spread, np.ones((len(x), 1))], axis=1)
        w, ridge = np.zeros(FEATURES + 1), np.diag([0.1] * FEATURES + [1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - label) + ridge @ w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        ones = label.sum()
        self.weights, self.constant = w[:-1], float(w[-1] + math.log(odds) / 2 - math.log(ones / (len(label) - ones)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = TRAIN_PER_LABEL) -> DistanceModel | None:
    """Dictionaries and calibration from a bounded sample of labelled rows that are not held out.

    ``per_label`` rows of each label come to the driver (and their bytes are
    bounded, see ``folds``).  A quarter of them, by place in order of id,
    calibrates.  None without labels of both kinds.
    """
    rows, counts = labelled_texts(docs, labels, id_col, text_col, label_col, per_label)
    kinds = {y: [r["text"] for r in rows if r["label"] == y] for y in (0, 1)}
    if not kinds[0] or not kinds[1]:
        return None
    fit = {y: [t for i, t in enumerate(texts) if i % 4] or texts for y, texts in kinds.items()}
    apart = {y: texts[::4] for y, texts in kinds.items()}
    model = DistanceModel(
        _dictionary([_plain(t) for t in fit[0]], ORDINARY_BYTES, ORDINARY_RATIO),
        _dictionary([_plain(t) for t in fit[1]], TOXIC_BYTES, TOXIC_RATIO),
    )
    label = np.repeat([0, 1], [len(apart[0]), len(apart[1])])
    model.calibrate(apart[0] + apart[1], label, counts[1] / counts[0])
    return model


def _score(model: DistanceModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                zero = pa.array(np.zeros(batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), zero, zero], names=["doc_id", "score", "saving"])
                continue
            for low, x in model.features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(x)), pa.array(model.probability(x)), pa.array(x[:, 2].copy())], names=["doc_id", "score", "saving"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: DistanceModel | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5), saving (mean bytes a window).

    Texts without words have no window and get the score of zero savings; without
    labels to learn from all scores are 0.  Rows of null ids count as held out;
    repeated rows are returned each; see ``labelled_texts`` for odd labels.
    """
    model = model or learn(docs, labels, id_col, text_col, label_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(_score(model), "doc_id long, score double, saving double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "saving")
