"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram's vector is the
product of its letters' vectors, the first permuted twice and the second once
(cyclic shifts), so order counts.  A text's profile is the sum of its trigrams'
vectors; a language's prototype is the sum of the normalised profiles of its
training texts.  The prototype with the largest cosine to a text names its
language.

Letters are lower-cased; runs of anything else are one blank; a text starts and
ends with a blank.  Every letter of any script has a vector of its own, made from
its code point.  Texts are read in segments, so a long one needs no more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordvec as W
from .folds import bounded_sample, held_out
from .rowwise import passing

DIMENSIONS = 512
#: Training texts of each language; prototypes need no more.
TRAIN_PER_LANGUAGE = 1500
UNKNOWN = "und"
#: Bytes and texts taken together, characters of a segment, trigrams multiplied at once, trigrams whose vectors are kept.
BLOCK, TEXTS, SEGMENT, AT_ONCE, KEPT = 1 << 18, 96, 1 << 18, 1 << 13, 1 << 15
#: Languages learned from: the most frequent ones.
LANGUAGES = 1024

_tables: dict[str, np.ndarray] = {}


def _lower_letters() -> np.ndarray:
    """Code point -> its letter in lower case, 0 for all but letters."""
    if "letters" not in _tables:
        table = np.zeros(0x110000, dtype=np.int64)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                table[c] = ord(ch.lower()[0])
        _tables["letters"] = table
    return _tables["letters"]


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """+1 and -1 for each letter (0: the blank), the same in every process."""
    words = -(-dimensions // 64)
    seeds = W.mix64(points.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    bits = W.mix64(seeds[:, None] + W._sequence(31, words)[None, :])
    return (np.unpackbits(bits.view(np.uint8), axis=1)[:, :dimensions].astype(np.int8) << 1) - 1


class Profiler:
    """Profiles of texts; vectors of the trigrams seen last are kept, ``KEPT`` at most."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.codes = np.zeros(0, dtype=np.int64)
        self.vectors = np.zeros((0, dimensions), dtype=np.int8)

    def _bound(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of trigrams: the letters' vectors turned by 2, 1 and 0 places, multiplied."""
        points = [codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]
        letters, place = np.unique(np.concatenate(points), return_inverse=True)
        vectors = letter_vectors(letters, self.dimensions)
        a, b, c = np.split(place, 3)
        return np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]

    def _of(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct trigrams."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        out = np.empty((len(codes), self.dimensions), dtype=np.int8)
        out[known] = self.vectors[at[known]]
        if not known.all():
            out[~known] = self._bound(codes[~known])
            if len(self.codes) + np.count_nonzero(~known) > KEPT:
                self.codes, self.vectors = codes[:KEPT].copy(), out[:KEPT].copy()
            else:
                both = np.concatenate([self.codes, codes[~known]])
                order = np.argsort(both, kind="stable")
                self.codes, self.vectors = both[order], np.concatenate([self.vectors, out[~known]])[order]
        return out

    def profiles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(profile of each text, whether it has a letter)."""
        return self.measured(texts)[:2]

    def measured(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(profile of each text, whether it has a letter, number of its trigrams)."""
        n = len(texts)
        ends = np.cumsum([len(t or "") + 2 for t in texts])
        joined = " " + "  ".join(t or "" for t in texts) + " "
        x, lettered, trigrams = np.zeros((n, self.dimensions), dtype=np.float32), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        last = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # the two letters before, and their texts
        for at in range(0, len(joined), SEGMENT):
            points = np.frombuffer(joined[at : at + SEGMENT].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            letter = np.concatenate([last[0], _lower_letters()[points]])
            doc = np.concatenate([last[1], np.searchsorted(ends, np.arange(at, at + len(points)), side="right")])
            keep = np.ones(len(letter), dtype=bool)
            keep[1:] = (letter[1:] > 0) | (letter[:-1] > 0) | (doc[1:] != doc[:-1])
            letter, doc = letter[keep], doc[keep]
            lettered |= np.bincount(doc[letter > 0], minlength=n) > 0
            last = letter[-2:], doc[-2:]
            whole = doc[:-2] == doc[2:]
            code, owner = (letter[:-2] << 42 | letter[1:-1] << 21 | letter[2:])[whole], doc[:-2][whole]
            trigrams += np.bincount(owner, minlength=n)
            distinct, place = np.unique(code, return_inverse=True)
            for low in range(0, len(distinct), AT_ONCE):
                some = distinct[low : low + AT_ONCE]
                mine = (place >= low) & (place < low + len(some)) if len(distinct) > AT_ONCE else slice(None)
                counts = np.bincount(owner[mine] * len(some) + place[mine] - low, minlength=n * len(some)).reshape(n, len(some))
                x += counts.astype(np.float32) @ self._of(some).astype(np.float32)
        return x, lettered, trigrams


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    import pyarrow.compute as pc

    from .tokens import balanced

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for low, high in balanced(sizes, BLOCK):
        for at in range(low, high, TEXTS):
            yield at, column.slice(at, min(TEXTS, high - at)).to_pylist()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _bundles(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(dimensions), {}
        for batch in batches:
            for at, texts in _blocks(batch.column(1)):
                x, _ = profiler.profiles(texts)
                x = _unit(x)
                langs = np.array(batch.column(0).slice(at, len(texts)).to_pylist(), dtype=object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + x[langs == lang].sum(axis=0, dtype=np.float64)
        columns = [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "bundle"])

    return run


class LanguageModel:
    """Prototypes of languages."""

    def __init__(self, languages: list[str], prototypes: np.ndarray) -> None:
        self.languages, self.prototypes = languages, _unit(prototypes.astype(np.float32)) if languages else prototypes

    def predictor(self):
        languages, prototypes = self.languages, self.prototypes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            profiler = Profiler(prototypes.shape[1])
            names = np.array([*languages, UNKNOWN], dtype=object)
            for batch in batches:
                for at, texts in _blocks(batch.column(1)):
                    x, lettered = profiler.profiles(texts)
                    cosine = _unit(x) @ prototypes.T if languages else np.zeros((len(texts), 0))
                    best = np.where(lettered, cosine.argmax(axis=1), len(languages)) if languages else np.zeros(len(texts), int)
                    score = np.where(lettered, cosine.max(axis=1), 0.0) if languages else np.zeros(len(texts))
                    columns = [batch.column(0).slice(at, len(texts)), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1).astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

        return run


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, dimensions: int = DIMENSIONS) -> LanguageModel:
    """Prototypes out of a bounded sample of the rows that are not held out.

    Partial sums of profiles come from the executors: one vector for each
    language and task.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sample = bounded_sample(rows, "doc_id", "lang", per_language, LANGUAGES).select("lang", "text")
    sums = sample.mapInArrow(_bundles(dimensions), "lang string, bundle array<double>")
    parts = sums.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    got = parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("x")).orderBy("lang").collect()
    return LanguageModel([r["lang"] for r in got], np.array([r["x"] for r in got]).reshape(len(got), dimensions))


#: Length classes (powers of two of trigrams) and steps of the cosine in which bounds are fitted.
CLASSES, STEPS = 32, 200
#: A bound is this share of the class's median cosine (letters of sf0.1's texts in random order stay below it from 64 letters
#: on), but at least so many times the lower quartile's distance below the median; and how many texts a class needs for one.
BOUND_SHARE, BOUND_SPREADS, BOUND_TEXTS = 0.4, 5, 50


def _length_class(trigrams: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(trigrams, 1)).astype(np.int64), 0, CLASSES - 1)


def _histogram(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, counts = Profiler(model.prototypes.shape[1]), np.zeros(CLASSES * STEPS, dtype=np.int64)
        places = {lang: i for i, lang in enumerate(model.languages)}
        for batch in batches:
            for at, texts in _blocks(batch.column(1)):
                x, lettered, trigrams = profiler.measured(texts)
                own = np.array([places[g] for g in batch.column(0).slice(at, len(texts)).to_pylist()], dtype=np.int64)
                cosine = (_unit(x) * model.prototypes[own]).sum(axis=1)
                step = np.clip((cosine * STEPS).astype(np.int64), 0, STEPS - 1)
                counts += np.bincount((_length_class(trigrams) * STEPS + step)[lettered], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["at", "n"])

    return run


def cosine_bounds(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """Least cosine of a text in a learned language, for each class of lengths.

    A class's bound follows from median and lower quartile of all its training
    texts' cosines to their own language, which a few odd texts do not move, and
    is no higher than those of longer texts.  A class of fewer than
    ``BOUND_TEXTS`` has no bound of its own: it takes that of the next shorter
    class, the shortest ones none.
    """
    if not model.languages:
        return np.zeros(CLASSES)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isin(model.languages) & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = np.zeros(CLASSES * STEPS, dtype=np.int64)
    for r in rows.select("lang", "text").mapInArrow(_histogram(model), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    counts = counts.reshape(CLASSES, STEPS)
    total = counts.sum(axis=1)
    middle, low = ((np.cumsum(counts, axis=1) >= q * total[:, None]).argmax(axis=1) / STEPS for q in (0.5, 0.25))
    own = np.maximum(np.minimum(BOUND_SHARE * middle, middle - BOUND_SPREADS * (middle - low)), 0)
    fitted = np.flatnonzero(total >= BOUND_TEXTS)
    bounds = np.zeros(CLASSES)
    for i, k in enumerate(fitted.tolist()):
        upto = fitted[i + 1] if i + 1 < len(fitted) else CLASSES
        bounds[k:upto] = own[fitted[i:]].min()
    return bounds


def _known(model: LanguageModel, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(model.prototypes.shape[1])
        for batch in batches:
            for at, texts in _blocks(batch.column(1)):
                x, known, trigrams = profiler.measured(texts)
                if model.languages:
                    known = known & ((_unit(x) @ model.prototypes.T).max(axis=1) >= bounds[_length_class(trigrams)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(known, pa.bool_())], names=["doc_id", "known"])

    return run


def in_known_language(docs: DataFrame, model: LanguageModel, bounds: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in a known language, columns as they are; each row is judged by itself.

    A text is known if it has a letter and its best cosine reaches the bound of
    its length; without any prototype every text with a letter is.
    """
    return passing(docs, _known(model, bounds), "known", True, text_col)


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (cosine, 0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if nothing could be learned.  Rows of null ids count as held out;
    repeated rows are returned each; languages seen in training are the only
    other answers.  Ties go to the language first in order.
    """
    model = model or learn(docs, id_col, text_col, lang_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(model.predictor(), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
