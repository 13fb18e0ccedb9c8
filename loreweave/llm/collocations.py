"""Collocations: phrases whose words occur together more than apart, counted in quotient filters.

Words are counted first.  A phrase that occurs often has only words, and only
pairs of neighbours, that do; so the second pass counts pairs of frequent words,
and the third triples and quadruples of frequent pairs.  Counts below
``least`` are never asked for, so leaving those phrases out loses nothing.

A task packs the ids of its n-grams, permutes, sorts and counts them, and sends
one counting quotient filter for each cell (see ``quotient``); filters of a cell
are merged in one task.  Cells are sized by the number of words of the corpus.
Beyond ``2 ** CELL_BITS`` cells, filters are merged in two rounds, first within
bundles of tasks, so that filters stay large however many cells there are.

Ids are places in the sorted hashes of the ``MAX_IDS`` most frequent words (of
a language), which every task holds.  N-grams with a rarer word that is still
frequent are counted as rows of word hashes.  Hashes have 64 bits and a secret
seed for each run; two words of one hash are looked for and start the run anew.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import quotient as Q
from . import wordvec as W
from .sketch import BitTable, bit_table
from ..sources.staging import Stage

LEAST, MOST_WORDS, TOP = 30, 4, 2000
#: A candidate is dropped if a longer one has this percentage of its count.
COVERED_PERCENT = 80
MAX_IDS = 1 << 22
#: N-grams that a task holds before it makes filters of them.
HELD = 1 << 21
#: N-grams of a cell, at most about; bits of the cells of one round.
CELL_GRAMS, CELL_BITS = 1 << 21, 12
TEXT_BYTES = 4 << 20

_PIECE_END = W._byte_set(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
_WORD = ~(_PIECE_END | W._byte_set((0x20, 0x20), (0x09, 0x09)))
FILTERS = "level int, cell long, bundle int, filter binary"
GRAMS = "words array<long>, f long"


class SharedHash(Exception):
    """Two words have one hash."""


def _language_hash(language: str, seed: int) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(language.encode(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), np.uint64)[0]


def _words(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of blocks of (lang, text): languages, and for each word its hash, language, first and end byte in the lower-cased bytes, and those."""
    languages = batch.column(0).fill_null("und").dictionary_encode()
    salts = np.array([_language_hash(x, seed) for x in languages.dictionary.to_pylist()], dtype=np.uint64)
    codes = languages.indices.to_numpy()
    for low, high, raw, offsets in W.blocks(batch.column(1), TEXT_BYTES):
        hashes, first, end, counts = W.word_hashes(raw, offsets, _WORD, seed)
        code = np.repeat(codes[low:high], counts)
        with np.errstate(over="ignore"):
            hashes = W.mix64(hashes ^ salts[code]) if len(salts) else hashes
        yield languages.dictionary, hashes, code, first, end, W._LOWER[raw]


def _follows(low: np.ndarray, first: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the next word is in the same piece of the same document."""
    stops = np.zeros(len(low) + 1, dtype=np.int32)
    np.cumsum(_PIECE_END[low], dtype=np.int32, out=stops[1:])
    return (stops[first[1:]] == stops[end[:-1]]) & (doc[1:] == doc[:-1])


def _strings(low: np.ndarray, first: np.ndarray, length: np.ndarray) -> pa.Array:
    """Runs of bytes as an array of strings."""
    offsets = np.concatenate([[0], np.cumsum(length)])
    data = low[np.repeat(first - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for languages, hashes, code, first, end, low in _words(batch, seed):
                if not len(hashes):
                    continue
                distinct, at, which, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                eight = np.ndarray(len(low) + 1, dtype="<u8", buffer=np.pad(low, (0, 8)), strides=(1,))
                length = end - first
                head = eight[first] & W._KEEP[np.minimum(length, 8)]
                for same in (length, head, code, eight[np.maximum(end - 8, first)] & W._KEEP[np.minimum(length, 8)]):
                    if (same != same[at][which]).any():
                        raise SharedHash
                columns = [pa.array(distinct.view(np.int64)), languages.take(pa.array(code[at])), _strings(low, first[at], length[at]), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "lang", "word", "n"])

    return run


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W.mix64(W.mix64(a) * np.uint64(W._BASE) + b)


class _Ids:
    """What every task knows: the hashes with ids, which others are frequent, and which pairs are."""

    def __init__(self, hashes: np.ndarray, others: BitTable | None, pairs: BitTable | None = None) -> None:
        self.hashes, self.others, self.pairs = hashes, others, pairs
        self.bits = max(1, (len(hashes) - 1).bit_length())

    def halves(self, level: int) -> tuple[int, int]:
        return (self.bits * (1 + (level > 2)), self.bits * (1 + (level > 3)))

    def of(self, words: np.ndarray) -> np.ndarray:
        """The id of each word, -1 for none, -2 for a frequent word without."""
        ids = np.full(len(words), -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            ids = np.where(self.hashes[at] == words, at, -1)
        if self.others is not None:
            rest = np.flatnonzero(ids == -1)
            ids[rest[self.others.may_have(words[rest])]] = -2
        return ids

    def starts(self, words: np.ndarray, ids: np.ndarray, follows: np.ndarray, level: int) -> np.ndarray:
        """Places of the n-grams of frequent words, and from three words on of frequent pairs."""
        pair = follows & (ids[:-1] != -1) & (ids[1:] != -1)
        if level > 2:
            at = np.flatnonzero(pair)
            pair[at[~self.pairs.may_have(_pair_hash(words[at], words[at + 1]))]] = False
        good = pair[: len(pair) - level + 2].copy()
        for k in range(1, level - 1):
            good &= pair[k : len(pair) - level + 2 + k]
        return np.flatnonzero(good)

    def packed(self, ids: np.ndarray, at: np.ndarray, level: int) -> Q.Halves:
        part = lambda k: ids[at + k].astype(np.uint64)
        shift = np.uint64(self.bits)
        left = part(0) if level == 2 else (part(0) << shift) | part(1)
        right = part(1) if level == 2 else part(2) if level == 3 else (part(2) << shift) | part(3)
        return left, right

    def unpacked(self, left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
        """Word hashes of n-grams, a row each."""
        shift, low = np.uint64(self.bits), Q._mask(self.bits)
        ids = {2: (left, right), 3: (left >> shift, left & low, right), 4: (left >> shift, left & low, right >> shift, right & low)}[level]
        return self.hashes[np.stack(ids, axis=1).astype(np.int64)] if len(left) else np.zeros((0, level), np.uint64)


def _grams_of(batch: pa.RecordBatch, seed: int, known: _Ids, levels: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, words, ids, places of the n-grams) of blocks of (lang, text)."""
    row = np.arange(batch.num_rows)
    docs = iter(W.blocks(batch.column(1), TEXT_BYTES))
    for _, words, _, first, end, low in _words(batch, seed):
        a, b, _, offsets = next(docs)
        doc = np.searchsorted(offsets, first, side="right") + row[a]
        if len(words) > 1:
            ids, follows = known.of(words), _follows(low, first, end, doc)
            for level in levels:
                if len(words) >= level:
                    yield level, words, ids, known.starts(words, ids, follows, level)


def _make_filters(seed: int, known: _Ids, levels: tuple[int, ...], cell_bits: dict[int, int], bundles: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Q.Halves]] = {level: [] for level in levels}
        size = dict.fromkeys(levels, 0)

        def flushed(level: int) -> pa.RecordBatch:
            bits = known.halves(level)
            left, right = (np.concatenate([h[k] for h in held[level]]) for k in (0, 1))
            held[level], size[level] = [], 0
            cell, filters = Q.cells(*Q.tallied(*Q.permuted(left, right, bits), bits), bits, cell_bits[level])
            # The same if the task runs again.
            return _filter_rows(level, cell, TaskContext.get().partitionId() % bundles[level], filters)

        for batch in batches:
            for level, _, ids, at in _grams_of(batch, seed, known, levels):
                if known.others is not None:
                    at = at[np.all([ids[at + k] >= 0 for k in range(level)], axis=0)]
                held[level].append(known.packed(ids, at, level))
                size[level] += len(at)
                if size[level] >= HELD:
                    yield flushed(level)
        for level in levels:
            if size[level]:
                yield flushed(level)

    return run


def _filter_rows(level: int, cell: list[int], bundle: int, filters: list[bytes]) -> pa.RecordBatch:
    n = len(cell)
    columns = [pa.array(np.full(n, level, np.int32)), pa.array(cell, pa.int64()), pa.array(np.full(n, bundle, np.int32)), pa.array(filters, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["level", "cell", "bundle", "filter"])


def _sum(key: tuple, batches: Iterator[pa.RecordBatch], known: _Ids) -> tuple[int, tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    level = key[0].as_py()
    bits = known.halves(level)
    filters = [(f.as_buffer(), c) for b in batches for c, f in zip(b.column("cell").to_pylist(), b.column("filter"), strict=True)]
    return level, bits, Q.merged(filters, bits)


def _sum_bundle(known: _Ids, cell_bits: dict[int, int]):
    """Filters of one cell and bundle of tasks, as filters of smaller cells."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, bits, total = _sum(key, batches, known)
        cell, filters = Q.cells(*total, bits, cell_bits[level])
        yield _filter_rows(level, cell, 0, filters)

    return run


def _gram_rows(words: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    n, level = words.shape
    offsets = pa.array(np.arange(0, n * level + 1, level, dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(words).reshape(-1).view(np.int64))), pa.array(f.astype(np.int64))], names=["words", "f"])


def _frequent(known: _Ids, least: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, bits, (left, right, f) = _sum(key, batches, known)
        keep = f >= least
        yield _gram_rows(known.unpacked(*Q.restored(left[keep], right[keep], bits), level), f[keep])

    return run


def _rare_grams(seed: int, known: _Ids, levels: tuple[int, ...]):
    """N-grams with a frequent word that has no id, as rows of word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, words, ids, at in _grams_of(batch, seed, known, levels):
                at = at[np.any([ids[at + k] == -2 for k in range(level)], axis=0)]
                if len(at):
                    grams, n = np.unique(words[at[:, None] + np.arange(level)], axis=0, return_counts=True)
                    yield _gram_rows(grams, n)

    return run


def _most_frequent(words: DataFrame, total: int) -> Column:
    """Whether a word is among about ``MAX_IDS`` most frequent ones, at most so many."""
    if total <= MAX_IDS:
        return F.lit(True)
    size = F.floor(F.log2("n") * 16).cast("int")
    have, cut = 0, None
    for r in words.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # at most 16 * 64 rows
        have += r["count"]
        if have > MAX_IDS:
            break
        cut = r["size"]
    return F.lit(False) if cut is None else size >= cut


def _counted(stage: Stage, texts: DataFrame, seed: int, known: _Ids, levels: tuple[int, ...], n_words: int, least: int) -> DataFrame:
    """The frequent n-grams of some levels: words (hashes), f."""
    wanted = max(0, (n_words // CELL_GRAMS).bit_length())
    inner = {k: min(wanted, known.halves(k)[0]) for k in levels}
    outer = {k: min(CELL_BITS, inner[k]) for k in levels}
    bundles = {k: 1 << inner[k] - outer[k] for k in levels}
    filters = texts.mapInArrow(_make_filters(seed, known, levels, outer, bundles), FILTERS)
    if max(bundles.values()) > 1:
        filters = filters.groupBy("level", "cell", "bundle").applyInArrow(_sum_bundle(known, inner), FILTERS)
    name = "-".join(map(str, levels))
    found = stage.table(filters.groupBy("level", "cell").applyInArrow(_frequent(known, least), GRAMS), f"grams-{name}")
    if known.others is None:
        return found
    rare = texts.mapInArrow(_rare_grams(seed, known, levels), GRAMS).groupBy("words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return found.unionByName(stage.table(rare, f"rare-{name}"))


def phrase_counts(spark: SparkSession, texts: DataFrame, stage: Stage, least: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (lang, text): the frequent words (hash, lang, word, n), all words of each language (lang, n), frequent phrases (words, f)."""
    counts = texts.mapInArrow(_count_words(seed), "hash long, lang string, word string, n long")
    same = counts.groupBy("hash", "lang", "word").agg(F.sum("n").alias("n"))
    words = stage.table(same, "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.filter(F.col("n") >= least)
    facts = words.agg(F.sum("n").alias("n"), F.count("*").alias("words"), F.countDistinct("hash").alias("hashes"), F.sum((F.col("n") >= least).cast("long")).alias("frequent")).first()
    if facts["words"] != facts["hashes"]:
        raise SharedHash
    n_frequent = facts["frequent"] or 0
    with_id = _most_frequent(frequent, n_frequent)
    hashes = np.sort(frequent.filter(with_id).select("hash").toArrow().column(0).to_numpy().view(np.uint64))  # MAX_IDS at most
    others = bit_table(frequent.filter(~with_id), "hash", n_frequent - len(hashes)) if n_frequent > len(hashes) else None
    known = _Ids(hashes, others)
    n_words = facts["n"] or 0
    pairs = _counted(stage, texts, seed, known, (2,), n_words, least)
    one = pairs.select(F.col("words")[0].alias("a"), F.col("words")[1].alias("b"))
    known.pairs = bit_table(one.mapInArrow(_pair_hashes, "hash long"), "hash", pairs.count())
    longer = _counted(stage, texts, seed, known, (3, 4), n_words, least)
    single = frequent.select(F.array("hash").alias("words"), F.col("n").alias("f"))
    return frequent, totals, single.unionByName(pairs).unionByName(longer)


def _pair_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(_pair_hash(a, b).view(np.int64))], names=["hash"])


def collocations(spark: SparkSession, docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to 4 words within a piece that occur ``least``
    times (a).  Cut in two parts of l and r occurrences a phrase has the score
    floor(2000000 a / (l + r)); its lowest cut counts, the first of equals.
    Candidates inside a longer one with COVERED_PERCENT of their count are
    dropped.  n counts all words of the language.  Null languages are ``und``,
    null texts empty; repeated rows count each time; other columns are ignored;
    without candidates the result is empty.
    """
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    for last in (False, False, True):
        stage = Stage(spark, "collocations")
        try:
            words, totals, phrases = phrase_counts(spark, texts, stage, least, 1 + secrets.randbits(63))
            break
        except Exception as e:
            if last or not (isinstance(e, SharedHash) or "SharedHash" in str(e)):
                raise
    phrases = stage.table(phrases.withColumn("k", F.size("words")), "phrases")
    candidates = phrases.filter("k > 1").withColumnRenamed("f", "a")
    part = lambda name: phrases.select(F.col("words").alias(f"{name}_words"), F.col("f").alias(name))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("l_words", F.slice("words", F.lit(1), F.col("cut"))).withColumn("r_words", F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")))
    cuts = cuts.join(part("l"), "l_words").join(part("r"), "r_words")
    score = F.expr("cast(a as decimal(19,0)) * 2000000 div (cast(l as decimal(19,0)) + r)")
    best = cuts.groupBy("words", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b")).select("words", "a", "b.l", "b.r", "b.score")

    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.slice("words", i, m))))
    longer = phrases.filter("k > 2").select(F.explode(inside).alias("words"), "f").groupBy("words").agg(F.max("f").alias("longer"))
    covered = F.expr(f"cast(longer as decimal(19,0)) * 100 >= cast(a as decimal(19,0)) * {COVERED_PERCENT}")
    kept = best.join(longer, "words", "left").filter(~F.coalesce(covered, F.lit(False))).drop("longer")

    order = [F.desc("score"), F.desc("a")]
    first = kept.withColumn("hash", F.col("words")[0]).join(words.select("hash", "lang"), "hash").drop("hash")
    first = first.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top).drop("place")
    first = stage.table(first, "first")  # phrases of equal score and count included, so still without their words
    spelt = first.select("words", F.posexplode("words").alias("at", "hash")).join(words.select("hash", "word"), "hash")
    spelt = spelt.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first.join(spelt, "words").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
