"""Near-duplicate detection: MinHash signatures, a multi-index Hamming join, exact confirmation.

A document is the set of its distinct five-word shingles (fewer words: the whole
sequence is its one shingle).  Its signature has ``POSITIONS`` places of 16 bits
(b-bit MinHash).  Two documents of Jaccard similarity J agree in a place with
probability J, so at J = 0.8 they differ in more than ``MAX_DISTANCE`` of 40
places with a probability of 2e-5 (at 0.85 of 2e-7).

Candidates: the places are split into ``CHUNKS`` chunks.  By pigeonhole two
signatures within ``MAX_DISTANCE`` differ in at most ``MAX_DISTANCE // CHUNKS``
places of some chunk; those allowed errors are enumerated, as keys that leave
the erroneous place out.  So no pair within the signature distance is lost.

Links: candidates within the signature distance and the size ratio are
confirmed on their full shingle sets.  As only the class of a document is asked
for, a pair already known to lie in one class needs no confirmation: keys are
first linked to one pivot each, then to one document of another class, large ones
to one more by chance, then only pairs of different classes follow.
Documents of the same set are one class by a 128-bit BLAKE2b digest of the whole
sorted set; a shingle is a 64-bit hash of its words (see ``wordvec``) with a
secret seed for each run, so texts cannot be made to share shingles they lack.
The documents of large buckets are not paired bucket by bucket: pairs there must
also share one of their rarest shingles (a necessary condition, see
``_prefixes``), and a pair within the signature distance shares a bucket anyway.
All pairs must also pass a bound by parities of their sets (``_few_unlike``,
necessary as well), so documents that are near each other, but no link, make few
rows, and their sets are not moved.  Whatever asks for some of the sets leaves the
others where they are (``_among``).

Defined results: null or blank texts have no shingles and link with nothing;
rows without id link with nothing (component_id null, kept); repeated rows
share a class and are each returned; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordvec as W
from .components import connected_components
from .sketch import bit_table, count_hashes, places
from ..operators.skew import hot_keys, salted, spread_join
from ..sources.staging import BROADCAST_ROWS, Stage, bounded_broadcast

WIDTH = 5
POSITIONS, CHUNKS, MAX_DISTANCE = 40, 10, 19
PLACE_BITS = 16
PER_CHUNK = POSITIONS // CHUNKS
#: Documents of buckets above this size are paired by their rarest shingles.
LARGE_BUCKET = 32
#: Parts of the large buckets that are given another pivot in turn, before what is left is paired.
CHANCES = 2
#: Parities of up to this many sets (136 bytes each) may be broadcast.
MARKED_ROWS = 20_000
#: Rare shingles before a rare shingle that are looked at to tell whether two documents have met already.
BEFORE = 4
WORDS_OF_SIGNATURE = [f"s{i}" for i in range(POSITIONS * PLACE_BITS // 64)]
#: Binary logarithm of the bits of a set's parities, and the words that hold them.
PARITY_BITS = 10
PARITIES = [f"p{i}" for i in range((1 << PARITY_BITS) // 64)]

_MULTIPLY = W._sequence(21, POSITIONS) | np.uint64(1)
_ADD = W._sequence(22, POSITIONS)

FEATURES = "doc_id long, n_shingles long, set_hi long, set_lo long, " + ", ".join(f"{s} long" for s in WORDS_OF_SIGNATURE)


def shingle_sets(column: pa.Array, seed: int = 0) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for low, high, raw, offsets in W.blocks(column):
        words, _, _, counts = W.word_hashes(raw, offsets, W.BLANK_WORDS, seed)
        shingles = W.window_hashes(words, WIDTH)
        at = 0
        for n in counts.tolist():
            if n >= WIDTH:
                yield np.unique(shingles[at : at + n - WIDTH + 1])
            elif n:
                yield np.array([W.sequence_hash(words[at : at + n])], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)
            at += n


def signature(shingles: np.ndarray) -> np.ndarray:
    """b-bit MinHash of a non-empty set, one value a place."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 8192):
        low = np.minimum(low, (shingles[at : at + 8192, None] * _MULTIPLY + _ADD).min(axis=0))
    return W.mix64(low).astype(np.uint16)


def _features(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            rows = len(ids)
            numbers = np.zeros((rows, 3 + len(WORDS_OF_SIGNATURE)), dtype=np.int64)
            for i, s in enumerate(shingle_sets(batch.column(1), seed)):
                numbers[i, 0] = len(s)
                if len(s):
                    with np.errstate(over="ignore"):
                        numbers[i, 3:] = signature(s).view(np.int64)
                    numbers[i, 1:3] = np.frombuffer(hashlib.blake2b(s, digest_size=16).digest(), np.int64)
            none = (numbers[:, 0] == 0) | np.asarray(ids.is_null())
            columns = [ids, pa.array(numbers[:, 0])]
            columns += [pa.array(numbers[:, k], mask=none if k < 3 else None) for k in range(1, numbers.shape[1])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_hi", "set_lo", *WORDS_OF_SIGNATURE])

    return run


def _sets(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), seed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return run


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of the bits that hashes are dealt to, whether a set has an odd number there."""
    at = (shingles >> np.uint64(64 - PARITY_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=1 << PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = np.zeros((batch.num_rows, 1 + len(PARITIES)), dtype=np.int64)
        for i, s in enumerate(batch.column(1)):
            own = np.frombuffer(s.as_buffer(), np.uint64)
            numbers[i, 0], numbers[i, 1:] = len(own), parities(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, numbers.T.copy())], names=["rep", "m", *PARITIES])


def _confirmed(percent: int):
    """Links out of rows in order (a, b, shingles): the set of ``a`` (b is null), then those of its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            is_own = np.asarray(batch.column(1).is_null())
            for i, s in enumerate(batch.column(2)):
                other = np.frombuffer(s.as_buffer(), np.uint64)
                if is_own[i]:
                    own = other.copy()
                    continue
                a, b = (own, other) if len(own) <= len(other) else (other, own)
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _place(word: str, k: int) -> Column:
    return F.shiftrightunsigned(F.col(word), PLACE_BITS * k).bitwiseAND(F.lit(0xFFFF))


def bucket_keys() -> Column:
    """The keys of a signature: for each chunk, each way to leave one place out."""
    per_word = 64 // PLACE_BITS
    keys = []
    for chunk in range(CHUNKS):
        places = range(chunk * PER_CHUNK, (chunk + 1) * PER_CHUNK)
        for wrong in places:
            parts = [_place(WORDS_OF_SIGNATURE[p // per_word], p % per_word) for p in places if p != wrong]
            key = reduce(lambda x, y: F.shiftleft(x, PLACE_BITS).bitwiseOR(y), parts)
            keys.append(F.shiftleft(F.lit(wrong).cast("long"), 48).bitwiseOR(key))
    return F.array(*keys)


def _distance() -> Column:
    """Places in which signatures a_s* and b_s* differ."""
    parts = []
    for s in WORDS_OF_SIGNATURE:
        unlike = F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))
        for at in range(0, 64, PLACE_BITS):
            place = 0xFFFF << at
            parts.append((unlike.bitwiseAND(F.lit(place - (1 << 64) if at == 48 else place)) != 0).cast("int"))
    return reduce(lambda x, y: x + y, parts)


def _few_unlike(percent: int) -> Column:
    """Whether sets of a_m and b_m shingles with parities a_p* and b_p* may be a link.

    A shingle that only one of them has changes one parity, so they have at least as
    many of those as parities differ; the others are counted twice.
    """
    unlike = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITIES))
    both = F.col("a_m") + F.col("b_m")
    return (both - unlike) * (100 + percent) >= both * (2 * percent)


def _among(rows: DataFrame, column: str, wanted: DataFrame, n: int) -> DataFrame:
    """The ``rows`` whose ``column`` is one of the ``n`` ids of ``wanted`` (one column), without moving any.

    More ids than may be broadcast are held as a bit table, so some other rows pass too.
    """
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted.toDF(column)), column, "left_semi")
    table = bit_table(wanted.select(F.xxhash64(wanted.columns[0]).alias("hash")), "hash", n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(table.may_have(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))))

    hashed = rows.withColumn("_hash", F.xxhash64(column))
    return hashed.mapInArrow(run, hashed.schema).drop("_hash")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Class of every document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id reachable over links of at least
    ``percent`` per cent Jaccard similarity; ``kept`` marks that document.
    ``percent`` is at least 80, for which the signature distance is dimensioned.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must lie between 80 and 100")
    stage = Stage(spark, "near-dup")
    seed = 1 + secrets.randbits(63)  # of the word hashes; a text cannot be made to collide with another one
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = stage.table(texts.mapInArrow(_features(seed), FEATURES), "features")

    same = features.filter("set_hi is not null").groupBy("set_hi", "set_lo")
    reps = same.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), *(F.first(s).alias(s) for s in WORDS_OF_SIGNATURE))
    reps = stage.table(reps, "reps")
    sums = reps.agg(F.count("*").alias("sets"), F.sum("copies").alias("rows")).first()
    keyed = reps.select("rep", F.explode(bucket_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    shared = stage.table(shared, "shared")
    hot = hot_keys(stage, "hot-buckets", shared, ["key"], "size", sums["sets"])
    members = stage.table(spread_join(keyed, shared, ["key"], hot, F.xxhash64("rep")), "members")
    seen = stage.table(members.select("rep").distinct(), "seen")
    n_seen = seen.count()
    sets = _among(texts, "doc_id", seen, n_seen)
    if not features.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        sets = sets.dropDuplicates(["doc_id"])  # moves whole texts, so only where ids repeat
    sets = stage.table(sets.mapInArrow(_sets(seed), "doc_id long, shingles binary"), "sets")

    facts = _among(reps.select("rep", "n", *WORDS_OF_SIGNATURE), "rep", seen, n_seen)
    marks = sets.mapInArrow(_parities, "rep long, m long, " + ", ".join(f"{p} long" for p in PARITIES))
    marked = stage.table(facts.join(bounded_broadcast(marks, n_seen, MARKED_ROWS), "rep"), "marked")
    facts = marked.select(*facts.columns)
    close = (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent) & (_distance() <= MAX_DISTANCE)
    side = lambda df, x: df.select(*(F.col(c).alias(c if c == "key" else x if c == "rep" else f"{x}_{c}") for c in df.columns))

    def asked(pairs: DataFrame, x: str, n: int) -> DataFrame:
        """(x, shingles) of the ``n`` documents that are ``x`` of written pairs; the other sets stay where they are."""
        return _among(sets.select(F.col("doc_id").alias(x), "shingles"), x, pairs.select(x).distinct(), n)

    def pivots(pairs: DataFrame, name: str) -> DataFrame | None:
        """Those ``a`` of written pairs that have a large share of them."""
        return hot_keys(stage, f"hot-{name}", pairs.groupBy("a").agg(F.count("*").alias("size")), ["a"], "size", pairs.count())

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose full sets are similar enough; the set of ``a`` travels once for all its partners (of a part)."""
        dealt = salted(pairs, pivots(pairs, name), ["a"], F.xxhash64("b"))
        ends = pairs.agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).first()
        others = dealt.join(asked(pairs, "b", ends["b"]), "b").select("a", "_salt", "b", "shingles")
        own = dealt.select("a", "_salt").distinct().join(asked(pairs, "a", ends["a"]), "a")
        rows = others.unionByName(own.select("a", "_salt", F.lit(None).cast("long").alias("b"), "shingles"))
        rows = rows.repartition("a", "_salt").sortWithinPartitions("a", "_salt", F.asc_nulls_first("b")).select("a", "b", "shingles")
        return stage.table(rows.mapInArrow(_confirmed(percent), "a long, b long"), name)

    def possible(star: DataFrame, name: str) -> DataFrame:
        """Those of written pairs (a, b), of a pivot and another document as a rule, that may be a link."""
        rows, own = star.join(side(marked, "b"), "b"), star.select("a").distinct()
        if (n := own.count()) <= MARKED_ROWS:
            met = rows.join(F.broadcast(side(marked, "a").join(bounded_broadcast(own, n), "a", "left_semi")), "a")
        else:
            met = spread_join(rows, side(marked, "a"), ["a"], pivots(star, name), F.xxhash64("b"))
        return met.filter(close & _few_unlike(percent)).select("a", "b")

    def linked(star: DataFrame, name: str) -> DataFrame:
        """Confirmed links of written pairs (a, b)."""
        return confirmed(stage.table(possible(star, name), f"{name}-close"), f"{name}-links")

    # Each key's documents against its pivot.
    star = members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = linked(stage.table(star, "star"), "star")
    labels = connected_components(links, stage, "star").withColumnRenamed("v", "rep")
    known = stage.table(reps.select("rep").join(labels, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")), "known")

    def merged(known: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """The classes (rep, label) with those made one that links join; classes are the vertices."""
        end = lambda x: known.select(F.col("rep").alias(x), F.col("label").alias(f"{x}_label"))
        between = links.join(end("a"), "a").join(end("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
        moved = connected_components(between, stage, name).select(F.col("v").alias("label"), F.col("label").alias("into")).filter("into <> label")
        return stage.table(known.join(moved, "label", "left").select("rep", F.coalesce("into", "label").alias("label")), f"known-{name}")

    def several(known: DataFrame, name: str, members: DataFrame = members) -> DataFrame:
        """Members (key, rep, size, label, low, other) of keys with several classes; ``other`` is not of the class ``low``."""
        left = stage.table(members.select("key", "rep", "size").join(known, "rep"), f"labelled-{name}")
        spread = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("rep", "label").alias("other")).filter("low <> high").select("key", "low", "other")
        return stage.table(spread_join(left, spread, ["key"], hot, F.xxhash64("rep")), f"left-{name}")

    # Two large classes that share keys mostly have a link: the least class against one document of the greatest.
    second = several(known, "first").filter("label = low").select(F.col("other").alias("a"), F.col("rep").alias("b")).distinct()
    known = merged(known, linked(stage.table(second, "second"), "second"), "second")

    # Large keys have many classes and a pivot is near some of them: another pivot by chance, one of each class as likely as of another.
    chance = lambda c: F.xxhash64(c, "key")
    for at in range(CHANCES):
        name = f"chance-{at}"
        left = several(known, name, members.filter((F.col("size") > LARGE_BUCKET) & (F.pmod(F.xxhash64("key"), F.lit(CHANCES)) == at)))
        drawn = left.groupBy("key").agg(F.min_by(F.struct("rep", "label"), F.struct(chance("label"), chance("rep"))).alias("pivot"))
        star = spread_join(left, drawn, ["key"], hot, F.xxhash64("rep")).filter("label <> pivot.label").select(F.col("pivot.rep").alias("a"), F.col("rep").alias("b")).distinct()
        links = linked(stage.table(star, name), name)
        if not links.isEmpty():
            known = merged(known, links, name)
        stage.drop(f"labelled-{name}", f"left-{name}", name, f"{name}-close")

    # What is left: pairs of one key in different classes.
    left = several(known, "rest")
    apart = (F.col("a") < F.col("b")) & (F.col("a_label") != F.col("b_label")) & close
    small = stage.table(left.filter(F.col("size") <= LARGE_BUCKET).join(facts, "rep").select("key", "rep", "label", *facts.columns[1:]), "small")
    large = stage.table(left.filter(F.col("size") > LARGE_BUCKET).select("rep", "label").distinct(), "large-docs")
    large = stage.table(_prefixes(large, sets, percent).join(marked, "rep").select("key", "at", "before", "rep", "label", *marked.columns[1:]), "large")
    pairs = side(small, "a").join(side(small, "b"), "key").filter(apart).select("a", "b").distinct()
    pairs = possible(stage.table(pairs, "small-pairs"), "small-pairs")
    far = side(large, "a").join(side(large, "b"), "key").filter(_first_met(percent, apart)).select("a", "b")
    pairs = pairs.unionByName(far).distinct()
    more = confirmed(stage.table(pairs, "pairs"), "more-links")
    known = merged(known, more, "all")

    classes = reps.select("rep", "set_hi", "set_lo").join(known, "rep").select("set_hi", "set_lo", F.col("label").alias("component_id"))
    hot = hot_keys(stage, "hot-sets", reps, ["set_hi", "set_lo"], "copies", sums["rows"] or 0)
    out = features.select("doc_id", "n_shingles", "set_hi", "set_lo")
    some = spread_join(out.filter("set_hi is not null"), classes, ["set_hi", "set_lo"], hot, F.xxhash64("doc_id")).select("doc_id", "n_shingles", "component_id")
    none = out.filter("set_hi is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    stage.drop("shared", "members", "seen", "sets", "star", "star-close", "second", "second-close", "labelled-first", "left-first", "labelled-rest", "left-rest", "small", "small-pairs", "large-docs", "large", "pairs", "marked", "star-links", "second-links", "more-links")
    return some.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _own_shingles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    at = 0
    while at < batch.num_rows:  # sets together up to some megabytes
        parts, size = [], 0
        while at < batch.num_rows and size < 1 << 20:
            parts.append(np.frombuffer(batch.column(0)[at].as_buffer(), np.uint64))
            size += len(parts[-1])
            at += 1
        yield np.concatenate(parts)


def _rarest(counts: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shingles = np.frombuffer(s.as_buffer(), np.uint64)
                n = len(shingles)
                seen = counts[places(shingles)]
                first = np.lexsort((shingles, seen))[: n - -(-n * percent // 100) + 1]
                at = np.flatnonzero(seen[first] > 1)  # a count of 1 is exact: nobody shares it
                keys = shingles[first[at]].view(np.int64)
                upto = np.arange(len(keys))
                before = [keys[max(i - BEFORE, 0) : i] for i in upto]
                ends = np.append(0, np.cumsum(np.minimum(upto, BEFORE))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([keys[:0], *before])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), rep, np.int64)), pa.array(at + 1), pa.array(keys), lists], names=["rep", "at", "key", "before"])

    return run


def _first_met(percent: int, apart: Column) -> Column:
    """Whether documents ``a`` and ``b`` that share a rare shingle, and are ``apart``, may be a link that has not met before.

    Of the first shingle that they share everything before it is missing in the
    other one, which leaves the less to share the later it comes.  If they share
    one of the shingles just ``before``, they have met there: that one passes
    the bound if this one does, and the first one that they share is never left out.
    """
    enough = (F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) + 1) * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent
    return enough & apart & _few_unlike(percent) & ~F.arrays_overlap("a_before", "b_before")


def _prefixes(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles (``key``) of each of ``docs`` and their places (``at``, from 1), enough for any link to share one.

    ``before`` has the last ``BEFORE`` of them that come before ``key``.

    A link of ``percent`` shares that part of either set, so of a set of n all
    but n - ceil(percent n / 100) shingles; one more than those cannot all be
    missing in the other document.  This holds for any order that all documents
    follow; rarity is counted over all of ``docs`` (distinct ids), and others that
    ``_among`` lets pass, in a sketch of fixed size.
    """
    sets = _among(sets, "doc_id", docs.select("rep"), docs.count())
    counts = count_hashes(sets.select("shingles"), _own_shingles)
    return sets.mapInArrow(_rarest(counts, percent), "rep long, at long, key long, before array<long>").join(docs, "rep")
