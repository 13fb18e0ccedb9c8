"""Spelling variants: frequent words that differ by one letter, found with bit-sliced position indexes.

For a set of words the index has, for each position and letter, the set of words
with that letter there, as bits.  A query word is read letter by letter; four
sets of words follow it at once, 64 words an operation: those equal so far (no
error), and those with one letter replaced, one more, or one less so far, whose
later letters are compared at the same, the next, or the previous position.
Many query words of one length are read together.

The vocabulary is split so that near words meet in one index: a word is cut in
three segments, and one error lies in one of them, so near words share the two
others (which key a block).  Blocks are gathered into bins of about ``BIN_ROWS``
words; larger blocks are dealt over several indexes, each asked by all words of
its block, so no task holds a whole hot block.  A pair is reported under the
first of the keys it shares, once.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import Stage

#: Words of an index, about.
BIN_ROWS = 2048
SEGMENTS = 3
#: Words longer than this share bins.
LONG_LENGTH = 64
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One run in so many loses a letter (the planted errors of the contract).
ERROR_EVERY = 97

NEAR = "word string, n_near long, best_n long, best string"


def words_with_errors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = ERROR_EVERY) -> DataFrame:
    """Every run of letters of every text as ``word``, one in ``every`` with a letter deleted; shorter results than LEAST_LETTERS are left out."""
    text = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit("([a-zÀ-ÿ]+)"), F.lit(1))).alias("run"))
    runs = runs.filter(F.length("run") >= LEAST_LETTERS)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.expr("cast(h % length(run) as int)")
    wrong = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, wrong).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LETTERS)


def _segments(length: Column, extra: int) -> list[Column]:
    """Hashes of a word without each segment of a word of ``length`` letters; ``extra`` letters more go with the segment."""
    cut = [F.floor(length * j / SEGMENTS).cast("int") for j in range(SEGMENTS + 1)]
    word = F.col("word")
    return [F.xxhash64(length, F.lit(j), F.substring(word, F.lit(1), cut[j]), F.substring(word, cut[j + 1] + extra + 1, F.length(word))) for j in range(SEGMENTS)]


def _bits(rows: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(rows, axis=1, bitorder="little")
    spare = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, spare)))).view(np.uint64)


class PositionIndex:
    """Bits of the words that have a letter at a position."""

    def __init__(self, words: list[str]) -> None:
        self.lengths = np.array([len(w) for w in words])
        self.codes = np.zeros((len(words), max(self.lengths, default=0)), dtype=np.uint32)
        for i, w in enumerate(words):
            self.codes[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        self.slices: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of_length(self, n: int) -> np.ndarray:
        return _bits((self.lengths == n)[None, :])

    def slice_at(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The letters at position ``i``, and the bits of the words that have each; positions before are forgotten."""
        if i not in self.slices:
            self.slices = {k: v for k, v in self.slices.items() if k >= i - 2}
            letters = np.unique(self.codes[:, i]) if 0 <= i < self.codes.shape[1] else np.zeros(0, np.uint32)
            self.slices[i] = letters, _bits(self.codes[:, i] == letters[:, None]) if len(letters) else np.zeros((0, -(-len(self.codes) // 64)), np.uint64)
        return self.slices[i]

    def having(self, i: int, letters: np.ndarray) -> np.ndarray:
        """For each letter the bits of the words that have it at position ``i``."""
        known, bits = self.slice_at(i)
        if not len(known):
            return np.zeros((len(letters), bits.shape[1]), np.uint64)
        at = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        return np.where((known[at] == letters)[:, None], bits[at], np.uint64(0))

    def near(self, queries: np.ndarray) -> np.ndarray:
        """For query words of one length (rows of code points): the bits of the words exactly one error away."""
        n = queries.shape[1]
        self.slices.clear()
        every = _bits(np.ones((1, len(self.codes)), dtype=bool))
        same = np.repeat(every, len(queries), axis=0)
        replaced, more, less = np.zeros_like(same), np.zeros_like(same), np.zeros_like(same)
        for i in range(n):
            letters = queries[:, i]
            before, here, after = (self.having(k, letters) for k in (i - 1, i, i + 1))
            less = (less & before) | same
            more = (more | same) & after
            replaced = (replaced & here) | (same & ~here)
            same = same & here
        return (replaced & self.of_length(n)) | ((more | same) & self.of_length(n + 1)) | (less & self.of_length(n - 1))


def _near_in_bin(table: pa.Table) -> pa.Table:
    """For each word of a bin: its near words whose first shared key this bin's blocks have, and the best of them."""
    words, n = table["word"].to_pylist(), table["n"].to_numpy()
    short, indexed = np.asarray(table["short"]), np.flatnonzero(np.asarray(table["indexed"]))
    keys, part = np.stack([table[f"k{j}"].to_numpy() for j in range(SEGMENTS)]), table["j"].to_numpy()
    lengths = np.array([len(w) for w in words])
    count, best = np.zeros(len(words), dtype=np.int64), [None] * len(words)
    for length in np.unique(lengths).tolist():
        mine = indexed[np.abs(lengths[indexed] - length) <= 1]
        if not len(mine):
            continue
        index = PositionIndex([words[i] for i in mine])
        queries = np.flatnonzero(lengths == length)
        for low in range(0, len(queries), BIN_ROWS):
            some = queries[low : low + BIN_ROWS]
            codes = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), length)
            found = index.near(codes)
            q, w = np.nonzero(found)
            # Bits of the words of 64 with any.
            bits = np.unpackbits(found[q, w][:, None].view(np.uint8), axis=1, bitorder="little")
            row, bit = np.nonzero(bits)
            a, b = some[q[row]], mine[w[row] * 64 + bit]
            equal = keys[:, a] == keys[:, b]
            first = np.where(equal.any(axis=0), equal.argmax(axis=0), -1)
            good = (first == part[a]) & (part[a] == part[b]) & (short[a] | short[b])
            for x, y in zip(a[good].tolist(), b[good].tolist(), strict=True):
                count[x] += 1
                if best[x] is None or (-n[y], words[y]) < (-n[best[x]], words[best[x]]):
                    best[x] = y
    has = np.flatnonzero(count)
    chosen = [best[i] for i in has]
    return pa.table({"word": [words[i] for i in has], "n_near": count[has], "best_n": n[chosen] if len(has) else count[has], "best": pa.array([words[i] for i in chosen], pa.string())}).cast(
        pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    )


def near_words(stage: Stage, words: DataFrame) -> DataFrame:
    """Of ``words`` (word, n; distinct): word, n_near, best_n, best, for each word with a near one.

    ``best`` is the near word of largest n, of equals the smallest.
    """
    length = F.length("word")
    keys = lambda cols: [c.alias(f"k{j}") for j, c in enumerate(cols)]
    short = words.select("word", "n", length.alias("m"), F.lit(True).alias("short"), *keys(_segments(length, 0)))
    long = words.filter(length > 1).select("word", "n", (length - 1).alias("m"), F.lit(False).alias("short"), *keys(_segments(length - 1, 1)))
    rows = short.unionByName(long).withColumn("class", F.least("m", F.lit(LONG_LENGTH)))
    rows = rows.select("*", F.posexplode(F.array(*(f"k{j}" for j in range(SEGMENTS)))).alias("j", "key"))
    sizes = {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()}  # LONG_LENGTH rows at most
    bins = F.coalesce(*(F.when(F.col("class") == c, F.lit(-(-k // BIN_ROWS))) for c, k in sizes.items()), F.lit(1)) if sizes else F.lit(1)
    blocks = rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > BIN_ROWS)
    hot = stage.table(blocks.select("key", F.ceil(F.col("size") / BIN_ROWS).cast("int").alias("_parts")), "hot-blocks")
    rows = rows.join(hot, "key", "left")
    bin_of = F.when(F.col("_parts").isNull(), F.pmod("key", bins)).otherwise(F.col("key"))
    own = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("word"), F.col("_parts")))
    rows = rows.withColumn("bin", bin_of).withColumn("own", own.cast("int"))
    # A word of a hot block is in one index of it and asks all of them.
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    rows = rows.withColumn("indexed", F.col("part") == F.col("own"))
    found = rows.select("class", "bin", "part", "j", "word", "n", "short", "indexed", *(f"k{j}" for j in range(SEGMENTS))).groupBy("class", "bin", "part").applyInArrow(_near_in_bin, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def followed(stage: Stage, forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last of each word's chain of forms, in rounds that double the steps."""
    roots, step = stage.table(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        step += 1
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stage.table(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{step}")
        stage.drop(f"roots-{step - 1}")
        roots = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return roots


def spelling_variants(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """Per frequent word: word, form, root, n, n_near, form_n.

    Words are the runs of A-Z, a-z and U+00C0 to U+00FF of all texts (A-Z as a-z;
    planted errors applied) with at least LEAST_LETTERS letters and
    ``least_count`` occurrences.  A word's form is its near word of largest n if
    that has at least twice the word's occurrences, else null; equal n: the
    smallest word.  Null and empty texts have no words; a null id counts as an
    empty one; repeated rows count each time; other columns are ignored; without
    words the result is empty.
    """
    stage = Stage(spark, "spelling")
    counts = words_with_errors(docs, id_col, text_col).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)
    words = stage.table(counts, "words")
    near = near_words(stage, words)
    found = words.join(near, "word", "left")
    is_form = F.col("best_n") >= 2 * F.col("n")
    out = found.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"))
    out = stage.table(out, "forms")
    roots = followed(stage, out.filter("form is not null").select("word", "form"))
    stage.drop("words", "hot-blocks")
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
