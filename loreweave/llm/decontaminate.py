"""Benchmark decontamination: a prefix-filtered set join of windows with documents.

Windows are ``WINDOW`` consecutive words of a benchmark item; an item of fewer
words is one window.  A window is a set of shingles of ``SHINGLE`` words (of all
its words if it has fewer).

1. Rarity: occurrences of each benchmark shingle over all documents.  A window
   with a shingle that no document has occurs nowhere.
2. Prefix: all shingles of a window must occur where it occurs, so its rarest one
   alone is a necessary token: the prefix of its shingles in order of rarity.
3. Join: documents give every place where a prefix shingle stands, with the words
   around it; these are joined with the windows by shingle.  Up to ``SENT_WINDOWS``
   windows are broadcast; beyond, both sides are shuffled and a hot shingle (of a
   passage in a third of all documents) is dealt over tasks.
4. Verification: the place of the shingle in the window fixes where it would start;
   the positional bound (not before the text's first word) and the length bound (as
   many words left as the window has) apply, then the words themselves are compared.

Before rarity and join, documents drop shingles that a bit table of bounded size
rules out; it holds all benchmark (or prefix) shingles and so loses none.

Defined results: null or wordless texts have 0 words and no hit; items without
words have no window; repeated rows are returned each; an empty benchmark hits
nothing; null item ids are not reported but their windows hit; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordvec as W
from .sketch import BitTable, bit_table
from ..operators.skew import hot_keys, spread_join
from ..sources.staging import Stage, bounded_broadcast

WINDOW, SHINGLE = 10, 5
#: Rows of a batch sent to the JVM.
TOGETHER = 10_000
#: Windows (some 100 bytes each) up to which they travel to the places of their shingles; beyond, both are shuffled.
SENT_WINDOWS = 50_000

_WINDOWS = "item string, window string, width int, size int, shingles array<long>"
_PLACES = "row long, doc_id long, digest string, n_words long, place long, before int, shingle long, around string"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of items (item, text)."""
    for batch in batches:
        for low, high, raw, offsets in W.blocks(batch.column(1)):
            hashes, first, end, counts = W.word_hashes(raw, offsets, W.ALNUM_WORDS)
            text = W._LOWER[raw].tobytes()
            stop = np.cumsum(counts)
            for i in np.flatnonzero(counts).tolist():
                item, n = batch.column(0)[low + i].as_py(), int(counts[i])
                a = int(stop[i]) - n
                words = [text[x:y].decode() for x, y in zip(first[a : a + n].tolist(), end[a : a + n].tolist(), strict=True)]
                width, size = min(WINDOW, n), min(SHINGLE, n)
                own = W.window_hashes(hashes[a : a + n], size).view(np.int64)
                per = width - size + 1
                for at in range(0, n - width + 1, TOGETHER):
                    upto = min(n - width + 1, at + TOGETHER)
                    shingles = pa.array(own[np.arange(at, upto)[:, None] + np.arange(per)].ravel())
                    many = upto - at
                    columns = [
                        pa.array([item] * many, pa.string()),
                        pa.array([" ".join(words[k : k + width]) for k in range(at, upto)]),
                        pa.array(np.full(many, width, np.int32)),
                        pa.array(np.full(many, size, np.int32)),
                        pa.ListArray.from_arrays(np.arange(many + 1, dtype=np.int32) * per, shingles),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "window", "width", "size", "shingles"])


def _found(hashes: np.ndarray, counts: np.ndarray, sizes: list[int], table: BitTable) -> tuple[np.ndarray, np.ndarray]:
    """(place among all words, shingle) of shingles inside a document that the table may have."""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))  # words from here to the document's end
    places, found = [], []
    for size in sizes:
        shingles = W.window_hashes(hashes, size)
        at = np.flatnonzero((left[: len(shingles)] >= size) & table.may_have(shingles))
        places.append(at)
        found.append(shingles[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(found)


def _occurrences(sizes: list[int], table: BitTable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in W.blocks(batch.column(1)):
                hashes, _, _, counts = W.word_hashes(raw, offsets, W.ALNUM_WORDS)
                shingles, n = np.unique(_found(hashes, counts, sizes, table)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    return run


def _places(sizes: list[int], table: BitTable):
    """A row for each document (no place), then one for each place of a shingle, with the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low, high, raw, offsets in W.blocks(batch.column(1)):
                hashes, first, end, counts = W.word_hashes(raw, offsets, W.ALNUM_WORDS)
                rows = row + np.arange(high - low)
                row += high - low
                none = pa.nulls(high - low, pa.int64())
                ids = batch.column(0).slice(low, high - low)
                words_of = pa.array(counts.astype(np.int64))
                plain = [pa.array(rows), ids, pa.nulls(high - low, pa.string()), words_of, none, pa.nulls(high - low, pa.int32()), none, pa.nulls(high - low, pa.string())]
                yield pa.RecordBatch.from_arrays(plain, names=_NAMES)
                at, shingles = _found(hashes, counts, sizes, table)
                if not len(at):
                    continue
                stop = np.cumsum(counts)
                doc = np.searchsorted(stop, at, side="right")
                begin = stop[doc] - counts[doc]
                some = np.unique(doc)
                digest = {d: hashlib.sha256(raw[offsets[d] : offsets[d + 1]]).hexdigest() for d in some.tolist()}
                text = W._LOWER[raw].tobytes()
                for k in range(0, len(at), TOGETHER):
                    a, d = at[k : k + TOGETHER], doc[k : k + TOGETHER]
                    left, right = np.maximum(a - WINDOW + 1, begin[k : k + TOGETHER]), np.minimum(a + WINDOW, stop[d])
                    around = [b" ".join([text[x:y] for x, y in zip(first[p:q].tolist(), end[p:q].tolist(), strict=True)]).decode() for p, q in zip(left.tolist(), right.tolist(), strict=True)]
                    columns = [
                        pa.array(rows[d]),
                        pa.nulls(len(a), pa.int64()),
                        pa.array([digest[x] for x in d.tolist()]),
                        pa.nulls(len(a), pa.int64()),
                        pa.array(a - begin[k : k + TOGETHER]),
                        pa.array((a - left).astype(np.int32)),
                        pa.array(shingles[k : k + TOGETHER].view(np.int64)),
                        pa.array(around),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return run


_NAMES = [c.split()[0] for c in _PLACES.split(", ")]


def _joined(stage: Stage, texts: DataFrame, items: DataFrame, sent_windows: int) -> tuple[DataFrame, DataFrame]:
    """(documents by row with doc_id and n_words; occurrences: row, digest, begin, end, window, items)."""
    windows = items.mapInArrow(_windows, _WINDOWS)
    windows = windows.groupBy("window").agg(F.first("width").alias("width"), F.first("size").alias("size"), F.first("shingles").alias("shingles"), F.collect_set("item").alias("items"))
    windows = stage.table(windows, "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # 1 to SHINGLE
    shingles = windows.select(F.explode("shingles").alias("shingle")).distinct()
    table = bit_table(shingles, "shingle", shingles.count())
    rarity = texts.mapInArrow(_occurrences(sizes, table), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rarity = stage.table(rarity, "rarity")

    each = windows.select("window", F.size("shingles").alias("many"), F.posexplode("shingles").alias("at", "shingle")).join(rarity, "shingle")
    rarest = F.min(F.struct("n", "shingle", "at"))
    prefix = each.groupBy("window", "many").agg(rarest.alias("p"), F.count("*").alias("there")).filter("there = many")
    prefix = prefix.join(windows.select("window", "width", "items"), "window").select("window", "width", "items", "p.*")
    prefix = stage.table(prefix, "prefix")
    keys = prefix.select("shingle", "n").distinct()
    sums = keys.agg(F.count("*").alias("keys"), F.sum("n").alias("places")).first()
    found = stage.table(texts.mapInArrow(_places(sizes, bit_table(keys, "shingle", sums["keys"])), _PLACES), "places")

    places = found.filter("place is not null").select("row", "digest", "place", "before", "shingle", "around")
    if prefix.count() <= sent_windows:
        near = places.join(F.broadcast(prefix), "shingle")
    else:
        hot = hot_keys(stage, "hot", keys, ["shingle"], "n", sums["places"] or 0)
        near = spread_join(places, prefix, ["shingle"], hot, F.xxhash64("row", "place"))
    start = F.col("before") - F.col("at")
    words = F.split("around", " ")
    fits = (start >= 0) & (start + F.col("width") <= F.size(words))
    same = F.when(fits, F.array_join(F.slice(words, F.greatest(start, F.lit(0)) + 1, F.col("width")), " ") == F.col("window"))
    near = near.filter(same).select("row", "digest", (F.col("place") - F.col("at")).alias("begin"), (F.col("place") - F.col("at") + F.col("width")).alias("end"), "window", "items")
    return found.filter("place is null").select("row", "doc_id", "n_words"), near


def _tables(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts, benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))


def uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", sent_windows: int = SENT_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without a hit, columns as they are.

    A row is judged by its text: SHA-256 digests of the texts with a hit are
    looked up, so rows that share an id do not pass for each other.
    """
    stage = Stage(spark, "uncontaminated")
    _, near = _joined(stage, *_tables(docs, benchmark, id_col, text_col, item_col, item_text_col), sent_windows)
    bad = stage.table(near.select(F.col("digest").alias("_digest")).distinct(), "bad")
    stage.drop("windows", "rarity", "prefix", "places", "hot")
    own = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    return docs.join(bounded_broadcast(bad, bad.count()), own == F.col("_digest"), "left_anti")


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", sent_windows: int = SENT_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, items, spans, contaminated.

    ``spans`` are the hit words as begin, end, begin, end ..., ``items`` the item
    ids as sorted strings.
    """
    stage = Stage(spark, "contamination")
    rows, near = _joined(stage, *_tables(docs, benchmark, id_col, text_col, item_col, item_text_col), sent_windows)
    near = stage.table(near.distinct(), "occurrences")
    # Overlapping and adjacent occurrences of a document are one span.
    order = Window.partitionBy("row").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = near.select("row", "begin", "end").distinct().withColumn("fresh", F.coalesce(F.col("begin") > before, F.lit(True)).cast("int"))
    spans = spans.withColumn("span", F.sum("fresh").over(order)).groupBy("row", "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.sum(F.col("end") - F.col("begin")).alias("n_hit"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", "end"))), lambda s: F.array(s["begin"], s["end"]))).alias("spans"))
    owners = near.select("row", "window", "items").distinct().select("row", F.explode("items").alias("item")).distinct()
    owners = owners.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = rows.join(spans, "row", "left").join(owners, "row", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>")), "spans": F.coalesce("spans", F.array().cast("array<long>"))})
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))
