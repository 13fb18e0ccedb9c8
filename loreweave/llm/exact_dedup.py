"""Exact deduplication with DataFrame operations only.

Rows are grouped by a 128-bit content hash and, inside a hash, by the text
itself: grouping keys are compared byte by byte, so texts that collide in the
hash fall apart.  Copies collapse in the map-side part of that aggregation; a
text crosses the network at most once per map task however many copies it has.

The groups (hashes, size, the row that stays) are written.  Back on the rows,
they are found by (content hash, SHA-256).  Should two different texts agree in
both, the run ends with an error rather than wrong groups.  The rows of a hot
group are dealt over several tasks.

Defined results: a null text counts as empty; repeated rows are copies of each
other, and of rows with the same id all are marked kept; null ids never win
while an id exists, and a group of null ids only keeps all of its rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, spread_join
from ..sources.staging import Stage


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", hash_of: Callable[[Column], Column] = content_hash, row_col: str | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, and ``row`` if ``row_col`` names a column of row numbers.

    ``keep`` names the row that stays of equal texts: ``smallest`` or ``largest`` id.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    number = [F.col(row_col).alias("row")] if row_col else []
    spark = docs.sparkSession
    stage = Stage(spark, "exact-dedup")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *number)
    texts = texts.withColumn("h", hash_of(F.col("text")))
    groups = texts.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select("h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    clash = F.raise_error(F.lit("two texts agree in both content hashes")).cast("long")
    groups = groups.groupBy("h", "text_sha256").agg(
        F.first("keep_id").alias("keep_id"), F.when(F.count("*") == 1, F.first("group_size")).otherwise(clash).alias("group_size")
    )
    groups = stage.table(groups, "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = hot_keys(stage, "hot", groups, ["h", "text_sha256"], "group_size", total)
    rows = texts.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"), *(["row"] if row_col else []))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    # Equal rows (same id, same text) must not fall together, hence a number of the row's own.
    spread = F.xxhash64(F.monotonically_increasing_id())
    found = spread_join(rows, groups, ["h", "text_sha256"], hot, spread)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", *(["row"] if row_col else []))
