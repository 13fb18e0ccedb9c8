"""Held-out folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

FOLDS = 5
#: Bytes of labelled text of each label that may come to the driver; a text beyond a sixteenth of it is not learned from.
LABEL_BYTES = 16 << 20


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by ``FOLDS``; null ids are."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def bounded_sample(rows: DataFrame, id_col: str, label_col: str, per_label: int, labels: int = 1024) -> DataFrame:
    """About ``per_label`` rows of each label (all, where there are fewer), the same on every run.

    Rows are taken by a hash of their id below a share that follows from the
    label's count, so the sample is bounded whatever the table's size, and no
    label gathers in one task.  Of more than ``labels`` different labels the most
    frequent ones are learned from.
    """
    counts = rows.groupBy(label_col).count().orderBy(F.desc("count"), label_col).limit(labels)
    share = counts.select(label_col, F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("count")).alias("_share"))
    spread = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(share), label_col).filter(spread < F.col("_share")).select(*rows.columns)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, max_bytes: int = LABEL_BYTES) -> tuple[list[Row], dict[int, int]]:
    """(rows of doc_id, text, label in order of doc_id; number of rows of each label that may be learned from).

    At most about ``per_label`` rows and ``max_bytes`` bytes of each label come
    to the driver, chosen by a hash of the id.  Labels other than 0 and 1 and ids
    with both labels are not learned from; of several texts of one id the first
    in order is.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    marks = marks.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    marks = marks.filter("label = other").select("doc_id", "label")
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    sample = bounded_sample(marks, "doc_id", "label", per_label)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes // 16)
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    # A few thousand rows of each label.
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("_bytes", so_far).filter(F.col("_bytes") <= max_bytes)
    return rows.select("doc_id", "text", "label").orderBy("doc_id").collect(), counts
