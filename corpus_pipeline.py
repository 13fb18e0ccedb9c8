"""Training-corpus pipeline: language, exact copies, near copies, benchmark leaks, packing.

Every stage judges rows, not ids: rows that share an id or have none do not pass
for each other.  Null texts have no letter and go in the first stage; of equal or
near rows, repeated ones among them, one stays; texts of any length are read
whole; empty tables give empty results; other columns go through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.decontaminate import uncontaminated
from loreweave.llm.exact_dedup import exact_duplicates
from loreweave.llm.language import cosine_bounds, in_known_language, learn
from loreweave.llm.near_dup import near_duplicates
from loreweave.llm.packing import pack
from loreweave.sources.staging import Stage


def _numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written so that it stays the same, and the number's column."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    return Stage(spark, f"rows-{name}").table(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _keep(rows: DataFrame, row: str, good: DataFrame) -> DataFrame:
    """The rows whose number is among ``good``'s (one column, no repeats); columns as they were."""
    good = good.toDF("_kept_row")
    return rows.join(good, rows[row] == good["_kept_row"], "left_semi").drop(row)


def _first(row: str) -> Column:
    """Of a group's rows the number of the one with the smallest id; null ids last, ties by row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row")))["row"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and those whose cosine to every learned language is too low for their length.

    Bounds are fitted on the training folds; short texts of few examples have none.
    Where nothing could be learned every text with a letter stays.
    """
    model = learn(docs)
    return in_known_language(docs, model, cosine_bounds(docs, model))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays; one row, also of repeated rows and null ids."""
    rows, row = _numbered(spark, docs, "exact")
    kept = exact_duplicates(rows, keep="smallest", row_col=row).filter("kept")
    return _keep(rows, row, kept.groupBy("text_sha256").agg(F.min("row")).select("min(row)"))


#: Per cent of Jaccard similarity from which two documents are near copies.
NEAR_PERCENT = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id stays; one row, also of repeated rows and null ids."""
    rows, row = _numbered(spark, docs, "near")
    classes = near_duplicates(spark, rows, id_col=row, percent=NEAR_PERCENT).select(F.col("doc_id").alias(row), "component_id")
    return _keep(rows, row, classes.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(_first(row).alias("row")).select("row"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark window."""
    return uncontaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language, near copies and packing have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = Stage(spark, "pipeline")
    before = None
    for name, step in STAGES[:-1]:
        docs = stage.table(step(spark, docs, sf_dir), name)
        if before:
            stage.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
