"""Event records out of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import slots as S
from ..functions import text as T
from ..schema import EVENTS, conform
from .analyze import event_type


def completeness(*slots: Column) -> Column:
    """Number of slots that are filled."""
    filled = [F.nullif(s.cast("string"), F.lit("")).isNotNull().cast("int") for s in slots]
    return sum(filled[1:], filled[0])


def keep_most_complete(records: DataFrame, keys: list[str], score: Column, order: Column) -> DataFrame:
    """One record of each key: the most complete, of equal ones the last in order."""
    best = Window.partitionBy(*keys).orderBy(score.desc(), order.desc())
    return records.withColumn("_at", F.row_number().over(best)).filter("_at = 1").drop("_at")


def extract_events(chunks: DataFrame, tags: DataFrame, notes: DataFrame, reference_year: int) -> DataFrame:
    """Event records of chunks.

    Dates without a year take the note's year, notes without a date take
    ``reference_year``.  Of records with the same note, type and key the most
    complete one stays.
    """
    types = tags.groupBy("chunk_id").agg(F.collect_set("topic_type").alias("types"))
    base = chunks.join(notes.select(F.col("id").alias("note_id"), F.col("title").alias("note_title"), "published_at"), "note_id")
    base = base.join(types.withColumnRenamed("chunk_id", "id"), "id", "left")
    section = F.coalesce(F.nullif("section_title", F.lit("")), "note_title")
    base = base.withColumn("section", section).withColumn("text", T.joined(F.col("note_title"), F.col("section"), F.col("chunk_text")))
    base = base.withColumn("event_type", event_type(F.col("text"), F.coalesce("types", F.array().cast("array<string>")))).filter(F.col("event_type").isNotNull())
    year = F.coalesce(F.nullif(F.substring("published_at", 1, 4), F.lit("")).cast("int"), F.lit(reference_year))
    text = F.col("text")
    got = base.withColumns({"raw_period_text": S.raw_period(text), "raw_target_text": S.raw_target(text), "raw_realm_text": S.raw_realm(text), "limit_per_account": S.account_limit(text)})
    got = got.withColumns({"start_at": S.period_start(F.col("raw_period_text"), year), "end_at": S.period_end(F.col("raw_period_text"), year)})
    got = got.withColumn("title", F.trim(F.regexp_replace("section", "[┃◾]", "")))
    source = F.coalesce("start_at", F.nullif(F.substring("published_at", 1, 10), F.lit("")), "title")
    got = got.withColumn("event_key", F.concat_ws(":", "event_type", source, T.slug(F.coalesce("raw_target_text", "title"))))
    got = got.withColumns({"target_scope": S.scope_json(F.col("raw_target_text")), "realm_scope": S.scope_json(F.col("raw_realm_text")), "summary": T.first_sentence(F.col("chunk_text"))})
    score = completeness(*(F.col(c) for c in ("start_at", "end_at", "target_scope", "realm_scope", "limit_per_account")))
    kept = keep_most_complete(got, ["note_id", "event_type", "event_key"], score, F.col("chunk_index"))
    kept = kept.withColumns({"chunk_id": F.col("id"), "id": F.xxhash64("note_id", "event_type", "event_key"), "is_historical": F.lit(1)})
    return conform(kept, EVENTS)
