"""Filters, joins, aggregates and orders of the store's read queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import Stage

# -- filters -----------------------------------------------------------------
def in_dates(df: DataFrame, date_from: str | None, date_to: str | None, column: str = "published_at") -> DataFrame:
    """Rows whose ISO text lies in the range; text order, so a bare end date ends before that day's times."""
    if date_from:
        df = df.filter(F.col(column) >= date_from)
    if date_to:
        df = df.filter(F.col(column) <= date_to)
    return df


def overlapping(df: DataFrame, date_from: str | None, date_to: str | None) -> DataFrame:
    """Events whose span meets the range; missing ends fall back to the other end, then the note's date."""
    if date_from:
        df = df.filter(F.coalesce("end_at", "start_at", "published_at") >= date_from)
    if date_to:
        df = df.filter(F.coalesce("start_at", "end_at", "published_at") <= date_to)
    return df


#: Spans and ranges of up to 2 ** SPAN_LEVELS days are told apart by length; longer ones share the last level.
SPAN_LEVELS = 16


def _buckets(rows: DataFrame, low: str, high: str) -> DataFrame:
    """``rows`` with day numbers ``low`` and ``high``, once for each level from that of their length on and each bucket they touch there.

    A bucket of level l has 2 ** l days, so a span of its own level or below
    touches two at most; the last level has one bucket for all days.
    """
    days = F.greatest(F.col(high) - F.col(low) + 1, F.lit(1))
    rows = rows.withColumn("_own", F.least(F.ceil(F.log2(days)), F.lit(SPAN_LEVELS)).cast("int"))
    rows = rows.withColumn("_level", F.explode(F.sequence("_own", F.lit(SPAN_LEVELS))))
    bucket = lambda day: F.when(F.col("_level") == SPAN_LEVELS, F.lit(0)).otherwise(F.expr(f"shiftright({day}, _level)"))
    rows = rows.withColumns({"_first": bucket(low), "_last": bucket(high)})
    return rows.withColumn("_bucket", F.explode(F.sequence("_first", "_last"))).drop("_last")


def overlapping_ranges(events: DataFrame, ranges: DataFrame, event_key: str, range_key: str) -> DataFrame:
    """(range_key, event_key) of each of ``ranges`` (range_key, date_from, date_to) and the events that ``overlapping`` finds for it.

    Events have start_at, end_at and published_at.  Both sides are dealt to
    buckets of days of all lengths from their own on; a pair meets at the level
    of the longer of the two, where neither touches more than two buckets, and
    counts in the first bucket they share.  So the join makes few pairs that do
    not overlap, whatever the lengths.  Open ends and texts that are no dates
    reach over all days; the text order of ``overlapping`` decides at the end.
    """
    day = lambda c: F.unix_date(F.substring(c, 1, 10).try_cast("date"))
    far = 1 << 22
    spans = events.select(event_key, F.coalesce("start_at", "end_at", "published_at").alias("_from"), F.coalesce("end_at", "start_at", "published_at").alias("_to"))
    a, b = day(F.col("_from")), day(F.col("_to"))
    odd = a.isNull() | b.isNull() | (a > b) | (F.length("_from") < 10) | (F.length("_to") < 10)
    spans = spans.withColumns({"_low": F.when(odd, -far).otherwise(a), "_high": F.when(odd, far).otherwise(b)})
    # A bare month or year as an end stands before its first day.
    asked = ranges.select(range_key, "date_from", "date_to")
    low, high = day(F.col("date_from")), day(F.col("date_to"))
    wide = (F.col("date_from").isNotNull() & low.isNull()) | (F.col("date_to").isNotNull() & high.isNull()) | (low > high)
    asked = asked.withColumns({"_low": F.when(wide | low.isNull(), -far).otherwise(low), "_high": F.when(wide | high.isNull(), far).otherwise(high)})
    left = _buckets(spans, "_low", "_high").select(event_key, "_from", "_to", F.col("_own").alias("_own_a"), F.col("_first").alias("_first_a"), "_level", "_bucket")
    right = _buckets(asked, "_low", "_high").select(range_key, "date_from", "date_to", F.col("_own").alias("_own_b"), F.col("_first").alias("_first_b"), "_level", "_bucket")
    met = left.join(right, ["_level", "_bucket"]).filter((F.col("_level") == F.greatest("_own_a", "_own_b")) & (F.col("_bucket") == F.greatest("_first_a", "_first_b")))
    meets = (F.col("date_from").isNull() | (F.col("_to") >= F.col("date_from"))) & (F.col("date_to").isNull() | (F.col("_from") <= F.col("date_to")))
    return met.filter(meets).select(range_key, event_key)


def with_topic(chunks: DataFrame, tags: DataFrame, topic: str | None, key: str = "chunk_id") -> DataFrame:
    """Chunks that have a tag of a type."""
    if not topic:
        return chunks
    return chunks.join(tags.filter(F.col("topic_type") == topic).select(F.col("chunk_id").alias(key)), key, "left_semi")


def without_chunks(notes: DataFrame, chunks: DataFrame, only_missing: bool = True) -> DataFrame:
    """Notes with text; of those, the ones not analysed yet."""
    notes = notes.filter("plain_text is not null and plain_text <> ''")
    return notes.join(chunks.select(F.col("note_id").alias("id")), "id", "left_anti") if only_missing else notes


def newest_notes(notes: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = notes.orderBy(F.desc("published_at"), F.desc("id"))
    return ordered.limit(limit) if limit else ordered


# -- aggregates --------------------------------------------------------------
def ordered_distinct(value: str, order: str) -> Column:
    """Distinct values of a group in order of first occurrence, nulls left out."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: p["v"].isNotNull()), lambda p: p["v"]))


def tag_summary(tags: DataFrame) -> DataFrame:
    """One row a chunk: policy flags and its distinct types and keys."""
    return tags.groupBy("chunk_id").agg(
        F.max("prefer_latest").alias("prefer_latest"),
        F.max("preserve_history").alias("preserve_history"),
        ordered_distinct("topic_type", "id").alias("topic_types"),
        ordered_distinct("topic_key", "id").alias("topic_keys"),
    )


def search_rows(chunks: DataFrame, notes: DataFrame, tags: DataFrame, topic: str | None = None, date_from: str | None = None, date_to: str | None = None, latest_default: int = 1) -> DataFrame:
    """Chunks with their note and summed-up tags; untagged chunks count as latest-first.

    Tags are summed up before the join, so a chunk's text is never repeated.
    """
    own = chunks.select(F.col("id").alias("chunk_id"), "note_id", "chunk_index", "section_title", "chunk_text")
    own = with_topic(own, tags, topic)
    dated = in_dates(notes.select(F.col("id").alias("note_id"), F.col("title").alias("note_title"), "published_at", "url"), date_from, date_to)
    rows = own.join(dated, "note_id").join(tag_summary(tags), "chunk_id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "prefer_latest": F.coalesce("prefer_latest", F.lit(latest_default)),
            "preserve_history": F.coalesce("preserve_history", F.lit(0)),
            "topic_types": F.coalesce("topic_types", none),
            "topic_keys": F.coalesce("topic_keys", none),
        }
    )


def search_order(df: DataFrame) -> list[Column]:
    """Newest note first, chunks in order; ids decide what the columns leave open."""
    return [F.desc("published_at"), F.asc("chunk_index"), F.asc("chunk_id")]


def chunk_rows_by_id(chunks: DataFrame, notes: DataFrame, tags: DataFrame, ids: list[int]) -> DataFrame:
    """Search rows of given chunks; none for no ids.  Untagged chunks are not latest-first here."""
    some = chunks.filter(F.col("id").isin(ids)) if ids else chunks.limit(0)
    return search_rows(some, notes, tags, latest_default=0)


def filter_chunk_ids(chunks: DataFrame, notes: DataFrame, tags: DataFrame, topic: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    own = with_topic(chunks.select(F.col("id").alias("chunk_id"), "note_id"), tags, topic)
    dated = in_dates(notes.select(F.col("id").alias("note_id"), "published_at"), date_from, date_to)
    return own.join(dated, "note_id").select("chunk_id").distinct()


def event_rows(events: DataFrame, notes: DataFrame, chunks: DataFrame, topic: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Event records with note and chunk; the type filter is on the event's type."""
    return with_chunk_text(owned_events(events, notes, topic, date_from, date_to), chunks)


def owned_events(events: DataFrame, notes: DataFrame, topic: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Event records with their note, without texts of chunks."""
    if topic:
        events = events.filter(F.col("event_type") == topic)
    owned = events.withColumnsRenamed({"id": "event_record_id", "title": "event_title"}).join(
        notes.select(F.col("id").alias("note_id"), F.col("title").alias("note_title"), "published_at", "url"), "note_id"
    )
    return overlapping(owned, date_from, date_to)


def with_chunk_text(owned: DataFrame, chunks: DataFrame) -> DataFrame:
    """``owned_events`` with section and text of their chunk, or their own where there is none."""
    parts = chunks.select(F.col("id").alias("chunk_id"), "section_title", "chunk_text")
    rows = owned.join(parts, "chunk_id", "left")
    return rows.withColumns(
        {
            "section_title": F.coalesce("section_title", "event_title"),
            "chunk_text": F.coalesce("chunk_text", "summary", "event_title"),
            "topic_types": F.array("event_type"),
            "topic_keys": F.array("event_type"),
            "prefer_latest": F.lit(0),
            "preserve_history": F.lit(1),
        }
    )


def event_order() -> list[Column]:
    return [F.coalesce("start_at", "published_at").desc(), F.asc("event_record_id")]


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in an order."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_at = 1").drop("_at")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def globally_ranked(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in an order over the whole table, without a task that holds it.

    Rows are dealt to ranges of the order and written sorted; each range's rank
    starts after the sizes of the ranges before it (one number a range).
    """
    stage = Stage(rows.sparkSession, "ranked")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    table = stage.table(sorted_rows, "rows")
    part = F.shiftright("_row", 33)  # the number of the range; below it the row's place in the range
    sizes = sorted((r["part"], r["n"]) for r in table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    out = table.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_row", "_before")


# -- ingestion state ----------------------------------------------------------
def failures(items: DataFrame) -> DataFrame:
    return items.filter("status = 'failed'").groupBy("url").agg(F.count("*").alias("failures"))


def retry_urls(items: DataFrame, max_retries: int = 3) -> DataFrame:
    """Failed urls that may be tried again."""
    return failures(items).filter(F.col("failures") < max_retries).select("url")


def abandoned_urls(items: DataFrame, max_retries: int = 3) -> DataFrame:
    """Urls that failed too often; successes in between do not count."""
    return failures(items).filter(F.col("failures") >= max_retries).select("url")


def classify_changes(incoming: DataFrame, notes: DataFrame, items: DataFrame | None = None, max_retries: int = 3) -> DataFrame:
    """``incoming`` (url, content_hash ...) with an action: insert, update or skip; abandoned urls are left out."""
    if items is not None:
        incoming = incoming.join(abandoned_urls(items, max_retries), "url", "left_anti")
    known = notes.select("url", F.col("content_hash").alias("known_hash"), F.lit(1).alias("known"))
    action = F.when(F.col("known").isNull(), "insert").when(F.col("content_hash").eqNullSafe(F.col("known_hash")), "skip").otherwise("update")
    return incoming.join(known, "url", "left").withColumn("action", action).drop("known", "known_hash")


def run_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("action", "status").agg(F.count("*").alias("n"))


# -- review -------------------------------------------------------------------
def board_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("source_board").agg(F.count("*").alias("n")).orderBy("source_board")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a table: its name and number of rows."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parity(own: DataFrame, totals: DataFrame) -> DataFrame:
    """Boards' notes (source_board, n) against the totals their source reports (source_board, total)."""
    both = totals.join(own.withColumnRenamed("n", "own"), "source_board", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return both.select("source_board", "own", "total", (F.col("own") == F.col("total")).alias("same"))


def latest_runs(runs: DataFrame, n: int = 1) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def count_mismatches(documented: DataFrame, actual: DataFrame) -> DataFrame:
    """Names whose documented count is missing or differs (name, documented, actual)."""
    both = actual.select("name", F.col("n").alias("actual")).join(documented.select("name", F.col("n").alias("documented")), "name", "left")
    return both.filter(~F.col("documented").eqNullSafe(F.col("actual")))
