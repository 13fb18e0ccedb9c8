"""The store: six tables, each a list of parts that never change.

``<path>/<table>/m<version>`` names the parts of a version, oldest first; a part
is a folder of Parquet.  A batch adds a part with its rows and the keys they
stand for; rows of older parts with those keys are superseded, which readers see
by one join on the key.  So a batch writes what it brings, not the whole table.
Once there are ``MOST_PARTS`` the next write folds them into one.

A version is published by a rename that fails if another writer was first; the
loser looks at the new version and tries again.  Readers see whole versions; the
parts of the version before stay for those who still read them.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..schema import CHUNKS, EVENTS, NOTES, RUN_ITEMS, RUNS, TABLES, TAGS, conform
from .files import file_system, hadoop_path, numbered, publish, text_of

#: What a part's rows stand for; items are only ever added.
KEYS = {"notes": "id", "chunks": "note_id", "tags": "note_id", "events": "note_id", "runs": "id", "run_items": None}
MOST_PARTS = 8


def now_text() -> str:
    """The present in ISO text, told at +09:00."""
    return dt.datetime.now(dt.timezone(dt.timedelta(hours=9))).isoformat(timespec="seconds")


class Store:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False) -> None:
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        if read_only and not self._fs().exists(hadoop_path(spark, self.path)):
            raise FileNotFoundError(path)

    # -- versions ---------------------------------------------------------------
    def _fs(self):
        return file_system(self.spark, self.path)

    def version(self, table: str) -> int:
        """Number of the current version, 0 for a table never written."""
        return max(numbered(self.spark, f"{self.path}/{table}", "m"), default=0)

    def versions(self) -> tuple[int, ...]:
        return tuple(self.version(t) for t in TABLES)

    def _parts(self, table: str, version: int) -> list[str]:
        return json.loads(text_of(self.spark, f"{self.path}/{table}/m{version}")) if version else []

    def _publish(self, table: str, version: int, parts: list[str]) -> bool:
        if not publish(self.spark, f"{self.path}/{table}", f"m{version}", json.dumps(parts)):
            return False
        if version > 2:  # the version before stays for its readers
            old, kept = self._parts(table, version - 2), {*parts, *self._parts(table, version - 1)}
            for part in set(old) - kept:
                self._fs().delete(hadoop_path(self.spark, f"{self.path}/{table}/{part}"), True)
            self._fs().delete(hadoop_path(self.spark, f"{self.path}/{table}/m{version - 2}"), True)
        return True

    def _part(self, table: str, df: DataFrame, owners: DataFrame | None) -> str:
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        name = f"part-{uuid.uuid4().hex}"
        at = f"{self.path}/{table}/{name}"
        conform(df, TABLES[table]).write.parquet(f"{at}/rows")
        if owners is not None:
            owners.distinct().write.parquet(f"{at}/owners")
        return name

    # -- tables -------------------------------------------------------------------
    def _rows(self, table: str, part: str) -> DataFrame:
        # Columns added to the schema later are null in older files.
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}/{part}/rows")

    def _merged(self, table: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        if len(parts) == 1:
            return self._rows(table, parts[0])
        key = KEYS[table]
        rows = self._rows(table, parts[0]).withColumn("_part", F.lit(0))
        owners = None
        for i, part in enumerate(parts[1:], 1):
            rows = rows.unionByName(self._rows(table, part).withColumn("_part", F.lit(i)))
            if key:
                own = self.spark.read.parquet(f"{self.path}/{table}/{part}/owners").select(key, F.lit(i).alias("_last"))
                owners = own if owners is None else owners.unionByName(own)
        if key:
            last = owners.groupBy(key).agg(F.max("_last").alias("_last"))
            rows = rows.join(last, key, "left").filter(F.coalesce("_last", "_part") == F.col("_part"))
        return rows.select(*conform(rows, TABLES[table]).columns)

    def read(self, table: str) -> DataFrame:
        return conform(self._merged(table, self._parts(table, self.version(table))), TABLES[table])

    def write(self, table: str, df: DataFrame) -> None:
        """Put ``df`` in place of the whole table."""
        part = self._part(table, df, None)
        while not self._publish(table, self.version(table) + 1, [part]):
            pass

    def put(self, table: str, df: DataFrame, owners: DataFrame | None = None, after: int | None = None) -> DataFrame | None:
        """Add rows in place of all rows with their keys, and of ``owners`` (key) even if those have none; returns the rows.

        With ``after`` only if that is still the current version, else None.
        """
        key = KEYS[table]
        if self.version(table) and len(self._parts(table, self.version(table))) >= MOST_PARTS:
            folded = self._fold(table)
            if after is not None:
                if folded != after + 1:  # another writer was first
                    return None
                after = folded
        part = self._part(table, df, None if key is None else (owners if owners is not None else df).select(key))
        while True:
            version = self.version(table)
            if after is not None and version != after:
                return None
            if self._publish(table, version + 1, [*self._parts(table, version), part]):
                return self._rows(table, part)

    def _fold(self, table: str) -> int | None:
        """Put one part in place of all; the version it made, None if another writer was first (then the next one folds)."""
        version = self.version(table)
        parts = self._parts(table, version)
        one = self._part(table, self._merged(table, parts), None)
        return version + 1 if self._publish(table, version + 1, [one]) else None

    def init(self) -> None:
        """Make missing tables; those that exist stay as they are."""
        for table in TABLES:
            if not self.version(table):
                self.write(table, self.spark.createDataFrame([], TABLES[table]))

    notes = property(lambda self: self.read("notes"))
    chunks = property(lambda self: self.read("chunks"))
    tags = property(lambda self: self.read("tags"))
    events = property(lambda self: self.read("events"))
    runs = property(lambda self: self.read("runs"))
    run_items = property(lambda self: self.read("run_items"))

    # -- notes ------------------------------------------------------------------
    def new_ids(self, urls: DataFrame) -> DataFrame:
        """(url, id) for new urls: a hash, drawn again for those whose hash is taken."""
        taken, todo, out = self.notes.select("id"), urls.select("url").distinct(), None
        attempt = 0
        while True:
            drawn = F.xxhash64("url") if not attempt else F.xxhash64("url", F.lit(attempt))
            got = todo.withColumn("id", F.pmod(drawn, F.lit(schema.NOTE_IDS))).groupBy("id").agg(F.min("url").alias("url"))
            got = got.join(taken, "id", "left_anti").select("url", "id")
            out = got if out is None else out.unionByName(got)
            todo = todo.join(got.select("url"), "url", "left_anti")
            if todo.isEmpty():
                return out
            taken = taken.unionByName(got.select("id"))
            attempt += 1

    def upsert_notes(self, changed: DataFrame, at: str | None = None) -> DataFrame:
        """Insert new urls; of known ones update board, title, hash, texts and time, but not the date published.

        Of several rows of a url the latest published one counts.  Returns the notes written.
        """
        at = at or now_text()
        latest = Window.partitionBy("url").orderBy(F.desc("published_at"), F.asc("content_hash"))
        new = conform(changed, NOTES).withColumn("_at", F.row_number().over(latest)).filter("_at = 1").drop("_at", "id")
        old = self.notes.join(new.select("url"), "url", "left_semi")
        ids = self.new_ids(new.select("url").join(old.select("url"), "url", "left_anti"))
        new = new.withColumns({"collected_at": F.lit(at), "created_at": F.lit(at), "updated_at": F.lit(at), "source_site": F.coalesce("source_site", F.lit("web")), "source_board": F.coalesce("source_board", F.lit("update"))})
        fresh = ("source_board", "title", "content_hash", "raw_html", "plain_text", "collected_at", "updated_at")
        both = new.alias("n").join(old.alias("o"), F.col("o.url") == F.col("n.url"), "left").join(ids.alias("i"), F.col("i.url") == F.col("n.url"), "left")
        known = F.col("o.url").isNotNull()
        columns = [F.coalesce("o.id", "i.id").alias("id") if c == "id" else F.when(known & ~F.lit(c in fresh), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns]
        return self.put("notes", both.select(*columns))

    def update_texts(self, texts: DataFrame) -> None:
        """Put (id, plain_text) in place."""
        self.put("notes", self.notes.drop("plain_text").join(texts.select("id", "plain_text"), "id"))

    def replace_children(self, note_ids: DataFrame, chunks: DataFrame, tags: DataFrame, events: DataFrame) -> None:
        """Chunks, tags and events of the notes (id) go, the given ones come."""
        owners = note_ids.select(F.col("id").alias("note_id"))
        for table, rows in (("chunks", conform(chunks, CHUNKS)), ("tags", conform(tags, TAGS)), ("events", conform(events, EVENTS))):
            self.put(table, rows, owners)

    # -- runs ---------------------------------------------------------------------
    def start_run(self, run_type: str = "scheduled", at: str | None = None) -> int:
        while True:
            version = self.version("runs")
            run_id = (self.runs.agg(F.max("id")).first()[0] or 0) + 1
            row = self.spark.createDataFrame([(run_id, run_type, at or now_text(), "running", 0, 0, 0, 0)], "id bigint, run_type string, started_at string, status string, scanned_count int, inserted_count int, updated_count int, error_count int")
            if self.put("runs", conform(row, RUNS), after=version) is not None:
                return run_id

    def finish_run(self, run_id: int, status: str = "success", scanned: int = 0, inserted: int = 0, updated: int = 0, errors: int = 0, note: str | None = None, at: str | None = None) -> None:
        values = {"finished_at": at or now_text(), "status": status, "scanned_count": scanned, "inserted_count": inserted, "updated_count": updated, "error_count": errors, "note": note}
        self.put("runs", self.runs.filter(F.col("id") == run_id).withColumns({c: F.lit(v) for c, v in values.items()}))

    def record_items(self, run_id: int, items: DataFrame) -> None:
        """Append (url, action, status, error_message) of a run."""
        rows = items.withColumns({"run_id": F.lit(run_id).cast("bigint"), "id": F.xxhash64(F.lit(run_id), "url", "action", "status")})
        self.put("run_items", conform(rows, RUN_ITEMS))
