"""Incremental ingestion of landed details as a stream.

Each micro-batch goes through the batch job, which is idempotent: a batch that
is repeated after a failure finds its texts unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..config import Settings
from ..operators.relational import best_per_key
from ..plans.jobs import build_indexes, run_ingestion
from ..sources.landing import parse_details
from ..sources.store import Store

LANDED = "board_key string, board_id string, json string"


def stream_ingest(spark: SparkSession, store: Store, landed: str, checkpoint: str, settings: Settings | None = None, rebuild: bool = False, files_per_batch: int = 1000) -> StreamingQuery:
    """Take in all JSON-line files under ``landed`` not seen yet, then stop."""
    lines = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).json(landed)

    def take(batch: DataFrame, number: int) -> None:
        notes = parse_details(batch)
        newest = best_per_key(notes, ["url"], [F.desc("published_at"), F.asc("content_hash")])
        run_ingestion(store, newest, "stream", settings=settings, rebuild=False)
        if rebuild:
            build_indexes(store, settings)

    return lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
