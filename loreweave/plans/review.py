"""Checks of a store against its documents and its source."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Source
from ..operators import relational as R
from ..sources.landing import Get, board_total
from ..sources.store import Store

#: Pattern of a documented count: "notes: 1,322" or "| chunks | 13313 |".
COUNT = r"(?im)\b{name}\b[^0-9\n]{{0,40}}([0-9][0-9,]*)"
NAMES = ("notes", "chunks", "tags", "events")


def collect_counts(store: Store) -> dict:
    """Rows of each table and notes of each board."""
    tables = {r["table_name"]: r["n"] for r in R.table_counts({t: store.read(t) for t in ("notes", "chunks", "tags", "events", "runs", "run_items")}).collect()}
    return tables | {"boards": {r["source_board"]: r["n"] for r in R.board_counts(store.notes).collect()}}


def latest_run(store: Store) -> dict | None:
    row = R.latest_runs(store.runs).first()
    return row.asDict() if row else None


def board_parity(store: Store, board: str, total: int) -> dict:
    """Notes of a board against the number its source reports."""
    totals = store.spark.createDataFrame([(board, total)], "source_board string, total bigint")
    row = R.parity(R.board_counts(store.notes), totals).first()
    return {"board": board, "store": row["own"], "source": total, "match": row["same"]}


def source_parity(store: Store, get: Get, source: Source) -> list[dict]:
    """``board_parity`` of every configured board, with the totals fetched from the source."""
    return [board_parity(store, key, board_total(get, board)) for key, board in source.board_targets]


def documented_counts(spark: SparkSession, paths: list[str], names: tuple[str, ...] = NAMES) -> DataFrame:
    """(name, n) found in text files; of several files the first that has a name."""
    parts = [spark.read.text(p, wholetext=True).select(F.lit(i).alias("i"), "value") for i, p in enumerate(paths)]
    text = parts[0]
    for p in parts[1:]:
        text = text.unionByName(p)
    found = [F.struct(F.lit(n).alias("name"), F.nullif(F.replace(F.regexp_extract("value", COUNT.format(name=n), 1), F.lit(","), F.lit("")), F.lit("")).cast("bigint").alias("n")) for n in names]
    rows = text.select("i", F.explode(F.array(*found)).alias("r")).select("i", "r.*").filter("n is not null")
    return rows.groupBy("name").agg(F.min_by("n", "i").alias("n"))


def compare_counts(store: Store, documented: DataFrame) -> dict:
    """Counts that are documented wrongly or not at all."""
    actual = R.table_counts({t: store.read(t) for t in NAMES}).withColumnRenamed("table_name", "name")
    wrong = R.count_mismatches(documented, actual).orderBy("name").collect()
    return {"match": not wrong, "mismatches": [r.asDict() for r in wrong]}


def dump_json(payload: object) -> str:
    return json.dumps(payload, ensure_ascii=False, indent=2, default=str)
