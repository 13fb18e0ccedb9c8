"""Joins whose hot keys are split over several tasks.

A key is hot if it has more than its share of ``1 / HOT_PARTS`` of all rows (and
more than ``LEAST``).  Sizes add up to the number of rows, so at most
``HOT_PARTS`` keys are hot however large the table is; only those are broadcast.
The rows of a hot key are dealt into parts of about that share by a hash of
something else, and the other side's row is copied once for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stage

HOT_PARTS = 4096
LEAST = 64


def hot_keys(stage: Stage, name: str, counts: DataFrame, on: list[str], size: str, total: int) -> DataFrame | None:
    """Written (on, _parts) of the hot keys among ``counts`` (on, size) of a table of ``total`` rows: HOT_PARTS at most, None if none is."""
    share = max(LEAST, -(-total // HOT_PARTS))
    hot = counts.filter(F.col(size) > share).select(*on, F.ceil(F.col(size) / share).cast("int").alias("_parts"))
    return None if hot.isEmpty() else stage.table(hot, name)


def salted(rows: DataFrame, hot: DataFrame | None, on: list[str], spread: Column) -> DataFrame:
    """``rows`` with ``_salt``: 0, or for a hot key its part by ``spread``, a hash."""
    if hot is None:
        return rows.withColumn("_salt", F.lit(0))
    out = rows.join(F.broadcast(hot), on, "left")
    return out.withColumn("_salt", F.pmod(spread, F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")).drop("_parts")


def copied(rows: DataFrame, hot: DataFrame | None, on: list[str]) -> DataFrame:
    """``rows`` once for each part of their key, with ``_salt``."""
    if hot is None:
        return rows.withColumn("_salt", F.lit(0))
    out = rows.join(F.broadcast(hot), on, "left")
    return out.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], hot: DataFrame | None, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` on ``on``; hot keys of ``rows`` in parts, which those of ``keyed`` are copied to."""
    if hot is None:
        return rows.join(keyed, on, how)
    return salted(rows, hot, on, spread).join(copied(keyed, hot, on), [*on, "_salt"], how).drop("_salt")
