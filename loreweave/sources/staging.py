"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shared_folder


class Stage:
    """Tables of one run under a folder of their own.

    ``table`` writes a DataFrame as Parquet and returns it as read again, which
    cuts the lineage: a lost executor costs the running stage only.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows up to this many, of a few values each, may be held by the driver instead of written.
LOCAL_ROWS = 20_000


class Held:
    """Intermediate results of one question set: of a small one held by the driver, of a larger one written."""

    def __init__(self, stage: Stage, small: bool) -> None:
        self.stage, self.small = stage, small

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        if self.small:
            return self.stage.spark.createDataFrame(df.toArrow(), df.schema)
        return self.stage.table(df, name)


def held_or_written(stage: Stage, df: DataFrame, name: str, limit: int = LOCAL_ROWS) -> tuple[DataFrame, Held]:
    """``df``, held if it has at most ``limit`` rows, else written, and the way to keep what follows from it."""
    some = df.limit(limit + 1).toArrow()
    if some.num_rows <= limit:
        return stage.spark.createDataFrame(some, df.schema), Held(stage, True)
    return stage.table(df, name), Held(stage, False)


#: A side of at most this many rows of a few longs may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within the bound, else as it is."""
    return F.broadcast(df) if rows <= limit else df
