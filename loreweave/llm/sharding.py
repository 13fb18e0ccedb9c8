"""Sharding by size-tiered compaction, with DataFrame operations only.

A store is a folder:

* ``data/<run>``   immutable Parquet shards of one run, and of nothing else
* ``manifest/<version>``  JSON, written aside and renamed into place

Arrivals are appended as runs of small shards.  Runs of similar size are merged,
once there are ``fanout`` of them, into one run of shards of about
``target_bytes`` of text: in order of size, a tier holds the runs of at most twice
its smallest, and all runs up to ``small_bytes`` are one tier.  So a large run is not
rewritten for the sake of small ones, and as a merge gives at least two and a half
times the largest run it read, a row beyond ``small_bytes`` is rewritten a number of
times that grows with the logarithm of the table.  A merge reads at most
``MERGE_RUNS`` runs; runs of one schema are one scan.

A version of the manifest names the runs that make up the table; readers see
whole versions only.  The rename fails where the name is taken (it is atomic on
file systems that have such a rename, HDFS among them); the loser reads the
winner's version and tries again: an append adds its runs to it, a merge counts
only if the runs it read are still there.  A lost executor only repeats tasks of
a run that no manifest names yet.  ``vacuum`` leaves runs younger than a grace
period alone, as another writer may be about to commit them.

A row's shard follows from a hash of its id, so a hot source, hot text or hot id
range spreads over all shards.  Rows of one id share a shard, unless the id (or
the null id) has a large share of all rows: those are dealt over several shards.
A single row larger than the target makes its shard larger by that row.  Columns
are stored as they are; names starting with ``shard_`` are reserved and raise an
error; null texts count 0 bytes.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.skew import hot_keys, salted
from ..sources.staging import Stage

TARGET_BYTES = 128 << 20
SMALL_BYTES = 16 << 20
#: Shards are read often and never changed, so they are packed well.
CODEC = "zstd"
FANOUT = 4
WAVES = 8
#: Runs that one merge reads, the smallest of the tier.
MERGE_RUNS = 64


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Run:
    """Immutable shards written together."""

    name: str
    shards: int
    rows: int
    bytes: int
    schema: str = ""


def id_hash(text: Column, digits: int = 8) -> Column:
    """A number of ``digits`` hexadecimal digits out of an id's text, evenly spread."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


class ShardStore:
    """A versioned table of shards; see the module's text."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "doc_id", text_col: str = "text", target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES, fanout: int = FANOUT) -> None:
        if fanout < 2 or not 0 < small_bytes <= target_bytes:
            raise ValueError("fanout must be 2 at least and 0 < small_bytes <= target_bytes")
        self.spark, self.folder = spark, folder.rstrip("/")
        self.id_col, self.text_col = id_col, text_col
        self.target_bytes, self.small_bytes, self.fanout = target_bytes, small_bytes, fanout

    # -- manifest ---------------------------------------------------------
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        fs, at = self._fs(), self._path("manifest")
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())

    def runs(self, version: int | None = None) -> list[Run]:
        have = self.versions()
        if version is None:
            version = have[-1] if have else 0
        if not version:
            return []
        if version not in have:
            raise ValueError(f"no version {version}")
        text = self.spark.read.text(f"{self.folder}/manifest/{version:012d}", wholetext=True).first()[0]
        return [Run(**{k: v for k, v in r.items() if k != "tier"}) for r in json.loads(text)["runs"]]

    def commit(self, runs: list[Run], after: int) -> int:
        """Make ``runs`` version ``after`` + 1; ``Conflict`` if somebody else did."""
        version, jvm = after + 1, self.spark._jvm
        aside, place = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/{version:012d}")
        fs = self._fs()
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": version, "runs": [asdict(r) | {"tier": self.tier_of(r.bytes)} for r in runs]}).encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(aside, place, never_over)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(place):
                raise Conflict(f"version {version} is already committed") from e
            raise
        return version

    def _latest(self) -> tuple[int, list[Run]]:
        have = self.versions()
        version = have[-1] if have else 0
        return version, self.runs(version)

    # -- writing ----------------------------------------------------------
    def _bytes(self) -> Column:
        return F.octet_length(F.coalesce(F.col(self.text_col).cast("string"), F.lit("")))

    def _shard(self, df: DataFrame, measured: int, shards: Column) -> DataFrame:
        """``df`` with shard_no below ``shards``; rows of an id with a large share of all are dealt."""
        stage = Stage(self.spark, "hot-ids")
        key = F.coalesce(F.col(self.id_col).cast("string"), F.lit(""))
        counts = df.groupBy(key.alias("shard_key")).agg(F.count("*").alias("n"))
        hot = hot_keys(stage, "hot", counts, ["shard_key"], "n", measured)
        out = salted(df.withColumn("shard_key", key), hot, ["shard_key"], F.xxhash64(F.monotonically_increasing_id()))
        return out.withColumn("shard_no", F.pmod(id_hash(F.col("shard_key")) + F.col("_salt"), shards).cast("int")).drop("shard_key", "_salt")

    def _checked(self, df: DataFrame) -> None:
        taken = [c for c in df.columns if c.lower().startswith(("shard_", "_salt", "_parts"))]
        if taken:
            raise ValueError(f"reserved column names: {taken}")

    def _write(self, df: DataFrame, shard_bytes: int, measured: tuple[int, int]) -> Run:
        rows, size = measured
        shards = max(1, math.ceil(size / shard_bytes))
        name = f"run-{uuid.uuid4().hex}"
        numbered = self._shard(df, rows, F.lit(shards))
        numbered.repartitionById(shards, F.col("shard_no")).write.option("compression", CODEC).parquet(f"{self.folder}/data/{name}")
        return Run(name, shards, rows, size, numbered.schema.json())

    def append(self, df: DataFrame, wave: Column | None = None, attempts: int = 20) -> int:
        """Commit arrivals as runs of small shards: one run, or one of each value of ``wave``.

        Waves are read once and written in one job; there should be few of them.
        """
        self._checked(df)
        wave = F.lit(0) if wave is None else wave
        name = f"run-{uuid.uuid4().hex}"
        arrivals = df.withColumn("shard_wave", wave.cast("int"))
        totals = arrivals.groupBy("shard_wave").agg(F.count("*").alias("rows"), F.sum(self._bytes()).alias("bytes")).orderBy("shard_wave").collect()
        added, schema = [], StructType([*df.schema.fields, StructField("shard_no", IntegerType())]).json()
        if totals:
            first, parts = {}, 0
            for t in totals:
                n = max(1, math.ceil(t["bytes"] / self.small_bytes))
                first[t["shard_wave"]] = (parts, n)
                parts += n
                added.append(Run(f"{name}/shard_wave={t['shard_wave']}", n, t["rows"], t["bytes"], schema))
            begin = F.create_map(*(F.lit(x) for w, (b, _) in first.items() for x in (w, b)))[F.col("shard_wave")]
            many = F.create_map(*(F.lit(x) for w, (_, n) in first.items() for x in (w, n)))[F.col("shard_wave")]
            numbered = self._shard(arrivals, sum(t["rows"] for t in totals), many)
            numbered.repartitionById(parts, (begin + F.col("shard_no")).cast("int")).write.option("compression", CODEC).partitionBy("shard_wave").parquet(f"{self.folder}/data/{name}")
        for left in range(attempts, 0, -1):
            version, runs = self._latest()
            try:
                return self.commit(runs + added, version)
            except Conflict:
                if left == 1:
                    raise
        raise ValueError("attempts must be positive")

    def tier_of(self, size: int) -> int:
        """Level of a size, for reports: 0 up to ``small_bytes``, then one more for each factor of ``fanout``."""
        return 0 if size <= self.small_bytes else 1 + int(math.log(size / self.small_bytes, self.fanout))

    def tiers(self, runs: list[Run]) -> list[list[Run]]:
        """Runs of similar size, smallest first: none above twice the smallest of its tier, but for small runs."""
        out: list[list[Run]] = []
        for run in sorted(runs, key=lambda r: (r.bytes, r.name)):
            if out and run.bytes <= max(self.small_bytes, 2 * out[-1][0].bytes):
                out[-1].append(run)
            else:
                out.append([run])
        return out

    def compact(self) -> int:
        """Merge tiers of ``fanout`` runs and more until there is none; returns the version."""
        while True:
            version, runs = self._latest()
            merged = next((t[: max(self.fanout, MERGE_RUNS)] for t in self.tiers(runs) if len(t) >= self.fanout), None)
            if merged is None:
                return version
            measured = (sum(r.rows for r in merged), sum(r.bytes for r in merged))
            run = self._write(self._read(merged).drop("shard_no", "shard_run"), self.target_bytes, measured)
            while True:
                version, runs = self._latest()
                if not set(merged) <= set(runs):  # another writer merged some of them; ours is never named
                    break
                try:
                    self.commit([r for r in runs if r not in merged] + [run], version)
                    break
                except Conflict:
                    continue

    # -- reading ----------------------------------------------------------
    def _read(self, runs: list[Run]) -> DataFrame:
        """Rows of runs with shard_run, the run's name; one scan for all runs of a schema, whose footers are not read for it."""
        alike: dict[str, list[str]] = {}
        for r in runs:
            alike.setdefault(r.schema, []).append(f"{self.folder}/data/{r.name}")
        reader = lambda schema: self.spark.read.schema(StructType.fromJson(json.loads(schema))) if schema else self.spark.read
        name = F.regexp_extract("_metadata.file_path", r"/data/(run-[0-9a-f]{32}(?:/shard_wave=[^/]+)?)/[^/]+$", 1)
        parts = [reader(schema).parquet(*paths).withColumn("shard_run", name) for schema, paths in alike.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table at a version (the last one by default) with shard_run, shard_tier, shard_no; None if empty.

        The runs' levels come from the manifest, which has one short row a run and is read whole by the driver in any case.
        """
        version = self._latest()[0] if version is None else version
        runs = self.runs(version)
        if not runs:
            return None
        named = self.spark.read.json(f"{self.folder}/manifest/{version:012d}", "runs array<struct<name string, tier int>>", multiLine=True)
        tiers = named.select(F.inline("runs")).toDF("shard_run", "shard_tier")
        return self._read(runs).join(F.broadcast(tiers), "shard_run")

    def vacuum(self, grace_seconds: int = 24 * 3600) -> None:
        """Remove runs that the last version does not name and older manifests, both only beyond the grace period."""
        have = self.versions()
        if not have:
            return
        fs, named = self._fs(), {r.name.split("/")[0] for r in self.runs(have[-1])}
        old = time.time() * 1000 - grace_seconds * 1000
        for s in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else ():
            if s.getPath().getName() not in named and (not grace_seconds or s.getModificationTime() < old):
                fs.delete(s.getPath(), True)
        for v in have[:-1]:
            at = self._path(f"manifest/{v:012d}")
            if not grace_seconds or fs.getFileStatus(at).getModificationTime() < old:
                fs.delete(at, False)


def shard_table(spark: SparkSession, docs: DataFrame, folder: str, waves: int = WAVES, **options) -> DataFrame:
    """Append ``docs`` in ``waves`` arrivals, compact, and report each stored row.

    doc_id, n_bytes, text_md5 (of the stored text), shard_tier, shard_no, shard_rows, shard_bytes.
    """
    store = ShardStore(spark, folder, **options)
    wave = F.pmod(id_hash(F.coalesce(F.col(store.id_col).cast("string"), F.lit("")), 2), F.lit(waves))
    store.append(docs, wave)
    store.compact()
    store.vacuum(grace_seconds=0)  # the folder is this call's own
    table = store.read()
    if table is None:
        table = docs.limit(0).withColumns({"shard_run": F.lit(""), "shard_tier": F.lit(0), "shard_no": F.lit(0)})
    rows = table.select(F.col(store.id_col).alias("doc_id"), store._bytes().cast("long").alias("n_bytes"), F.md5(F.coalesce(F.col(store.text_col).cast("string"), F.lit(""))).alias("text_md5"), "shard_run", "shard_tier", "shard_no")
    shards = rows.groupBy("shard_run", "shard_no").agg(F.count("*").alias("shard_rows"), F.sum("n_bytes").alias("shard_bytes"))
    return rows.join(shards, ["shard_run", "shard_no"]).select("doc_id", "n_bytes", "text_md5", "shard_tier", "shard_no", "shard_rows", "shard_bytes")
