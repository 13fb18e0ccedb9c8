"""Jobs over a store: ingestion, enrichment, index builds, the full refresh."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import content_hash, normalize_text
from ..operators import relational as R
from ..operators.analyze import chunk_notes, tag_chunks
from ..operators.dense import DenseIndex, build_dense
from ..operators.events import extract_events
from ..operators.search import Corpus, search_table
from ..operators.sparse import SparseIndex, build_sparse, index_text
from ..rules import KOREAN, RulePack
from ..sources.files import file_system, hadoop_path, numbered, publish
from ..sources.staging import Stage
from ..sources.landing import Get, all_listings, fetch_board, fetch_details, parse_details
from ..sources.store import Store


def index_path(store: Store, settings: Settings | None = None) -> str:
    """Folder of the indexes: the configured one, else beside the tables."""
    settings = settings or Settings()
    if settings.vector.backend != "local":
        raise ValueError(f"unknown vector backend {settings.vector.backend!r}")
    return settings.vector.index_path or f"{store.path}/indexes"


def build_indexes(store: Store, settings: Settings | None = None) -> dict[str, int]:
    """Both indexes over all chunks, written as a new version that the pointer then names.

    Feature counts of chunks that did not change are taken from the version before.
    """
    path = index_path(store, settings)
    stage = Stage(store.spark, "index-texts")
    texts = stage.table(index_text(store.chunks, store.notes), "texts")
    built = _index_version(store, path)
    before = SparseIndex.load(store.spark, f"{path}/v{built}/sparse") if built else None
    version = built + 1
    while file_system(store.spark, path).exists(hadoop_path(store.spark, f"{path}/v{version}")):  # another build is under way
        version += 1
    sparse = build_sparse(texts, before).save(f"{path}/v{version}/sparse")
    dense = build_dense(texts, stage=f"{path}/v{version}/stage-dense").save(f"{path}/v{version}/dense")
    search_table(store.chunks, store.notes, store.tags).write.parquet(f"{path}/v{version}/rows")
    file_system(store.spark, path).delete(hadoop_path(store.spark, f"{path}/v{version}/stage-dense"), True)
    publish(store.spark, path, f"p{version}", "")
    out = {"chunks": texts.count(), "features": sparse.idf.count(), "rank": dense.rank}
    stage.drop("texts")
    return out


def _index_version(store: Store, path: str) -> int:
    return max(numbered(store.spark, path, "p"), default=0)


_corpora: dict[tuple, tuple[tuple, Corpus]] = {}


def load_corpus(store: Store, settings: Settings | None = None) -> Corpus:
    """Tables and the current indexes, which are built if there are none; kept until a version changes."""
    path = index_path(store, settings)
    if not _index_version(store, path):
        build_indexes(store, settings)
    state = (_index_version(store, path), store.versions())
    key = (store.spark.sparkContext.applicationId, store.path, path)
    if key not in _corpora or _corpora[key][0] != state:
        at = f"{path}/v{state[0]}"
        rows = store.spark.read.parquet(f"{at}/rows")
        corpus = Corpus(store.notes, store.chunks, store.tags, store.events, SparseIndex.load(store.spark, f"{at}/sparse"), DenseIndex.load(store.spark, f"{at}/dense"), rows)
        _corpora[key] = state, corpus
    return _corpora[key][1]


def analyse_into(store: Store, notes: DataFrame, rules: RulePack = KOREAN, settings: Settings | None = None, year: int | None = None) -> None:
    """Rebuild chunks, tags and events of ``notes``."""
    settings = settings or Settings()
    owners = notes.select(F.col("id").alias("note_id"))
    # Each step reads what the one before wrote.
    chunks = store.put("chunks", chunk_notes(notes, rules), owners)
    tags = store.put("tags", tag_chunks(chunks, notes, rules, settings.policy), owners)
    store.put("events", extract_events(chunks, tags, notes, year or dt.date.today().year), owners)


def run_ingestion(store: Store, incoming: DataFrame, run_type: str = "manual", rules: RulePack = KOREAN, settings: Settings | None = None, failed: DataFrame | None = None, rebuild: bool = True) -> dict:
    """Take in notes (url, title, published_at, raw_html, plain_text[, content_hash, source_board]).

    New urls are inserted, changed texts updated, the same text skipped, urls
    that failed too often left out; of several rows of a url the latest counts.  ``failed`` (url, error_message) lists details
    that could not be fetched.
    """
    settings = settings or Settings()
    store.init()
    run_id = store.start_run(run_type)
    if "content_hash" not in incoming.columns:
        incoming = incoming.withColumn("content_hash", content_hash(F.coalesce("plain_text", F.lit(""))))
    if "published_at" not in incoming.columns:
        incoming = incoming.withColumn("published_at", F.lit(None).cast("string"))
    incoming = R.best_per_key(incoming, ["url"], [F.desc("published_at"), F.asc("content_hash")])
    # Written: the parts that decide what changed are superseded further down.
    stage = Stage(store.spark, "ingestion")
    acted = stage.table(R.classify_changes(incoming, store.notes, store.run_items, settings.ingestion.max_retries), "acted")
    counts = {r["action"]: r["n"] for r in acted.groupBy("action").agg(F.count("*").alias("n")).collect()}
    errors = failed.count() if failed is not None else 0
    changed = acted.filter("action <> 'skip'")
    if counts.get("insert", 0) + counts.get("update", 0):
        analyse_into(store, store.upsert_notes(changed.drop("action")), rules, settings)
        if rebuild:
            build_indexes(store, settings)
    items = acted.select("url", "action", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message"))
    if failed is not None:
        items = items.unionByName(failed.select("url", F.lit("fetch").alias("action"), F.lit("failed").alias("status"), "error_message"))
    store.record_items(run_id, items)
    status = "partial_success" if errors else "success"
    scanned = sum(counts.values()) + errors
    store.finish_run(run_id, status, scanned, counts.get("insert", 0), counts.get("update", 0), errors)
    stage.drop("acted")
    return {"run_id": run_id, "status": status, "scanned": scanned, "inserted": counts.get("insert", 0), "updated": counts.get("update", 0), "skipped": counts.get("skip", 0), "errors": errors}


def crawl(store: Store, get: Get, run_type: str = "scheduled", max_items: int | None = None, rules: RulePack = KOREAN, settings: Settings | None = None, rebuild: bool = True, pause: float | None = None, url: str = "/%s/%s") -> dict:
    """List all boards, leave out abandoned urls, fetch details one by one, and take them in.

    Details that fail are recorded; a later run tries them again until they have
    failed ``max_retries`` times.
    """
    settings = settings or Settings()
    store.init()
    spark, pause = store.spark, settings.source.request_delay if pause is None else pause
    boards = [fetch_board(spark, get, key, board, max_items, min(pause, 0.5), url) for key, board in settings.source.board_targets]
    listing = all_listings(boards, max_items).join(R.abandoned_urls(store.run_items, settings.ingestion.max_retries), "url", "left_anti")
    listing = listing.orderBy(F.desc("published_at"), "thread_id")
    raw, failed = fetch_details(spark, get, listing, pause)
    return run_ingestion(store, parse_details(raw, url), run_type, rules, settings, failed, rebuild)


def run_enrichment(store: Store, force: bool = False, limit: int | None = None, rules: RulePack = KOREAN, settings: Settings | None = None, rebuild: bool = True) -> dict[str, int]:
    """Analyse notes that have no chunks yet, or all of them; newest first if limited."""
    todo = R.newest_notes(R.without_chunks(store.notes, store.chunks, only_missing=not force), limit)
    stage = Stage(store.spark, "enrichment")
    ids = stage.table(todo.select("id"), "ids")  # written: what has no chunks changes below
    n = ids.count()
    if n:
        fresh = store.notes.join(ids, "id", "left_semi").select("id", normalize_text(F.col("plain_text"), rules).alias("plain_text"))
        store.update_texts(fresh)
        analyse_into(store, store.notes.join(ids, "id", "left_semi"), rules, settings)
    stage.drop("ids")
    if rebuild and (n or force):
        build_indexes(store, settings)
    return {"processed": n}


def full_refresh(store: Store, get: Get | None = None, incoming: DataFrame | None = None, run_type: str = "manual", settings: Settings | None = None, pause: float | None = None) -> dict:
    """Init, take in all boards over ``get`` (or ``incoming`` notes), analyse everything anew, index."""
    store.init()
    if get is not None:
        out = crawl(store, get, run_type, settings=settings, rebuild=False, pause=pause)
    else:
        out = run_ingestion(store, incoming, run_type, settings=settings, rebuild=False)
    out |= run_enrichment(store, force=True, settings=settings, rebuild=False)
    return out | build_indexes(store, settings)
