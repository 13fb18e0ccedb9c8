"""Command line: init, ingest, status, index, search, enrich, review."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .api import Service, checked
from .config import load
from .operators import relational as R
from .plans import jobs, review
from .sources.landing import http_get, parse_details
from .sources.store import Store


def safe_text(text: str, encoding: str | None = None) -> str:
    """``text`` with what the console cannot show replaced."""
    encoding = encoding or sys.stdout.encoding or "utf-8"
    return text.encode(encoding, "replace").decode(encoding)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loreweave")
    out.add_argument("--store")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    ingest = sub.add_parser("ingest")
    ingest.add_argument("landed", help="folder of JSON lines (board_key, board_id, json)")
    ingest.add_argument("--max-items", type=int)
    ingest.add_argument("--run-type", default="manual")
    crawl = sub.add_parser("crawl", help="list boards over the network, fetch details, take them in")
    crawl.add_argument("--max-items", type=int)
    crawl.add_argument("--run-type", default="scheduled")
    sub.add_parser("refresh", help="crawl all boards, analyse every note anew, build the indexes")
    sub.add_parser("status")
    sub.add_parser("index")
    find = sub.add_parser("search")
    find.add_argument("question")
    find.add_argument("--topic-type")
    find.add_argument("--date-from")
    find.add_argument("--date-to")
    find.add_argument("--top-k", type=int)
    enrich = sub.add_parser("enrich")
    enrich.add_argument("--force", action="store_true")
    enrich.add_argument("--limit", type=int)
    look = sub.add_parser("review")
    look.add_argument("--documents", nargs="*", default=[], help="text files with documented counts")
    look.add_argument("--source", action="store_true", help="compare boards with their source")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, say=print) -> int:
    args, settings = parser().parse_args(argv), load()
    spark = spark or SparkSession.builder.appName("loreweave").getOrCreate()
    store = Store(spark, args.store or settings.store_path, read_only=args.command == "review")
    if args.command == "init":
        store.init()
        say(f"store ready: {store.path}")
    elif args.command == "ingest":
        incoming = parse_details(spark.read.schema("board_key string, board_id string, json string").json(args.landed))
        if args.max_items:
            incoming = R.newest_notes(incoming.withColumnRenamed("external_id", "id"), args.max_items).withColumnRenamed("id", "external_id")
        out = jobs.run_ingestion(store, incoming, args.run_type, settings=settings)
        say(" ".join(f"{k}={v}" for k, v in out.items()))
    elif args.command == "crawl":
        out = jobs.crawl(store, http_get(settings.source), args.run_type, args.max_items, settings=settings)
        say(" ".join(f"{k}={v}" for k, v in out.items()))
    elif args.command == "refresh":
        say(" ".join(f"{k}={v}" for k, v in jobs.full_refresh(store, http_get(settings.source), settings=settings).items()))
    elif args.command == "status":
        for name, n in review.collect_counts(store).items():
            say(f"{name}: {n}")
        for r in R.latest_runs(store.runs, 5).collect():
            say(f"run {r['id']} {r['run_type']} {r['status']} scanned={r['scanned_count']} inserted={r['inserted_count']} updated={r['updated_count']} errors={r['error_count']}")
    elif args.command == "index":
        say(" ".join(f"{k}={v}" for k, v in jobs.build_indexes(store, settings).items()))
    elif args.command == "search":
        checked(args.question, args.top_k)
        got = Service(store, settings=settings).query_debug(args.question, args.topic_type, args.date_from, args.date_to, args.top_k)
        say(safe_text(f"{got['answer']} [{got['policy_applied']}] total={got['total_hits']}"))
        for i, e in enumerate(got["evidence"], 1):
            say(safe_text(f"{i}. {e['score']:.4f} {e['published_at']} {e['note_title']} {e['url']}"))
    elif args.command == "enrich":
        say(f"processed={jobs.run_enrichment(store, args.force, args.limit, settings=settings)['processed']}")
    else:
        found = {"counts": review.collect_counts(store), "latest_run": review.latest_run(store)}
        if args.documents:
            found["documents"] = review.compare_counts(store, review.documented_counts(spark, args.documents))
        if args.source:
            found["parity"] = review.source_parity(store, http_get(settings.source), settings.source)
        say(review.dump_json(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
