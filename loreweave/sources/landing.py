"""Listings and details of boards: paging, parsing, and landed JSON.

A page is ``{"threads": [{"threadId", "title", "createDate"}], "totalElements",
"blockStartKey": [...], "blockStartNo"}``; a detail is ``{"threadId", "title",
"createDate", "content"}``.  The network is a function that gives a page or a
detail, so that the rest works on landed files as well.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Source
from ..functions.text import content_hash
from .staging import Stage
from .html import html_to_text

LISTING = "thread_id string, board_key string, board_id string, title string, published_at string, url string"
PAGE = "threads array<struct<threadId:string,title:string,createDate:bigint>>, totalElements bigint"
DETAIL = "threadId string, title string, createDate bigint, content string"
PAGE_SIZE = 100
#: Epoch seconds are told in this zone.
ZONE, OFFSET = "Asia/Seoul", "+09:00"

Get = Callable[[str, dict], dict]


def http_get(source: Source, timeout: float = 30.0) -> Get:
    """A ``get(path, params)`` over HTTP with the source's headers."""
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    headers = {"User-Agent": source.user_agent, "Accept": "application/json"} | ({"x-api-key": source.api_key} if source.api_key else {})

    def get(path: str, params: dict) -> dict:
        with urlopen(Request(f"{source.base_url}{path}?{urlencode(params)}", headers=headers), timeout=timeout) as answer:
            return json.loads(answer.read().decode("utf-8"))

    return get


def pages(get: Get, board_id: str, max_items: int | None = None, pause: float = 0.5) -> Iterator[dict]:
    """Pages of a board until all elements came, a page is empty, brings nothing new, or has no marker."""
    size = min(PAGE_SIZE, max_items) if max_items else PAGE_SIZE
    seen: set[str] = set()
    params: dict = {"boardId": board_id, "pageSize": size}
    while True:
        page = get("/threads", params)
        fresh = {str(t["threadId"]) for t in page.get("threads") or []} - seen
        if not fresh:
            return
        yield page
        seen |= fresh
        total, key = page.get("totalElements"), page.get("blockStartKey")
        if max_items and len(seen) >= max_items or total is not None and len(seen) >= int(total) or not key or page.get("blockStartNo") is None:
            return
        params = {"boardId": board_id, "pageSize": size, "blockStartKey": ",".join(map(str, key)) if isinstance(key, list) else key, "blockStartNo": page["blockStartNo"]}
        time.sleep(pause)


def board_total(get: Get, board_id: str) -> int:
    """Number of threads that the source reports for a board."""
    return int(get("/threads", {"boardId": board_id, "pageSize": 1}).get("totalElements") or 0)


def fetch_details(spark: SparkSession, get: Get, listing: DataFrame, pause: float = 2.0, path: str = "/thread/%s", on_host: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Raw details (board_key, board_id, json) of a listing's threads, and those that failed (url, error_message).

    One request after the other with a pause, as the source asks for; a failure
    is noted and the next thread follows.  Answers go to the shared folder every
    ``on_host`` threads, so the driver holds no more than those.
    """
    stage = Stage(spark, "details")
    raw = spark.createDataFrame([], "board_key string, board_id string, json string")
    failed = spark.createDataFrame([], "url string, error_message string")
    rows, lost, part = [], [], 0

    def put() -> None:
        nonlocal raw, failed, rows, lost, part
        if rows:
            raw = raw.unionByName(stage.table(spark.createDataFrame(rows, raw.schema), f"raw-{part}"))
        if lost:
            failed = failed.unionByName(stage.table(spark.createDataFrame(lost, failed.schema), f"failed-{part}"))
        rows, lost, part = [], [], part + 1

    for i, r in enumerate(listing.select("thread_id", "board_key", "board_id", "url").toLocalIterator()):
        if i:
            time.sleep(pause)
        try:
            rows.append((r["board_key"], r["board_id"], json.dumps(get(path % r["thread_id"], {"boardId": r["board_id"]}))))
        except Exception as e:  # any failure of one thread is its own
            lost.append((r["url"], str(e)[:500]))
        if len(rows) + len(lost) >= on_host:
            put()
    put()
    return raw, failed


def epoch_text(seconds: Column) -> Column:
    """ISO text with the fixed offset of an epoch column, whatever the session's zone."""
    local = F.timestamp_seconds(seconds.cast("bigint")).cast("timestamp")
    shown = F.convert_timezone(F.current_timezone(), F.lit(ZONE), local.cast("timestamp_ntz"))
    return F.concat(F.date_format(shown, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(OFFSET))


def parse_pages(raw: DataFrame, url: str = "/%s/%s") -> DataFrame:
    """Listing rows of raw pages (board_key, board_id, json); a thread counts once, its first page wins."""
    got = raw.withColumn("p", F.from_json("json", PAGE))
    order = F.monotonically_increasing_id()
    rows = got.withColumn("_page", order).select("board_key", "board_id", "_page", F.posexplode("p.threads").alias("_at", "t"))
    rows = rows.select(
        F.col("t.threadId").alias("thread_id"),
        "board_key",
        "board_id",
        F.col("t.title").alias("title"),
        epoch_text(F.col("t.createDate")).alias("published_at"),
        F.format_string(url, F.col("board_key"), F.col("t.threadId")).alias("url"),
        F.struct("_page", "_at").alias("_order"),
    )
    first = rows.groupBy("thread_id").agg(F.min_by(F.struct("board_key", "board_id", "title", "published_at", "url"), "_order").alias("r"))
    return first.select("thread_id", "r.*")


def all_listings(parts: list[DataFrame], max_items: int | None = None) -> DataFrame:
    """Boards together, newest first; the limit holds for each board and for all."""
    newest = lambda df: df.orderBy(F.desc("published_at")).limit(max_items) if max_items else df
    out = newest(parts[0])
    for p in parts[1:]:
        out = out.unionByName(newest(p))
    out = out.orderBy(F.desc("published_at"))
    return out.limit(max_items) if max_items else out


def fetch_board(spark: SparkSession, get: Get, board_key: str, board_id: str, max_items: int | None = None, pause: float = 0.5, url: str = "/%s/%s") -> DataFrame:
    """Listing of a board over ``get``."""
    rows = [(board_key, board_id, json.dumps(p)) for p in pages(get, board_id, max_items, pause)]
    out = parse_pages(spark.createDataFrame(rows, "board_key string, board_id string, json string").coalesce(1), url)
    return out.orderBy(F.desc("published_at"), "thread_id").limit(max_items) if max_items else out


def parse_details(raw: DataFrame, url: str = "/%s/%s") -> DataFrame:
    """Incoming notes of raw details (board_key, board_id, json): text, hash, url and date."""
    got = raw.withColumn("d", F.from_json("json", DETAIL)).select("board_key", "board_id", "d.*")
    got = got.withColumn("plain_text", html_to_text(F.col("content")))
    return got.select(
        F.col("threadId").alias("external_id"),
        F.col("board_key").alias("source_board"),
        F.format_string(url, F.col("board_key"), F.col("threadId")).alias("url"),
        "title",
        epoch_text(F.col("createDate")).alias("published_at"),
        F.col("content").alias("raw_html"),
        "plain_text",
        content_hash(F.col("plain_text")).alias("content_hash"),
    )
