"""Boards as a Spark data source: paged listings as a batch, details as a stream.

    spark.dataSource.register(BoardSource)
    spark.read.format("boards").options(base_url=..., boards="update:7,notice:8").load()
    spark.readStream.format("boards").options(...).load()

The batch has one row a page (board_key, board_id, json), a task a board; a
board's pages follow each other, as each names the next.  The stream has one row
a detail; its offset is the newest thread (date and id) of each board that was
handed out, so a run that was killed goes on after the last batch it finished.
Requests are tried again with growing pauses.  Tasks of one host share its
rate: each waits ``pause`` times their number between two requests.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..config import Source
from .landing import Get, http_get, pages

RAW = "board_key string, board_id string, json string"


def patient(get: Get, interval: float, retries: int, wait: Callable[[float], None] = time.sleep) -> Get:
    """``get`` with ``interval`` seconds between requests, each tried ``retries`` times more after 1, 2, 4 ... intervals."""
    last = [0.0]

    def ask(path: str, params: dict) -> dict:
        for attempt in range(retries + 1):
            wait(max(0.0, last[0] + interval * 2**attempt - time.monotonic()))
            last[0] = time.monotonic()
            try:
                return get(path, params)
            except (OSError, ValueError):
                if attempt == retries:
                    raise
        raise AssertionError

    return ask


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.source = Source(base_url=options["base_url"].rstrip("/"), api_key=options.get("api_key", ""))
        self.boards = [tuple(b.split(":", 1)) for b in options["boards"].split(",") if ":" in b]
        self.pause = float(options.get("pause", "0.5"))
        self.retries = int(options.get("retries", "3"))
        self.max_items = int(options["max_items"]) if "max_items" in options else None
        self.batch = int(options.get("batch", "100"))

    def get(self, shared_by: int = 1) -> Get:
        return patient(http_get(self.source), self.pause * shared_by, self.retries)


class _Board(InputPartition):
    def __init__(self, key: str, board_id: str) -> None:
        self.key, self.board_id = key, board_id


class _Pages(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Board(*b) for b in self.options.boards]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        get = self.options.get(len(self.options.boards))
        for page in pages(get, partition.board_id, self.options.max_items, 0):
            yield partition.key, partition.board_id, json.dumps(page, ensure_ascii=False)


class _Details(SimpleDataSourceStreamReader):
    """Threads newer than the offset, oldest first, ``batch`` of a board at a time."""

    def __init__(self, options: _Options) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {key: [-1, ""] for key, _ in self.options.boards}

    def _new(self, get: Get, board_id: str, after: list) -> list[tuple[int, str]]:
        """(date, id) of the threads after the offset; pages are newest first, so the first older thread ends the listing."""
        found: set[tuple[int, str]] = set()
        for page in pages(get, board_id, None, 0):
            marks = [(int(t["createDate"]), str(t["threadId"])) for t in page["threads"]]
            found.update(m for m in marks if m > tuple(after))
            if min(marks) <= tuple(after):
                break
        return sorted(found)[: self.options.batch]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        get, rows, end = self.options.get(), [], dict(start)
        for key, board_id in self.options.boards:
            for date, thread in self._new(get, board_id, start.get(key, [-1, ""])):
                rows.append((key, board_id, json.dumps(get(f"/thread/{thread}", {"boardId": board_id}), ensure_ascii=False)))
                end[key] = [date, thread]
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The rows of a batch again, after a failure."""
        get = self.options.get()
        for key, board_id in self.options.boards:
            for date, thread in self._new(get, board_id, start.get(key, [-1, ""])):
                if (date, thread) <= tuple(end[key]):
                    yield key, board_id, json.dumps(get(f"/thread/{thread}", {"boardId": board_id}), ensure_ascii=False)


class BoardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Pages(_Options(self.options))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Details(_Options(self.options))
