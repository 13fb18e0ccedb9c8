"""Boards as a data source against a local server, failures as the state of a stream."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from loreweave.operators.relational import abandoned_urls
from loreweave.sources.boards import BoardSource, patient
from loreweave.sources.landing import parse_details, parse_pages
from loreweave.streaming.failures import failure_states


class Board:
    """Threads of a board, newest first, a page of ``size`` at a time."""

    def __init__(self, threads, size=3):
        self.threads, self.size, self.asked, self.broken = threads, size, [], set()

    def answer(self, path, params):
        self.asked.append(path)
        if path in self.broken:
            self.broken.discard(path)
            raise OSError
        if path == "/threads":
            rows = sorted(self.threads, reverse=True)
            at = int(params.get("blockStartNo", 0))
            some = [{"threadId": str(t), "title": f"t{t}", "createDate": t} for t in rows[at : at + self.size]]
            return {"threads": some, "totalElements": len(rows), "blockStartKey": [at + self.size], "blockStartNo": at + self.size}
        thread = path.rsplit("/", 1)[1]
        return {"threadId": thread, "title": f"t{thread}", "createDate": int(thread), "content": f"<p>text {thread}</p>"}


@pytest.fixture
def board():
    board = Board(list(range(100, 110)))

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            try:
                data = json.dumps(board.answer(url.path, {k: v[-1] for k, v in parse_qs(url.query).items()})).encode()
            except OSError:
                return self.send_error(500)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    board.url = f"http://127.0.0.1:{server.server_port}"
    yield board
    server.shutdown()


def options(board, **more):
    return {"base_url": board.url, "boards": "update:7", "pause": "0", **more}


def test_pages_are_read_as_a_table(spark, board):
    spark.dataSource.register(BoardSource)
    board.broken.add("/threads")  # one failure is tried again
    raw = spark.read.format("boards").options(**options(board)).load()
    rows = parse_pages(raw.coalesce(1)).collect()
    assert {r["thread_id"] for r in rows} == {str(t) for t in range(100, 110)} and {r["board_key"] for r in rows} == {"update"}


def test_a_stream_goes_on_where_it_was_killed(spark, board, tmp_path):
    spark.dataSource.register(BoardSource)
    taken = []

    def run(fail_at=None):
        def take(batch, number):
            rows = [r["external_id"] for r in parse_details(batch).collect()]
            if fail_at is not None and number >= fail_at:
                raise RuntimeError("killed")
            taken.append((number, rows))

        stream = spark.readStream.format("boards").options(**options(board, batch="4")).load()
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"file://{tmp_path}/ck").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="killed"):
        run(fail_at=1)
    assert taken == [(0, ["100", "101", "102", "103"])]
    asked = len([p for p in board.asked if p == "/thread/100"])
    run()
    assert sorted(t for _, rows in taken for t in rows) == [str(t) for t in range(100, 110)]
    assert len([p for p in board.asked if p == "/thread/100"]) == asked  # not fetched again
    board.threads += [110, 111]
    run()
    assert sorted(taken[-1][1]) == ["110", "111"]


def test_requests_wait_and_are_tried_again():
    waited, calls = [], []

    def get(path, params):
        calls.append(path)
        if len(calls) < 3:
            raise OSError("busy")
        return {}

    assert patient(get, 5.0, 3, waited.append)("/x", {}) == {}
    assert len(calls) == 3 and waited[1] > 9 and waited[2] > 19
    with pytest.raises(OSError):
        patient(lambda *a: (_ for _ in ()).throw(OSError("gone")), 0.0, 1, waited.append)("/x", {})


def test_failures_are_kept_as_state(spark, tmp_path):
    items = tmp_path / "items"
    items.mkdir()
    batches = [[("u/1", "failed"), ("u/2", "failed"), ("u/1", "success")], [("u/1", "failed"), ("u/3", "failed"), (None, "failed")], [("u/1", "failed"), ("u/2", "failed"), ("u/2", "failed")]]
    latest, every = {}, []

    def run():
        stream = spark.readStream.schema("url string, status string").option("maxFilesPerTrigger", 1).json(f"file://{items}")
        out = failure_states(stream, 3).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/ck")
        out.foreachBatch(lambda df, _: latest.update({r["url"]: (r["failures"], r["abandoned"]) for r in df.collect()})).trigger(availableNow=True).start().awaitTermination()

    for i, batch in enumerate(batches):  # each run goes on from the state of the one before
        (items / f"{i}.json").write_text("\n".join(json.dumps({"url": u, "status": s}) for u, s in batch))
        every += batch
        run()
        want = {r["url"] for r in abandoned_urls(spark.createDataFrame(every, "url string, status string").filter("url is not null"), 3).collect()}
        assert {u for u, (_, gone) in latest.items() if gone} == want
    assert latest == {"u/1": (3, True), "u/2": (3, True), "u/3": (1, False)}
