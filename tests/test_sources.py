"""Paging, parsing, HTML, configuration, streaming, command line."""

import json

import numpy as np
from pyspark.sql import functions as F

from loreweave import cli, config, schema
from loreweave.functions import present
from loreweave.operators.dense import DenseIndex, build_dense, search_dense, term_counts, unit_rows
from loreweave.plans import jobs, review
from loreweave.sources import landing
from loreweave.sources import store as store_module
from loreweave.sources.files import publish
from loreweave.sources.html import visible_text
from loreweave.sources.store import Store
from loreweave.streaming.ingest import stream_ingest


def thread(i):
    return {"threadId": i, "title": f"t{i}", "createDate": 1767225600 + i}


def test_paging_follows_markers_until_nothing_is_new(spark):
    asked = []
    answers = [
        {"threads": [thread(100)], "totalElements": 3, "blockStartKey": ["a", "b"], "blockStartNo": 1},
        {"threads": [thread(101)], "totalElements": 3, "blockStartKey": ["c"], "blockStartNo": 2},
        {"threads": [thread(101)], "totalElements": 3, "blockStartKey": ["c"], "blockStartNo": 2},
    ]

    def get(path, params):
        asked.append(params)
        return answers[len(asked) - 1]

    got = landing.fetch_board(spark, get, "update", "7", pause=0).orderBy("thread_id").collect()
    assert [r["thread_id"] for r in got] == ["100", "101"] and len(asked) == 3
    assert asked[1]["blockStartKey"] == "a,b" and got[0]["published_at"] == "2026-01-01T09:01:40+09:00" and got[0]["url"] == "/update/100"


def test_paging_stops_at_the_limit(spark):
    asked = []

    def get(path, params):
        asked.append(params)
        return {"threads": [thread(1)], "totalElements": 200, "blockStartKey": ["k"], "blockStartNo": 1}

    assert landing.fetch_board(spark, get, "update", "1", 1, pause=0).count() == 1
    assert len(asked) == 1 and asked[0]["pageSize"] == 1


def test_visible_text():
    html = "<style>p{}</style><h1> A </h1><!-- no --><p>b<img alt='map'><img src=x>&amp; c</p><script>1</script>"
    assert visible_text(html) == "A\nb\n[이미지: map]\n& c" and visible_text(None) == ""


def test_details(spark):
    raw = [("update", "1", json.dumps({"threadId": 5, "title": "T", "createDate": 0, "content": "<p>가  나</p><p>다</p>"}))]
    r = landing.parse_details(spark.createDataFrame(raw, "board_key string, board_id string, json string")).first()
    assert (r["plain_text"], r["published_at"], r["url"], len(r["content_hash"])) == ("가 나\n다", "1970-01-01T09:00:00+09:00", "/update/5", 16)


def test_config():
    s = config.load({"BOARD_TARGETS": "a:1, b:2,bad", "TOP_K": "x", "DEFAULT_PREFER_LATEST": "no", "STORE_URL": "sqlite:///data/x"})
    assert s.source.board_targets == (("a", "1"), ("b", "2")) and s.query.top_k == 8 and not s.policy.default_prefer_latest and s.store_path == "data/x"
    assert config.load({}).source.board_targets == (("update", ""),)
    assert config.store_path("") == "data/notes" and config.store_path("/abs") == "/abs"


def test_stream_takes_each_file_once(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    line = lambda i, text: json.dumps({"board_key": "update", "board_id": "1", "json": json.dumps({"threadId": i, "title": f"t{i}", "createDate": i, "content": text})}) + "\n"
    (landed / "a.json").write_text(line(1, "<p>x</p>") + line(2, "<p>y</p>"))
    store = Store(spark, f"file://{tmp_path}/store")
    run = lambda: stream_ingest(spark, store, f"file://{landed}", f"file://{tmp_path}/ck").awaitTermination()
    run()
    assert store.notes.count() == 2
    (landed / "b.json").write_text(line(2, "<p>z</p>"))
    run()
    run()
    assert {r["plain_text"] for r in store.notes.collect()} == {"x", "z"} and store.runs.count() == 2


def test_command_line(spark, tmp_path):
    said = []
    at = f"file://{tmp_path}/s"
    landed = tmp_path / "in.json"
    landed.write_text(json.dumps({"board_key": "update", "board_id": "1", "json": json.dumps({"threadId": 1, "title": "거래소 안내", "createDate": 0, "content": "<p>거래소 이용료가 5퍼센트로 바뀝니다.</p>"})}))
    run = lambda *a: cli.main(["--store", at, *a], spark, said.append)
    run("init")
    run("ingest", f"file://{landed}")
    run("status")
    run("search", "거래소 이용료")
    run("enrich")
    run("review")
    text = "\n".join(said)
    assert "inserted=1" in text and "notes: 1" in text and "거래소 안내" in text and "processed=0" in text
    assert cli.safe_text("가", "ascii") == "?"


def notes_of(spark, *rows):
    return spark.createDataFrame([(u, t, p, x) for u, t, p, x in rows], "url string, title string, published_at string, plain_text string")


def test_note_ids_are_drawn_again_where_taken(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(schema, "NOTE_IDS", 64)
    store = Store(spark, f"file://{tmp_path}/store")
    store.upsert_notes(notes_of(spark, *((f"u/{i}", "t", "2026-01-01", "x") for i in range(6))))
    before = {r["url"]: r["id"] for r in store.notes.collect()}
    store.upsert_notes(notes_of(spark, *((f"u/{i}", "new", "2026-01-02", "y") for i in range(4, 14))))
    rows = store.notes.collect()
    assert len(rows) == 14 == len({r["id"] for r in rows})
    assert all(r["id"] == before[r["url"]] for r in rows if r["url"] in before)
    known = next(r for r in rows if r["url"] == "u/5")
    assert (known["title"], known["published_at"]) == ("new", "2026-01-01")


def test_batches_add_parts_that_supersede(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_PARTS", 3)
    store = Store(spark, f"file://{tmp_path}/store")
    chunk = lambda n, *texts: spark.createDataFrame([(n * 10 + i, n, i, t) for i, t in enumerate(texts)], "id long, note_id long, chunk_index int, chunk_text string")
    owner = lambda *ids: spark.createDataFrame([(i,) for i in ids], "note_id long")
    want = {}
    for step in range(8):
        n = step % 3
        texts = [f"{step}-{k}" for k in range(step % 4)]
        store.put("chunks", chunk(n, *texts) if texts else chunk(n, "x").limit(0), owner(n))
        want[n] = texts
        got = {}
        for r in store.chunks.orderBy("id").collect():
            got.setdefault(r["note_id"], []).append(r["chunk_text"])
        assert got == {k: v for k, v in want.items() if v}
    assert len(store._parts("chunks", store.version("chunks"))) <= 3
    at = store.version("chunks")
    assert store.put("chunks", chunk(9, "a"), after=at - 1) is None and store.version("chunks") == at
    assert publish(spark, f"{store.path}/chunks", f"m{at}", "[]") is False


def test_a_url_twice_in_a_batch_counts_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    got = jobs.run_ingestion(store, notes_of(spark, ("u/1", "old", "2026-01-01", "a"), ("u/1", "new", "2026-01-02", "b")), rebuild=False)
    assert got["inserted"] == 1 and [r["plain_text"] for r in store.notes.collect()] == ["b"]


def test_crawl_fetches_details_and_tries_failures_again(spark, tmp_path):
    asked, broken = [], {"101"}

    def get(path, params):
        asked.append(path)
        if path == "/threads":
            return {"threads": [thread(100), thread(101)], "totalElements": 2}
        number = path.rsplit("/", 1)[1]
        if number in broken:
            raise OSError("timed out")
        return {"threadId": number, "title": f"t{number}", "createDate": 1, "content": f"<p>text {number}</p>"}

    settings = config.Settings(source=config.Source(board_targets=(("update", "7"),)), ingestion=config.Ingestion(2))
    store = Store(spark, f"file://{tmp_path}/store")
    run = lambda: jobs.crawl(store, get, settings=settings, pause=0, rebuild=False)
    first = run()
    assert (first["inserted"], first["errors"], first["status"]) == (1, 1, "partial_success")
    second = run()
    assert (second["skipped"], second["errors"]) == (1, 1)
    third = run()  # failed twice: not asked for any more
    assert (third["errors"], third["status"]) == (0, "success") and asked.count("/thread/101") == 2
    assert landing.board_total(get, "7") == 2
    assert review.source_parity(store, get, settings.source) == [{"board": "update", "store": 1, "source": 2, "match": False}]


def test_full_refresh_crawls_analyses_and_indexes(spark, tmp_path):
    def get(path, params):
        if path == "/threads":
            return {"threads": [thread(100), thread(101)], "totalElements": 2}
        number = path.rsplit("/", 1)[1]
        return {"threadId": number, "title": f"거래소 안내 {number}", "createDate": 1, "content": f"<p>거래소 이용료가 {number}퍼센트로 바뀝니다.</p>"}

    settings = config.Settings(source=config.Source(board_targets=(("update", "7"),)))
    store = Store(spark, f"file://{tmp_path}/store")
    got = jobs.full_refresh(store, get, settings=settings, pause=0)
    assert (got["inserted"], got["processed"], got["chunks"]) == (2, 2, 2) and got["features"] > 0
    assert store.chunks.count() == 2 and [r["run_type"] for r in store.runs.collect()] == ["manual"]
    again = jobs.full_refresh(store, incoming=notes_of(spark, ("u/1", "t", "2026-01-01", "x")), settings=settings)
    assert (again["inserted"], again["processed"]) == (1, 3)


def test_a_fold_that_lost_its_race_takes_no_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_PARTS", 2)
    store = Store(spark, f"file://{tmp_path}/store")
    store.start_run()
    store.start_run()
    other, fold = Store(spark, store.path), Store._fold
    lost = []

    def late(self, table):
        if not lost:  # another run starts while this one folds
            lost.append(1)
            monkeypatch.setattr(store_module, "MOST_PARTS", 99)
            other.start_run()
        return fold(self, table)

    monkeypatch.setattr(Store, "_fold", late)
    assert store.start_run() == 4 and sorted(r["id"] for r in store.runs.collect()) == [1, 2, 3, 4]


def test_indexes_are_kept_until_a_version_changes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    jobs.run_ingestion(store, notes_of(spark, ("u/1", "거래소 안내", "2026-01-01T00:00:00+09:00", "거래소 이용료가 5퍼센트로 바뀝니다.")))
    one = jobs.load_corpus(store)
    assert jobs.load_corpus(store) is one
    jobs.build_indexes(store)
    assert jobs.load_corpus(store) is not one
    empty = DenseIndex.load(spark, f"file://{tmp_path}/nowhere")
    assert search_dense(empty, spark.createDataFrame([(0, "거래소")], "qid int, text string"), 3).count() == 0


def test_presentation(spark):
    rows = [
        ("클래스 체인지: 상세", "n", "2025-03-12T05:00:00+09:00", "2025-03-26T04:59:59+09:00", None, '{"raw": "전체 클래스"}', 0.756),
        (None, "공지", None, None, "2025-01-02T00:00:00+09:00", None, 0.4),
        ("a very long title in front of: the rest", None, "2025-03-12T05:00:00+09:00", None, None, "{no json", 0.1),
        ("봄 이벤트 (3월)", None, "2025-03-12T05:00:00+09:00", "2025-03-12T06:00:00+09:00", None, "모두", 0.7),
    ]
    df = spark.createDataFrame(rows, "event_title string, note_title string, start_at string, end_at string, published_at string, target_scope string, score double")
    got = [tuple(r) for r in present.timeline(df, ("클래스 체인지", "이벤트"), "월").select("period", "days", "shown_title", "scope", "percent", "bucket").collect()]
    assert got == [
        ("2025-03-12 ~ 2025-03-26", 14, "클래스 체인지 (3월)", "전체 클래스", 76, "high"),
        ("2025-01-02", None, "공지", "-", 40, "mid"),
        ("2025-03-12 ~", None, "a very long title in front of: the rest", "{no json", 10, "low"),
        ("2025-03-12 ~ 2025-03-12", None, "봄 이벤트 (3월)", "모두", 70, "high"),
    ]
    assert present.recent(["b", "a"], "a", 2) == ["a", "b"]


def test_dense_index_equals_the_whole_decomposition(spark):
    rng = np.random.default_rng(3)
    words = [f"word{chr(97 + i)}x" for i in range(26)]
    texts = [(i, " ".join(rng.choice(words[(i % 3) * 8 : (i % 3) * 8 + 10], 12))) for i in range(30)]
    df = spark.createDataFrame(texts, "chunk_id long, text string")
    index = build_dense(df, max_rank=5)
    terms = {r["term"]: k for k, r in enumerate(index.terms.orderBy("term").collect())}
    matrix = np.zeros((30, len(terms)))
    for r in unit_rows(term_counts(df, "chunk_id"), index.terms, "chunk_id").collect():
        matrix[r["chunk_id"], terms[r["term"]]] = r["w"]
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    want = u[:, :5] * s[:5]
    got = np.array([r["vector"] for r in index.vectors.orderBy("chunk_id").collect()])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-2)
