"""Many questions in one plan, pruned reads, distributed order, interval join."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.operators import analyze as A
from loreweave.operators import clusters as C
from loreweave.operators import relational as R
from loreweave.operators import search as H
from loreweave.operators import sparse as X
from loreweave.operators.dense import build_dense
from loreweave.rules import ENGLISH
from loreweave.sources import staging
from loreweave.sources.staging import Stage


@pytest.mark.parametrize("limits", [{}, {"PART_VECTORS": 50, "PART_QUESTIONS": 3, "HELD_QUESTIONS": 0}])
def test_nearest_vectors_are_exact_and_few_are_read(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(C, name, value)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 12))[rng.integers(0, 30, 1500)] + 0.1 * rng.standard_normal((1500, 12))
    x[5], x[7] = 0, x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    found = C.clustered(Stage(spark, "test"), vectors)
    assert len(found.centres) > 1 and found.sizes.sum() == 1499
    ids = [*range(0, 1500, 100), 5, 7]
    asked = vectors.filter(F.col("chunk_id").isin(ids)).select(F.col("chunk_id").alias("qid"), F.col("vector").alias("q"))
    allowed = vectors.filter("chunk_id % 3 > 0").select("chunk_id")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for candidates, keep in ((None, np.ones(1500, bool)), (allowed, np.arange(1500) % 3 > 0)):
        got = {}
        for r in C.nearest(found, asked, 10, candidates).collect():
            got.setdefault(r["qid"], []).append((-round(r["score"], 10), r["chunk_id"]))
        for q in ids:
            score = np.round(unit @ unit[q], 10)
            want = [(-score[i], i) for i in np.lexsort((np.arange(1500), -score)) if score[i] > 0 and keep[i]][:10]
            assert [i for _, i in sorted(got.get(q, []))] == [i for _, i in want]
    read = C.members_read(found, asked, 10).collect()
    assert sum(r["read"] for r in read) < 0.4 * sum(r["all"] for r in read)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "chunk_id long, vector array<double>")
    found = C.clustered(Stage(spark, "test"), none)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, q array<double>")
    assert C.nearest(found, asked, 3).count() == 0


def topic_texts(n=240):
    """Texts of eight vocabularies that share no runs of letters."""
    rng = random.Random(5)
    pools = [[a + b for a in letters for b in letters] for letters in ("abc", "def", "ghi", "jkl", "mno", "pqr", "stu", "vwx")]
    return [(i, " ".join(rng.choice(pools[i % 8]) for _ in range(rng.randint(5, 60)))) for i in range(n)]


@pytest.mark.parametrize("rows_held", [20_000, 0])
def test_blocks_that_cannot_reach_the_top_are_not_read(spark, monkeypatch, rows_held):
    monkeypatch.setattr(X, "held_or_written", lambda *a: staging.held_or_written(*a[:3], rows_held))
    texts = spark.createDataFrame(topic_texts(), "chunk_id long, text string")
    index = X.build_sparse(texts)
    questions = spark.createDataFrame([(i, f"{t} {u} unknownword") for (i, t), (_, u) in zip(topic_texts(8), topic_texts(16)[8:], strict=True)] + [(90, "zz"), (91, "")], "qid long, text string")
    rows = lambda df: sorted((r["qid"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    for candidates in (None, texts.filter("chunk_id % 5 > 1").select("chunk_id")):
        got = rows(X.search_sparse(index, questions, 4, candidates))
        assert got == rows(X.top_scores(X.search_sparse(index, questions, None, candidates), 4)) and len(got) == 32
    read = X.postings_read(index, questions, 4).collect()
    assert sum(r["read"] for r in read) < 0.75 * sum(r["all"] for r in read)


def test_an_index_after_batches_equals_one_built_anew(spark, tmp_path, monkeypatch):
    counted, plain = [], X.feature_counts
    monkeypatch.setattr(X, "feature_counts", lambda texts, key="chunk_id": counted.append(sorted(r[key] for r in texts.collect())) or plain(texts, key))
    state, index = dict(topic_texts(60)) | {70: None, 71: ""}, None
    # Changed, added, removed, emptied, and an id that comes back with the text of another one.
    batches = [({}, [], sorted(state)), ({3: "new words here", 90: "added one"}, [5, 6], [3, 90]), ({5: state[7], 8: "", 70: "now a text"}, [90], [5, 8, 70]), ({}, [], [])]
    frame = lambda: spark.createDataFrame(sorted(state.items()), "chunk_id long, text string")
    for at, (changed, gone, want) in enumerate(batches):
        state = {k: v for k, v in state.items() if k not in gone} | changed
        index = X.build_sparse(frame(), index).save(f"file://{tmp_path}/v{at}")
        assert counted.pop() == sorted(want)
    anew = X.build_sparse(frame())
    rows = lambda df, *names: sorted(tuple(round(r[c], 12) if isinstance(r[c], float) else r[c] for c in names) for r in df.collect())
    for name, columns in (("postings", ("feature", "chunk_id", "n", "tf", "weight", "unit")), ("idf", ("feature", "df", "idf")), ("norms", ("chunk_id", "norm")), ("digests", ("chunk_id", "digest"))):
        assert rows(getattr(index, name), *columns) == rows(getattr(anew, name), *columns)


def small_corpus(spark):
    rng = random.Random(9)
    words = ["archer", "license", "season", "boost", "maintenance", "token", "tale", "river", "stone", "cloud"]
    notes = spark.createDataFrame(
        [(i, f"https://x/{i}", rng.choice(words) + f" {i}", f"2025-{1 + i % 12:02d}-0{1 + i % 9}T06:00:00+09:00", " ".join(rng.choice(words) for _ in range(30))) for i in range(60)],
        "id long, url string, title string, published_at string, plain_text string",
    )
    chunks = A.chunk_notes(notes, ENGLISH).cache()
    tags = A.tag_chunks(chunks, notes, ENGLISH)
    kinds = ["season_event", "boosting_event", "class_change"]
    events = [(i, i % 60, None, kinds[i % 3], f"k{i}", f"event {i}", None, f"2025-0{1 + i % 9}-11T00:00:00+09:00" if i % 2 else None, None, i % 4 or None) for i in range(90)]
    events = spark.createDataFrame(events, "id long, note_id long, chunk_id long, event_type string, event_key string, title string, summary string, start_at string, end_at string, limit_per_account int")
    none = {c: F.lit(None).cast("string") for c in ("raw_period_text", "raw_target_text", "raw_realm_text", "target_scope", "realm_scope")}
    texts = X.index_text(chunks, notes)
    return H.Corpus(notes, chunks, tags, events.withColumns(none).cache(), X.build_sparse(texts), build_dense(texts, max_rank=6))


@pytest.mark.parametrize("filters", [H.Filters(), H.Filters("season_event", "2025-03-01", "2025-10-01")])
def test_many_questions_are_answered_as_each_alone(spark, monkeypatch, filters):
    asked = ["when was the season", "token of the archer", "how often the boost, maintenance", "nothing known", "license"]
    corpus = small_corpus(spark)
    questions = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(asked)], "qid string, text string")
    got = H.answer(spark, corpus, questions, filters, 6, ENGLISH)
    names = [c for c in got.hits.columns if c not in ("qid", "place")]
    flat = lambda r: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names)
    many = {q: [flat(r) for r in got.hits.filter(F.col("qid") == q).orderBy("place").collect()] for q in (f"q{i}" for i in range(len(asked)))}
    for i, q in enumerate(asked[:2]):
        alone = H.search(spark, corpus, q, filters, 6, ENGLISH)
        assert [flat(h) for h in alone.hits] == many[f"q{i}"] and alone.hits
    # Written instead of held by the driver.
    for module in (H, X, C):
        monkeypatch.setattr(module, "held_or_written", lambda *a: staging.held_or_written(*a[:3], 0))
    again = H.answer(spark, corpus, questions, filters, 6, ENGLISH).hits
    assert sorted(map(str, again.select("qid", "place", "source_id").collect())) == sorted(map(str, got.hits.select("qid", "place", "source_id").collect()))


def test_order_over_a_table_without_one_task_for_all(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc") if i % 7 else None, rng.randint(0, 5)) for i in range(3000)]
    table = spark.createDataFrame(rows, "id long, a string, b int").repartition(7)
    order = [F.desc("a"), F.asc("b"), F.asc("id")]
    got = R.globally_ranked(table, order)
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    want = [r["id"] for r in table.orderBy(*order).collect()]
    assert [r["id"] for r in got.orderBy("place").collect()] == want
    assert [r["place"] for r in got.orderBy("place").collect()] == list(range(1, 3001))
    assert R.globally_ranked(table.limit(0), order).count() == 0


def test_interval_join_equals_the_filter_of_each_range(spark):
    rng = random.Random(3)
    day = lambda lo=0, hi=900: f"202{rng.randint(4, 6)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" + rng.choice(["", "T05:00:00+09:00", "T23:59:59+09:00"])
    maybe = lambda: rng.choice([None, day(), day(), day()])
    events = [(i, maybe(), maybe(), day()) for i in range(150)] + [(200, "soon", None, "2025-01-01"), (201, None, None, None), (202, "2025-02", "2025-03", "2025-01-01"), (203, "", "", "2025-01-01")]
    events = spark.createDataFrame(events, "id long, start_at string, end_at string, published_at string").cache()
    ranges = [(i, maybe(), maybe()) for i in range(30)] + [(40, None, None), (41, "2025", "2025-06"), (42, "2025-05-05", "2025-05-05"), (43, "x", None), (44, None, "")]
    got = {}
    for r in R.overlapping_ranges(events, spark.createDataFrame(ranges, "rid long, date_from string, date_to string"), "id", "rid").collect():
        got.setdefault(r["rid"], []).append(r["id"])
    first = lambda *values: next((v for v in values if v is not None), None)

    def meets(row, low, high):
        _, start, end, published = row
        last, begin = first(end, start, published), first(start, end, published)
        return (low is None or last is not None and last >= low) and (high is None or begin is not None and begin <= high)

    rows = [tuple(r) for r in events.collect()]
    for rid, low, high in ranges:
        assert sorted(got.get(rid, [])) == sorted(r[0] for r in rows if meets(r, low, high)), (rid, low, high)
    some = R.overlapping(events, "2025-03-01", "2025-06")
    assert sorted(r["id"] for r in some.collect()) == sorted(r[0] for r in rows if meets(r, "2025-03-01", "2025-06"))
