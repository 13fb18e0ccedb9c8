"""The pipeline against brute force, and its stages' columns."""

import importlib

import corpus_pipeline
from pyspark.sql import functions as F

from .test_near_dup import brute_classes, brute_hits
from .test_tokens import checked


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = []
    base = " ".join(f"word{i} stands here" for i in range(40))
    rows += [(1, base, "en"), (2, base, "en"), (3, base.replace("word7", "other"), "en"), (4, "123 456", "en"), (5, None, "en"), (6, "the exam asks one two three four five six seven eight nine ten words", "en")]
    rows += [(10 + i, f"plain clean text number {i} about topic{i} and thing{i * 7} with some words", "en") for i in range(30)]
    docs = spark.createDataFrame([(i, t, g, "src", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "exam asks one two three four five six seven eight nine ten")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    first = {}
    for i, t in kept:
        first.setdefault(t, i)
    kept = [(i, t) for i, t in kept if first[t] == i]
    classes = brute_classes(kept)
    kept = [(i, t) for i, t in kept if classes[i][2]]
    bad = {r[0] for r in brute_hits(kept, items) if r[5]}
    kept = [(i, t) for i, t in kept if i not in bad]
    assert bad == {6} and 2 not in dict(kept) and 3 not in dict(kept)
    assert checked(kept, corpus_pipeline.run(spark, str(tmp_path)).collect()) == 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("_kept", F.lit(1))
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()


def test_entry_has_each_query():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_empty_and_odd_tables_run_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "a b c d e f", "en", "s", 1), (None, None, None, None, None), (1, "", "en", "s", 0), (1, "x y " * 200_000, "en", "s", 2), (1, "x y " * 200_000, "en", "s", 2)]
    for name, some in (("none", []), ("odd", rows)):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        assert len({(r["doc_id"], r["doc_tokens"]) for r in got}) == (0 if name == "none" else 2)
