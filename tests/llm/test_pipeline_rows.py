"""The pipeline's stages by their thresholds and row by row."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from .test_near_dup import brute_classes


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")


def test_near_stage_links_from_80_per_cent(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(10**9)}" for _ in range(204)]
        other = list(base)
        for at in (20, 70, 120, 170):  # five shingles each: J = 180 / 220
            other[at] = f"new{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    want = {i for i, (_, _, kept) in brute_classes(rows, corpus_pipeline.NEAR_PERCENT).items() if kept}
    assert want == set(range(0, 120, 2)) and all(kept for _, _, kept in brute_classes(rows).values())
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table(spark, rows), "").select("doc_id").collect()}
    assert got == want


def kept_rows(spark, stage, rows, folder=""):
    return sorted(((r["doc_id"], r["text"]) for r in stage(spark, table(spark, rows), folder).collect()), key=str)


def test_verdicts_are_per_row(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lettered = [(1, "a clean text"), (1, "1 2 3"), (None, "another text"), (None, None), (None, "..."), (1, None)]
    assert kept_rows(spark, corpus_pipeline.language_id, lettered) == sorted([lettered[0], lettered[2]], key=str)
    leaks = [(1, "a clean text"), (1, "alpha beta gamma"), (None, "another text"), (None, "see alpha beta gamma")]
    assert kept_rows(spark, corpus_pipeline.decontamination, leaks, str(tmp_path)) == sorted([leaks[0], leaks[2]], key=str)
    copies = [(5, "same"), (5, "same"), (2, "same"), (2, "same"), (None, "same"), (2, "other"), (None, "nobody"), (None, "nobody"), (7, "twice"), (7, "twice")]
    assert kept_rows(spark, corpus_pipeline.exact_dedup, copies) == sorted([(2, "same"), (2, "other"), (None, "nobody"), (7, "twice")], key=str)


def test_near_stage_keeps_one_row_of_each_class(spark):
    base = " ".join(f"word{i} stands here" for i in range(40))
    near, far = base.replace("word7", "other"), " ".join(f"thing{i} lies there" for i in range(40))
    rows = [(9, base), (None, near), (3, near), (3, near), (3, far), (None, far), (None, "alone it is"), (None, "alone it is"), (4, "4 five words in text"), (4, "quite another short text here"), (8, ""), (8, None)]
    want = [(3, near), (3, far), (None, "alone it is"), (4, "4 five words in text"), (4, "quite another short text here"), (8, ""), (8, None)]
    assert kept_rows(spark, corpus_pipeline.near_dedup, rows) == sorted(want, key=str)


def test_language_stage_drops_letter_junk_only(spark):
    rng = random.Random(7)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(600)) for _ in range(100)]
    both = docs.unionByName(spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(junk)], docs.schema))
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, both, "").select("doc_id").collect()}
    lettered = {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert not any(i >= 10**6 for i in got) and got <= lettered and len(got) > 0.98 * len(lettered)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, unlabelled, "").select("doc_id").collect()} == lettered
    print("kept", len(got), "of", len(lettered))
