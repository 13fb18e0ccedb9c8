"""Overlap of every question with every text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staging import BROADCAST_ROWS

#: Texts and questions that meet at once.
TEXTS, QUESTIONS = 2048, 512


def _shares(text_key: str, question_key: str):
    """Of some texts (their tokens) and some questions (theirs): the share of a question's tokens that a text has, for all pairs."""

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        questions = asked["q"].to_pylist()
        place: dict[str, int] = {}
        for q in questions:
            for token in q or ():
                place.setdefault(token, len(place))
        has = np.zeros((len(place), len(questions)), dtype=np.float64)
        for j, q in enumerate(questions):
            has[[place[t] for t in q or ()], j] = 1
        sizes = np.maximum([len(q or ()) for q in questions], 1)
        share = np.zeros((texts.num_rows, len(questions)))
        for i, own in enumerate(texts["own"]):
            some = [place[t] for t in own.as_py() or () if t in place]
            share[i] = has[some].sum(axis=0) / sizes
        rows, cols = (x.ravel() for x in np.indices(share.shape))
        return pa.table({question_key: asked[question_key].take(pa.array(cols)), text_key: texts[text_key].take(pa.array(rows)), "overlap": pa.array(share.ravel())})

    return run


def overlaps(texts: DataFrame, questions: DataFrame, text_key: str = "doc_id", question_key: str = "item_id") -> DataFrame:
    """(question_key, text_key, overlap): ``T.overlap`` of every question (key, text) with every text (key, text).

    A text is cut into tokens once, and only tokens that some question has travel on; blocks of texts meet blocks of questions.
    """
    q = questions.select(question_key, T.token_set(F.col("text")).alias("q"))
    asked = q.select(F.explode("q").alias("token")).distinct()
    own = T.token_set(F.col("text"))
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(asked.agg(F.collect_list("token").alias("asked"))))
        own = F.array_intersect(own, F.col("asked"))
    parts, turns = max(1, -(-texts.count() // TEXTS)), max(1, -(-q.count() // QUESTIONS))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    mine = texts.select(text_key, own.alias("own"), F.pmod(F.xxhash64(text_key), F.lit(parts)).alias("part"))
    mine = mine.select(text_key, "own", "part", each(turns).alias("turn"))
    theirs = q.select(question_key, "q", F.pmod(F.xxhash64(question_key), F.lit(turns)).alias("turn"), each(parts).alias("part"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"{question_key} {kind(q, question_key)}, {text_key} {kind(texts, text_key)}, overlap double"
    return mine.groupBy("part", "turn").cogroup(theirs.groupBy("part", "turn")).applyInArrow(_shares(text_key, question_key), schema)
