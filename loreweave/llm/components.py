"""Connected components as joins of edge and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stage


def connected_components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """Smallest reachable id of every end of ``edges`` (a, b), as (v, label).

    In each round every vertex takes the least of itself and its neighbours,
    labels take their own labels until none changes (chains halve each time), and
    edges are rewritten to the labels of their ends; those within one label go.
    So at most half of the vertices of a component are left for the next round.
    Only labels that do change are joined with the vertices, so a large class is
    not moved for its own sake.  Labels are a written table, never collected.
    """
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    current = stage.table(ordered(edges), f"{name}-edges-0")
    labels, step = None, 0
    while labels is None or not current.isEmpty():
        step += 1
        ends = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = ends.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label"))
        own = _settled(stage.table(hooked, f"{name}-hooked-{step}-0"), stage, f"{name}-hooked-{step}")
        if labels is None:
            labels = own
        else:
            moved = own.select(F.col("v").alias("label"), F.col("label").alias("up")).filter("up <> label")
            labels = stage.table(labels.join(moved, "label", "left").select("v", F.coalesce("up", "label").alias("label")), f"{name}-labels-{step}")
        end = lambda x: own.select(F.col("v").alias(x), F.col("label").alias(f"{x}_label"))  # noqa: B023, E731
        rewritten = current.join(end("a"), "a").join(end("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
        current = stage.table(ordered(rewritten), f"{name}-edges-{step}")
        stage.drop(f"{name}-edges-{step - 1}")
    return labels


def _settled(labels: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(v, label) with each label replaced by its own label until it is its own."""
    step = 0
    while True:
        step += 1
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up")).filter("up <> label")
        moves = stage.table(labels.select("label").distinct().join(up, "label"), f"{name}-moves-{step}")
        if moves.isEmpty():
            return labels
        labels = stage.table(labels.join(moves, "label", "left").select("v", F.coalesce("up", "label").alias("label")), f"{name}-{step}")
        stage.drop(f"{name}-{step - 1}", f"{name}-moves-{step}")
