"""Rows kept or dropped by a verdict on their own text, without a join."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def passing(docs: DataFrame, run: Run, column: str, wanted: bool, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` for which ``column`` of ``run``'s output, taken as a truth value, is ``wanted``.

    ``run`` gets batches of (row in the batch, text) and answers each row, in
    order and batch by batch.  So a row's verdict is its own whatever its id.
    """
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def feed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    yield pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), pc.cast(batch.column(place), pa.string())], names=["doc_id", "text"])

        masks, have = [], 0
        for part in run(feed()):
            masks.append(pc.cast(part.column(part.schema.get_field_index(column)), pa.bool_()))
            have += part.num_rows
            if waiting and have == waiting[0].num_rows:
                mask = pa.concat_arrays(masks)
                yield waiting.popleft().filter(mask if wanted else pc.invert(mask))
                masks, have = [], 0
        if waiting:
            raise RuntimeError("rows without a verdict")

    return docs.mapInArrow(kept, docs.schema)
