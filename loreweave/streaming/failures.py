"""Failures of urls as the state of a stream.

A batch of run items changes the counts of its own urls only; nothing is counted
anew.  A count that has not changed for ``keep`` is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAILURES = "url string, failures long, abandoned boolean"


def failure_states(items: DataFrame, max_retries: int = 3, keep_ms: int | None = None) -> DataFrame:
    """Of a stream of run items (url, status): url, failures, abandoned for each url whose count changed.

    To be written in update mode.  As in ``abandoned_urls`` successes in between
    do not count and a null url is none.  ``keep_ms`` without a failure forgets a
    url, which then comes once more with no failures.
    """

    def count(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"url": [key[0]], "failures": [0], "abandoned": [False]})
            return
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({"url": [key[0]], "failures": [n], "abandoned": [n >= max_retries]})

    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    failed = items.filter((F.col("status") == "failed") & F.col("url").isNotNull()).select("url")
    return failed.groupBy("url").applyInPandasWithState(count, FAILURES, "failures long", "update", timeout)
