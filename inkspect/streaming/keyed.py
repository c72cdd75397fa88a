"""One row per id from a stream, kept in state that ends with the watermark.

Rows of an id inside one micro-batch are ordered by their time and then by the digest of
their text, so a replayed batch gives the same row. ``first`` lets the first row of an id through
and holds back all others; ``last`` lets every row through that is later than what was
sent before, so the latest version of an id is the one with the largest time. Rows
older than the watermark are dropped. An id is forgotten once the watermark has passed its last
row by ``delay`` once more, so the state is bounded by the ids of that span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "at long, digest string"


def _digest(text) -> str:
    return "" if text is None else hashlib.md5(text.encode("utf-8", "replace")).hexdigest()


def one_per_id(stream: DataFrame, time_col: str, delay: str, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, time) rows of a stream, one per id (``first``) or one per new version (``last``).

    ``delay`` is an interval such as "10 minutes". Rows without an id or a time are left out.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep is first or last, not {keep}")
    span = pd.Timedelta(delay) // pd.Timedelta(milliseconds=1)
    rows = stream.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(time_col).cast("timestamp").alias("time"))
    rows = rows.where("id IS NOT NULL AND time IS NOT NULL").withWatermark("time", delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = []
        for batch in batches:
            for text, time in zip(batch["text"], batch["time"], strict=True):
                found.append((int(time.value // 1_000_000), _digest(text), text, time))
        if not found:
            return
        found.sort(key=lambda r: r[:2])
        best = found[0] if keep == "first" else found[-1]
        known = state.getOption
        if known is None or (keep == "last" and best[:2] > tuple(known)):
            state.update(best[:2])
            yield pd.DataFrame({"id": [key[0]], "text": [best[2]], "time": [best[3]]})
        until = max(found[-1][0], state.get[0]) + span
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    out = rows.groupBy("id").applyInPandasWithState(
        step, "id long, text string, time timestamp", STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.col("time").alias(time_col))
