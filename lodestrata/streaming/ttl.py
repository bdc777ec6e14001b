"""Live state of a change stream, with expiry by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.session import ship

STATE = "seq bigint, value string, expires_at bigint, is_delete boolean"
OUT = "key string, seq bigint, value string, status string"


def _step(retention_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = lambda seq, value, status: pd.DataFrame([(key[0], seq, value, status)], columns=["key", "seq", "value", "status"])
        mark = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            seq, _, _, dead = state.get
            if dead:  # nothing older is expected any more
                state.remove()
                return
            # a tombstone stays for a while, so that late older entries do not come back
            state.update((seq, None, 0, True))
            state.setTimeoutTimestamp(max(mark, 0) + retention_ms)
            yield told(seq, None, "expired")
            return
        newest, before = state.getOption, state.getOption
        for rows in batches:
            top = rows.loc[rows["seq"].idxmax()]
            if newest is None or int(top["seq"]) > newest[0]:
                dead = bool(top["is_delete"])
                newest = (int(top["seq"]), None if dead else top["value"], 0 if pd.isna(top["expires_at"]) else int(top["expires_at"]), dead)
        if newest is None:
            return
        status = "deleted" if newest[3] else "live"
        if not newest[3] and newest[2] and newest[2] * 1000 <= mark:
            newest, status = (newest[0], None, 0, True), "expired"
        state.update(newest)
        # a timeout holds until the next call only, so each call sets it
        if newest[3]:
            state.setTimeoutTimestamp(max(mark, 0) + retention_ms)
        elif newest[2]:
            state.setTimeoutTimestamp(newest[2] * 1000)
        if newest != before:
            yield told(newest[0], newest[1], status)

    return run


def live_changes(changes: DataFrame, event_time: str, delay: str = "10 minutes", retention_seconds: int = 7 * 86_400) -> DataFrame:
    """A stream of (key, seq, value, status) whenever a key's visible state changes.

    ``changes``: a stream with key, seq, is_delete, value (text), expires_at
    (epoch seconds, 0 or null never) and an event time.  Status is 'live',
    'deleted' or 'expired'; an entry expires once the watermark, ``delay``
    behind the newest event, passes ``expires_at``.  A deleted or expired key is
    remembered until the watermark has moved on by ``retention_seconds``; an
    older entry that comes later than that counts as new.  Within it entries in
    any order and repeated deliveries give the same final state.  Null keys or
    seq are no entries.
    """
    ship(changes.sparkSession)
    src = changes.where("key is not null and seq is not null").withWatermark(event_time, delay)
    rows = src.select(F.col("key").cast("string").alias("key"), "seq", "is_delete", F.col("value").cast("string").alias("value"), "expires_at", event_time)
    step = _step(max(1, retention_seconds * 1000))
    return rows.groupBy("key").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
