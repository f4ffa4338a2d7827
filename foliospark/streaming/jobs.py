"""Streams of item events: latest state, admissions under a rate limit, windows of progress."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECONDS = 60


def progress_windows(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window_start, kind, events) of a stream or table of (ts, kind); late rows are taken for ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "kind").agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "kind", "events")


def once(events: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """A stream without rows delivered again within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def _latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, status = state.get if state.exists else (-1, "")
    for batch in batches:
        best = batch.loc[batch["seq"].idxmax()]
        if best["seq"] > seq:
            seq, status = int(best["seq"]), str(best["status"])
    state.update((seq, status))
    yield pd.DataFrame({"item_key": [key[0]], "seq": [seq], "status": [status]})


def latest_states(log: DataFrame) -> DataFrame:
    """The last state of each item of a stream of (item_key, seq, status), emitted whenever rows of it arrive; rows that
    arrive late or twice never set it back. One number and one status are kept for each item, for good: an item may come
    back at any time."""
    return log.select("item_key", "seq", "status").groupBy("item_key").applyInPandasWithState(_latest, "item_key string, seq long, status string", "seq long, status string", "update", GroupStateTimeout.NoTimeout)


def _admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, rpm: int) -> Iterator[pd.DataFrame]:
    open_at = list(state.get[0]) if state.exists else []
    # of a batch's rows only their times are held
    asked = np.sort(np.concatenate([batch["ts"].to_numpy(np.int64) for batch in batches]), kind="stable")
    admitted = []
    for second in asked.tolist():
        open_at = [t for t in open_at if t > second - SECONDS]
        at = second if len(open_at) < rpm else open_at[-rpm] + SECONDS
        open_at.append(at)
        admitted.append(at)
    state.update((open_at[-rpm:],))
    yield pd.DataFrame({"client": [key[0]] * len(asked), "asked": asked, "admitted": admitted})


def admissions(requests: DataFrame, rpm: int) -> DataFrame:
    """(client, asked, admitted) of a stream of (client, ts in epoch seconds): when each request is let through if at most
    ``rpm`` are in any trailing minute."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _admit(key, batches, state, rpm)

    return requests.select("client", "ts").groupBy("client").applyInPandasWithState(run, "client string, asked long, admitted long", "open_at array<long>", "append", GroupStateTimeout.NoTimeout)
