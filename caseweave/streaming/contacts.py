"""Live forms of the batch operators. The batch operators stay the truth: late rows past the watermark are dropped here."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.temporal import BURST_N, BURST_S

BURST_SCHEMA = "key string, start timestamp, end timestamp, first_id long, third_id long"
_STATE = "ids array<long>, times array<double>, fired boolean"


def _bursts(forget_ms: int):
    def run(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, times, fired = state.get if state.exists else ([], [], False)
        rows = sorted([*zip(times, ids, strict=True), *((t.timestamp(), i) for b in batches for t, i in zip(b["at"], b["id"], strict=True))])
        out, keep = [], rows[-(BURST_N - 1) :]
        for i in range(len(rows) - BURST_N + 1 if not fired else 0):
            (t0, first), (t2, third) = rows[i], rows[i + BURST_N - 1]
            if t2 - t0 <= BURST_S:
                out.append((key[0], pd.Timestamp(t0, unit="s"), pd.Timestamp(t2, unit="s"), first, third))
                fired = True
                break
        state.update(([i for _, i in keep], [t for t, _ in keep], fired))
        state.setTimeoutTimestamp(max(int(rows[-1][0] * 1000) + forget_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "start", "end", "first_id", "third_id"])

    return run


def live_bursts(contacts: DataFrame, delay: str = "1 hour", forget_s: int = 7 * 86_400) -> DataFrame:
    """The first burst of each key over a stream of (key string, id long, at timestamp). Contacts later than the watermark are
    dropped. The state of a key is its last two contacts and whether it has fired; it goes once the watermark has passed the last
    contact by `forget_s` seconds, a burst's width at least. A key that then bursts again is told again: the sink keeps alerts once
    (see new_alerts and rules.evaluate)."""
    marked = contacts.withWatermark("at", delay)
    run = _bursts(max(forget_s, BURST_S) * 1000)
    return marked.groupBy("key").applyInPandasWithState(run, BURST_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def new_alerts(alerts: DataFrame, at: str = "at", delay: str = "1 hour") -> DataFrame:
    """Each alert key once within the watermark; the sink's own anti-join catches older repeats."""
    return alerts.withWatermark(at, delay).dropDuplicatesWithinWatermark(["case_id", "rule", "key"])


def activity(contacts: DataFrame, width: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Contacts per key and tumbling window."""
    return contacts.withWatermark("at", delay).groupBy(F.window("at", width), "key").agg(F.count("*").alias("contacts"))


def process_new_files(spark, path: str, checkpoint: str, handle) -> None:
    """Hand every batch of new files under `path` to `handle(files, batch_id)`, then stop; a rerun takes only newer ones."""
    files = spark.readStream.format("binaryFile").load(path)
    files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start().awaitTermination()
