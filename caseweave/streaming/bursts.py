"""Bursts over a live feed that goes on from what a batch run has found.

State of a key: its last two contacts as a list, and whether it has fired. It is loaded from the batch result, so that nothing
fires twice, and a timer removes it once the watermark has passed the last contact by long enough. Rows behind the watermark
are dropped by Spark and counted in the query's progress (see late_rows).

The state store has to be RocksDB's (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.temporal import BURST_N, BURST_S, bursts

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, start timestamp, end timestamp, first_id long, third_id long"


class Bursts(StatefulProcessor):
    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at double, id long")
        self.fired = handle.getValueState("fired", "fired boolean")

    def _keep(self, rows: list[tuple[float, int]]) -> None:
        """The last contacts, and one timer behind the last of them."""
        self.recent.put(rows[-(BURST_N - 1) :])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(rows[-1][0] * 1000) + self.forget_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = sorted((t.timestamp(), int(i)) for t, i in zip(initialState["at"], initialState["id"], strict=True))
        if bool(initialState["fired"].any()):
            self.fired.update((True,))
        self._keep(rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(float(t), int(i)) for t, i in (self.recent.get() if self.recent.exists() else [])]
        new = [(t.timestamp(), int(i)) for b in rows for t, i in zip(b["at"], b["id"], strict=True)]
        every = sorted({*held, *new})
        out = []
        if not self.fired.exists():
            for i in range(len(every) - BURST_N + 1):
                (t0, first), (t2, third) = every[i], every[i + BURST_N - 1]
                if t2 - t0 <= BURST_S:
                    out.append((key[0], pd.Timestamp(t0, unit="s"), pd.Timestamp(t2, unit="s"), first, third))
                    self.fired.update((True,))
                    break
        self._keep(every)
        if out:
            yield pd.DataFrame(out, columns=["key", "start", "end", "first_id", "third_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.fired.clear()
        return iter([])

    def close(self) -> None:
        pass


def batch_state(contacts: DataFrame) -> DataFrame:
    """key, id, at, fired: what a live run goes on from after a batch of (key, id, at): each key's last two contacts and whether it
    has had its burst."""
    last = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("id"))
    kept = contacts.withColumn("_n", F.row_number().over(last)).where(F.col("_n") < BURST_N).drop("_n")
    had = bursts(contacts.withColumn("at", F.col("at").cast("timestamp_ntz")), ["key"]).select("key", F.lit(True).alias("fired"))
    return kept.join(had, "key", "left").select("key", "id", "at", F.coalesce("fired", F.lit(False)).alias("fired"))


def live_bursts(contacts: DataFrame, state: DataFrame | None = None, delay: str = "1 hour", forget_s: int = 7 * 86_400) -> DataFrame:
    """The first burst of each key over a stream of (key string, id long, at timestamp), going on from `state` (see batch_state). A
    contact that comes twice counts once while it is among its key's last two."""
    return contacts.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(
        Bursts(max(forget_s, BURST_S) * 1000), OUT, "Append", "EventTime", initialState=state.groupBy("key") if state is not None else None
    )


def late_rows(query) -> int:
    """How many rows a query has dropped because they came behind the watermark, as far as its progress reaches back."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
