"""Values that are made once a key and held for a time, as the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Held(StatefulProcessor):
    """For each key, when its value was made. A row finds it if it comes less than ``millis`` later; otherwise it makes it anew, and
    rows of one key never make it twice at a time."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        old = made = self.made.get()[0] if self.made.exists() else None
        fresh = []
        for at in batch["ts"].astype("datetime64[us]").astype("int64"):
            fresh.append(made is None or at >= made + self.millis * 1000)
            made = at if fresh[-1] else made
        if made != old:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.made.update((int(made),))
            self.handle.registerTimer(int(made) // 1000 + self.millis)
        yield pd.DataFrame({"user_id": key[0], "event_id": batch["event_id"].to_numpy(), "fresh": fresh})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The value's time is over for all rows that may still come: it goes."""
        self.made.clear()
        yield from ()


def held(events: DataFrame, millis: int, late: str = "1 day") -> DataFrame:
    """user_id, event_id, fresh (must the value be made?) of a stream (user_id, event_id, ts). Rows of a micro-batch are taken by their
    time, ties by event_id; rows without user or time drop out. The state of a user goes when the watermark passes its lifetime.
    Needs the RocksDB state store. A task holds a user's id and time columns of one micro-batch: bound that by files a batch."""
    rows = events.where("user_id is not null and ts is not null").select("user_id", "event_id", "ts").withWatermark("ts", late)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("user_id").transformWithStateInPandas(Held(millis), f"user_id {kind['user_id']}, event_id {kind['event_id']}, fresh boolean", "Append", "EventTime")
