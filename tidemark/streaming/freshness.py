"""Silent sources of a stream: keyed state with timers.

Each source keeps its newest item, the number of its items and of those among them that came late, behind a newer one of
an earlier batch. An item sets a timer at its time plus the limit; when the stream's watermark passes that without a
newer item, the source is reported stale, once for each silence. Items behind the watermark are dropped by the engine,
which counts them (numRowsDroppedByWatermark of the query's progress).

State is a row a source; the engine keeps it in its state store, so the job goes on where it was after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REPORT = "source string, status string, newest_published_at timestamp, n_items long, n_late long"
_STATE = "newest long, items long, late long"
#: Microseconds of an hour.
HOUR = 3_600_000_000


class Silence(StatefulProcessor):
    """Reports a source that gave nothing newer for ``limit_hours`` of the stream's time, and again when it comes back."""

    def __init__(self, limit_hours: float):
        self.limit = int(limit_hours * HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _STATE)

    def _row(self, key, status: str, newest: int, items: int, late: int) -> pd.DataFrame:
        at = pd.Timestamp(newest, unit="us") if newest >= 0 else pd.NaT
        return pd.DataFrame({"source": [key[0]], "status": [status], "newest_published_at": [at], "n_items": [items], "n_late": [late]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, items, late = self.seen.get() if self.seen.exists() else (-1, 0, 0)
        before, mark = newest, timerValues.getCurrentWatermarkInMs() * 1000
        for batch in rows:
            late += int((batch["at"] < before).sum())
            items += len(batch)
            newest = max(newest, int(batch["at"].max()))
        self.seen.update((newest, items, late))
        if newest > before:
            if before >= 0:
                self.handle.deleteTimer((before + self.limit) // 1000)
                if mark > before + self.limit:
                    yield self._row(key, "back", newest, items, late)
            self.handle.registerTimer((newest + self.limit) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, items, late = self.seen.get()
        if expiredTimerInfo.getExpiryTimeInMs() == (newest + self.limit) // 1000:
            yield self._row(key, "stale", newest, items, late)

    def close(self) -> None:
        pass


def silent_sources(items: DataFrame, limit_hours: float = 36, watermark: str = "1 hour") -> DataFrame:
    """Streaming reports (REPORT) of a stream of items (source, published_at): ``stale`` when a source's limit passes without a newer item, ``back`` when one comes after that.

    Items without a date are left out. The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = items.where("published_at is not null").select("source", F.col("published_at").cast("timestamp").alias("published_at"))
    rows = rows.withColumn("at", F.unix_micros("published_at")).withWatermark("published_at", watermark)
    return rows.groupBy("source").transformWithStateInPandas(Silence(limit_hours), REPORT, "Append", "EventTime")
