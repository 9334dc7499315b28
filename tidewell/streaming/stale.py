"""Stops a source after so many pages in a row without anything new, as keyed state of a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "source string, page long, streak int, stopped boolean"


class StalePages(StatefulProcessor):
    """Per source: the streak so far and whether the source has been stopped."""

    def __init__(self, limit: int, ttl_ms: int | None = None):
        self.limit, self.ttl_ms = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "streak int, stopped boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values):
        streak, stopped = self.state.get() if self.state.exists() else (0, False)
        frame = pd.concat(list(rows)).sort_values("page")
        out = []
        for page, found, saved in zip(frame["page"], frame["found"], frame["saved"], strict=True):
            if stopped:
                break
            streak = streak + 1 if found > 0 and saved == 0 else 0
            stopped = 0 < self.limit <= streak
            out.append((key[0], int(page), streak, stopped))
        self.state.update((streak, stopped))
        yield pd.DataFrame(out, columns=["source", "page", "streak", "stopped"])

    def close(self) -> None:
        pass


def stop_stale(pages: DataFrame, limit: int, ttl_ms: int | None = None) -> DataFrame:
    """(source, page, streak, stopped) of a stream of (source, page, found, saved), up to where each source stops.

    With ttl_ms what is known of a source is forgotten so long after its last page: it may begin anew.
    Needs the RocksDB state store.
    """
    return pages.groupBy("source").transformWithStateInPandas(StalePages(limit, ttl_ms), OUT, "Append", "ProcessingTime" if ttl_ms else "None")
