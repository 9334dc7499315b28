"""A crawl as a stream that ends its sources itself: what pages held is keyed state, and the reader sees the end.

For every source a map of fingerprints (of requests and of contents) is kept. A source ends at a
request that it was sent before, at content that it has served before, at a page without items, or
after ``limit`` pages in a row whose items are all known. The page is noted in the ``marks`` folder
of the reader (``sources.paged``), which asks for no further page; what had been read beyond it is
dropped. Needs the RocksDB state store.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.paged import Marks

OUT = "source string, page int, item string, is_new boolean, ends boolean"


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


class Guard(StatefulProcessor):
    """Per source: fingerprints of requests, contents and items, the streak of pages without anything new, and the last page."""

    def __init__(self, limit: int, marks: str | None, ttl_ms: int | None = None):
        self.limit, self.marks, self.ttl_ms = limit, marks, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "mark string", "page int", self.ttl_ms)
        self.state = handle.getValueState("state", "streak int, page int, ended boolean")

    def _new(self, kind: str, text: str, page: int) -> bool:
        key = (kind + fingerprint(text),)
        if self.seen.containsKey(key):
            return self.seen.getValue(key)[0] == page  # the page itself, read again after a failure
        self.seen.updateValue(key, (page,))
        return True

    def handleInputRows(self, key, rows, timer_values):
        streak, last, ended = self.state.get() if self.state.exists() else (0, 0, False)
        frame = pd.concat(list(rows)).sort_values("page")
        out = []
        for page, url, items in zip(frame["page"], frame["url"], frame["items"], strict=True):
            if ended or page <= last:
                continue
            items = list(items)
            if not items or not self._new("u", url, page) or not self._new("c", "\0".join(items), page):
                ended, first_without = True, int(page)
                out.append((key[0], int(page), None, False, True))
            else:
                fresh = [self._new("i", x, page) for x in items]
                streak = 0 if any(fresh) else streak + 1
                ended = 0 < self.limit <= streak
                out += [(key[0], int(page), x, new, ended) for x, new in zip(items, fresh, strict=True)]
                last, first_without = int(page), int(page) + 1
            if ended and self.marks:
                Marks(self.marks).end(key[0], first_without)
        self.state.update((streak, last, ended))
        yield pd.DataFrame(out, columns=["source", "page", "item", "is_new", "ends"])

    def close(self) -> None:
        pass


def guarded(pages: DataFrame, limit: int = 0, marks: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(source, page, item, is_new, ends) of a stream of (source, page, url, items: array of string), up to where each source ends.

    A page that ends its source without counting comes as one row without an item. With ttl_ms a
    fingerprint is forgotten so long after it was seen, so state doesn't grow for ever.
    """
    return pages.select("source", "page", "url", "items").groupBy("source").transformWithStateInPandas(Guard(limit, marks, ttl_ms), OUT, "Append", "ProcessingTime" if ttl_ms else "None")
