"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. Runs of five benchmark words are seeds; a
rolling hash finds them in every document. First the seeds that a document has at all tell how
much of an item tiles could cover; only for the items that could be contained are seeds laid out
by place. Seeds on one diagonal join to maximal matches; the longest match whose words are still
free on both sides becomes a tile, again and again, down to five words. An item counts as
contained when tiles cover at least 0.8 of its words, in whatever order they stand in the
document. The words of the tiles themselves are compared before it is reported. An item of fewer
than five words counts when all of it stands in one run.

The benchmark is the stated query set: it is read in blocks of at most ``BLOCK_ITEMS`` items
(and ``BLOCK_WORDS`` words), each sent to the executors and held against all documents. The
documents are never shuffled.

Null, empty and wordless items take no part; null and empty documents hold nothing. Repeated
items and repeated documents are judged row by row, also without an id. Extra columns are ignored
by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, gram_hashes, pieces, text_buffer, word_hashes, words_of

MIN_MATCH = 5
COVERAGE = 0.8
BLOCK_ITEMS = 50_000
BLOCK_WORDS = 4_000_000
SEEDS = 4_000_000  # laid out at a time
_BASE = 0xA0761D6478BD642F
_WORD = np.full(256, 0x20, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORD[_b] = _b
FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("item_words", T.IntegerType()),
        T.StructField("covered_words", T.IntegerType()),
        T.StructField("tiles", T.IntegerType()),
        T.StructField("coverage", T.DoubleType()),
    ]
)


class Words:
    """The words of an Arrow text column: their hashes, their bytes and the first word of each row."""

    def __init__(self, column):
        import pyarrow as pa
        import pyarrow.compute as pc

        data, offsets = text_buffer(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
        data = _WORD[data]
        marks = np.flatnonzero(data == 0xC2)  # U+0080 to U+00BF, signs
        marks = marks[marks + 1 < len(data)]
        data[marks] = data[marks + 1] = 0x20
        marks = np.flatnonzero(data[:-2] == 0xE2) if len(data) > 2 else np.zeros(0, np.int64)
        marks = marks[(data[marks + 1] == 0x80) | (data[marks + 1] == 0x81)]  # U+2000 to U+207F, punctuation
        data[marks] = data[marks + 1] = data[marks + 2] = 0x20
        self.data = data
        self.starts, self.ends, self.first = words_of(data, offsets)
        self.hashes = word_hashes(data, self.starts)

    def run(self, i: int, n: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist(), strict=True)]


def matches(places: np.ndarray, item_places: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, place in the document, place in the item) from seeds of k words."""
    diagonal = places - item_places
    order = np.lexsort((places, diagonal))
    places, item_places, diagonal = places[order], item_places[order], diagonal[order]
    cut = np.concatenate(([0], np.flatnonzero((np.diff(diagonal) != 0) | (np.diff(places) != 1)) + 1))
    runs = np.diff(np.append(cut, len(places)))
    return list(zip((runs + k - 1).tolist(), places[cut].tolist(), item_places[cut].tolist(), strict=True))


def tile(found: list[tuple[int, int, int]], item_words: int, k: int) -> list[tuple[int, int, int]]:
    """Tiles by greedy string tiling: longest first, ties by place in the document, then in the item."""
    heap = [(-n, d, i) for n, d, i in found]
    heapq.heapify(heap)
    free = np.ones(item_words, bool)
    used: set[int] = set()
    tiles, left = [], item_words
    while heap and left >= k:
        n, d, i = heapq.heappop(heap)
        n = -n
        ok = free[i : i + n].copy()
        if used:
            ok &= np.array([x not in used for x in range(d, d + n)])
        if ok.all():
            tiles.append((n, d, i))
            free[i : i + n] = False
            used.update(range(d, d + n))
            left -= n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.astype(np.int8), [0]))))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= k:
                heapq.heappush(heap, (s - e, d + s, i + s))
    return tiles


class Items:
    """One block of the benchmark, ready to be looked for."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int = MIN_MATCH):
        import pyarrow as pa

        self.words = Words(pa.array(texts, pa.large_string()))
        first, hashes = self.words.first, self.words.hashes
        self.k, self.ids, self.sizes = k, ids, np.diff(first)
        grams = gram_hashes(hashes, k, _BASE)
        row = np.repeat(np.arange(len(ids)), np.diff(first))
        own = np.flatnonzero(row[: len(grams)] == row[k - 1 : k - 1 + len(grams)]) if len(grams) else np.zeros(0, np.int64)
        self.by_item = grams[own]  # in the order of items
        self.bounds = np.searchsorted(row[own], np.arange(len(ids) + 1))
        order = np.argsort(self.by_item, kind="stable")
        self.grams, self.items = self.by_item[order], row[own][order]
        self.places = (own - first[row[own]])[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.grams & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.short = {}  # words -> sorted hashes of whole items, and the items
        for n in range(1, k):
            few = np.flatnonzero(self.sizes == n)
            if len(few):
                whole = gram_hashes(hashes, n, _BASE)[first[few]]
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], few[order]

    def contained(self, column, coverage: float):
        """(row, item, tiles) of every item contained in a row of an Arrow text column."""
        words = Words(column)
        for row, item, tiles in (*self._whole(words), *self._tiled(words, coverage)):
            at, own = words.first[row], self.words.first[item]
            if all(words.run(at + d, n) == self.words.run(own + i, n) for n, d, i in tiles):
                yield row, item, tiles

    def _whole(self, words: Words):
        """Short items that stand in a row: the first place of each."""
        for n, (whole, few) in self.short.items():
            grams = gram_hashes(words.hashes, n, _BASE)
            at = np.flatnonzero(np.isin(grams, whole))
            row = np.searchsorted(words.first, at, "right") - 1
            at, row = at[at + n <= words.first[row + 1]], row[at + n <= words.first[row + 1]]
            _, once = np.unique(np.stack([row.astype(np.uint64), grams[at]], 1), axis=0, return_index=True)
            for at, row in zip(at[once].tolist(), row[once].tolist(), strict=True):
                for item in few[np.searchsorted(whole, grams[at], "left") : np.searchsorted(whole, grams[at], "right")].tolist():
                    yield row, item, [(n, int(at - words.first[row]), 0)]

    def _tiled(self, words: Words, coverage: float):
        grams = gram_hashes(words.hashes, self.k, _BASE)
        at = np.flatnonzero(self.maybe[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = at[np.isin(grams[at], self.grams)] if len(at) else at
        row = np.searchsorted(words.first, at, "right") - 1
        inside = at + self.k <= words.first[row + 1]
        at, row = at[inside], row[inside]
        if not len(at):
            return
        order = np.lexsort((at, grams[at], row))
        at, row, gram = at[order], row[order], grams[at][order]
        once = np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))
        lo, hi = np.searchsorted(self.grams, gram[once], "left"), np.searchsorted(self.grams, gram[once], "right")
        rows = np.flatnonzero(np.append(True, row[once][1:] != row[once][:-1]))  # a row at a time, or several small ones
        cost = np.add.reduceat(hi - lo, rows)
        cut = np.append(rows, len(lo))
        start = 0
        while start < len(rows):
            end = max(start + 1, int(np.searchsorted(np.cumsum(cost[start:]), SEEDS, "right")) + start)
            part = slice(cut[start], cut[end])
            for r, item in self._possible(row[once][part], lo[part], hi[part], coverage):
                s, e = np.searchsorted(row, r, "left"), np.searchsorted(row, r, "right")
                tiles = self._tiles(item, at[s:e] - words.first[r], gram[s:e])
                if sum(n for n, _, _ in tiles) >= coverage * self.sizes[item]:
                    yield r, item, tiles
            start = end

    def _possible(self, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, coverage: float) -> list[tuple[int, int]]:
        """(row, item) where all seeds together, wherever they stand in the row, cover enough of the item."""
        times = hi - lo
        slot = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        row, item, place = np.repeat(row, times), self.items[slot], self.places[slot]
        order = np.lexsort((place, item, row))
        row, item, place = row[order], item[order], place[order]
        new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))
        adds = np.where(new, self.k, np.minimum(np.diff(place, prepend=0), self.k))
        first = np.flatnonzero(new)
        ok = np.add.reduceat(adds, first) >= coverage * self.sizes[item[first]]
        return list(zip(row[first[ok]].tolist(), item[first[ok]].tolist(), strict=True))

    def _tiles(self, item: int, at: np.ndarray, gram: np.ndarray) -> list[tuple[int, int, int]]:
        """Tiles of an item and a row whose seeds are gram, in ascending order, at places."""
        own = self.by_item[self.bounds[item] : self.bounds[item + 1]]
        lo, hi = np.searchsorted(gram, own, "left"), np.searchsorted(gram, own, "right")
        times = hi - lo
        slot = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        return tile(matches(at[slot], np.repeat(np.arange(len(own)), times), self.k), int(self.sizes[item]), self.k)


def blocks(benchmark: DataFrame, k: int = MIN_MATCH):
    """The benchmark in blocks of bounded size."""
    ids, texts, words = [], [], 0
    for row in benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        words += len(row[1]) // 2
        if len(ids) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield Items(ids, texts, k)
            ids, texts, words = [], [], 0
    if ids:
        yield Items(ids, texts, k)


def _look(items, coverage: float):
    def run(batches):
        import pyarrow as pa

        own = items.value
        for batch in batches:
            out = []
            for part in pieces(batch):
                ids = part.column("doc_id").to_pylist()
                for row, item, tiles in own.contained(part.column("text"), coverage):
                    size, covered = int(own.sizes[item]), sum(n for n, _, _ in tiles)
                    out.append((ids[row], own.ids[item], size, covered, len(tiles), covered / size))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=FOUND.names)

    return run


def _clean(items, coverage: float):
    def run(batches):
        import pyarrow as pa

        own = items.value
        for batch in batches:
            for part in pieces(batch):
                keep = np.ones(part.num_rows, bool)
                for row, _, _ in own.contained(part.column("text"), coverage):
                    keep[row] = False
                yield part.filter(pa.array(keep))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, k: int = MIN_MATCH) -> DataFrame:
    """A row for every document and item contained in it."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], FOUND)
    for items in blocks(benchmark, k):
        out = out.union(docs.mapInArrow(_look(spark.sparkContext.broadcast(items), coverage), FOUND))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, k: int = MIN_MATCH) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    spark = docs.sparkSession
    for items in blocks(benchmark, k):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(items), coverage), docs.schema)
    return docs


def op5(spark, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
