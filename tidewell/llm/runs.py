"""Periodic runs: maximal stretches of consecutive words that repeat with a period.

A run is a stretch with smallest period q, at least ``max(LEAST, 2 * q)`` words long, that no
neighbouring word extends. Its words agree with those q places on over at least
``max(LEAST - q, q)`` words, which is never fewer than ``k = ceil(LEAST / 2)``. So every word of
a run lies in a k-gram that stands twice in the document: words outside repeated k-grams are
masked, and runs are looked for in the stretches that are left (most texts leave none). A run lies in
one such stretch whole, with every word that could extend it.

In a stretch runs are found by the divide and conquer of Main and Lorentz: at every middle of a
block, the words that agree forwards and backwards with those a period away tell the longest
stretch of that period through the middle. All blocks of a level are worked at once. A pair of
places is only extended where three words agree beside it (a run has at least three on one side)
and where no run found before explains it. Words are compared by number, so results are exact.

Each text is worked on its own, within one task, without a shuffle; memory goes with the longest
text. A null or empty text has no words, no runs and an empty collapsed text. Every row gives
one row, also where doc_ids repeat or are missing; extra columns are ignored by ``runs`` and
kept by ``collapsed``, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, gram_hashes, mixed, pieces

LEAST = 12
#: Places compared one after another for all pairs at once; what still agrees is compared in stretches.
STEPS = 48
RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for every word, the same for equal words."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def surviving(x: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches [start, end) of words that lie in k-grams standing more than once."""
    grams = gram_hashes(mixed(x.astype(np.uint64) + np.uint64(1)), k)  # equal grams have equal hashes: what collides is only looked at in vain
    if len(grams) < 2:
        return []
    order = np.argsort(grams, kind="stable")
    twice = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if not len(twice):
        return []
    depth = np.zeros(len(x) + 1, np.int64)
    at = np.unique(np.concatenate((order[twice], order[twice + 1])))
    depth[at] += 1
    depth[at + k] -= 1
    inside = np.concatenate(([False], np.cumsum(depth[:-1]) > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def _agreeing(x: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many words from u and from v on agree (u < v); x ends with a word that no other equals."""
    out, live = np.zeros(len(u), np.int64), np.arange(len(u))
    for k in range(STEPS):
        live = live[x[u[live] + k] == x[v[live] + k]]
        if not len(live):
            return out
        out[live] += 1
    for i in live.tolist():
        a, b, size = int(u[i]) + STEPS, int(v[i]) + STEPS, 256
        while True:
            n = min(size, len(x) - b)
            off = np.flatnonzero(x[a : a + n] != x[b : b + n])
            if len(off):
                break
            a, b, size = a + n, b + n, 2 * size
        out[i] = b + int(off[0]) - int(v[i])
    return out


def maximal_runs(x: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words x, by start and period."""
    n, w = len(x), max(1, -(-least // 4))
    if n < least:
        return []
    ahead, behind = np.append(x, -1), np.append(x[::-1], -1)
    edge = np.concatenate((np.full(w, -2), x, np.full(w, -3)))  # so that places beside the ends agree with none
    found: dict[tuple[int, int], int] = {}
    ends, periods = [], []  # of runs by number
    over, longest = np.full(n, -1), np.zeros(n, np.int64)  # the longest run over each word, and its length
    half = 1 << max(0, (n - 1).bit_length() - 1)
    lowest = 1 << max(0, (least - 1).bit_length() - 1)
    while half >= lowest:  # every run holds a middle of these levels
        at = np.arange(n)
        middle = at // (2 * half) * (2 * half) + half
        ok = (middle < n) & (at != middle)
        at, middle = at[ok], middle[ok]
        after = np.ones(len(at), bool)
        before = np.ones(len(at), bool)
        for k in range(w):
            after &= edge[at + w + k] == edge[middle + w + k]
            before &= edge[at + w - 1 - k] == edge[middle + w - 1 - k]
        near = after | before
        u, v = np.minimum(at, middle)[near], np.maximum(at, middle)[near]
        order = np.argsort(v - u, kind="stable")
        u, v, take = u[order], v[order], 64
        while len(u):  # shorter periods first: their runs explain the multiples
            if ends:
                run = over[u]
                known = (run >= 0) & (v < np.array(ends)[run]) & ((v - u) % np.array(periods)[run] == 0)
                u, v = u[~known], v[~known]
            a, b, u, v = u[:take], v[:take], u[take:], v[take:]
            take *= 2
            q = b - a
            back, on = _agreeing(behind, n - b, n - a), _agreeing(ahead, a, b)
            for s, e, p in zip(*(y[(back + on >= q) & (back + on + q >= least)].tolist() for y in (a - back, b + on, q)), strict=True):
                if p < found.get((s, e), n):
                    found[s, e] = p
                    shorter = longest[s:e] <= e - s
                    over[s:e][shorter], longest[s:e][shorter] = len(ends), e - s
                    ends.append(e)
                    periods.append(p)
        half >>= 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def document_runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a document's words."""
    if len(words) < least:
        return []
    x = numbered(words)
    out = []
    for start, end in surviving(x, -(-least // 2)):
        out += [(start + s, length, period) for s, length, period in maximal_runs(x[start:end], least)]
    return out


def without_repeats(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not found:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Words as op12 wants them: a tenth of all documents (by a hash of doc_id) repeat a part to their end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _runs(least: int, rewrite):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in pieces(batch):
                sizes, spans, texts = [], [], []
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                    words = (text or b"").split()  # at space and 0x09 to 0x0D
                    if rewrite is not None:
                        words = rewrite(words, doc_id)
                    found = document_runs(words, least)
                    sizes.append(len(words))
                    spans.append([dict(zip(RUN.names, x, strict=True)) for x in found])
                    texts.append(b" ".join(without_repeats(words, found)).decode())
                kinds = (pa.int64(), pa.list_(pa.struct([(x, pa.int64()) for x in RUN.names])), pa.string())
                columns = [piece.column("doc_id"), *(pa.array(x, t) for x, t in zip((sizes, spans, texts), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=FOUND.names)

    return run


def runs(docs: DataFrame, least: int = LEAST, rewrite=None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of docs (doc_id, text): its runs by start and period, and its words without their repeats.

    rewrite: a function of a document's words and doc_id that gives the words to look at.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_runs(least, rewrite), FOUND)


def _collapse(least: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            for piece in pieces(batch):
                texts = []
                for text in piece.column(at).cast(pa.large_binary()).to_pylist():
                    words = (text or b"").split()
                    found = document_runs(words, least)
                    texts.append(b" ".join(without_repeats(words, found)).decode() if found else None if text is None else text.decode())
                yield piece.set_column(at, piece.schema.field(at), pa.array(texts, piece.schema.field(at).type))

    return run


def collapsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs with all their columns; texts with runs are replaced by their words without the repeats, others stay as they are."""
    return docs.mapInArrow(_collapse(least), docs.schema)


def op12(spark, sf_dir: str) -> DataFrame:
    found = runs(documents(spark, sf_dir), rewrite=planted)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    longest = F.get(F.expr("array_sort(runs, (a, b) -> CASE WHEN a.length <> b.length THEN sign(b.length - a.length) WHEN a.start <> b.start THEN sign(a.start - b.start) ELSE sign(a.period - b.period) END::int)"), F.lit(0))
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        F.col("longest.length").alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
