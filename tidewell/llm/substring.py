"""Exact substring removal by a compacted De Bruijn graph of words.

A window of 20 words is an edge of the De Bruijn graph from its first 19 words to its last
19. The graph is never held edge by edge:

1. Every window has a minimizer, the smallest hash among its runs of 8 words. Equal windows
   have equal minimizers at equal places, so a window whose minimizer occurs once in the
   corpus occurs once. Only minimizers are counted over the corpus (about one in seven words).
2. Consecutive windows on one minimizer are a path; equal paths compact into one class, kept
   with its first place. A copied document, however often copied, costs one class a path.
3. The edges of the distinct paths meet in one aggregate that finds each edge's first place.
4. The places go back to their documents, which hold every repeated window against its first
   place: a window is removed unless it starts there.

Every exchange is dealt by a hash behind a partial aggregate or by row, so no frequent passage
gathers in a task. Grouping is by two independent 64-bit hashes of the words. Texts are shuffled
once; only those with a repeated window are shuffled again.

Rows are told apart by 96 bits of hash of doc_id and text. Rows that share a doc_id but not a text
are documents of their own, in the order of that hash; equal rows count as the same place, so they
do not remove one another. Rows without a doc_id come before all others. Null and empty texts have
no words: nothing is removed and the digest is that of the empty string. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, gram_hashes, pieces, release, text_buffer, word_hashes, words_of, written

WINDOW = 20
GRAM = 8
#: A row: 64 bits of hash of doc_id and text, and 32 of the text in front of a place.
ANCHORS = T.StructType([T.StructField("h", T.LongType()), T.StructField("row", T.LongType()), T.StructField("at", T.LongType())])
#: A path of a row (pos, gram, windows), or what becomes of the row: all of it, or its text and the runs (start, length) of its repeated windows.
ROWS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("check", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("gram", T.LongType()),
        T.StructField("windows", T.ArrayType(T.LongType())),
        T.StructField("text", T.StringType()),
        T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("n_words", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)
KEPT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def _minimizers(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every gram, and for every window the place of its (leftmost) smallest gram."""
    grams = gram_hashes(hashes, gram)
    span = window - gram + 1
    if len(grams) < span:
        return grams, np.zeros(0, np.int64)
    n = len(grams) - span + 1
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, span):
        less = grams[k : k + n] < best
        np.copyto(best, grams[k : k + n], where=less)
        at[less] = k
    return grams, at + np.arange(n)


def _parts(batch, window: int, gram: int):
    """(first row, words by row, word hashes, gram hashes, minimizer of every window, row of every window or -1)."""
    for part in pieces(batch):
        data, offsets = text_buffer(part.column("text"))
        starts, _, first = words_of(data, offsets)
        hashes = word_hashes(data, starts)
        grams, at = _minimizers(hashes, window, gram)
        row = np.repeat(np.arange(part.num_rows), np.diff(first))
        inside = row[: len(at)] == row[window - 1 : window - 1 + len(at)] if len(at) else np.zeros(0, bool)
        yield part, first, hashes, grams, at, np.where(inside, row[: len(at)], -1)


def _anchors(window: int, gram: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, first, _, grams, at, row in _parts(batch, window, gram):
                keys, checks = (part.column(x).to_numpy(zero_copy_only=False) for x in ("row", "check"))
                places = np.unique(at[row >= 0])
                rows = np.searchsorted(first, places, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(grams[places].view(np.int64)), pa.array(keys[rows]), pa.array((checks[rows].astype(np.int64) << 32) | (places - first[rows]))], names=ANCHORS.names)

    return run


def _rows(window: int, gram: int, with_text: bool):
    """Repeated paths of each row, and a row with its text and all its repeated windows, or with its result where it has none."""

    def run(batches):
        import pyarrow as pa

        kinds = {"doc_id": pa.int64(), "row": pa.int64(), "check": pa.int32(), "pos": pa.int32(), "gram": pa.int64(), "windows": pa.list_(pa.int64()), "text": pa.string(), "places": pa.list_(pa.int32()), "n_words": pa.int64(), "kept_sha256": pa.string()}

        def out(n, part, rows, **columns):
            columns |= {x: part.column(x).take(pa.array(rows)) for x in ("doc_id", "row", "check")}
            return pa.RecordBatch.from_arrays([columns[x].cast(t) if x in columns else pa.nulls(n, t) for x, t in kinds.items()], names=list(kinds))

        for batch in batches:
            for part, first, hashes, grams, at, row in _parts(batch, window, gram):
                once = np.zeros(len(hashes) + 1, bool)
                lists = part.column("once")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = np.array([x or 0 for x in _sizes(lists)], np.int64)
                once[flat + np.repeat(first[:-1], sizes)] = True
                keep = np.flatnonzero((row >= 0) & ~once[at]) if len(at) else np.zeros(0, np.int64)
                rows = row[keep] if len(keep) else np.zeros(0, np.int64)
                some = np.unique(rows)
                if len(keep):
                    windows, mins = gram_hashes(hashes, window, 0xFF51AFD7ED558CCD)[keep].view(np.int64), at[keep]
                    cut = np.concatenate(([0], np.flatnonzero((np.diff(keep) != 1) | (np.diff(mins) != 0) | (np.diff(rows) != 0)) + 1))
                    own = rows[cut]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(keep)).astype(np.int32)), pa.array(windows))
                    yield out(len(cut), part, own, pos=pa.array((keep[cut] - first[own]).astype(np.int32)), gram=pa.array(grams[mins[cut]].view(np.int64)), windows=lists)
                    run = np.concatenate(([0], np.flatnonzero((np.diff(keep) != 1) | (np.diff(rows) != 0)) + 1))
                    pairs = np.stack([keep[run] - first[rows[run]], np.diff(np.append(run, len(keep)))], 1).astype(np.int32)
                    edge = (2 * np.append(np.searchsorted(rows[run], some), len(run))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(pairs.ravel()))
                    yield out(len(some), part, some, text=part.column("text").take(pa.array(some)), places=lists)
                rest = np.setdiff1d(np.arange(part.num_rows), some)
                if len(rest):
                    texts = part.column("text").take(pa.array(rest))
                    words = [(x or b"").split() for x in texts.cast(pa.large_binary()).to_pylist()]
                    kept = [b" ".join(w) for w in words]
                    extra = {"text": pa.array([k.decode() for k in kept], pa.string())} if with_text else {}
                    yield out(len(rest), part, rest, n_words=pa.array([len(w) for w in words], pa.int64()), kept_sha256=pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), **extra)

    return run


def _sizes(lists):
    import pyarrow.compute as pc

    return pc.list_value_length(lists).to_pylist()


def removed_words(n: int, places, firsts, window: int) -> np.ndarray:
    """Which of n words some repeated window covers that does not start at its first place; places are runs (start, length)."""
    runs = np.asarray(places, np.int64).reshape(-1, 2)
    own = np.repeat(runs[:, 0] - (np.cumsum(runs[:, 1]) - runs[:, 1]), runs[:, 1]) + np.arange(int(runs[:, 1].sum()))
    gone = np.setdiff1d(own, np.asarray(firsts, np.int64))
    gone = gone[gone + window <= n]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, gone, 1)
    np.add.at(step, gone + window, -1)
    return np.cumsum(step[:n]) > 0


def _kept(window: int, with_text: bool):
    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in pieces(whole)):
            texts = batch.column("text").cast(pa.large_binary())
            places, firsts = batch.column("places"), batch.column("firsts")
            n_words, n_removed, digest, kept_text = [], [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                n_words.append(len(words))
                gone = removed_words(len(words), places[i].values.to_numpy(), firsts[i].values.to_numpy() if firsts[i].is_valid else [], window)
                words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_text.append(kept.decode())
            out = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out.append(pa.array(kept_text, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", F.isnull("doc_id"), "text")).withColumn("check", (F.crc32(F.coalesce("text", F.lit(""))) - (1 << 31)).cast("int"))
    anchors = docs.mapInArrow(_anchors(window, gram), ANCHORS)
    single = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min("at").alias("at")).where("n = 1")
    pos = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    once = single.groupBy("row", F.shiftright("at", 32).cast("int").alias("check")).agg(F.collect_list(pos).alias("once"))
    once, once_at = written(once, "substring-once")
    marked = docs.join(once, ["row", "check"], "left").select("doc_id", "row", "check", "text", "once")
    found, _ = written(marked.mapInArrow(_rows(window, gram, with_text), ROWS), "substring-rows", "zstd")
    release(spark, once_at)
    place = F.struct("doc_id", "row", "pos", "check")
    classes = found.where("pos IS NOT NULL").groupBy("gram", "windows").agg(F.min(place).alias("at"))
    edges = classes.select("gram", "at.doc_id", "at.row", "at.check", "at.pos", F.posexplode("windows").alias("k", "edge"))
    firsts = edges.groupBy("gram", "edge").agg(F.min(F.struct("doc_id", "row", (F.col("pos") + F.col("k")).alias("pos"), "check")).alias("at"))
    firsts = firsts.groupBy(F.col("at.row").alias("row"), F.col("at.check").alias("check")).agg(F.collect_list("at.pos").alias("firsts"))
    firsts, _ = written(firsts, "substring-firsts")
    schema = T.StructType([*KEPT.fields, T.StructField("kept_text", T.StringType())]) if with_text else KEPT
    spans = found.where("places IS NOT NULL").select("doc_id", "row", "check", "text", "places").join(firsts, ["row", "check"], "left")
    held = spans.select("doc_id", "text", "places", "firsts").mapInArrow(_kept(window, with_text), schema)
    whole = found.where("n_words IS NOT NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", *([F.col("text").alias("kept_text")] if with_text else []))
    return whole.union(held)


def op7(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
