"""Very many terms in texts, as a join: none of the terms goes through the driver, and no task holds them all.

A term is known by one piece of it: as many bytes as the longest step of a ladder that it fills, and
of its pieces the one that fewest terms hold. Texts are cut into all pieces of those lengths
by rolling hashes, whole Arrow batches at a time; a Bloom filter of the terms' pieces (at most
32 MB) leaves few, which meet the terms by equal hashes. The letters decide in the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import any_terms_held

LADDER = (1, 2, 4, 8, 16)
PROBES, LEAST_BITS, MOST_BITS, CHUNK = 4, 16, 28, 16
ROWS = 2_000
_POWERS = [pow(0x9E3779B97F4A7C15, n, 1 << 64) for n in LADDER]
_MIX, _STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _mixed(x):
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def _pieces(data, starts, ends):
    """(length, places, hashes) of the pieces of each length of the ladder: all that lie within one text; texts are data[start:end]."""
    h = data.astype(np.uint64) + np.uint64(1)
    for k, n in enumerate(LADDER):
        if n > 1:
            half = LADDER[k - 1]
            if len(h) <= half:
                return
            h = h[:-half] * np.uint64(_POWERS[k - 1]) + h[half:]
        whole = np.zeros(len(data) + 1, np.int32)  # places where a piece may begin
        long = ends - starts >= n
        np.add.at(whole, starts[long], 1)
        np.add.at(whole, ends[long] - n + 1, -1)
        at = np.flatnonzero(np.cumsum(whole[: len(h)]))
        yield n, at, _mixed(h[at] + np.uint64(n)).view(np.int64)


def _flat(texts: pa.Array):
    """The bytes of an array of strings, with where each begins and ends."""
    texts = pa.array([x or "" for x in texts.to_pylist()], pa.large_string()) if texts.null_count or texts.offset else texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
    data = np.frombuffer(texts.buffers()[2], np.uint8, ends[-1]) if texts.buffers()[2] is not None and ends[-1] else np.zeros(0, np.uint8)
    return data, ends[:-1], ends[1:]


def _term_pieces(batches):
    """(term, hash) of the pieces by which terms may be known: those of the longest step that they fill."""
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            terms = pa.array(batch.column(0).slice(k, ROWS).to_pylist(), pa.string())
            data, starts, ends = _flat(terms)
            for n, at, h in _pieces(data, starts, ends):
                owner = np.searchsorted(ends, at, "right")
                own = (n == LADDER[-1]) | (ends[owner] - starts[owner] < 2 * n)
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(owner[own])), pa.array(h[own])], names=["term", "h"])


def _place(h, probe: int, bits: int):
    """The place of each hash in the filter, one for each probe."""
    u = h.view(np.uint64)
    if probe:
        u = u + np.uint64(probe) * (_mixed(u + _STEP) | np.uint64(1))
    return (u >> np.uint64(64 - bits)).astype(np.int64)


def _filter(keys: DataFrame, bits: int) -> bytes:
    """A Bloom filter of hashes, put together from chunks that tasks make."""

    def places(batches):
        for batch in batches:
            for probe in range(PROBES):
                at = _place(batch.column(0).to_numpy(), probe, bits)
                yield pa.RecordBatch.from_arrays([pa.array(at >> CHUNK), pa.array(at & ((1 << CHUNK) - 1))], names=["chunk", "bit"])

    def chunks(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, bit = (c.to_numpy() for c in batch.columns)
            for c in np.unique(chunk):
                held.setdefault(int(c), np.zeros(1 << CHUNK, bool))[bit[chunk == c]] = True
                if len(held) > 64:
                    yield from _packed(held)
        yield from _packed(held)

    def _packed(held):
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["chunk", "bits"])
        held.clear()

    whole = np.zeros(1 << (bits - 3), np.uint8)
    made = keys.select("h").mapInArrow(places, "chunk long, bit long").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(chunks, "chunk long, bits binary")
    for r in made.toLocalIterator():
        at = r.chunk << (CHUNK - 3)
        whole[at : at + (1 << (CHUNK - 3))] |= np.frombuffer(r.bits, np.uint8)
    return whole.tobytes()


def terms_by_id(rows: DataFrame, terms: DataFrame, *texts: Column) -> DataFrame:
    """(id, held) of rows that hold some of the terms (one column, each once, none blank) in one of the texts."""
    spark = rows.sparkSession
    pieces = terms.toDF("term").mapInArrow(_term_pieces, "term string, h long").distinct()
    often = pieces.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    keys = pieces.join(often, "h").groupBy("term").agg(F.min_by("h", F.struct("n", "h")).alias("h"))
    bits = min(MOST_BITS, max(LEAST_BITS, (terms.count() * 16).bit_length()))
    known = spark.sparkContext.broadcast(_filter(keys, bits))

    def near(batches):
        mask = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.slice(k, ROWS)
                for column in part.columns[1:]:
                    text = pa.array(column.to_pylist(), pa.string())
                    data, starts, ends = _flat(text)
                    for _, at, h in _pieces(data, starts, ends):
                        for probe in range(PROBES):
                            place = _place(h, probe, bits)
                            left = (mask[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
                            at, h = at[left], h[left]
                        owner = np.searchsorted(ends, at, "right")
                        found = np.unique(np.stack([owner.astype(np.int64), h]), axis=1)
                        if found.shape[1]:
                            rows_ = pa.array(found[0])
                            yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_pylist(), part.schema.field(0).type).take(rows_), text.take(rows_), pa.array(found[1])], names=["id", "text", "h"])

    kind = rows.schema["id"].dataType.simpleString()
    asked = rows.select("id", *(t.alias(f"t{i}") for i, t in enumerate(texts)))
    met = asked.mapInArrow(near, f"id {kind}, text string, h long").join(keys, "h").where(F.contains("text", "term"))
    return met.groupBy("id").agg(F.sort_array(F.collect_set("term")).alias("held"))


def with_terms(rows: DataFrame, to: str, terms: DataFrame | list[str], *texts: Column, block: int) -> DataFrame:
    """Rows (id, ...) with the terms that stand in one of the texts: up to a block of them through one automaton, more by a join on id."""
    if isinstance(terms, list) and len(set(terms)) <= block:
        return rows.withColumn(to, any_terms_held(terms, *texts, block=block))
    if isinstance(terms, list):
        terms = rows.sparkSession.createDataFrame([(x,) for x in sorted(set(terms))], "term string")
    (column,) = terms.columns
    terms = terms.where(F.col(column) != "").distinct()
    if terms.limit(block + 1).count() <= block:
        return rows.withColumn(to, any_terms_held(terms, *texts, block=block))
    held = terms_by_id(rows, terms, *texts).withColumnRenamed("held", to)
    return rows.join(held, "id", "left").withColumn(to, F.coalesce(to, F.array().cast("array<string>")))
