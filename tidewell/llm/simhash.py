"""Near-duplicate detection by SimHash with pigeonring candidate filtering.

A fingerprint has a bit set where more than half of the shingle hashes have it set. Two
fingerprints link when they differ in at most four bits. The 64 bits form a ring of three
segments; the strong form of the pigeonhole principle on a ring says that, for a pair within
the limit, some segment starts a chain whose cumulative differences over l segments never
exceed l * limit / 3. Its first segment differs in one bit at most, which an index with one
bit masked out finds; the chain of two is tested next, and only what is left gets the full
Hamming test.

Equal fingerprints are one node, so exact copies cost one row each. Within a bucket links are
reduced to a star for each component before they leave the task: large buckets are searched breadth
first against the fingerprints not yet reached, so no task emits all pairs. Buckets beyond
``BLOCK_ROWS`` are cut into blocks, and every pair of blocks is its own bucket (exact).

Null and empty texts have fingerprint zero and link like any other. Rows that share a doc_id
are kept; each gets its fingerprint and the component of that fingerprint. Rows without a doc_id
link like others; a component of such rows alone has no component_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, release, written

SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, width
LIMIT = 4
SHINGLE = 4
SEED = 42
SMALL_BUCKET = 24
BLOCK_ROWS = 50_000
FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of lower-cased bytes, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in spans], dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                if text:
                    out[i] = fingerprint(text.lower(), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints(shingle, seed), FINGERPRINTS)


def ring(words: tuple[str, ...] = ("fp",)) -> list[tuple[str, int, int, int]]:
    """(column, first bit in it, width, first bit on the ring) of each segment of fingerprints of one 64-bit column or more."""
    return [(word, lo, width, 64 * k + lo) for k, word in enumerate(words) for lo, width in SEGMENTS]


def _masks(width: int, parts: int | None) -> list[tuple[int, int]]:
    """(first bit, mask of the bits) of each of so many parts of a segment; by default a bit is a part."""
    parts = parts or width
    cuts = [width * k // parts for k in range(parts + 1)]
    return [(lo, ((1 << hi) - 1) & ~((1 << lo) - 1)) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _index(fps: DataFrame, words: tuple[str, ...] = ("fp",), parts: int | None = None) -> DataFrame:
    """(key, columns of fps): a key for each part of each segment, which is masked out; by default 64 keys a column of words."""
    keys = []
    for word, lo, width, first in ring(words):
        own = F.shiftrightunsigned(word, lo).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        keys += [(F.lit((first + j) << 22).bitwiseOR(own.bitwiseAND(F.lit(~gone).cast("long")))).cast("int") for j, gone in _masks(width, parts)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), *fps.columns)


def _hot(fps: DataFrame, block: int) -> DataFrame:
    """(key, blocks) of index keys that more than block fingerprints may share; from segment values, which are three a row."""
    values = F.array(*[F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("v")) for i, (lo, w) in enumerate(SEGMENTS)])
    many = fps.select(F.explode(values).alias("s")).groupBy("s").count().where(F.col("count") * 2 > block)
    masked = F.expr("CASE s.seg " + " ".join(f"WHEN {i} THEN transform(sequence(0, {w - 1}), j -> CAST(((({lo} + j) << 22) | (s.v & ~(1L << j))) AS INT))" for i, (lo, w) in enumerate(SEGMENTS)) + " END")
    return many.select(F.explode(masked).alias("key"), (F.ceil(F.col("count") * 2 / block)).cast("int").alias("blocks")).groupBy("key").agg(F.max("blocks").alias("blocks"))


def _chain_masks() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 64 index positions: bits of its segment with the next one round the ring, and how many may differ."""
    bits = [((1 << w) - 1) << lo for lo, w in SEGMENTS]
    pair = [bits[i] | bits[(i + 1) % len(bits)] for i in range(len(bits))]
    masks = np.zeros(64, np.uint64)
    for i, (lo, w) in enumerate(SEGMENTS):
        masks[lo : lo + w] = pair[i]
    return masks, 2 * LIMIT // len(SEGMENTS)


def _linked(x: np.ndarray, mask) -> np.ndarray:
    """Pigeonring chain of two first, then all bits."""
    ok = np.bitwise_count(x & mask) <= 2 * LIMIT // len(SEGMENTS)
    ok[ok] = np.bitwise_count(x[ok]) <= LIMIT
    return ok


def bucket_forest(fps: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray]:
    """For each component of one bucket's links, edges from its first fingerprint to all others."""
    left, a, b = fps, [], []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        root = frontier[0]
        while len(frontier) and len(left):
            met = np.zeros(len(left), bool)
            for one in frontier:
                rest = np.flatnonzero(~met)
                if not len(rest):
                    break
                met[rest[_linked(left[rest] ^ one, mask)]] = True
            frontier, left = left[met], left[~met]
            a.append(np.full(len(frontier), root))
            b.append(frontier)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _forests(batches):
    """Connecting edges of each bucket, from rows sorted by bucket."""
    import pyarrow as pa

    masks, _ = _chain_masks()
    kept_key = kept_block = kept_fp = None

    def solve(key, block, fp):
        a, b = [], []
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        starts = np.concatenate(([0], cut))
        sizes = np.diff(np.append(starts, len(key)))
        small = np.repeat(sizes <= SMALL_BUCKET, sizes)
        group = np.repeat(np.arange(len(starts)), sizes)
        position = masks[key >> 22]
        for d in range(1, min(SMALL_BUCKET, int(sizes.max()))):
            same = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            same = same[_linked_rows(fp[same] ^ fp[same + d], position[same])]
            a.append(fp[same])
            b.append(fp[same + d])
        for g in np.flatnonzero(sizes > SMALL_BUCKET):
            x, y = bucket_forest(np.unique(fp[starts[g] : starts[g] + sizes[g]]), position[starts[g]])
            a.append(x)
            b.append(y)
        if not a:
            return None
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        both = both[both[:, 0] != both[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"]) if len(both) else None

    def _linked_rows(x, mask):
        ok = np.bitwise_count(x & mask) <= 2 * LIMIT // len(SEGMENTS)
        return ok & (np.bitwise_count(x) <= LIMIT)

    for batch in batches:
        key, block, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = fp.view(np.uint64)
        if kept_key is not None:
            key, block, fp = np.concatenate([kept_key, key]), np.concatenate([kept_block, block]), np.concatenate([kept_fp, fp])
        last = np.flatnonzero((key != key[-1]) | (block != block[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        kept_key, kept_block, kept_fp = key[cut:], block[cut:], fp[cut:]
        if cut and (out := solve(key[:cut], block[:cut], fp[:cut])) is not None:
            yield out
    if kept_key is not None and len(kept_key) > 1 and (out := solve(kept_key, kept_block, kept_fp)) is not None:
        yield out


def links(fps: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints fps (fp) just as their links do, without all pairs."""
    rows = _index(fps).withColumn("block", F.lit(0))
    hot = _hot(fps, block)
    if not hot.isEmpty():
        split = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.least(own, t) * F.lit(1 << 15) + F.greatest(own, t))
        rows = split.select("key", "fp", F.explode(pairs).alias("block"))
    rows = rows.select("key", "block", "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(_forests, EDGES)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, block: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs; component_id is the smallest doc_id reachable."""
    spark = docs.sparkSession
    all_fps, _ = written(fingerprints(docs, shingle, seed), "simhash-fps")
    nodes, _ = written(all_fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    edges, edges_at = written(links(nodes.select("fp"), block).distinct(), "simhash-edges")
    labels = connected_components(edges, "simhash-cc")
    release(spark, edges_at)
    found = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = found.groupBy("label").agg(F.min("rep").alias("component_id"))
    return all_fps.join(found.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """One row of docs for each group of near-duplicates, that of the smallest doc_id, with all columns.

    Of a group's rows that share that doc_id the first in the input stays. Rows without a doc_id
    are kept: nothing can name them.
    """
    return one_of_each(docs, lambda known: near_duplicates(known, **how))


def one_of_each(docs: DataFrame, grouped) -> DataFrame:
    """One row of docs for each component that grouped(rows with doc_id, text) gives as (doc_id, component_id).

    Where doc_ids repeat, rows get numbers of their own and are grouped by those, so texts that
    only share a doc_id are told apart.
    """
    known = docs.where("doc_id IS NOT NULL")
    nameless = docs.where("doc_id IS NULL")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        found, _ = written(grouped(known), "simhash-found")
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
        rows = known.select(F.col("doc_id").cast("long").alias("id"), F.struct(*(known[f"`{x}`"] for x in known.columns)).alias("row"))
        return rows.join(gone, "id", "left_anti").select("row.*").unionByName(nameless)
    rows = known.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("id"), F.struct(*(known[f"`{x}`"] for x in known.columns)).alias("row"))
    rows, _ = written(rows, "simhash-rows")
    found = grouped(rows.select(F.col("uid").alias("doc_id"), F.col("row.text").alias("text"))).withColumnRenamed("doc_id", "uid")
    best = found.join(rows.select("uid", "id"), "uid").groupBy("component_id").agg(F.min(F.struct("id", "uid")).alias("best"))
    kept, _ = written(best.select("best.uid"), "simhash-kept")
    return rows.join(kept, "uid", "left_semi").select("row.*").unionByName(nameless)


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


__all__ = ["bucket_forest", "fingerprint", "fingerprints", "links", "near_duplicates", "op2"]
