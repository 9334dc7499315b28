"""Near copies by shingle similarity: SimHash with pigeonring finds candidates, the shingles themselves decide.

Two texts are near copies when the sets of their runs of five words (lower case; of all words in a
shorter text) have a Jaccard similarity of 0.8 or more. Components of that relation are exact but
for the wide fingerprint test named in step 2:

1. Texts with equal sets are one node with a SimHash of 128 bits. Pigeonring: the bits form a ring of
   six segments, and of two fingerprints within ``NEAR`` = 11 bits some segment starts chains whose
   differences over l segments never exceed l * 11 / 6. Its first segment differs in one bit at most,
   so it is found in an index of segments with one of ``PARTS`` parts masked out (30 keys, where op2's
   one bit would need 128); longer chains and then all bits are tested. What it links is a class.
2. Pairs beyond 11 bits: 0.8 means some 20 of 128 bits, which leaves no segment long enough to index,
   so the pigeonring alone would lose them. In a fixed order of all shingles, two sets of similarity t
   share one of the first n - ceil(t * n) + 1 of each (prefix filter, no loss). Nodes of different
   classes that meet at these are linked if they are of like size and within ``BITS`` of 128 bits.
   At similarity 0.8 about 19 bits differ, with a deviation of 4; unrelated texts differ in 64.
   Links leave a bucket as trees, never all pairs, which keeps the components of the links.
3. Near copies lie in one such component, so each component's texts meet once, and an index of
   their shingles gives the exact similarities. Components beyond ``GROUP_ROWS`` are cut into blocks,
   and every pair of blocks is a group (exact).

Null and empty texts have the empty set and are one node. Rows that share a doc_id are kept apart
by their sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import connected_components, gram_hashes, mixed, pieces, release, small_batches, text_buffer, word_hashes, words_of, written

SHINGLE = 5
LEAST = (4, 5)  # similarity as a fraction
NEAR = 11  # bits: 2 * 6 segments - 1, the most that one masked part finds
PARTS = 5
BITS = 40
SMALL_BUCKET = 24
BUCKET_ROWS = 50_000
GROUP_ROWS = 10_000
PIECE_BYTES = 1 << 20  # of text hashed at once, which takes about forty times that
NODES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("f", T.LongType()), T.StructField("g", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_SECOND = np.uint64(0xA0761D6478BD642F)


def shingle_sets(column, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text of an Arrow column."""
    data, offsets = text_buffer(column)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, _, first = words_of(data, offsets)
    hashes = word_hashes(data, starts)
    grams = gram_hashes(hashes, shingle)
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - s >= shingle:
            out.append(np.unique(grams[s : e - shingle + 1]))
        else:
            out.append(gram_hashes(hashes[s:e], e - s, 0x9FB21C651E98DF25) if e > s else np.zeros(0, np.uint64))
    return out


def set_id(own: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    with np.errstate(over="ignore"):
        return int(mixed((mixed(own ^ _SECOND)).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]) if len(own) else 0


def _majority(h: np.ndarray) -> np.ndarray:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        counts += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0]


def _nodes(shingle: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                ids, n, f, g, keys = [], [], [], [], []
                for own in shingle_sets(part.column("text"), shingle):
                    ids.append(set_id(own))
                    n.append(len(own))
                    f.append(_majority(own))
                    g.append(_majority(mixed(own ^ _SECOND)))
                    keys.append(own[: len(own) - -(-LEAST[0] * len(own) // LEAST[1]) + 1].view(np.int64))
                bounds = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=NODES.names)

    return run


def _like(n, f, g, m, p, q) -> np.ndarray:
    """Whether sizes allow the similarity and fingerprints are near."""
    ok = np.minimum(n, m) * LEAST[1] >= np.maximum(n, m) * LEAST[0]
    return ok & (np.bitwise_count(f ^ p).astype(np.int64) + np.bitwise_count(g ^ q) <= BITS)


def _grouped(batches, width: int):
    """Column arrays of whole groups from batches sorted by their first two columns."""
    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield [x[:cut] for x in now]
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield held


def _bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1, [len(a)]))


def _chains() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of both words (length, index position) of the chains from the segment of each of the 128 positions, and how many of them may differ."""
    parts = simhash.ring(("f", "g"))
    f, g = np.zeros((2, len(parts), 128), np.uint64)
    for i, (_, _, width, first) in enumerate(parts):
        for long in range(len(parts)):
            for word, lo, w, _ in (parts[(i + k) % len(parts)] for k in range(long + 1)):
                (f if word == "f" else g)[long, first : first + width] |= np.uint64(((1 << w) - 1) << lo)
    return f, g, NEAR * np.arange(1, len(parts) + 1) // len(parts)


def _ringed(f, g, p, q, start, chains) -> np.ndarray:
    """Whether every chain from the segment of an index position (one, or one a pair) is within its bounds; the last is the whole ring."""
    x, y = f ^ p, g ^ q
    at = np.arange(len(x))
    for one, two, most in zip(*chains, strict=True):
        begins = start if np.ndim(start) == 0 else start[at]
        at = at[np.bitwise_count(x[at] & one[begins]).astype(np.int64) + np.bitwise_count(y[at] & two[begins]) <= most]
    ok = np.zeros(len(x), bool)
    ok[at] = True
    return ok


def _edges(a: list, b: list):
    """A batch of the distinct links of a bucket's lists; None if there are none."""
    import pyarrow as pa

    if not a:
        return None
    a, b = np.concatenate(a), np.concatenate(b)
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    both = both[both[:, 0] != both[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"]) if len(both) else None


def _rings(batches):
    """Connecting links within NEAR bits of each bucket (key, block, node, f, g) of the pigeonring's index."""
    chains = _chains()
    for key, block, node, f, g in _grouped(batches, 5):
        f, g = f.view(np.uint64), g.view(np.uint64)
        bounds = _bounds(key, block)
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat(sizes <= SMALL_BUCKET, sizes)
        start = key >> 22
        a, b = [], []
        for d in range(1, min(SMALL_BUCKET, int(sizes.max()))):
            at = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            at = at[_ringed(f[at], g[at], f[at + d], g[at + d], start[at], chains)]
            a.append(node[at])
            b.append(node[at + d])
        for k in np.flatnonzero(sizes > SMALL_BUCKET):
            left = np.arange(bounds[k], bounds[k + 1])
            while len(left) > 1:
                root, frontier, left = left[0], [left[0]], left[1:]
                while frontier and len(left):
                    one = frontier.pop()
                    ok = _ringed(f[left], g[left], f[one], g[one], start[one], chains)
                    a.append(np.full(int(ok.sum()), node[root]))  # a star: this says connected, not within the limit
                    b.append(node[left[ok]])
                    frontier.extend(left[ok].tolist())
                    left = left[~ok]
        if (found := _edges(a, b)) is not None:
            yield found


def _met(batches):
    """Connecting links between the classes of each bucket (key, block, class, n, f, g)."""
    for key, block, own, n, f, g in _grouped(batches, 6):
        n, f, g = n.astype(np.int64), f.view(np.uint64), g.view(np.uint64)  # bits of negative numbers are counted without sign
        bounds = _bounds(key, block)
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat(sizes <= SMALL_BUCKET, sizes)
        a, b = [], []
        for d in range(1, min(SMALL_BUCKET, int(sizes.max()))):
            at = np.flatnonzero((group[d:] == group[:-d]) & small[d:] & (own[d:] != own[:-d]))
            at = at[_like(n[at], f[at], g[at], n[at + d], f[at + d], g[at + d])]
            a.append(own[at])
            b.append(own[at + d])
        for k in np.flatnonzero(sizes > SMALL_BUCKET):
            left = np.arange(bounds[k], bounds[k + 1])
            while len(left) > 1:
                peers = own[left] == own[left[0]]  # members of a class need no link
                frontier, left = left[peers].tolist(), left[~peers]
                while frontier and len(left):
                    one = frontier.pop()
                    ok = _like(n[left], f[left], g[left], n[one], f[one], g[one])
                    if ok.any():
                        met = np.unique(own[left[ok]])
                        a.append(np.full(len(met), own[one]))
                        b.append(met)
                        ok = np.isin(own[left], met)
                        frontier.extend(left[ok].tolist())
                        left = left[~ok]
        if (found := _edges(a, b)) is not None:
            yield found


def exact_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect just the sets that similarity LEAST connects."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out, left, frontier, indexed = [], np.arange(len(sets)), [], 0
    while len(left):
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
            continue
        if not indexed or 2 * len(left) < indexed:  # an index of the sets not yet reached
            indexed = len(left)
            values = np.concatenate([sets[i] for i in left])
            owners = np.repeat(left, sizes[left])
            order = np.argsort(values, kind="stable")
            values, owners = values[order], owners[order]
        one = frontier.pop()
        lo, hi = np.searchsorted(values, sets[one], "left"), np.searchsorted(values, sets[one], "right")
        width = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(int(width.sum()))
        shared = np.bincount(owners[at], minlength=len(sets))[left]
        ok = shared * LEAST[1] >= LEAST[0] * (sizes[one] + sizes[left] - shared)
        out += [(one, int(i)) for i in left[ok]]
        frontier.extend(left[ok].tolist())
        left = left[~ok]
    return out


def _verified(shingle: int):
    def run(batches):
        import pyarrow as pa

        for label, block, node, text in _grouped(batches, 4):
            bounds = _bounds(label, block)
            a, b = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = {}
                for lo in range(s, e, 500):
                    hi = min(e, lo + 500)
                    for i, found in zip(node[lo:hi].tolist(), shingle_sets(pa.array(text[lo:hi], pa.large_string()), shingle), strict=True):
                        if set_id(found) == i:  # else another row of the same doc_id
                            own[i] = found
                ids = list(own)
                for x, y in exact_forest([own[i] for i in ids]):
                    a.append(ids[x])
                    b.append(ids[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _in_blocks(rows: DataFrame, blocks, by) -> DataFrame:
    """Adds block: every pair of the blocks that a row is in."""
    own = F.pmod(F.xxhash64(by), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda t: F.least(own, t) * F.lit(1 << 15) + F.greatest(own, t))
    return rows.withColumn("block", F.explode(pairs.cast("array<int>")))


def _dealt(rows: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """Rows (key, node, ..) by key and block: keys of hot (key, blocks) are cut into pairs of blocks."""
    hot, _ = written(hot, name)
    if hot.isEmpty():
        rows = rows.withColumn("block", F.lit(0))
    else:
        rows = _in_blocks(rows.join(hot, "key", "left"), F.coalesce("blocks", F.lit(1)), "node")
    return rows


def _sorted(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "block").sortWithinPartitions("key", "block")


def ring_links(fps: DataFrame, bucket: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) that connect nodes fps (node, f, g) just as the pairs within NEAR bits do, by the pigeonring."""
    rows = simhash._index(fps, ("f", "g"), PARTS)
    hot = rows.groupBy("key").count().where(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).cast("int").alias("blocks"))
    return _sorted(_dealt(rows, hot, "similar-ring-hot").select("key", "block", "node", "f", "g")).mapInArrow(_rings, EDGES)


def _met_links(nodes: DataFrame, bucket: int) -> DataFrame:
    """Edges between classes of nodes (node, class, n, f, g, keys) that meet at keys."""
    rows = nodes.select(F.explode("keys").alias("key"), "node", "class", "n", "f", "g")
    # keys shared by many nodes, from every 16th node: only how work is dealt depends on it
    hot = nodes.where("pmod(node, 16) = 0").select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") * 16 > bucket)
    rows = _dealt(rows, hot.select("key", F.ceil(F.col("count") * 16 / bucket).cast("int").alias("blocks")), "similar-hot")
    return _sorted(rows.select("key", "block", "class", "n", "f", "g")).mapInArrow(_met, EDGES)


def candidates(rows: DataFrame, reps: DataFrame, bucket: int) -> DataFrame:
    """(node, label) of nodes that have a candidate: classes of the pigeonring, joined where their members meet at keys.

    rows: (doc_id, node, n, f, g, keys); reps: (node, rep), the doc_id whose row stands for a node.
    """
    spark = rows.sparkSession
    fps, _ = written(rows.drop("keys").join(reps, "node").where("doc_id = rep").select("node", "f", "g").dropDuplicates(["node"]), "similar-fps")
    links, links_at = written(ring_links(fps, bucket), "similar-ring")
    classes = connected_components(links, "similar-classes").withColumnRenamed("label", "class")
    release(spark, links_at)
    own = reps.join(classes, "node", "left").select(F.col("node").alias("id"), "rep", F.coalesce("class", "node").alias("class"))
    nodes = rows.join(own, (rows["node"] == own["id"]) & (rows["doc_id"] == own["rep"])).select("node", "class", "n", "f", "g", "keys")
    links, links_at = written(_met_links(nodes, bucket), "similar-links")
    joined = connected_components(links, "similar-candidates").withColumnRenamed("node", "class")
    release(spark, links_at)
    alone = joined.join(classes.select(F.col("node").alias("class")), "class", "left_anti").select(F.col("class").alias("node"), "label")
    return classes.join(joined, "class", "left").select("node", F.coalesce("label", "class").alias("label")).union(alone)


def components(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET_ROWS, group: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, component_id) of every row of docs (doc_id, text); component_id is the smallest doc_id reachable."""
    with small_batches(docs.sparkSession):
        return _components(docs, shingle, bucket, group)


def _components(docs: DataFrame, shingle: int, bucket: int, group: int) -> DataFrame:
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows, _ = written(texts.mapInArrow(_nodes(shingle), NODES), "similar-rows")
    reps, _ = written(rows.groupBy("node").agg(F.min("doc_id").alias("rep")), "similar-reps")
    labels, _ = written(candidates(rows, reps, bucket), "similar-labels")
    sizes = labels.groupBy("label").count().select("label", F.ceil(F.col("count") / group).cast("int").alias("blocks"))
    members = labels.join(sizes, "label").join(reps, "node").select("label", "node", "rep", "blocks")
    members, _ = written(members, "similar-members")
    grouped = _in_blocks(members.where("blocks > 1"), F.col("blocks"), "node").select("label", "block", "node", "rep")
    grouped = grouped.union(members.where("blocks = 1").select("label", F.lit(0).alias("block"), "node", "rep"))
    met = grouped.join(texts, grouped["rep"] == texts["doc_id"]).select("label", "block", "node", "text")
    edges, _ = written(met.repartition(n, "label", "block").sortWithinPartitions("label", "block").mapInArrow(_verified(shingle), EDGES), "similar-edges")
    exact = connected_components(edges, "similar-cc")
    found = reps.join(exact, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = found.groupBy("label").agg(F.min("rep").alias("component_id"))
    return rows.select("doc_id", "node").join(found.join(least, "label").select("node", "component_id"), "node").select("doc_id", "component_id")
