"""What the operators share: the shared folder, materialised steps, word hashing and components."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch

#: The bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes written steps that nothing reads any more."""
    for path in paths:
        fs, where = file_system(spark, path)
        fs.delete(where, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def cleaned_up(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends: it has been written and won't be asked for again."""
    return _setting(spark, CLEANUP, "true")


def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Arrow batches of what runs inside hold about size bytes (or one row), in the JVM and in Python, where by default they hold 10,000 texts."""
    return _setting(spark, BATCH_SETTING, str(size))


def written(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """The rows written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with cleaned_up(spark):
        df.write.option("compression", compression).parquet(path)
    schema = df.schema
    del df
    return spark.read.schema(schema).parquet(path), path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its row offsets; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch, limit: int = 1 << 22):
    """Slices of an Arrow batch of about limit bytes of text each (a longer text stands alone)."""
    sizes = np.cumsum([0] + [x or 0 for x in _lengths(batch)])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _lengths(batch) -> list[int]:
    import pyarrow.compute as pc

    return pc.binary_length(batch.column("text")).to_pylist()


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, np.ndarray] = {}
WINDOW = 1 << 21


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def words_of(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (with a last entry: all words); gaps tells the bytes between words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = gaps[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = ~gap
    begins[1:] &= gap[:-1] | first[1:-1]
    ends = ~gap
    ends[:-1] &= gap[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.append(starts[1:], len(data))
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # windows of words, so that memory doesn't depend on the batch
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + WINDOW, "right")))
        own = starts[lo:hi] - starts[lo]
        part = data[starts[lo] : ends[hi - 1]]
        at = np.arange(len(part), dtype=np.int64)
        at -= np.repeat(own, np.diff(np.append(own, len(part))))
        value = _BYTE[part]
        value *= powers(int(_BASE), int(at.max()) + 1)[at]
        out[lo:hi] = mixed(np.add.reduceat(value, own))
        lo = hi
    return out


def gram_hashes(h: np.ndarray, n: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """A hash of every n consecutive word hashes (also across rows: the caller masks those)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), out=total[1:])
    return mixed((total[n:] - total[:-n]) * powers(inverse, len(h) - n + 1))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Label every node of edges (a, b: long) with the smallest node reachable: (node, label).

    Each round maps a node to the first of its neighbours and itself, and contracts the edges. The
    first round goes by number, which settles stars around their smallest node at once; later ones
    go by a hash that is new every time, which halves a path in expectation, so rounds grow with
    its logarithm. Rounds are written to the shared folder; all aggregates combine before the
    shuffle, and joins on a hub are left to skew splitting.
    """
    spark = edges.sparkSession
    edges, at = written(edges.where("a <> b").distinct(), name)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels, labels_at = written(nodes.select("node", F.col("node").alias("label")), name)
    turn = 0
    while not edges.isEmpty():
        order = (lambda x: F.col(x)) if not turn else (lambda x, salt=turn: F.xxhash64(x, F.lit(str(salt))))  # a text is no part of the generated code, which then serves every round
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", order("b")).alias("b"), F.min(order("b")).alias("least"))
        step, step_at = written(first.select("a", F.when(F.col("least") < order("a"), F.col("b")).otherwise(F.col("a")).alias("to")), name)
        one = step.select(F.col("a"), F.col("to").alias("x"))
        two = step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        fewer = edges.join(one, "a").join(two, "b").where("x <> y")
        fewer, next_at = written(fewer.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
        relabelled = labels.join(step.select(F.col("a").alias("label"), "to"), "label", "left")
        relabelled, relabelled_at = written(relabelled.select("node", F.coalesce("to", "label").alias("label")), name)
        release(spark, at, step_at, labels_at)
        edges, at, labels, labels_at, turn = fewer, next_at, relabelled, relabelled_at, turn + 1
    release(spark, at)
    if turn < 2:
        return labels
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    named, _ = written(labels.join(least, "label").select("node", F.col("least").alias("label")), name)
    release(spark, labels_at)
    return named
