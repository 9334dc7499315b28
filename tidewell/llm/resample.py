"""Target-distribution importance resampling with hashed word features.

Two passes over the texts, both in Arrow batches and without a shuffle. The first counts features
by bucket: every partition gives one vector of ``BUCKETS`` counts (``np.bincount``), and
``treeReduce`` adds the vectors up, so neither the driver nor a task holds more than a few of
them. A bucket's gain is the logarithm of its smoothed share among the target texts over its
share among all documents, in floored thousandths. The second pass broadcasts the gains (one
vector of fixed length), gathers them by bucket and sums them by document (``np.bincount`` with
weights). Gumbel noise from a hash of doc_id is added, and the highest scores are drawn, which is
sampling without replacement in proportion to the weights.

The drawing needs no global sort of all documents: a histogram of the whole-number scores
(their range is bounded by the gains and the noise, some 10^5 values) gives the lowest score
drawn, and only documents from there on are sorted, in ranges of (score, doc_id), so that no
score or doc_id gathers in a task.

A null or empty text has no features, weight 0 and is never drawn. A null doc_id counts as an
empty one in the noise and loses ties. Rows that share a doc_id are scored and ranked each by
themselves; ties among them are broken arbitrarily. With an empty table nothing is drawn; empty
targets give gains from the smoothing alone. Extra columns are ignored by ``importance`` and
kept by ``resampled``, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, pieces, text_buffer, words_of, written

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bytes of a feature that are hashed side by side; what is longer is hashed alone.
SHORT = 24

_AT = np.arange(256)
#: What is not in a word: ASCII but digits and lower-case letters.
GAP = (_AT < 0x80) & ~((_AT >= 0x30) & (_AT <= 0x39)) & ~((_AT >= 0x61) & (_AT <= 0x7A))
WEIGHED = T.StructType([T.StructField(x, T.LongType()) for x in ("doc_id", "n_words", "n_features", "weight")])


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    live = np.arange(len(starts))
    for k in range(SHORT):
        live = live[size[live] > k]
        if not len(live):
            break
        now = out[live]
        out[live] = _CRC[(now ^ data[starts[live] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def features(column, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature of an Arrow text column, and each row's number of words."""
    data, offsets = text_buffer(column)
    data = data + np.where((data >= 0x41) & (data <= 0x5A), np.uint8(0x20), np.uint8(0))
    starts, ends, first = words_of(data, offsets, GAP)
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(n_words)), n_words)
    if longest == 1:
        return row, crcs(data, starts, ends) % np.uint32(buckets), n_words
    size = ends - starts  # words with one space behind each, so that a run is one stretch of bytes
    begin = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(begin, size) + within] = data[np.repeat(starts, size) + within]
    rows, found = [], []
    for n in range(1, longest + 1):
        whole = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        rows.append(row[whole])
        found.append(crcs(joined, begin[whole], begin[whole + n - 1] + size[whole + n - 1]) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found), n_words


def _count(buckets: int, longest: int):
    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                total += np.bincount(features(piece.column("text"), buckets, longest)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts (text) fall into each bucket."""
    vectors = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(buckets, longest), "counts binary").rdd
    n = vectors.getNumPartitions()
    if not n:
        return np.zeros(buckets, np.int64)
    depth = max(2, math.ceil(math.log(n, 64)))  # so that a task adds up some 64 vectors
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add, depth)


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """Floored thousandths of the logarithm of each bucket's smoothed share in the target over that in all."""
    buckets = len(all_counts)
    whole, aim = float(all_counts.sum() + buckets), float(target_counts.sum() + buckets)
    pairs = zip(all_counts.tolist(), target_counts.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * aim))) for s, t in pairs], np.int64)


def _weigh(broadcast, longest: int):
    def run(batches):
        import pyarrow as pa

        gain = broadcast.value
        for batch in batches:
            for piece in pieces(batch):
                row, bucket, n_words = features(piece.column("text"), len(gain), longest)
                n = np.bincount(row, minlength=piece.num_rows)
                total = np.bincount(row, weights=gain[bucket], minlength=piece.num_rows).astype(np.int64)
                columns = [piece.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_words, n, total // np.maximum(n, 1)))]
                yield pa.RecordBatch.from_arrays(columns, names=WEIGHED.names)

    return run


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of docs (doc_id, text)."""
    broadcast = docs.sparkSession.sparkContext.broadcast(gain)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(_weigh(broadcast, longest), WEIGHED)


def noise(doc_id: str | Column = "doc_id", seed: int = SEED) -> Column:
    """Floored thousandths of Gumbel noise, from a hash of the seed and doc_id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _lowest(scores: DataFrame, percent: int) -> tuple[int, int | None]:
    """How many rows of scores (score) are drawn, and the lowest score among them."""
    histogram = np.array(scores.groupBy("score").count().collect(), np.int64).reshape(-1, 2)  # bounded by the range of scores
    histogram = histogram[np.argsort(-histogram[:, 0])]
    n = int(histogram[:, 1].sum()) * percent // 100
    return n, int(histogram[np.searchsorted(np.cumsum(histogram[:, 1]), n), 0]) if n else None


def _placed(batches):
    """Rows with their partition and place in it."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        places = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n, dtype=np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *places], names=[*batch.schema.names, "part", "at"])
        at += n


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows of scored (row, doc_id, n_words, score) with rank, from 1 by descending score and then doc_id; null where not drawn."""
    spark = scored.sparkSession
    able = F.col("n_words") >= least_words
    n, lowest = _lowest(scored.where(able).select("score"), percent)
    none = F.lit(None).cast("long")
    if not n:
        return scored.withColumn("rank", none)
    near = able & (F.col("score") >= lowest)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.where(near).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = T.StructType([*scored.schema.fields, T.StructField("part", T.LongType()), T.StructField("at", T.LongType())])
    placed, _ = written(dealt.mapInArrow(_placed, kind), "resample-placed")
    before, rows = [], 0
    for part, count in sorted(placed.groupBy("part").count().collect()):  # one row a partition
        before.append((part, rows))
        rows += count
    starts = spark.createDataFrame(before, "part long, before long")
    drawn = placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("at") + 1)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return scored.where(~near).withColumn("rank", none).unionByName(drawn.select(*scored.columns, "rank"))


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text), against the texts of target (text)."""
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = weights(docs, gain, longest).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored, _ = written(scored.withColumn("row", F.monotonically_increasing_id()), "resample-scored")
    return ranked(scored, percent, least_words).drop("row")


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of docs with all their columns; rows that share a doc_id stay if one of them is drawn, those without one go."""
    drawn = importance(docs, target, **how).where("rank IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*(docs[f"`{x}`"] for x in docs.columns)).alias("row"))
    return rows.join(drawn, "id", "left_semi").select("row.*")


def op11(spark, sf_dir: str) -> DataFrame:
    found = importance(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE11 = """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
), texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark
), words AS (
  SELECT side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS word FROM texts
), own AS (
  SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL
), vocabulary AS (
  SELECT word, hex(word) AS x FROM (SELECT DISTINCT word FROM own)
), buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::UBIGINT)), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM vocabulary, crc_table
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM own JOIN buckets USING (word) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) + 10000 AS s_all, coalesce(sum(t), 0) + 10000 AS t_all FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * s_all / ((s + 1) * t_all)))::BIGINT AS gain FROM counts, totals
), weighed AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS total FROM own JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT AS h
  FROM documents LEFT JOIN weighed USING (doc_id)
), full_scores AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM full_scores WHERE n_features >= 20
)
SELECT f.doc_id, f.n_features, f.weight, f.score, p.place::BIGINT AS rank
FROM full_scores f LEFT JOIN placed p ON f.doc_id = p.doc_id AND p.place <= 10 * p.n // 100
"""
