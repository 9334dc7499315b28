"""A word index beside the listings: immutable segments of sorted postings, and bitmaps of what is gone.

A batch of new and changed listings becomes a segment: Parquet files of (word, id) in ranges of
words, sorted, so that a prefix reads the row groups and pages of its range alone. Its changed and deleted
ids go into bitmaps, a row for every 32,768 ids, which count against the segments before it; nothing is
rewritten. A search looks its prefixes up in every segment, leaves out what a bitmap names and
keeps the ids that have all of its words.

Segments of about one size are merged when ``SAME`` of them have gathered, without what is gone, so
their number grows with the logarithm of the listings. Which segments and bitmaps count is told by
a version file that is written by one rename; readers of an older version go on undisturbed until ``vacuum``.
A batch that is added again changes nothing.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import versions
from .filters import SEARCHED, search, tokens

SAME = 4
WORDS, GONE = "word string, id long", "bucket long, bits binary"
LAST = "\U0010ffff"


def postings(opps: DataFrame) -> DataFrame:
    """(word, id): every word of the searched columns, lower case and without accents, once."""
    words = tokens(F.concat_ws(" ", *SEARCHED))
    return opps.select("id", F.explode(F.array_distinct(words)).alias("word")).where("word <> ''").select("word", "id")


def bitmaps(ids: DataFrame) -> DataFrame:
    """(bucket, bits) of ids (id)."""
    place = ids.select(F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit"))
    return place.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _in(bits: str, column: str) -> Column:
    """Whether a bitmap holds an id."""
    at = F.bitmap_bit_position(column)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def _state(spark: SparkSession, index: str) -> tuple[int, int, list[dict]]:
    version, value = versions.newest(spark, f"{index}/versions")
    return version, value.get("batch", -1), value.get("segments", [])


def _commit(spark: SparkSession, index: str, version: int, batch: int, segments: list[dict]) -> None:
    if not versions.put(spark, f"{index}/versions", version + 1, {"batch": batch, "segments": segments}):
        raise RuntimeError(f"another writer has changed the index {index}")


def _segment(index: str, rows: DataFrame) -> dict:
    """Writes postings as a segment; rows is how many it has."""
    spark, at = rows.sparkSession, f"{index}/segments/{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "word").sortWithinPartitions("word", "id").write.parquet(at)
    return {"path": at, "rows": spark.read.schema(WORDS).parquet(at).count(), "gone": []}


def add_batch(index: str, batch: int, changed: DataFrame, deleted: DataFrame | None = None) -> None:
    """Adds the postings of new and changed listings, in place of what the index holds of them and of deleted ids; batches count upwards."""
    spark = changed.sparkSession
    version, last, segments = _state(spark, index)
    if batch <= last:
        return
    if segments:
        gone, at = changed.select("id"), f"{index}/gone/{uuid.uuid4().hex}"
        bitmaps(gone if deleted is None else gone.union(deleted.select("id"))).write.parquet(at)
        segments = [s | {"gone": [*s["gone"], at]} for s in segments]
    _commit(spark, index, version, batch, _merged(spark, index, [*segments, _segment(index, postings(changed))]))


def _merged(spark: SparkSession, index: str, segments: list[dict]) -> list[dict]:
    """The segments, those of one size merged where there are SAME of them, from small to large."""
    while True:
        sizes: dict[int, list[dict]] = {}
        for s in segments:
            sizes.setdefault((max(1, s["rows"]).bit_length() + 1) // 2, []).append(s)
        full = next((own for _, own in sorted(sizes.items()) if len(own) >= SAME), None)
        if full is None:
            return segments
        one = _segment(index, reduce(DataFrame.union, [_alive(spark, s) for s in full]))
        segments = [*(s for s in segments if s not in full), one]


def merge(spark: SparkSession, index: str) -> None:
    """Merges all segments into one, without what is gone."""
    version, batch, segments = _state(spark, index)
    if len(segments) > 1 or any(s["gone"] for s in segments):
        _commit(spark, index, version, batch, [_segment(index, reduce(DataFrame.union, [_alive(spark, s) for s in segments]))])


def vacuum(spark: SparkSession, index: str) -> None:
    """Deletes segments, bitmaps and versions that the newest version doesn't name; nobody may be reading them."""
    version, _, segments = _state(spark, index)
    kept = {s["path"] for s in segments} | {x for s in segments for x in s["gone"]}
    for kind in ("segments", "gone"):
        for name in versions.names(spark, f"{index}/{kind}"):
            if f"{index}/{kind}/{name}" not in kept:
                versions.remove(spark, f"{index}/{kind}/{name}")
    for name in versions.names(spark, f"{index}/versions"):
        if name != f"{version:012d}.json":
            versions.remove(spark, f"{index}/versions/{name}")


def _alive(spark: SparkSession, segment: dict, test: Column | None = None) -> DataFrame:
    """(word, id) of a segment that meet a test and are not gone."""
    rows = spark.read.schema(WORDS).parquet(segment["path"])
    rows = rows if test is None else rows.where(test)
    if not segment["gone"]:
        return rows
    gone = spark.read.schema(GONE).parquet(*segment["gone"]).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    marked = rows.withColumn("bucket", F.bitmap_bucket_number("id")).join(gone, "bucket", "left")
    return marked.where(F.col("bits").isNull() | ~_in("bits", "id")).select("word", "id")


def live(spark: SparkSession, index: str) -> DataFrame:
    """(word, id) that count."""
    segments = _state(spark, index)[2]
    return reduce(DataFrame.union, [_alive(spark, s) for s in segments]) if segments else spark.createDataFrame([], WORDS)


def prefixes(text: str) -> list[str]:
    """The beginnings of words that a search asks for: the last part of each of its first six words; none where one has no letter or figure."""
    found = []
    for word in text.split()[:6]:
        plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
        parts = [p for p in re.split(r"[\W_]+", plain) if p]
        if not parts:
            return []
        found.append(parts[-1])
    return found


def candidates(spark: SparkSession, index: str, text: str) -> DataFrame:
    """(id) of listings that hold, for each word of a search, a word that begins with its last part."""
    asked, segments = list(dict.fromkeys(prefixes(text))), _state(spark, index)[2]
    if not asked or not segments:
        return spark.createDataFrame([], "id long")
    word = F.col("word")
    near = reduce(lambda a, b: a | b, [(word >= p) & (word <= p + LAST) for p in asked])
    mask = reduce(lambda a, b: a + b, [F.when(word.startswith(p), 1 << i).otherwise(0) for i, p in enumerate(asked)])
    found = reduce(DataFrame.union, [_alive(spark, s, near) for s in segments])
    whole = found.groupBy("id").agg(F.bit_or(mask).alias("has"))
    return whole.where(F.col("has") == (1 << len(asked)) - 1).select("id")


def narrowed(opps: DataFrame, index: str, text: str) -> DataFrame:
    """The listings that a search can find, by the index; all of them where it has no words to look up, as a quoted text."""
    if '"' in text or not text.strip():
        return opps
    return opps.join(candidates(opps.sparkSession, index, text), "id", "left_semi")


def searched(opps: DataFrame, index: str, text: str) -> DataFrame:
    """Listings that a search finds."""
    return narrowed(opps, index, text).where(search(text))


def stray(opps: DataFrame, index: str) -> DataFrame:
    """Ids that the index and the listings disagree on: to be added again or taken out."""
    spark = opps.sparkSession
    indexed = live(spark, index).select("id").distinct()
    real = postings(opps).select("id").distinct()
    missing, extra = real.join(indexed, "id", "left_anti"), indexed.join(real, "id", "left_anti")
    return missing.withColumn("why", F.lit("missing")).union(extra.withColumn("why", F.lit("extra")))
