"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gets a block in every window [floor(j / w), ceil((j + 1) / w)): the
window's start is block j's release time, its end the deadline. Earliest deadline first over
the released blocks fills one slot after another, and at every slot each source has had less
than one block more or less than its weight's share. When a source has no block left, either
the mix ends (``exhausted="stop"``: what is left over would break the weights) or the others
go on with weights scaled up, in a new phase (``"continue"``: every row gets a place).

The schedule is over blocks of ``BLOCK_ROWS`` documents, known from the counts of the sources
alone. It repeats after as many slots as the weights add up to, so the driver makes at most one
such period (about ``UNIT`` slots) of each phase, whatever the rows, and tasks repeat it. Rows find their block by rank within their source in
the order of a hash of doc_id: rows are counted in cells of about ``CELL_ROWS`` hash-adjacent
rows, so a source with a third of all rows is ranked by as many tasks as it has cells.

Null sources are a source of their own. Null and empty texts count like others: only doc_id
and source matter. Rows that share a doc_id get places of their own in no set order among
them. An empty table gives an empty mix. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, written

BLOCK_ROWS = 64
CELL_ROWS = 1024
POWER = 0.7
MAX_BROADCAST_SOURCES = 50_000
UNIT = 1_000_000
SLOTS = T.StructType([T.StructField(x, T.StringType() if x == "key" else T.LongType()) for x in ("key", "block", "release", "deadline", "slot", "phase", "cycles", "step", "span")])


def target_weights(counts: dict[str, int], power: float = POWER) -> dict[str, int]:
    """Whole-number weights in proportion to a power of the counts."""
    whole = sum(n**power for n in counts.values())
    return {key: max(1, round(UNIT * n**power / whole)) for key, n in counts.items()}


def pfair(weights: dict[str, int], blocks: dict[str, int], exhausted: str = "continue") -> dict[str, np.ndarray]:
    """Slots of the blocks 0.. of every source with a weight, by earliest deadline first within Pfair windows.

    After as many slots as the weights add up to, every source has had its weight in blocks and
    the schedule starts again. So at most one such period is worked out in a phase: an entry
    stands for ``cycles`` blocks, each ``step`` blocks and ``span`` slots after the one before.
    """
    left = {k: n for k, n in blocks.items() if n > 0 and weights.get(k, 0) > 0}
    out: dict[str, list] = {x: [] for x in SLOTS.names}
    done = dict.fromkeys(left, 0)
    start = phase = 0
    while left:
        keys = sorted(left)
        total = sum(weights[k] for k in keys)
        cycles = max(0, min(left[k] // weights[k] for k in keys) - 1)  # whole periods before a source can end
        for whole in (True, False) if cycles else (False,):
            slots = _period(keys, weights, left, total, None if whole else exhausted)
            for i, count, release, deadline, slot in slots:
                key = keys[i]
                row = (key, done[key] + count, start + release, start + deadline, start + slot, phase, cycles if whole else 1, weights[key], total)
                for name, value in zip(SLOTS.names, row, strict=True):
                    out[name].append(value)
            had = Counter(keys[s[0]] for s in slots)
            for key in keys:
                n = had[key] * (cycles if whole else 1)
                done[key] += n
                left[key] -= n
            start += cycles * total if whole else len(slots)
        left = {k: n for k, n in left.items() if n}
        phase += 1
        if exhausted == "stop":
            break
    return {x: np.array(v, object if x == "key" else np.int64) for x, v in out.items()}


def _period(keys: list[str], weights: dict[str, int], left: dict[str, int], total: int, exhausted: str | None) -> list[tuple[int, int, int, int, int]]:
    """(source, its count so far, release, deadline, slot) of one period, or until a source ends where exhausted says what happens then."""
    left = dict(left)
    waiting = [(0, i) for i in range(len(keys))]
    placed, ready, slot, end, out = [0] * len(keys), [], 0, total if exhausted is None else None, []
    while end is None or slot < end:
        while waiting and waiting[0][0] <= slot:
            release, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(placed[i] + 1) * total // weights[keys[i]]), i, release))
        if not ready:  # only after a source has ended: the rest is ahead of its share
            break
        deadline, i, release = heapq.heappop(ready)
        key = keys[i]
        out.append((i, placed[i], release, deadline, slot))
        placed[i] += 1
        left[key] -= 1
        slot += 1
        if left[key]:
            heapq.heappush(waiting, (placed[i] * total // weights[key], i))
        else:
            missing = -(-(placed[i] + 1) * total // weights[key]) - 1 if exhausted == "stop" else slot
            end = missing if end is None else min(end, missing)
    return out


def source_key(column="source"):
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(column).cast("string")))


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, exhausted: str = "continue", block_rows: int = BLOCK_ROWS, power: float = POWER) -> DataFrame:
    """(doc_id, source, block, place, release, deadline, slot, phase) of the rows of docs that are mixed.

    weights: by source; without them, a power of the counts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), source_key().alias("key"))
    counts = dict(rows.groupBy("key").count().collect())
    if weights is None:
        own = target_weights(counts, power)
    else:
        own = {"-" if k is None else f"+{k}": w for k, w in weights.items()}
    schedule = pfair(own, {k: -(-n // block_rows) for k, n in counts.items()}, exhausted)
    import pyarrow as pa

    slots = spark.createDataFrame(pa.table({x: pa.array(v.tolist(), pa.string() if x == "key" else pa.int64()) for x, v in schedule.items()})) if len(schedule["key"]) else spark.createDataFrame([], SLOTS)
    if (schedule["cycles"] > 1).any():
        again = slots.withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cycles") - 1)))
        slots = again.select("key", (F.col("block") + F.col("again") * F.col("step")).alias("block"), *((F.col(x) + F.col("again") * F.col("span")).alias(x) for x in ("release", "deadline", "slot")), "phase")
    sizes = spark.createDataFrame([(k, -(-n // CELL_ROWS)) for k, n in sorted(counts.items())], "key string, cells long")
    if len(counts) <= MAX_BROADCAST_SOURCES:  # a row for each source: else a join that splits skew
        sizes = F.broadcast(sizes)
    h = F.xxhash64("doc_id")
    celled = rows.join(sizes, "key").withColumn("h", h).withColumn("cell", F.floor((F.shiftrightunsigned("h", 32) * F.col("cells")) / F.lit(1 << 32)).cast("long")).drop("cells")
    within = celled.groupBy("key", "cell").count()
    before = within.select("key", "cell", (F.sum("count").over(Window.partitionBy("key").orderBy("cell")) - F.col("count")).alias("before"))
    order = Window.partitionBy("key", "cell").orderBy(F.shiftrightunsigned("h", 1), "doc_id")
    ranked = celled.withColumn("own", F.row_number().over(order) - 1).join(before, ["key", "cell"]).withColumn("rank", F.col("before") + F.col("own"))
    placed = ranked.withColumn("block", F.floor(F.col("rank") / block_rows).cast("long")).withColumn("place", (F.col("rank") % block_rows).cast("int"))
    return placed.join(slots, ["key", "block"]).select("doc_id", "source", "block", "place", "release", "deadline", "slot", "phase")


def mixed(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS, power: float = POWER, exhausted: str = "stop") -> DataFrame:
    """The rows of docs in the order of the mix, with all columns; with "stop" those that fit the target weights before a source ends.

    Rows that share a doc_id stay or go together.
    """
    spark = docs.sparkSession
    placed = mix(docs, weights, exhausted, block_rows, power).groupBy("doc_id").agg(F.min(F.struct("slot", "place")).alias("at"))
    placed, _ = written(placed, "mix")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*(docs[f"`{x}`"] for x in docs.columns)).alias("row"))
    joined = rows.join(placed, rows["id"].eqNullSafe(placed["doc_id"])).select("row", "at")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartitionByRange(n, "at").sortWithinPartitions("at").select("row.*")


def op4(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
